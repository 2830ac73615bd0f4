"""A page's text out of its HTML: title, description, visible text, and how far the extraction went."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .health import wall

#: Elements whose content isn't the page's text; elements that end a line; named references that are read.
SILENT = ("script", "style", "noscript", "template", "svg", "head", "nav", "header", "footer", "aside", "form")
BREAKS = "(?i)<(?:br|/p|/div|/li|/h[1-6]|/tr|/section|/article|/blockquote|/pre|/ul|/ol|/table)[^>]*>"
REFERENCES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))
DESCRIPTION = "(?is)<meta\\s[^>]*?(?:name|property)\\s*=\\s*[\"'](?:description|og:description)[\"'][^>]*?content\\s*=\\s*[\"'](.*?)[\"']"
REVERSED = "(?is)<meta\\s[^>]*?content\\s*=\\s*[\"'](.*?)[\"'][^>]*?(?:name|property)\\s*=\\s*[\"'](?:description|og:description)[\"']"
USEFUL = 200


def unescape(text: Column) -> Column:
    """Named references to characters; the ampersand's last, so that nothing is read twice."""
    for name, char in REFERENCES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def clean(text: Column) -> Column:
    """White space collapsed in lines, lines trimmed, at most one empty line in a row."""
    text = F.regexp_replace(F.regexp_replace(text, "\\r\\n?", "\n"), "[ \\t\\x{00A0}]+", " ")
    lines = F.array_join(F.transform(F.split(text, "\n"), lambda x: F.btrim(x)), "\n")
    return F.btrim(F.regexp_replace(lines, "\\n{3,}", "\n\n"), F.lit(" \n"))


def strip_tags(html: Column) -> Column:
    return F.btrim(unescape(F.regexp_replace(html, "<[^>]+>", " ")))


def title(html: Column) -> Column:
    return F.regexp_replace(strip_tags(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1)), "[ \\t\\x{00A0}]+", " ")


def description(html: Column) -> Column:
    first = F.regexp_extract(html, DESCRIPTION, 1)
    return strip_tags(F.when(html.rlike(DESCRIPTION), first).otherwise(F.regexp_extract(html, REVERSED, 1)))


def visible(html: Column) -> Column:
    for tag in SILENT:
        html = F.regexp_replace(html, f"(?is)<{tag}[\\s>].*?</{tag}\\s*>", " ")
    return clean(unescape(F.regexp_replace(F.regexp_replace(html, BREAKS, "\n"), "<[^>]+>", " ")))


def extracted(html: Column) -> dict[str, Column]:
    """title, text, tier (body, metadata or none), walled and usable: the longer of the visible text and title with description counts
    where the visible text is short."""
    html = F.coalesce(html, F.lit(""))
    body, name, about = visible(html), title(html), description(html)
    meta = clean(F.concat_ws("\n", F.nullif(name, F.lit("")), F.nullif(about, F.lit(""))))
    use_body = (F.length(body) >= USEFUL) | (F.length(body) > F.length(meta))
    text = F.when(use_body, body).otherwise(meta)
    walled = wall(html, text)
    tier = F.when(use_body, "body").when(meta != "", "metadata").otherwise("none")
    return {"title": name, "text": text, "tier": tier, "walled": walled, "usable": (F.length(text) >= USEFUL) & ~walled}
