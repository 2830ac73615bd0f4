"""Column builders: URLs, hosts, texts, timestamps. Pure expressions, so they stay in the scan's stage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Second-level labels under which a registration has three labels.
TWO_LEVEL = (
    "co", "com", "net", "org", "gov", "edu", "ac", "or", "ne", "go", "in", "id", "web", "sch", "res", "mil", "info", "biz", "gen", "ltd", "plc", "me", "nom", "firm", "store", "art", "adm",
)


def host_of(url: Column) -> Column:
    """The host in lower case without port; empty if there is none."""
    return F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))


def registrable_domain(host: Column) -> Column:
    """The last two labels, or three under a two-level suffix; addresses and short hosts as they are."""
    labels = F.split(host, "[.]")
    n = F.size(labels)
    last = lambda k: F.array_join(F.slice(labels, n - k + 1, k), ".")
    plain = (n <= 2) | host.rlike("^[0-9.]*$")
    return F.when(plain, host).when(F.get(labels, n - 2).isin(*TWO_LEVEL), last(F.lit(3))).otherwise(last(F.lit(2)))


def head_tail(text: Column, limit: int) -> Column:
    """A long text's first 65 % and last 35 % of ``limit`` characters around a mark."""
    head = limit * 65 // 100
    cut = F.concat(F.substring(text, 1, head), F.lit("\n...\n"), F.substring(text, -(limit - head), limit - head))
    return F.when(F.length(text) > limit, cut).otherwise(F.coalesce(text, F.lit("")))


def language_tag(text: Column) -> Column:
    """zh where over 5 % of the first 2,000 characters are CJK, unknown for no text, else en."""
    start = F.substring(text, 1, 2000)
    share = F.regexp_count(start, F.lit("[\\x{3400}-\\x{9FFF}]")) / F.length(start)
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, "unknown").when(share > 0.05, "zh").otherwise("en")


def html_title(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1), "[ \\t\\n\\r]+", " "))


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970 of a timestamp without zone, read as UTC (the session's zone)."""
    return F.floor(F.unix_micros(ts.cast("timestamp")) / 1_000_000).cast("long")


def snippet(text: Column, limit: int = 300) -> Column:
    """The start of a text with white space collapsed."""
    return F.substring(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "[ \\t\\n\\r]+", " ")), 1, limit)


def dot(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


#: What changes at each fetch of a page without a change of its content: dates, clock times, ages.
CHURN = (
    "[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}([ T][0-9]{1,2}:[0-9]{2}(:[0-9]{2})?)?", "\\b[0-9]{1,2}:[0-9]{2}(:[0-9]{2})?\\b", "(?i)\\b[0-9]+[ \\t]*(minutes?|hours?|days?|weeks?|months?|years?)[ \\t]+ago\\b",
    "[0-9]+[ \\t]*(分钟|小时|天|周|个月|年)前",
)
#: Units of raw times, as (name, divisor, seconds to take off); the first that gives a plausible time counts.
UNITS = (("unix_s", 1, 0), ("unix_ms", 1_000, 0), ("unix_us", 1_000_000, 0), ("webkit_us", 1_000_000, 11_644_473_600))


def body_canonical(text: Column) -> Column:
    """A page's text without what changes at each fetch, lines of two characters or fewer, and repeated white space."""
    out = F.coalesce(text, F.lit(""))
    for pattern in CHURN:
        out = F.regexp_replace(out, pattern, " ")
    lines = F.filter(F.transform(F.split(out, "\n"), lambda x: F.btrim(x, F.lit(" \t\r"))), lambda x: F.length(x) > 2)
    return F.trim(F.regexp_replace(F.array_join(lines, " "), "[ \\t\\n\\r]+", " "))


def time_unit(raw: Column, now: int) -> Column:
    """The first unit in which a raw time lies between 1990 and 400 days from now; null if none does."""
    out = F.lit(None).cast("string")
    for name, divisor, off in reversed(UNITS):
        out = F.when((raw / divisor - off).between(631_152_000, now + 400 * 86400), name).otherwise(out)
    return out


def to_seconds(raw: Column, unit: Column) -> Column:
    out = F.lit(None).cast("long")
    for name, divisor, off in UNITS:
        out = F.when(unit == name, F.floor(raw / divisor) - off).otherwise(out)
    return out
