"""Words of texts, queries and addresses as columns: segments, keys, embedding texts, tolerant readings of lists, times and replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import urls
from .columns import head_tail
from .health import CJK

SPACES = "[ \\t\\n\\r]+"
#: The embedding text's recipe, and what it takes of each part.
RECIPE, KEYWORDS, BODY_CHARS = "1", 12, 2000
#: Parts of an address that say nothing about the page.
NOISE = (
    "http", "https", "www", "com", "net", "org", "edu", "gov", "io", "cn", "co", "html", "htm", "php", "asp", "aspx", "jsp", "shtml", "amp", "index", "default", "home", "main", "page", "pages",
    "post", "posts", "article", "articles", "blog", "news", "view", "detail", "details", "content", "item", "items", "show", "read", "en", "zh", "cgi", "bin", "static", "wp", "id", "utm", "src",
    "ref", "pdf", "wiki", "docs", "doc", "tag", "tags", "category", "categories", "archive", "archives", "search", "mobile", "app",
)
#: Folders by the first pattern that a title holds; the end of the word ``ai`` is written out, so that all engines read it alike.
FOLDERS = (
    ("(llm|gpt|claude|人工智能|大模型|机器学习|deep learning|neural|prompt|agent|ai(?:[^0-9A-Za-z_\\x{80}-\\x{10FFFF}]|$))", "AI/模型"), ("(rust|golang|python|typescript|javascript|java|c\\+\\+|编程语言|compiler|编译)", "编程/语言"),
    ("(react|vue|css|html|前端|浏览器|browser|web dev|tailwind)", "编程/前端"), ("(docker|kubernetes|k8s|linux|服务器|运维|devops|nginx|ssh|部署)", "编程/运维"),
    ("(database|sqlite|postgres|mysql|redis|数据库|sql)", "编程/数据库"), ("(security|安全|加密|隐私|privacy|漏洞|cve|密码)", "安全隐私"), ("(tool|工具|软件|应用|插件|extension|cli)", "工具"),
    ("(游戏|game|音乐|music|电影|摄影|photo|设计|design)", "兴趣"), ("(创业|职场|管理|产品|business|startup|career|工作)", "职业"), ("(科学|物理|数学|生物|space|science|research|论文|paper)", "科学"),
)
#: Words that don't count as a query's content, and words of time.
STOP = (
    "the", "that", "this", "with", "for", "and", "was", "were", "have", "had", "about", "from", "into", "when", "what", "which", "some", "thing", "stuff", "saved", "bookmark", "page", "article",
    "post", "one", "you", "your", "那个", "这个", "那些", "存的", "保存", "收藏", "文章", "网页", "东西", "时候", "一个", "的", "了", "在", "是", "和", "关于", "怎么", "如何",
)
TIMES = (
    "^(20[0-2][0-9]|去年|前年|今年|上个?月|这个?月|最近|年初|年底|年中|春天|夏天|秋天|冬天|[一二三四五六七八九十]月|十[一二]月|[0-9]{1,2}月"
    "|last|this|early|late|recently|spring|summer|autumn|fall|winter|january|february|march|april|may|june|july|august|september|october|november|december|year|month)$"
)
#: The kinds that a reply may name.
UTILITIES = ("reference", "tutorial", "tool", "news", "opinion", "documentation", "paper", "dataset", "product", "entertainment", "other")
CONTENT_TYPES = ("article", "docs", "repo", "video", "thread", "pdf", "slides", "landing", "forum", "other")
#: What isn't taken into a corpus.
SKIP_HOSTS = ("beekka.com", "wangbase.com", "ruanyifeng.com", "githubusercontent.com", "shields.io", "gravatar.com", "w.org")
SKIP_PATHS = "(?i)\\.(png|jpe?g|gif|webp|svg|mp4|mp3|zip|pdf|ico)$"
SKIP_URLS = "(?i)github\\.com/ruanyf/weekly|/issues/[0-9]+|mailto:|^javascript:"


def has_cjk(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(f"[{CJK}]")


def grams(run: Column, n: int) -> Column:
    """The overlapping n-grams of a text; a shorter one has none."""
    return F.when(F.length(run) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(run) - n + 1, F.lit(1))), lambda i: F.substr(run, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def segment(text: Column) -> Column:
    """A text with white space collapsed and runs of CJK characters as overlapping pairs (in place of a dictionary's words)."""
    text = F.coalesce(text, F.lit(""))
    runs = F.regexp_extract_all(text, F.lit(f"[{CJK}]+|[^{CJK} \\t\\n\\r]+"), F.lit(0))
    cut = F.flatten(F.transform(runs, lambda r: F.when(has_cjk(r) & (F.length(r) > 1), grams(r, 2)).otherwise(F.array(r))))
    return F.when(has_cjk(text), F.array_join(cut, " ")).otherwise(F.btrim(F.regexp_replace(text, SPACES, " ")))


def match_terms(query: Column, segmented: bool, most: int = 48) -> Column:
    """The terms that a query asks an index for: index syntax is space; for the index of three-character parts CJK pieces are cut into such
    parts and terms under three characters are left out."""
    text = F.regexp_replace(segment(query) if segmented else F.coalesce(query, F.lit("")), "[\"*():^-]+", " ")
    words = F.filter(F.split(text, SPACES), lambda w: F.length(w) > 0)
    if segmented:
        return F.array_distinct(words)
    parts = F.flatten(F.transform(words, lambda w: F.when(has_cjk(w), grams(w, 3)).otherwise(F.array(w))))
    return F.slice(F.array_distinct(F.filter(parts, lambda w: F.length(w) >= 3)), 1, most)


def match_expression(terms: Column) -> Column:
    """Quoted terms joined by OR; null without any."""
    return F.when(F.size(terms) > 0, F.array_join(F.transform(terms, lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " OR "))


def embedding_text(title: Column, summary: Column, keywords: Column, body: Column) -> Column:
    """Title, summary, the first keywords and the body's two ends, a line each where there is any."""
    parts = F.array(F.btrim(title), F.btrim(summary), F.array_join(F.slice(keywords, 1, KEYWORDS), " · "), head_tail(body, BODY_CHARS))
    return F.array_join(F.filter(parts, lambda p: F.length(p) > 0), "\n")


def fingerprint(text: Column) -> Column:
    """What a stored vector was made from: recipe and text."""
    return F.sha2(F.concat(F.lit(RECIPE).cast("binary"), F.unhex(F.lit("00")), text.cast("binary")), 256)


def title_only(title: Column, url: Column) -> Column:
    return F.concat(F.lit("t:"), F.sha2(F.concat(title.cast("binary"), F.unhex(F.lit("00")), url.cast("binary")), 256))


def anchor_key(url: Column, host: Column) -> Column:
    """What larger thing an address is part of: a repository, or a page whose fragment was kept; null if none."""
    base = F.split_part(urls.normalize(url), F.lit("#"), F.lit(1))
    path = F.regexp_extract(base, "^[^:]*://[^/]*/([^?]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda p: F.length(p) > 0)
    forge = (F.endswith(host, F.lit("github.com")) | F.endswith(host, F.lit("gitlab.com"))) & (F.size(parts) >= 2)
    kept = F.coalesce(F.length(urls.kept_fragment(urls.parts(url))) > 0, F.lit(False))
    key = F.when(forge, F.concat(F.lit("repo:"), host, F.lit("/"), F.get(parts, 0), F.lit("/"), F.get(parts, 1))).when(kept, F.concat(F.lit("page:"), base))
    return F.when(urls.indexable(url) & base.rlike("^[^:]*://[^/]*/"), key)


def slug_words(url: Column, most: int = 12) -> Column:
    """The distinct words that an address's path shows, without noise, numbers and hashes."""
    path = F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    text = F.regexp_replace(F.coalesce(F.try_url_decode(path), path), "([a-z0-9])([A-Z])", "$1 $2")
    words = F.transform(F.regexp_extract_all(text, F.lit("[\\x{4E00}-\\x{9FFF}]+|[A-Za-z]+"), F.lit(0)), F.lower)
    said = lambda w: ~w.isin(*NOISE) & ~w.rlike("^[a-f]{8,}$") & ((F.length(w) >= 2) | w.rlike("[\\x{4E00}-\\x{9FFF}]"))
    return F.slice(F.array_distinct(F.filter(words, said)), 1, most)


def folder_for(title: Column) -> Column:
    low, out = F.lower(title), F.lit("未分类")
    for pattern, folder in reversed(FOLDERS):
        out = F.when(low.rlike(pattern), folder).otherwise(out)
    return out


def tokens(text: Column) -> Column:
    """The distinct words of two characters or more."""
    return F.array_distinct(F.filter(F.regexp_extract_all(segment(F.lower(text)), F.lit("[0-9a-z_\\x{4E00}-\\x{9FFF}]+"), F.lit(0)), lambda w: F.length(w) > 1))


def content_tokens(text: Column) -> Column:
    return F.filter(tokens(text), lambda w: ~w.isin(*STOP) & ~w.rlike(TIMES))


def cjk_ratio(text: Column) -> Column:
    letters = F.regexp_count(text, F.lit("[a-zA-Z\\x{4E00}-\\x{9FFF}]"))
    return F.when(letters == 0, 0.0).otherwise(F.regexp_count(text, F.lit("[\\x{4E00}-\\x{9FFF}]")) / letters)


def text_key(text: Column) -> Column:
    """A query's identity: white space and case don't count."""
    return F.lower(F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")))


def language_hint(title: Column) -> Column:
    return F.when(F.regexp_count(title, F.lit("[\\x{4E00}-\\x{9FFF}]")) >= 2, "zh").otherwise("en")


def clip(text: Column, n: int) -> Column:
    """At most n characters, the last an ellipsis where something is cut."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\r"))
    return F.when(F.length(t) <= n, t).otherwise(F.concat(F.rtrim(F.substr(t, F.lit(1), F.lit(n - 1)), F.lit(" \t\n\r")), F.lit("…")))


def sentences(text: Column, most: int = 5, least: int = 4, chars: int = 4000) -> Column:
    """The first sentences and lines of a text of ``least`` characters or more; else the whole text."""
    body = F.substr(F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\r")), F.lit(1), F.lit(chars))
    cut = F.split(F.regexp_replace(body, "([.!?。！？])[ \\t\\n\\r]+", "$1\n"), "[\\n\\r]+")
    long = F.filter(F.transform(cut, lambda s: F.btrim(s, F.lit(" \t"))), lambda s: F.length(s) >= least)
    return F.when(F.length(body) == 0, F.array().cast("array<string>")).when(F.size(long) > 0, F.slice(long, 1, most)).otherwise(F.array(body))


def masked(value: Column) -> Column:
    value = F.coalesce(value, F.lit(""))
    return F.when(F.length(value) <= 8, value).otherwise(F.concat(F.substr(value, F.lit(1), F.lit(3)), F.lit("..."), F.right(value, F.lit(4))))


def listed(value: Column) -> Column:
    """The distinct items of a text, by commas or white space."""
    return F.array_distinct(F.filter(F.split(F.translate(value, ",", " "), SPACES), lambda x: F.length(x) > 0))


def read_time(raw: Column) -> Column:
    """Seconds of a number (milliseconds if above 1e11) or an ISO text; null if it is neither."""
    n = raw.try_cast("double")
    return F.when(n.isNotNull(), F.when(n > 1e11, F.floor(n / 1000)).otherwise(F.floor(n))).otherwise(F.unix_seconds(F.try_to_timestamp(raw))).cast("long")


def json_list(raw: Column) -> Column:
    """A JSON array of texts; empty for what is none."""
    return F.coalesce(F.when(F.btrim(raw).rlike("^\\["), F.from_json(raw, "array<string>")), F.array().cast("array<string>"))


def json_object(reply: Column) -> Column:
    """The JSON object in a model's reply, as text: the reply itself, a fenced part, or from the first to the last brace; null if none reads."""
    reply = F.btrim(F.coalesce(reply, F.lit("")), F.lit(" \t\n\r"))
    fence = F.btrim(F.regexp_extract(reply, "(?s)```(?:json)?[ \\t\\n\\r]*(.*?)```", 1), F.lit(" \t\n\r"))
    braces = F.regexp_extract(reply, "(?s)\\{.*\\}", 0)
    reads = lambda t: F.when(F.startswith(t, F.lit("{")) & F.try_parse_json(t).isNotNull(), t)
    return F.coalesce(reads(reply), reads(fence), reads(braces))


def coerced_list(json: Column, path: str, most: int) -> Column:
    """A field as a list: an array's items, or a text cut at lines, semicolons and commas; the first of items that differ in case only."""
    raw = F.get_json_object(json, path)
    items = F.when(F.startswith(raw, F.lit("[")), F.from_json(raw, "array<string>")).otherwise(F.split(raw, "[\\n;,]"))
    items = F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.btrim(F.regexp_replace(x, SPACES, " "))), lambda x: F.length(x) > 0)
    first = F.filter(items, lambda x, i: F.array_position(F.transform(items, F.lower), F.lower(x)) == i + 1)
    return F.slice(first, 1, most)


def coerced_kind(json: Column, path: str, allowed: tuple[str, ...]) -> Column:
    """A field as one of the allowed kinds: itself, or its first word that is one; else other."""
    s = F.btrim(F.lower(F.coalesce(F.get_json_object(json, path), F.lit(""))), F.lit(" ."))
    words = F.filter(F.split(s, "[ \\t\\n/,|-]+"), lambda w: w.isin(*allowed))
    return F.when(s.isin(*allowed), s).otherwise(F.coalesce(F.get(words, 0), F.lit("other")))


def claims(json: Column, sources: Column, most: int = 12) -> Column:
    """[(text, sources)] of a reply's claims that cite a source from 1 to ``sources``."""
    found = F.coalesce(F.from_json(json, "claims array<struct<text:string,sources:array<int>>>")["claims"], F.array().cast("array<struct<text:string,sources:array<int>>>"))
    kept = F.transform(found, lambda c: F.struct(F.substr(F.btrim(F.coalesce(c["text"], F.lit(""))), F.lit(1), F.lit(600)).alias("text"), F.array_sort(F.array_distinct(F.filter(F.coalesce(c["sources"], F.array().cast("array<int>")), lambda n: n.between(1, sources)))).alias("sources")))
    return F.slice(F.filter(kept, lambda c: (F.length(c["text"]) > 0) & (F.size(c["sources"]) > 0)), 1, most)


def excluded(host: Column, domains: tuple[str, ...]) -> Column:
    """Is the host one of the domains or under one?"""
    h = F.lower(host)
    return F.exists(F.array(*map(F.lit, domains)).cast("array<string>"), lambda d: (h == d) | F.endswith(h, F.concat(F.lit("."), d)))


def usable(url: Column, host: Column) -> Column:
    path = F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return (F.length(host) > 0) & ~excluded(host, SKIP_HOSTS) & ~path.rlike(SKIP_PATHS) & ~url.rlike(SKIP_URLS)


def shape(text: Column, chinese: Column) -> Column:
    """What is wrong with a query's form; empty if nothing is."""
    ratio, n = cjk_ratio(text), F.length(text)
    return (
        F.when(n == 0, "empty").when(n < F.when(chinese, 8).otherwise(15), "short").when(n > 120, "long").when(F.size(content_tokens(text)) < 2, "few words")
        .when(F.regexp_count(text, F.lit("[,，;；、/|]")) >= 2, "list").when(chinese & (ratio < 0.5), "not chinese").when(~chinese & (ratio > 0.3), "not english").otherwise("")
    )


def title_overlap(text: Column, title: Column, most: float) -> Column:
    """Is a query's content the title's, or too much of it?"""
    own, named = content_tokens(text), tokens(title)
    shared = F.size(F.array_intersect(own, named))
    return F.when(shared == F.size(own), "title").when(shared / F.greatest(F.size(own), F.lit(1)) > most, "mostly title").otherwise("")
