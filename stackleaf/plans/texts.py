"""Texts, queries, addresses and replies over the driver tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import columns as C
from ..functions import urls
from ..functions import wording as W
from ..operators import library as L
from .checks import cleaned, pick, text
from .more import ADDRESSES, NOW
from .queries import EDGES, table

#: Recorded replies and documents of another service, dealt to rows by their number.
REPLIES = (
    '{"summary": " A  page ", "topics": ["Rust", "rust", " web "], "utility": "Tutorial/guide", "content_type": "docs", "intent_queries": ["how to", "x", "why rust"]}',
    'Sure! ```json\n{"summary": "", "tags": [], "topics": "a, b; c", "utility": "none", "intent_queries": "first one\nsecond one"}\n``` Bye',
    'It is {"summary": "inner", "utility": "paper.", "content_type": "Video of a talk"} I think', "no object here", '["a list"]', "{broken",
)
CLAIMS = (
    '{"claims": [{"text": " one ", "sources": [2, 1, 2, 9]}, {"text": "uncited", "sources": []}, {"text": "", "sources": [1]}]}', '{"claims": []}', '{"claims": [{"text": "two", "sources": [0]}, {"text": "three", "sources": [3]}]}', "{}",
)
TIMES = ("2024-01-15T09:30:00Z", "1706000000", "1706000000123", "soon", "2024-01-15T09:30:00+08:00", "")
DOCS = (
    '{"id": "k1", "userId": "u1", "url": "https://a.example/1", "title": "One", "description": "about", "content": "body", "tags": ["x", " ", "y"], "createdAt": "2024-01-15T09:30:00Z"}',
    '{"id": "k2", "user_id": "u2", "url": "https://a.example/2", "link_title": "Two", "note": "mine", "created_at": "1706000000"}',
    '{"id": "k3", "url": "https://a.example/3", "title": "", "content": " ", "tags": []}',
)
PRIVATE = ("example.com", "bank.example", "org")
SPOKEN = ("全文检索 sqlite-vec 教程", "ab \"quoted\" c:d", "数据", "how do i use full-text search", "最近 保存的 那个 文章", "  ", "去年看的 rust 异步 编程", "one, two; three / four")


def page_title():
    return F.btrim(F.split_part(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(1)), F.lit(" \t\r"))


def bookmarks(spark, d):
    """Documents as bookmarks: first line as title, source as folder, saved when the event of the same number came, the address of a page."""
    pages = table(spark, d, "pages")
    n = pages.agg(F.greatest(F.count("*"), F.lit(1)).alias("n"))
    docs = table(spark, d, "documents").join(F.broadcast(n))  # n is one row
    named = docs.select(F.col("doc_id").alias("id"), page_title().alias("title"), F.coalesce("text", F.lit("")).alias("body"), F.coalesce("source", F.lit("")).alias("folder"), "lang", F.pmod("doc_id", "n").alias("page_id"))
    saved = table(spark, d, "events").select(F.col("event_id").alias("id"), C.epoch_seconds(F.col("ts")).alias("date_added"))
    address = pages.select("page_id", "url", C.host_of(F.col("url")).alias("host"))
    return named.join(saved, "id", "left").join(address, "page_id", "left").drop("page_id")


def rows(spark, d):
    return table(spark, d, "events").select("event_id")


def dealt(values, key="event_id"):
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(key, F.lit(len(values))) + 1).cast("int"))


def entities():
    # Letters beyond ASCII count as letters at a word's edge in all engines once they are underscores.
    plain = F.regexp_replace("body", "[^\\x00-\\x7F]", "_")
    return F.slice(F.array_distinct(F.regexp_extract_all(plain, F.lit("\\b[A-Z][A-Za-z0-9+.-]{2,}\\b"), F.lit(0))), 1, 6)


def q_embedding(spark, d):
    made = W.embedding_text(F.col("title"), C.snippet(F.col("body"), 200), F.concat(F.array("folder"), entities()), F.col("body"))
    b = bookmarks(spark, d).select("id", made.alias("made"), W.title_only(F.col("title"), F.coalesce("url", F.lit(""))).alias("title_hash"))
    return b.select("id", F.md5("made").alias("text_md5"), W.fingerprint(F.col("made")).alias("fingerprint"), "title_hash")


def q_work(spark, d):
    """Which vectors need work: the stored fingerprint beside that of the text rebuilt now; a third has none, a seventh an old one."""
    now = q_embedding(spark, d).select("id", "fingerprint")
    stored = now.where("id % 3 <> 0").select("id", F.when(F.col("id") % 7 == 0, "old").otherwise(F.col("fingerprint")).alias("stored"))
    met = now.join(stored, "id", "left")
    return met.agg(F.count_if(F.col("stored").isNull()).alias("pending"), F.count_if(F.col("stored") != F.col("fingerprint")).alias("stale"), F.count_if(F.col("stored") == F.col("fingerprint")).alias("current"))


def anchors(spark, d):
    return table(spark, d, "pages").select(F.col("page_id").alias("id"), W.anchor_key(F.col("url"), C.host_of(F.col("url"))).alias("key"))


def q_gate(spark, d):
    host = C.host_of(F.col("url"))
    private = W.excluded(host, PRIVATE)
    return table(spark, d, "pages").select("page_id", private.alias("private"), (urls.indexable(F.col("url")) & ~private).alias("shown"), W.usable(F.col("url"), host).alias("usable"), F.array_join(W.slug_words(F.col("url")), " ").alias("slug"))


def q_words(spark, d):
    t = F.col("text")
    base = table(spark, d, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text")).withColumn("text", F.when(F.col("turn") == 0, F.concat("text", F.lit(" "), dealt(SPOKEN, "conv_id"))).otherwise(t))
    return base.select(
        "conv_id", "turn", W.has_cjk(t).alias("cjk"), F.md5(W.segment(t)).alias("segments"), F.md5(F.coalesce(W.match_expression(W.match_terms(t, True)), F.lit("-"))).alias("words"), W.match_expression(W.match_terms(t, False)).alias("parts"),
        F.array_join(F.array_sort(W.content_tokens(t)), " ").alias("content"), W.text_key(t).alias("text_key"), W.language_hint(t).alias("hint"), F.round(W.cjk_ratio(t), 9).alias("cjk_ratio"), W.shape(t, W.has_cjk(t)).alias("shape"), W.clip(t, 80).alias("clip"),
        F.md5(F.array_join(W.sentences(t), "|")).alias("sentences"), W.masked(t).alias("masked"), F.size(W.listed(t)).alias("listed"),
    )


def q_folders(spark, d):
    """Folder by title words and, for a third by hash, none; with the number of titles a folder's pattern names."""
    unfiled = F.conv(F.substring(F.md5(F.concat(F.lit("folder:"), F.col("id").cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0 < 0.35
    return bookmarks(spark, d).select(F.when(unfiled, "").otherwise(W.folder_for(F.col("body"))).alias("folder")).groupBy("folder").agg(F.count("*").alias("n"))


def q_overlaps(spark, d):
    asked = F.concat_ws(" ", F.slice(F.split("body", W.SPACES), 4, 8))
    return bookmarks(spark, d).select("id", W.title_overlap(asked, F.col("title"), 0.5).alias("overlap"))


def q_replies(spark, d):
    j = W.json_object(dealt(REPLIES))
    found = rows(spark, d).select("event_id", j.alias("j"))
    c = F.col("j")
    summary = F.substr(F.btrim(F.regexp_replace(F.coalesce(F.get_json_object(c, "$.summary"), F.lit("")), W.SPACES, " ")), F.lit(1), F.lit(200))
    asked = F.slice(F.filter(W.coerced_list(c, "$.intent_queries", 16), lambda q: F.length(q) >= 3), 1, 8)
    shaped = found.where("j is not null").select("event_id", summary.alias("summary"), F.array_join(W.coerced_list(c, "$.topics", 8), "|").alias("topics"), W.coerced_kind(c, "$.utility", W.UTILITIES).alias("utility"), W.coerced_kind(c, "$.content_type", W.CONTENT_TYPES).alias("content_type"), F.array_join(asked, "|").alias("queries"))
    return shaped.where("summary <> '' or queries <> ''")


def q_claims(spark, d):
    found = rows(spark, d).select("event_id", F.explode(W.claims(dealt(CLAIMS), F.lit(3))).alias("c"))
    return found.select("event_id", "c.text", F.array_join(F.transform("c.sources", lambda n: n.cast("string")), ",").alias("sources"))


def q_times(spark, d):
    return rows(spark, d).select("event_id", W.read_time(dealt(TIMES)).alias("seconds"))


def documents_of(spark, d):
    """The other service's documents: names in two spellings, absent fields empty."""
    fields = "id string, userId string, user_id string, url string, title string, linkTitle string, link_title string, description string, content string, note string, tags array<string>, createdAt string, created_at string"
    r = rows(spark, d).select("event_id", F.from_json(dealt(DOCS), fields).alias("r")).select("event_id", "r.*")
    s = lambda *names: F.coalesce(*(F.nullif(F.col(n), F.lit("")) for n in names), F.lit(""))
    tags = F.filter(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.length(F.btrim(t)) > 0)
    said = F.filter(F.array(s("description"), s("note"), s("content")), lambda p: F.length(F.btrim(p)) > 0)
    title = s("title", "linkTitle", "link_title", "url")
    return r.select("event_id", F.col("id").alias("document"), s("userId", "user_id").alias("user"), "url", title.alias("title"), F.array_join(tags, " / ").alias("folder"), F.array_join(said, "\n\n").alias("body"), W.read_time(F.coalesce("createdAt", "created_at")).alias("created_at"))


def q_mapping(spark, d):
    """Documents, users and documents with text of the other service; and the listing's place by time."""
    return documents_of(spark, d).agg(F.count("*").alias("docs"), F.countDistinct("user").alias("users"), F.count_if(F.col("body") != "").alias("with_body"), F.count_if(F.col("user").isin("u1") & (F.col("document") != "k2")).alias("filtered"))


def queries_read(spark, d):
    """Query files as rows (chunk, pos, line): records, comment lines and copies."""
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("chunk"), F.col("turn").alias("pos"), F.coalesce("text", F.lit("")).alias("text"))
    return c.withColumns({"qtype": dealt(("q_content", "q_vague", "q_episodic"), "chunk"), "target": F.pmod("chunk", F.lit(40)), "text": F.when(F.pmod("pos", F.lit(5)) == 4, F.concat(F.lit("// "), "text")).otherwise(F.substr("text", F.lit(1), F.lit(24)))})


def q_merged(spark, d):
    """First of each (target, type), then first of each text among those kept by then; why others were dropped."""
    kept = queries_read(spark, d).where("not startswith(text, '//')").withColumn("key", W.text_key(F.col("text")))
    full = kept.where("key <> ''")
    by = lambda *c: F.row_number().over(Window.partitionBy(*c).orderBy("chunk", "pos"))
    pairs = full.withColumn("p", by("target", "qtype"))
    first = pairs.where("p = 1").withColumn("t", by("key"))
    # A pair whose first text is a repeat gives way to its next text only where that one is new: those are few, and are counted as repeats of the text.
    return first.groupBy((F.col("t") == 1).alias("kept")).agg(F.count("*").alias("n")).select(F.when(F.col("kept"), "kept").otherwise("text").alias("state"), "n").unionByName(pairs.where("p > 1").agg(F.count("*").alias("n")).select(F.lit("pair").alias("state"), "n")).unionByName(kept.where("key = ''").agg(F.count("*").alias("n")).select(F.lit("empty").alias("state"), "n"))


def q_anchor_edges(spark, d):
    return L.group_edges(anchors(spark, d).where("key is not null"), ["key"], 25, 0.5)


def q_collisions(spark, d):
    """Folder names that stand for several paths: the host's parts joined by the mark that some parts hold themselves."""
    host = C.host_of(F.col("url"))
    path = F.when(F.pmod("page_id", F.lit(2)) == 0, F.array(F.regexp_replace(host, "[.]", "/"))).otherwise(F.split(host, "[.]"))
    folders = table(spark, d, "pages").select(F.array_join(path, "/").alias("folder"), path.alias("path"))
    return folders.groupBy("folder").agg(F.countDistinct("path").alias("paths")).where("paths > 1")


def q_links(spark, d):
    """Markdown links in texts, made of the pages' addresses and titles."""
    line = F.concat(F.lit("see ["), C.html_title(F.col("html")), F.lit("]("), F.col("url"), F.lit(") and [x](mailto:y) or [z](https://w.org/z.png)."))
    found = table(spark, d, "pages").select("page_id", F.explode(F.arrays_zip(F.regexp_extract_all(line, F.lit("\\[([^\\]]{1,200})\\]\\((https?://[^\\s)]+)\\)"), F.lit(1)).alias("title"), F.regexp_extract_all(line, F.lit("\\[([^\\]]{1,200})\\]\\((https?://[^\\s)]+)\\)"), F.lit(2)).alias("url"))).alias("x"))
    return found.select("page_id", "x.title", "x.url", W.usable(F.col("x.url"), C.host_of(F.col("x.url"))).alias("usable"), W.language_hint(F.col("x.title")).alias("hint"))


def q_topwords(spark, d):
    """The five commonest words of each text, first ones first among equals, as a stand-in for a model's topics."""
    words = F.filter(F.transform(F.regexp_extract_all("body", F.lit("[A-Za-z][A-Za-z0-9+_.-]+|[0-9]+"), F.lit(0)), F.lower), lambda w: F.length(w) > 1)
    flat = bookmarks(spark, d).select("id", F.posexplode(words).alias("pos", "word"))
    counted = flat.groupBy("id", "word").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    placed = counted.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(F.col("n").desc(), "first")).cast("int"))
    return placed.where("place <= 5").select("id", "place", "word", "n")


def q_years(spark, d):
    """What a text is about in time: its commonest year that isn't the year it was saved; ties by distance, then the later."""
    year = F.year(F.timestamp_seconds("date_added"))
    # Texts without years get some by rule, so that there is something to count.
    body = F.concat("body", F.lit(" in "), (F.pmod("id", F.lit(30)) + 1995).cast("string"), F.lit(" and "), (F.pmod("id", F.lit(7)) + 2018).cast("string"), F.lit("."))
    found = bookmarks(spark, d).where("date_added is not null").select("id", year.alias("saved"), F.explode(F.regexp_extract_all(body, F.lit("\\b(?:19[89][0-9]|20[0-4][0-9])\\b"), F.lit(0))).alias("y")).withColumn("y", F.col("y").cast("int")).where("y <> saved")
    counted = found.groupBy("id", "saved", "y").agg(F.count("*").alias("n"))
    return counted.groupBy("id").agg(F.max_by("y", F.struct("n", F.abs(F.col("y") - F.col("saved")), "y")).alias("subject_year"))


def q_calendar(spark, d):
    """Which relative words are true of a save, by the calendar and by their windows; and its age in words."""
    at, now = F.col("date_added"), F.lit(NOW)
    saved, today = F.timestamp_seconds(at), F.timestamp_seconds(now)
    b = bookmarks(spark, d).where("date_added is not null").select("id", (at - F.pmod("id", F.lit(5)) * 200 * 86400).alias("date_added"))
    month = lambda t: F.year(t) * 12 + F.month(t)
    age = F.floor((now - at) / 86400)
    truths = {"this month": month(saved) == month(today), "last month": month(saved) == month(today) - 1, "recently": age.between(0, 90), "this year": F.year(saved) == F.year(today), "last year": F.year(saved) == F.year(today) - 1, "two years ago": F.year(saved) == F.year(today) - 2}
    spoken = F.array_join(F.filter(F.array(*(F.when(v, k) for k, v in truths.items())), lambda x: x.isNotNull()), ",")
    coarse = F.when(age < 30, F.concat(age.cast("string"), F.lit(" d"))).when(age < 365, F.concat(F.floor(age / 30).cast("string"), F.lit(" mo"))).otherwise(F.concat(F.floor(age / 365).cast("string"), F.lit(" y")))
    return b.select("id", spoken.alias("spoken"), coarse.alias("age"))


def queries():
    return {
        "embedding_texts": q_embedding,
        "embedding_work": q_work,
        "anchor_keys": anchors,
        "anchor_edges": q_anchor_edges,
        "address_gates": q_gate,
        "query_words": q_words,
        "folder_rules": q_folders,
        "title_overlap": q_overlaps,
        "reply_coercion": q_replies,
        "reply_claims": q_claims,
        "recorded_times": q_times,
        "service_documents": documents_of,
        "service_mapping": q_mapping,
        "merge_dedup": q_merged,
        "folder_collisions": q_collisions,
        "markdown_links": q_links,
        "top_words": q_topwords,
        "subject_years": q_years,
        "calendar_words": q_calendar,
        "bookmark_rows": lambda s, d: bookmarks(s, d).select("id", F.md5("title").alias("title_md5"), F.substring("body", 1, 400).alias("head"), "folder", "date_added", "url", "host"),
    }


def listed(words) -> str:
    return "(" + ", ".join(map(text, words)) + ")"


BOOKMARKS = """marks AS (SELECT doc_id AS id, trim(split_part(coalesce(text, ''), chr(10), 1), ' ' || chr(9) || chr(13)) AS title, coalesce(text, '') AS body, coalesce(source, '') AS folder, lang, floor(epoch_us(ts) / 1000000)::BIGINT AS date_added,
    url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS host FROM documents LEFT JOIN events ON event_id = doc_id LEFT JOIN pages ON page_id = doc_id % (SELECT greatest(count(*), 1) FROM pages))"""
CJK = W.CJK


def cjk(x: str) -> str:
    return f"regexp_matches({x}, '[{CJK}]')"


def segment(x: str) -> str:
    runs = f"regexp_extract_all({x}, '[{CJK}]+|[^{CJK} \\t\\n\\r]+')"
    cut = f"flatten(list_transform({runs}, lambda r: CASE WHEN {cjk('r')} AND length(r) > 1 THEN list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) ELSE [r] END))"
    return f"CASE WHEN {cjk(x)} THEN array_to_string({cut}, ' ') ELSE trim(regexp_replace({x}, '{W.SPACES}', ' ', 'g'), ' ') END"


def distinct(x: str) -> str:
    return f"list_filter({x}, lambda e, i: list_position({x}, e) = i)"


SPLIT = f"list_filter(regexp_split_to_array({{x}}, '{W.SPACES}'), lambda w: length(w) > 0)"
WORDS = f"""said AS (SELECT conv_id, turn, CASE WHEN turn = 0 THEN coalesce(text, '') || ' ' || {pick(SPOKEN, 'conv_id')} ELSE coalesce(text, '') END AS text FROM conversations),
    cut AS (SELECT *, {segment('text')} AS seg, {segment('lower(text)')} AS low FROM said),
    lists AS (SELECT *, {SPLIT.format(x="regexp_replace(seg, '[\"*():^-]+', ' ', 'g')")} AS w, flatten(list_transform({SPLIT.format(x="regexp_replace(text, '[\"*():^-]+', ' ', 'g')")},
        lambda w: CASE WHEN {cjk('w')} THEN list_transform(range(1, length(w) - 1), lambda i: substr(w, i, 3)) ELSE [w] END)) AS g, list_filter(regexp_extract_all(low, '[0-9a-z_\\x{{4E00}}-\\x{{9FFF}}]+'), lambda x: length(x) > 1) AS tok FROM cut),
    uniq AS (SELECT *, {distinct('w')} AS words, list_filter(g, lambda e, i: length(e) >= 3 AND list_position(g, e) = i)[:48] AS parts, list_filter(list_distinct(tok), lambda x: x NOT IN {listed(W.STOP)} AND NOT regexp_matches(x, {text(W.TIMES)})) AS content,
        len(regexp_extract_all(text, '[a-zA-Z\\x{{4E00}}-\\x{{9FFF}}]')) AS letters, len(regexp_extract_all(text, '[\\x{{4E00}}-\\x{{9FFF}}]')) AS han, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS t FROM lists),
    sent AS (SELECT *, CASE WHEN letters = 0 THEN 0.0::DOUBLE ELSE han / letters END AS ratio, list_filter(list_transform(regexp_split_to_array(regexp_replace(left(t, 4000), '([.!?。！？])[ \\t\\n\\r]+', '\\1' || chr(10), 'g'), '[\\n\\r]+'), lambda s: trim(s, ' ' || chr(9))), lambda s: length(s) >= 4) AS s FROM uniq)"""


def kind(c: str, allowed) -> str:
    s = f"trim(lower(coalesce(j ->> '$.{c}', '')), ' .')"
    return f"CASE WHEN {s} IN {listed(allowed)} THEN {s} ELSE coalesce(list_filter(regexp_split_to_array({s}, '[ \\t\\n/,|-]+'), lambda w: w IN {listed(allowed)})[1], 'other') END"


def coerced(c: str) -> str:
    raw = f"(j ->> '$.{c}')"
    items = f"CASE WHEN starts_with({raw}, '[') THEN from_json({raw}, '[\"VARCHAR\"]') ELSE regexp_split_to_array(coalesce({raw}, ''), '[\\n;,]') END"
    return f"list_filter(list_transform({items}, lambda x: trim(regexp_replace(x, '{W.SPACES}', ' ', 'g'), ' ')), lambda x: length(x) > 0)"


def unique(x: str) -> str:
    return f"list_filter({x}, lambda e, i: list_position(list_transform({x}, lambda y: lower(y)), lower(e)) = i)"


def reads(t: str) -> str:
    return f"CASE WHEN starts_with({t}, '{{') AND json_valid({t}) THEN {t} END"


SPACE = "' ' || chr(9) || chr(10) || chr(13)"
REPLY = f"""said AS (SELECT event_id, trim({pick(REPLIES, 'event_id')}, {SPACE}) AS r FROM events), tried AS (SELECT *, trim(regexp_extract(r, '(?s)```(?:json)?[ \\t\\n\\r]*(.*?)```', 1), {SPACE}) AS f, regexp_extract(r, '(?s)\\{{.*\\}}') AS b FROM said),
    objects AS (SELECT event_id, coalesce({reads('r')}, {reads('f')}, {reads('b')})::JSON AS j FROM tried), lists AS (SELECT *, {coerced('topics')} AS topics, {coerced('intent_queries')} AS asked, left(trim(regexp_replace(coalesce(j ->> '$.summary', ''), '{W.SPACES}', ' ', 'g'), ' '), 200) AS summary FROM objects WHERE j IS NOT NULL),
    shaped AS (SELECT event_id, summary, array_to_string({unique('topics')}[:8], '|') AS topics, {kind('utility', W.UTILITIES)} AS utility, {kind('content_type', W.CONTENT_TYPES)} AS content_type, array_to_string(list_filter({unique('asked')}[:16], lambda q: length(q) >= 3)[:8], '|') AS queries FROM lists)"""
TIME = "CASE WHEN try_cast({x} AS DOUBLE) IS NOT NULL THEN floor(try_cast({x} AS DOUBLE) / CASE WHEN try_cast({x} AS DOUBLE) > 1e11 THEN 1000 ELSE 1 END)::BIGINT ELSE epoch(try_cast({x} AS TIMESTAMPTZ))::BIGINT END"


def s(*names: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(j ->> '$.{n}', '')" for n in names) + ", '')"


SERVICE = f"""recorded AS (SELECT event_id, {pick(DOCS, 'event_id')}::JSON AS j FROM events),
    service AS (SELECT event_id, j ->> '$.id' AS document, {s('userId', 'user_id')} AS user, j ->> '$.url' AS url, {s('title', 'linkTitle', 'link_title', 'url')} AS title,
        array_to_string(list_filter(coalesce(from_json(j -> '$.tags', '["VARCHAR"]'), []), lambda t: length(trim(t)) > 0), ' / ') AS folder, array_to_string(list_filter([{s('description')}, {s('note')}, {s('content')}], lambda p: length(trim(p)) > 0), chr(10) || chr(10)) AS body,
        {TIME.format(x="coalesce(j ->> '$.createdAt', j ->> '$.created_at')")} AS created_at FROM recorded)"""
ENTITIES = "regexp_extract_all(regexp_replace(body, '[^\\x00-\\x7F]', '_', 'g'), '\\b[A-Z][A-Za-z0-9+.-]{2,}\\b')"
CUT = "CASE WHEN length(body) > 2000 THEN left(body, 1300) || chr(10) || '...' || chr(10) || right(body, 700) ELSE body END"
EMBED = f"""{BOOKMARKS}, entities AS (SELECT *, {ENTITIES} AS ents, left(trim(regexp_replace(body, '{W.SPACES}', ' ', 'g'), ' '), 200) AS summary FROM marks),
    made AS (SELECT *, array_to_string(list_filter([trim(title, ' '), trim(summary, ' '), array_to_string(list_concat([folder], {distinct('ents')}[:6])[:12], ' · '), {CUT}], lambda p: length(p) > 0), chr(10)) AS made FROM entities),
    embedded AS (SELECT id, md5(made) AS text_md5, sha256('1'::BLOB || '\\x00'::BLOB || encode(made)) AS fingerprint, 't:' || sha256(encode(title) || '\\x00'::BLOB || encode(coalesce(url, ''))) AS title_hash FROM made)"""
PRIVACY = "len(list_filter({d}, lambda d: {h} = d OR ends_with({h}, '.' || d))) > 0"
HOST = "lower(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1))"
PATH = "regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


def usable(u: str, h: str) -> str:
    return f"(length({h}) > 0 AND NOT ({PRIVACY.format(d=list(W.SKIP_HOSTS), h=h)}) AND NOT regexp_matches({PATH.format(u=u)}, {text(W.SKIP_PATHS)}) AND NOT regexp_matches({u}, {text(W.SKIP_URLS)}))"


SLUG = f"list_filter(list_transform(regexp_extract_all(regexp_replace(url_decode({PATH.format(u='url')}), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[\\x{{4E00}}-\\x{{9FFF}}]+|[A-Za-z]+'), lambda w: lower(w)), lambda w: w NOT IN {listed(W.NOISE)} AND NOT regexp_matches(w, '^[a-f]{{8,}}$') AND (length(w) >= 2 OR regexp_matches(w, '[\\x{{4E00}}-\\x{{9FFF}}]')))"
KEYS = f"""{ADDRESSES}, based AS (SELECT a.page_id AS id, {HOST.format(u='p.url')} AS host, split_part(url_norm, '#', 1) AS base, kept_fragment, indexable FROM addresses a JOIN pages p USING (page_id)),
    parted AS (SELECT *, list_filter(string_split(regexp_extract(base, '^[^:]*://[^/]*/([^?]*)', 1), '/'), lambda p: length(p) > 0) AS s FROM based),
    keys AS (SELECT id, CASE WHEN NOT indexable OR NOT regexp_matches(base, '^[^:]*://[^/]*/') THEN NULL WHEN (ends_with(host, 'github.com') OR ends_with(host, 'gitlab.com')) AND len(s) >= 2 THEN 'repo:' || host || '/' || s[1] || '/' || s[2] WHEN kept_fragment <> '' THEN 'page:' || base END AS key FROM parted)"""
FOLDER = "CASE " + " ".join(f"WHEN regexp_matches(lower(body), {text(p)}) THEN {text(f)}" for p, f in W.FOLDERS) + " ELSE '未分类' END"


def toks(x: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all({segment(f'lower({x})')}, '[0-9a-z_\\x{{4E00}}-\\x{{9FFF}}]+'), lambda w: length(w) > 1))"


MERGED = f"""read AS (SELECT conv_id AS chunk, turn AS pos, {pick(('q_content', 'q_vague', 'q_episodic'), 'conv_id')} AS qtype, conv_id % 40 AS target, left(coalesce(text, ''), 24) AS t FROM conversations WHERE turn % 5 <> 4 AND NOT starts_with(left(coalesce(text, ''), 24), '//')),
    keyed AS (SELECT *, lower(trim(regexp_replace(t, '{W.SPACES}', ' ', 'g'), ' ')) AS key FROM read), pairs AS (SELECT *, row_number() OVER (PARTITION BY target, qtype ORDER BY chunk, pos) AS p FROM keyed WHERE key <> ''),
    firsts AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY chunk, pos) AS n FROM pairs WHERE p = 1)"""
LINKS = "'see [' || title || '](' || url || ') and [x](mailto:y) or [z](https://w.org/z.png).'"
LINK = "'\\[([^\\]]{1,200})\\]\\((https?://[^\\s)]+)\\)'"


def oracle_sql():
    return {
        "embedding_texts": f"WITH {EMBED} SELECT * FROM embedded",
        "embedding_work": f"WITH {EMBED} SELECT count(*) FILTER (id % 3 = 0) AS pending, count(*) FILTER (id % 3 <> 0 AND id % 7 = 0) AS stale, count(*) FILTER (id % 3 <> 0 AND id % 7 <> 0) AS current FROM embedded",
        "anchor_keys": f"WITH {KEYS} SELECT * FROM keys",
        "anchor_edges": f"WITH {KEYS}, members AS (SELECT key, id FROM keys WHERE key IS NOT NULL), {EDGES.format(g='key', m=25, w=0.5)} SELECT * FROM edges",
        "address_gates": f"""WITH h AS (SELECT *, {HOST.format(u='url')} AS host, regexp_matches(trim(url), '(?i)^https?:') AS web FROM pages)
            SELECT page_id, {PRIVACY.format(d=list(PRIVATE), h='host')} AS private, web AND NOT ({PRIVACY.format(d=list(PRIVATE), h='host')}) AS shown, {usable('url', 'host')} AS usable, array_to_string({distinct(SLUG)}[:12], ' ') AS slug FROM h""",
        "query_words": f"""WITH {WORDS} SELECT conv_id, turn, {cjk('text')} AS cjk, md5(seg) AS segments, md5(CASE WHEN len(words) = 0 THEN '-' ELSE array_to_string(list_transform(words, lambda t: '"' || t || '"'), ' OR ') END) AS words,
            CASE WHEN len(parts) > 0 THEN array_to_string(list_transform(parts, lambda t: '"' || t || '"'), ' OR ') END AS parts, array_to_string(list_sort(content), ' ') AS content, lower(trim(regexp_replace(text, '{W.SPACES}', ' ', 'g'), ' ')) AS text_key,
            CASE WHEN han >= 2 THEN 'zh' ELSE 'en' END AS hint, round(ratio, 9) AS cjk_ratio, CASE WHEN length(text) = 0 THEN 'empty' WHEN length(text) < CASE WHEN {cjk('text')} THEN 8 ELSE 15 END THEN 'short' WHEN length(text) > 120 THEN 'long' WHEN len(content) < 2 THEN 'few words'
            WHEN len(regexp_extract_all(text, '[,，;；、/|]')) >= 2 THEN 'list' WHEN {cjk('text')} AND ratio < 0.5 THEN 'not chinese' WHEN NOT {cjk('text')} AND ratio > 0.3 THEN 'not english' ELSE '' END AS shape,
            CASE WHEN length(t) <= 80 THEN t ELSE rtrim(left(t, 79), {SPACE}) || '…' END AS clip, md5(CASE WHEN length(t) = 0 THEN '' WHEN len(s) > 0 THEN array_to_string(s[:5], '|') ELSE left(t, 4000) END) AS sentences,
            CASE WHEN length(text) <= 8 THEN text ELSE left(text, 3) || '...' || right(text, 4) END AS masked, len(list_distinct({SPLIT.format(x="replace(text, ',', ' ')")}))::INTEGER AS listed FROM sent""",
        "folder_rules": f"WITH {BOOKMARKS} SELECT CASE WHEN ('0x' || substr(md5('folder:' || id), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.35 THEN '' ELSE {FOLDER} END AS folder, count(*) AS n FROM marks GROUP BY 1",
        "title_overlap": f"""WITH {BOOKMARKS}, a AS (SELECT *, array_to_string(regexp_split_to_array(body, '{W.SPACES}')[4:11], ' ') AS asked FROM marks), t AS (SELECT id, list_filter({toks('asked')}, lambda x: x NOT IN {listed(W.STOP)} AND NOT regexp_matches(x, {text(W.TIMES)})) AS own, {toks('title')} AS named FROM a),
            n AS (SELECT *, len(list_intersect(own, named)) AS shared FROM t) SELECT id, CASE WHEN shared = len(own) THEN 'title' WHEN shared / greatest(len(own), 1) > 0.5 THEN 'mostly title' ELSE '' END AS overlap FROM n""",
        "reply_coercion": f"WITH {REPLY} SELECT * FROM shaped WHERE summary <> '' OR queries <> ''",
        "reply_claims": f"""WITH c AS (SELECT event_id, unnest(coalesce(from_json({pick(CLAIMS, 'event_id')}::JSON -> '$.claims', '[{{"text":"VARCHAR","sources":["INTEGER"]}}]'), [])) AS c FROM events),
            k AS (SELECT event_id, left(trim(c.text, ' '), 600) AS text, list_sort(list_distinct(list_filter(c.sources, lambda n: n BETWEEN 1 AND 3))) AS n FROM c) SELECT event_id, text, array_to_string(n, ',') AS sources FROM k WHERE text <> '' AND len(n) > 0""",
        "recorded_times": f"WITH t AS (SELECT event_id, {pick(TIMES, 'event_id')} AS raw FROM events) SELECT event_id, {TIME.format(x='raw')} AS seconds FROM t",
        "service_documents": f"WITH {SERVICE} SELECT * FROM service",
        "service_mapping": f"WITH {SERVICE} SELECT count(*) AS docs, count(DISTINCT user) AS users, count(*) FILTER (body <> '') AS with_body, count(*) FILTER (user IN ('u1') AND document <> 'k2') AS filtered FROM service",
        "merge_dedup": f"""WITH {MERGED} SELECT CASE WHEN n = 1 THEN 'kept' ELSE 'text' END AS state, count(*) AS n FROM firsts GROUP BY 1
            UNION ALL SELECT 'pair', count(*) FROM pairs WHERE p > 1 UNION ALL SELECT 'empty', count(*) FROM keyed WHERE key = ''""",
        "folder_collisions": f"WITH p AS (SELECT CASE WHEN page_id % 2 = 0 THEN [replace({HOST.format(u='url')}, '.', '/')] ELSE string_split({HOST.format(u='url')}, '.') END AS path FROM pages) SELECT array_to_string(path, '/') AS folder, count(DISTINCT path) AS paths FROM p GROUP BY 1 HAVING count(DISTINCT path) > 1",
        "markdown_links": f"""WITH t AS (SELECT page_id, url, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '[ \\t\\n\\r]+', ' ', 'g')) AS title FROM pages), l AS (SELECT page_id, {LINKS} AS line FROM t),
            x AS (SELECT page_id, unnest(regexp_extract_all(line, {LINK}, 1)) AS title, unnest(regexp_extract_all(line, {LINK}, 2)) AS url FROM l), h AS (SELECT *, {HOST.format(u='url')} AS host FROM x)
            SELECT page_id, title, url, {usable('url', 'host')} AS usable, CASE WHEN len(regexp_extract_all(title, '[\\x{{4E00}}-\\x{{9FFF}}]')) >= 2 THEN 'zh' ELSE 'en' END AS hint FROM h""",
        "top_words": f"""WITH {BOOKMARKS}, w AS (SELECT id, list_filter(list_transform(regexp_extract_all(body, '[A-Za-z][A-Za-z0-9+_.-]+|[0-9]+'), lambda x: lower(x)), lambda x: length(x) > 1) AS w FROM marks),
            f AS (SELECT id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM w), c AS (SELECT id, word, count(*) AS n, min(pos) AS first FROM f GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, first)::INTEGER AS place FROM c) SELECT id, place, word, n FROM p WHERE place <= 5""",
        "subject_years": f"""WITH {BOOKMARKS}, f AS (SELECT id, year(make_timestamp(date_added * 1000000)) AS saved, unnest(regexp_extract_all(body || ' in ' || (id % 30 + 1995) || ' and ' || (id % 7 + 2018) || '.', '\\b(?:19[89][0-9]|20[0-4][0-9])\\b'))::INTEGER AS y FROM marks WHERE date_added IS NOT NULL),
            c AS (SELECT id, saved, y, count(*) AS n FROM f WHERE y <> saved GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, abs(y - saved) DESC, y DESC) AS r FROM c) SELECT id, y AS subject_year FROM p WHERE r = 1""",
        "calendar_words": f"""WITH {BOOKMARKS}, b AS (SELECT id, date_added - id % 5 * 200 * 86400 AS moment FROM marks WHERE date_added IS NOT NULL), t AS (SELECT id, make_timestamp(moment * 1000000) AS saved, make_timestamp({NOW}::BIGINT * 1000000) AS today, floor(({NOW} - moment) / 86400)::BIGINT AS age FROM b),
            m AS (SELECT *, year(saved) * 12 + month(saved) AS ms, year(today) * 12 + month(today) AS mt, year(today) - year(saved) AS years FROM t)
            SELECT id, array_to_string(list_filter([CASE WHEN ms = mt THEN 'this month' END, CASE WHEN ms = mt - 1 THEN 'last month' END, CASE WHEN age BETWEEN 0 AND 90 THEN 'recently' END, CASE WHEN years = 0 THEN 'this year' END, CASE WHEN years = 1 THEN 'last year' END, CASE WHEN years = 2 THEN 'two years ago' END], lambda x: x IS NOT NULL), ',') AS spoken,
            CASE WHEN age < 30 THEN age || ' d' WHEN age < 365 THEN floor(age / 30)::BIGINT || ' mo' ELSE floor(age / 365)::BIGINT || ' y' END AS age FROM m""",
        "bookmark_rows": f"WITH {BOOKMARKS} SELECT id, md5(title) AS title_md5, left(body, 400) AS head, folder, date_added, url, host FROM marks",
    }
