"""Further library queries over the driver tables, and their SQL: addresses, query understanding, lifecycle, paired statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import understanding as U
from ..functions import urls
from ..operators import evaluation as E
from ..operators import library as L
from ..operators import lifecycle as Y
from ..operators import links as K
from ..operators import ranking as R
from .queries import FACETS, HEALTH, HOSTS, RUNS, SAVES, WORDS, facets, health, hosts, saves, table

NOW = 1706745600
GRID = (60, 300, 600, 1200, 1800, 3600, 7200)


def addresses(spark, d):
    url, p = F.col("url"), urls.parts(F.col("url"))
    norm = urls.normalize(url)
    return table(spark, d, "pages").select("page_id", norm.alias("url_norm"), F.sha2(norm, 256).alias("url_hash"), urls.kept_fragment(p).alias("kept_fragment"), urls.indexable(url).alias("indexable"))


def q_dedup(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.sha2(urls.normalize(F.col("url")), 256).alias("url_hash"), C.html_title(F.col("html")).alias("title"))
    longest = F.max_by("title", F.struct(F.length("title"), -F.col("page_id")))
    return pages.groupBy("url_hash").agg(F.count("*").alias("n"), F.min("page_id").alias("first"), longest.alias("title"))


def q_tracking(spark, d):
    names = F.transform(urls.parts(F.col("url")).pairs, lambda x: F.lower(x["k"]))
    found = table(spark, d, "pages").select("page_id", F.explode(names).alias("name")).where(urls.tracks(F.col("name")))
    return found.groupBy("name").agg(F.count("*").alias("n"))


def q_body(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(C.body_canonical(F.col("text")), 256).alias("body_hash"))


def q_similarity(spark, d):
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))
    w = table(spark, d, "documents").select("doc_id", words.alias("w"))
    met = w.join(w.select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("x")), "doc_id")
    both = F.size(F.array_intersect("w", "x"))
    union = F.size("w") + F.size("x") - both
    return met.select("doc_id", F.round(F.when(union == 0, 1.0).otherwise(both / union), 4).alias("similarity"))


def q_understand(spark, d):
    aside = F.element_at(F.array(*map(F.lit, ASIDES)), (F.pmod("conv_id", F.lit(len(ASIDES))) + 1).cast("int"))
    said = F.coalesce("text", F.lit(""))
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") == 0, F.concat(said, F.lit(" "), aside)).otherwise(said).alias("text"))
    return rows.select("conv_id", "turn", *(v.alias(k) for k, v in U.labels(F.col("text"), NOW).items()))


def bookmarks(spark, d):
    h = health(spark, d)
    opens = h.groupBy("bookmark_id").agg(F.count_if(F.col("verdict") == "unreachable").alias("open_count"), F.min("checked_at").alias("date_added"))
    return opens.join(L.latest(h).select("bookmark_id", "verdict"), "bookmark_id", "left")


def cold_layer(spark, d):
    """The whole predicate: unopened, old, and dead or superseded."""
    return Y.cold_flags(bookmarks(spark, d), NOW - 20 * 86400, q_supersession(spark, d))


def q_census(spark, d):
    """Each condition by itself, their conjunction, and how many of the cold could be shown."""
    flags = ("unopened", "old", "dead", "superseded", "cold")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("bookmark_id"), (F.coalesce(F.length("text"), F.lit(0)) >= 200).alias("body"))
    rows = cold_layer(spark, d).join(docs, "bookmark_id", "left")
    return rows.agg(F.count("*").alias("n"), *(F.count_if(f).alias(f) for f in flags), F.count_if(F.col("cold") & F.coalesce("body", F.lit(False))).alias("servable"))


def q_decay(spark, d):
    fused = R.rrf(facets(spark, d), {"content": 1.0, "label": 0.7})
    return Y.decay(fused.select("query_id", "doc_id", "score", (F.pmod("doc_id", F.lit(3)) == 0).alias("cold")))


def q_backoff(spark, d):
    return L.failure_runs(health(spark, d)).select("bookmark_id", "failures", Y.retry_after(F.col("failures")).alias("retry_s"))


def q_queue(spark, d):
    e = saves(spark, d).join(table(spark, d, "events").select(F.col("event_id").alias("id"), "event_type"), "id")
    state = F.when(F.col("event_type") == "click", "leased").when(F.col("event_type") == "error", "failed").otherwise("pending")
    tried = F.pmod("id", F.lit(3))
    queue = e.select("id", state.alias("state"), F.when(state == "leased", F.col("ts")).alias("leased_at"), tried.alias("attempts"), F.when(tried > 0, F.col("ts") + 600).alias("next_attempt_at"), F.col("ts").alias("queued_at"))
    return Y.lease(queue, 1705000000, 50).select("id", "state", "attempts")


def q_calibration(spark, d):
    rows = saves(spark, d).join(table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("folder")), "id")
    return Y.calibration(rows, "user_id", "folder", GRID)


def q_units(spark, d):
    scale = F.pmod("user_id", F.lit(4))
    us = F.col("ts") * 1_000_000
    raw = F.when(scale == 0, F.col("ts")).when(scale == 1, F.col("ts") * 1000).when(scale == 2, us).otherwise(us + F.lit(11_644_473_600_000_000))
    files = saves(spark, d).select("user_id", raw.alias("raw"))
    unit = C.time_unit(F.col("raw"), NOW)
    votes = files.select("user_id", "raw", unit.alias("unit")).groupBy("user_id", "unit").agg(F.count("*").alias("n"), F.min("raw").alias("least"))
    return votes.groupBy("user_id").agg(F.max_by(F.struct("unit", "n", "least"), F.struct("n", "unit")).alias("x")).select("user_id", "x.unit", F.col("x.n").alias("votes"), C.to_seconds(F.col("x.least"), F.col("x.unit")).alias("first"))


def q_stale(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("fp"))
    stored = docs.where("doc_id % 3 <> 0").select("doc_id", F.when(F.col("doc_id") % 7 == 0, "old").otherwise(F.col("fp")).alias("stored"))
    state = F.when(F.col("stored").isNull(), "pending").when(F.col("stored") != F.col("fp"), "stale").otherwise("current")
    return docs.join(stored, "doc_id", "left").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def hits(spark, d):
    """Each query's hits of two facets: is a document of an id divisible by 7 among its first five?"""
    hit = lambda f: F.coalesce(F.max((F.col("facet") == f) & (F.col("doc_id") % 7 == 0)), F.lit(False))
    return facets(spark, d).where("rank <= 5").groupBy("query_id").agg(hit("content").alias("a"), hit("label").alias("b"))


def q_bootstrap(spark, d):
    placed = hits(spark, d).select((F.col("query_id") / 50).cast("long").alias("place"), (F.col("b").cast("int") - F.col("a").cast("int")).alias("diff"))
    return E.bootstrap_ci(placed, 200)


def q_cold_whole(spark, d):
    return cold_layer(spark, d).where("cold").select("bookmark_id", "verdict", "superseded")


def q_bonus(spark, d):
    depth = F.col("n_nationkey") * 10
    return table(spark, d, "nation").select(depth.alias("depth"), R.guarantee_bonus(depth, (1.0, 1.0, 1.0, 0.7)).alias("bonus"))


def q_pages(spark, d):
    asked = table(spark, d, "nation").select(F.col("n_nationkey").alias("request"), (F.col("n_nationkey") * 20 - 10).alias("asked"), (F.col("n_regionkey") * 700).alias("skipped"))
    return asked.select("request", *(v.alias(k) for k, v in R.page_window(F.col("asked"), F.col("skipped")).items()))


def q_supersession(spark, d):
    title = F.split_part(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(1))
    return K.supersession_edges(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("domain"), title.alias("title"), (F.col("doc_id") * 40_000).alias("date")))


def q_folders(spark, d):
    members = hosts(spark, d).select(F.col("page_id").alias("id"), F.col("host").alias("folder"))
    anchors = members.where("id % 10 = 0").select("id", (1.0 / (1.0 + F.lit(0.2) * F.expr("id div 10 % 10"))).alias("strength"))
    return K.folder_peers(anchors, members).select("id", F.round("strength", 9).alias("strength"))


def q_intents(spark, d):
    probed = facets(spark, d).where("facet = 'label'").select(F.col("query_id").alias("bookmark_id"), F.col("doc_id").alias("id"), F.when(F.col("rank") % 5 != 0, F.col("rank")).alias("probe_rank"))
    return K.keep_intents(probed, 3, 10).groupBy("bucket").agg(F.count("*").alias("n"), F.count_if("kept").alias("kept"))


def q_diff(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.sha2(urls.normalize(F.col("url")), 256).alias("url_hash"), C.html_title(F.col("html")).alias("title"))
    one = lambda p: p.groupBy("url_hash").agg(F.min_by("title", "page_id").alias("title"))
    return K.library_diff(one(pages.where("page_id % 3 <> 0")), one(pages.where("page_id % 2 = 0 or page_id % 3 = 0")), "url_hash", ("title",))


def queries():
    return {
        "url_normalize": addresses,
        "url_dedup_groups": q_dedup,
        "tracking_params": q_tracking,
        "body_hash_dups": q_body,
        "drift_similarity": q_similarity,
        "understand_labels": q_understand,
        "cold_set": q_cold_whole,
        "cold_census": q_census,
        "decay_rerank": q_decay,
        "backoff_schedule": q_backoff,
        "queue_lease": q_queue,
        "eps_calibration_purity": q_calibration,
        "timestamp_unit_vote": q_units,
        "stale_fingerprints": q_stale,
        "mcnemar": lambda s, d: E.mcnemar(hits(s, d)),
        "bootstrap_ci": q_bootstrap,
        "overlap_at_k": lambda s, d: E.overlap_at(facets(s, d), "content", "label", 10),
        "guarantee_bonus": q_bonus,
        "page_window": q_pages,
        "supersession_edges": q_supersession,
        "folder_peers": q_folders,
        "intent_keep": q_intents,
        "library_diff": q_diff,
    }


def listed(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


PAIRS = "list_transform(list_filter(string_split({q}, '&'), lambda x: x <> ''), lambda x: {{'k': url_decode(replace(regexp_extract(x, '^([^=]*)', 1), '+', ' ')), 'v': url_decode(replace(regexp_extract(x, '^[^=]*=(.*)$', 1), '+', ' '))}})"
PATH_SQL = "url_encode(url_decode(path))"
for _c in urls.SAFE:
    PATH_SQL = f"replace({PATH_SQL}, '%{ord(_c):02X}', {quoted(_c)})"
ADDRESSES = f"""split AS (SELECT page_id, html, trim(url) AS u, lower(regexp_extract(trim(url), '{urls.SPLIT}', 1)) AS scheme, regexp_extract(trim(url), '{urls.SPLIT}', 2) AS auth, regexp_extract(trim(url), '{urls.SPLIT}', 3) AS path,
        {PAIRS.format(q=f"regexp_extract(trim(url), '{urls.SPLIT}', 4)")} AS pairs, regexp_extract(trim(url), '{urls.SPLIT}', 5) AS frag FROM pages),
    named AS (SELECT *, lower(regexp_extract(auth, '^(?:[^@]*@)?([^:]*)', 1)) AS h0, regexp_extract(auth, ':([0-9]+)$', 1) AS port FROM split),
    bare AS (SELECT *, CASE WHEN h0 LIKE 'www.%' AND length(h0) - length(replace(h0, '.', '')) >= 2 THEN substr(h0, 5) ELSE h0 END AS host,
        array_to_string(list_transform(list_sort(list_filter(pairs, lambda x: NOT (lower(x.k) IN {listed(urls.TRACKING)} OR regexp_matches(lower(x.k), '{urls.TRACKING_PREFIX}')))), lambda x: replace(url_encode(x.k), '%20', '+') || '=' || replace(url_encode(x.v), '%20', '+')), '&') AS query,
        regexp_replace(regexp_replace({PATH_SQL}, '/+', '/', 'g'), '/$', '') AS p FROM named),
    kept AS (SELECT *, CASE WHEN regexp_matches(frag, '^[!/]') OR host IN {listed(urls.ANCHOR_HOSTS)} THEN frag ELSE '' END AS kept_fragment FROM bare),
    addresses AS (SELECT page_id, html, kept_fragment, scheme IN ('http', 'https') AS indexable, CASE WHEN scheme IN ('http', 'https') THEN 'https://' || host
        || CASE WHEN port <> '' AND port <> (CASE scheme WHEN 'http' THEN '80' ELSE '443' END) THEN ':' || port ELSE '' END || CASE p WHEN '' THEN '/' ELSE p END
        || CASE WHEN query <> '' THEN '?' || query ELSE '' END || CASE WHEN kept_fragment <> '' THEN '#' || kept_fragment ELSE '' END ELSE u END AS url_norm FROM kept)"""
TITLE = "trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '[ \\t\\n\\r]+', ' ', 'g'))"
BODY = "coalesce(text, '')"
for _p in C.CHURN:
    BODY = f"regexp_replace({BODY}, {quoted(_p)}, ' ', 'g')"
BODY = f"trim(regexp_replace(array_to_string(list_filter(list_transform(string_split({BODY}, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: length(x) > 2), ' '), '[ \\t\\n\\r]+', ' ', 'g'))"
BOOKMARKS = f"""{HEALTH}, l AS (SELECT *, row_number() OVER (PARTITION BY bookmark_id ORDER BY checked_at DESC, id DESC) AS r FROM log),
    b AS (SELECT bookmark_id, count(*) FILTER (verdict = 'unreachable') = 0 AS unopened, min(checked_at) < {NOW - 20 * 86400} AS old, any_value(verdict) FILTER (r = 1) AS verdict FROM l GROUP BY bookmark_id),
    flags AS (SELECT *, verdict IN ('gone', 'drifted', 'soft_gone') AS dead FROM b)"""
HITS = f"{FACETS}, hits AS (SELECT query_id, bool_or(facet = 'content' AND doc_id % 7 = 0) AS a, bool_or(facet = 'label' AND doc_id % 7 = 0) AS b FROM lists WHERE rank <= 5 GROUP BY query_id)"
def n_ago(group: int) -> str:
    return f"regexp_extract(low, {quoted(U.AGO)}, {group})"


RELATIVE = " ".join(f"WHEN regexp_matches(low, {quoted(p)}) THEN {{'rule': 'relative', 'lo': {NOW - a * 86400}::BIGINT, 'hi': {int(NOW - z * 86400)}::BIGINT}}" for p, a, z in U.RELATIVE)
COUNT = n_ago(1)


def digit(x: str, empty: int) -> str:
    return f"CASE {x} WHEN '' THEN {empty} {' '.join(f"WHEN '{k}' THEN {v}" for k, v in U.NUMERALS.items())} END"


NUMERAL = f"CASE WHEN contains({COUNT}, '{U.TEN}') THEN ({digit(f"split_part({COUNT}, '{U.TEN}', 1)", 1)}) * 10 + ({digit(f"substr({COUNT}, instr({COUNT}, '{U.TEN}') + 1)", 0)}) ELSE CASE {COUNT} {' '.join(f"WHEN '{k}' THEN {v}" for k, v in U.NUMERALS.items())} END END"


def understand(rows: str) -> str:
    """The rules over rows with their text t and its lower case, low."""
    return f"""t AS ({rows}),
    n AS (SELECT *, CASE {n_ago(2)} {" ".join(f"WHEN '{k}' THEN {v}" for k, v in U.UNITS.items())} END * 86400 AS unit, greatest(coalesce(try_cast({n_ago(1)} AS INTEGER), CASE {n_ago(1)} {" ".join(f"WHEN '{k}' THEN {v}" for k, v in U.COUNTS.items())} END, {NUMERAL}, 1), 1) AS c,
        try_cast(regexp_extract(t, {quoted(U.YEAR)}, 1) AS INTEGER) AS y FROM t),
    w AS (SELECT *, CASE WHEN regexp_matches(low, {quoted(U.AGO)}) THEN {{'rule': 'n_ago', 'lo': ({NOW} - c * unit - greatest(unit // 2, 86400))::BIGINT, 'hi': least({NOW} - c * unit + greatest(unit // 2, 86400), {NOW})::BIGINT}} {RELATIVE}
        WHEN y IS NOT NULL THEN {{'rule': 'absolute_year', 'lo': date_diff('day', DATE '1970-01-01', make_date(y, 1, 1)) * 86400, 'hi': date_diff('day', DATE '1970-01-01', make_date(y + 1, 1, 1)) * 86400}} END AS win,
        regexp_matches(low, {quoted("|".join(U.VAGUE))}) AS vague, regexp_matches(t, {quoted(U.URL)}) AS isurl FROM n),
    f AS (SELECT *, regexp_matches(t, {quoted(U.QUOTED)}) OR regexp_matches(t, {quoted(U.IDENTIFIER)}) OR isurl AS lexical, isurl OR regexp_matches(t, {quoted(U.DOMAIN)}) AS navigational, win IS NOT NULL OR vague AS episodic FROM w)"""


ASIDES = ("三个月前 存的", "3天前", "十二周前看的", "a couple of weeks ago", 'the "exact words" and "more of it"', "去年", "两年前的 CamelCase", "二十一天前 example.com")
SPOKEN = f"CASE WHEN turn = 0 THEN coalesce(text, '') || ' ' || ([{', '.join(quoted(x) for x in ASIDES)}])[(conv_id % {len(ASIDES)} + 1)::BIGINT] ELSE coalesce(text, '') END"
UNDERSTAND = understand(f"SELECT conv_id, turn, trim(x) AS t, lower(trim(x)) AS low FROM (SELECT conv_id, turn, {SPOKEN} AS x FROM conversations)")


def oracle_sql():
    sql = {
        "url_normalize": f"WITH {ADDRESSES} SELECT page_id, url_norm, sha256(url_norm) AS url_hash, kept_fragment, indexable FROM addresses",
        "url_dedup_groups": f"WITH {ADDRESSES}, t AS (SELECT page_id, sha256(url_norm) AS url_hash, {TITLE} AS title FROM addresses) SELECT url_hash, count(*) AS n, min(page_id) AS first, first(title ORDER BY length(title) DESC, page_id) AS title FROM t GROUP BY url_hash",
        "tracking_params": f"WITH {ADDRESSES}, n AS (SELECT lower(unnest(list_transform(pairs, lambda x: x.k))) AS name FROM split) SELECT name, count(*) AS n FROM n WHERE name IN {listed(urls.TRACKING)} OR regexp_matches(name, '{urls.TRACKING_PREFIX}') GROUP BY name",
        "body_hash_dups": f"SELECT doc_id, sha256({BODY}) AS body_hash FROM documents",
        "drift_similarity": f"""WITH w AS (SELECT doc_id, list_distinct({WORDS}) AS w FROM documents), m AS (SELECT a.doc_id, len(list_intersect(a.w, b.w)) AS i, len(a.w) + len(b.w) AS n FROM w a JOIN w b ON b.doc_id = a.doc_id + 1)
            SELECT doc_id, round(CASE WHEN n - i = 0 THEN 1.0::DOUBLE ELSE i::DOUBLE / (n - i) END, 4) AS similarity FROM m""",
        "understand_labels": f"""WITH {UNDERSTAND} SELECT conv_id, turn, lexical, navigational, episodic, t <> '' AND NOT (navigational AND NOT lexical AND NOT episodic) AS semantic, win.rule AS time_rule, win.lo AS lo, win.hi AS hi,
            CASE WHEN win IS NOT NULL THEN 1.0::DOUBLE WHEN vague THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END AS confidence,
            episodic AND (coalesce(win.rule, '') <> 'absolute_year' OR vague OR regexp_matches(low, {quoted("|".join(U.SAVING))})) AS gate,
            array_to_string(list_transform(regexp_extract_all(t, {quoted(U.QUOTED)}, 1), lambda p: trim(p, ' ')), '|') AS phrases, array_to_string(list_filter([CASE WHEN regexp_matches(t, {quoted(U.QUOTED)}) THEN 'quoted' END, CASE WHEN regexp_matches(t, {quoted(U.IDENTIFIER)}) THEN 'identifier' END,
            CASE WHEN isurl THEN 'url' WHEN regexp_matches(t, {quoted(U.DOMAIN)}) THEN 'domain' END, 'time:' || win.rule, CASE WHEN vague THEN 'episodic_marker' END], lambda x: x IS NOT NULL), ',') AS rules FROM f""",
        "decay_rerank": f"""WITH {FACETS}, fused AS (SELECT query_id, doc_id, round(sum(CASE facet WHEN 'content' THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END / (60 + rank)), 9) AS score FROM lists GROUP BY ALL),
            j AS (SELECT *, coalesce(max(score) FILTER (doc_id % 3 <> 0) OVER (PARTITION BY query_id) < 0.02, true) AS rescued FROM fused)
            SELECT query_id, doc_id, round(CASE WHEN doc_id % 3 = 0 AND NOT rescued THEN score * 0.5::DOUBLE ELSE score END, 9) AS score, rescued FROM j""",
        "backoff_schedule": f"""WITH {HEALTH}, g AS (SELECT *, sum((verdict NOT IN ('gone', 'unreachable'))::INTEGER) OVER (PARTITION BY bookmark_id ORDER BY checked_at DESC, id DESC) AS good FROM log)
            SELECT bookmark_id, count(*) AS failures, least(86400 * pow(2, least(count(*), 20) - 1), 2592000)::BIGINT AS retry_s FROM g WHERE good = 0 GROUP BY bookmark_id""",
        "queue_lease": f"""WITH {SAVES}, q AS (SELECT id, saves.ts AS ts, id % 3 AS attempts, CASE event_type WHEN 'click' THEN 'leased' WHEN 'error' THEN 'failed' ELSE 'pending' END AS state FROM saves JOIN events ON event_id = id)
            SELECT id, 'leased' AS state, attempts + 1 AS attempts FROM q WHERE (state = 'pending' OR (state = 'leased' AND ts < 1705000000 - 300)) AND (attempts = 0 OR ts + 600 <= 1705000000) ORDER BY ts, id LIMIT 50""",
        "eps_calibration_purity": f"""WITH {SAVES}, g AS (SELECT saves.*, event_type AS folder, unnest({list(GRID)})::INTEGER AS eps FROM saves JOIN events ON event_id = id),
            m AS (SELECT *, coalesce((ts - lag(ts) OVER (PARTITION BY eps, user_id ORDER BY ts, id) > eps)::INTEGER, 1) AS start FROM g),
            r AS (SELECT *, sum(start) OVER (PARTITION BY eps, user_id ORDER BY ts, id) AS run FROM m), c AS (SELECT eps, user_id, run, folder, count(*) AS c FROM r GROUP BY ALL),
            p AS (SELECT eps, user_id, run, sum(c) AS n, sum(c * (c - 1) / 2) AS same FROM c GROUP BY ALL)
            SELECT eps, count(*) FILTER (n >= 2) AS sessions, round(coalesce(sum(n) FILTER (n >= 2), 0)::DOUBLE / sum(n)::DOUBLE, 9) AS coverage,
                round(CASE WHEN count(*) FILTER (n >= 2) > 0 THEN sum(same) FILTER (n >= 2) / sum(n * (n - 1) / 2) FILTER (n >= 2) ELSE 0 END, 9)::DOUBLE AS purity FROM p GROUP BY eps""",
        "timestamp_unit_vote": f"""WITH {SAVES} SELECT user_id, CASE user_id % 4 WHEN 0 THEN 'unix_s' WHEN 1 THEN 'unix_ms' WHEN 2 THEN 'unix_us' ELSE 'webkit_us' END AS unit, count(*) AS votes, min(ts) AS first FROM saves GROUP BY user_id""",
        "stale_fingerprints": "SELECT CASE WHEN doc_id % 3 = 0 THEN 'pending' WHEN doc_id % 7 = 0 THEN 'stale' ELSE 'current' END AS state, count(*) AS n FROM documents GROUP BY state",
        "mcnemar": f"""WITH {HITS}, n AS (SELECT count(*) FILTER (b AND NOT a) AS gained, count(*) FILTER (a AND NOT b) AS lost FROM hits),
            t AS (SELECT gained, lost, coalesce(sum(exp(lgamma(gained + lost + 1) - lgamma(i + 1) - lgamma(gained + lost - i + 1) - (gained + lost) * ln(2))), 0) AS tail FROM (SELECT *, unnest(range(least(gained, lost) + 1)) AS i FROM n) GROUP BY gained, lost)
            SELECT gained, lost, round(CASE WHEN gained + lost = 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, 2 * tail) END, 5) AS p FROM t""",
        "bootstrap_ci": f"""WITH {HITS}, d AS (SELECT query_id // 50 AS place, b::INTEGER - a::INTEGER AS diff FROM hits), n AS (SELECT count(*) AS n FROM d),
            w AS (SELECT r, ('0x' || substr(md5('11:' || r || ':' || place), 1, 8))::BIGINT % n AS place FROM d, n, range(200) AS x(r)),
            m AS (SELECT r, avg(diff) AS mean FROM w JOIN d USING (place) GROUP BY r), o AS (SELECT list_sort(list(mean)) AS m FROM m) SELECT round(m[5] * 100, 2) AS lo, round(m[196] * 100, 2) AS hi FROM o""",
        "overlap_at_k": f"""WITH {FACETS}, t AS (SELECT * FROM lists WHERE rank <= 10), c AS (SELECT query_id, count(*) FILTER (n = 2) AS common FROM (SELECT query_id, doc_id, count(*) AS n FROM t GROUP BY ALL) GROUP BY query_id),
            s AS (SELECT query_id, least(count(*) FILTER (facet = 'content'), count(*) FILTER (facet = 'label')) AS n FROM t GROUP BY query_id) SELECT query_id, round(common::DOUBLE / greatest(n, 1), 9) AS overlap FROM c JOIN s USING (query_id)""",
        "guarantee_bonus": "SELECT n_nationkey * 10 AS depth, round(CASE WHEN n_nationkey * 10 <= 1 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, (61 * 3.7::DOUBLE - (60 + n_nationkey * 10)) / (n_nationkey * 10 - 1)) END, 9) AS bonus FROM nation",
        "page_window": """WITH a AS (SELECT n_nationkey AS request, greatest(1, least(n_nationkey * 20 - 10, 200)) AS "limit", greatest(0, least(n_regionkey * 700, 1999)) AS "offset" FROM nation),
            w AS (SELECT *, greatest(50, "limit" + "offset") AS want FROM a) SELECT request, "limit", "offset", least(want, 2000) AS depth, want > 2000 AS ceiling_hit FROM w""",
        "supersession_edges": """WITH w AS (SELECT doc_id, source, list_distinct(list_filter(regexp_split_to_array(trim(split_part(coalesce(text, ''), chr(10), 1)), '[ \\t\\n\\r]+'), lambda x: length(x) > 1)) AS w FROM documents),
            m AS (SELECT a.doc_id AS src, b.doc_id AS dst, len(list_intersect(a.w, b.w))::DOUBLE AS i, len(a.w) + len(b.w) AS n FROM w a JOIN w b ON a.source = b.source AND b.doc_id - a.doc_id >= 3 AND len(a.w) > 0 AND len(b.w) > 0)
            SELECT src, dst, round(0.7::DOUBLE * (i / (n - i)), 4) AS weight FROM m WHERE i / (n - i) >= 0.8::DOUBLE""",
        "folder_peers": f"""WITH {HOSTS}, s AS (SELECT host FROM hosts WHERE host <> '' GROUP BY host HAVING count(*) <= 40),
            a AS (SELECT host, max(1.0::DOUBLE / (1.0::DOUBLE + 0.2::DOUBLE * (page_id // 10 % 10))) AS strength FROM hosts JOIN s USING (host) WHERE page_id % 10 = 0 GROUP BY host) SELECT page_id AS id, round(strength, 9) AS strength FROM hosts JOIN a USING (host)""",
        "intent_keep": f"""WITH {FACETS}, p AS (SELECT query_id, doc_id, CASE WHEN rank % 5 <> 0 THEN rank END AS r FROM lists WHERE facet = 'label'),
            k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY r NULLS LAST, doc_id) AS place FROM p)
            SELECT CASE WHEN r IS NULL THEN 'not_found' WHEN r = 1 THEN '1' WHEN r <= 3 THEN '2-3' WHEN r <= 10 THEN '4-k' ELSE '>k' END AS bucket, count(*) AS n, count(*) FILTER (r <= 10 AND place <= 3) AS kept FROM k GROUP BY bucket""",
        "library_diff": f"""WITH {ADDRESSES}, t AS (SELECT page_id, sha256(url_norm) AS url_hash, {TITLE} AS title FROM addresses), a AS (SELECT url_hash, arg_min(title, page_id) AS title FROM t WHERE page_id % 3 <> 0 GROUP BY url_hash),
            b AS (SELECT url_hash, arg_min(title, page_id) AS title FROM t WHERE page_id % 2 = 0 OR page_id % 3 = 0 GROUP BY url_hash)
            SELECT count(*) FILTER (a.url_hash IS NOT NULL AND b.url_hash IS NOT NULL) AS common, count(*) FILTER (b.url_hash IS NULL) AS only_first, count(*) FILTER (a.url_hash IS NULL) AS only_second,
                count(*) FILTER (a.url_hash IS NOT NULL AND b.url_hash IS NOT NULL AND a.title IS NOT DISTINCT FROM b.title) AS same_title FROM a FULL JOIN b ON a.url_hash = b.url_hash""",
    }
    # Unopened and old, and dead or with an edge of the supersession query.
    layer = f"""{BOOKMARKS}, newer AS ({sql["supersession_edges"]}), f AS (SELECT flags.*, bookmark_id IN (SELECT src FROM newer) AS superseded FROM flags), layer AS (SELECT *, unopened AND old AND (coalesce(dead, false) OR superseded) AS cold FROM f)"""
    sql["cold_set"] = f"WITH {layer} SELECT bookmark_id, verdict, superseded FROM layer WHERE cold"
    sql["cold_census"] = f"""WITH {layer} SELECT count(*) AS n, count(*) FILTER (unopened) AS unopened, count(*) FILTER (old) AS old, count(*) FILTER (dead) AS dead, count(*) FILTER (superseded) AS superseded, count(*) FILTER (cold) AS cold,
        count(*) FILTER (cold AND length(text) >= 200) AS servable FROM layer LEFT JOIN documents ON doc_id = bookmark_id"""
    return sql
