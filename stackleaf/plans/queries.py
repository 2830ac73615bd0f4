"""The library's queries over the driver tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import columns as C
from ..operators import library as L
from ..operators import ranking as R
from ..operators import timeline as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hosts(spark, d):
    return table(spark, d, "pages").select("page_id", C.host_of(F.col("url")).alias("host"))


def saves(spark, d):
    """Events as saves: (id, user_id, ts in seconds)."""
    return table(spark, d, "events").select(F.col("event_id").alias("id"), "user_id", C.epoch_seconds(F.col("ts")).alias("ts"))


#: The distance that bounds semantic edges: the first percentile of all pairs of these vectors, to two decimals.
FARTHEST = 1.19
#: The verdict that each event type stands for.
VERDICTS = {"error": "gone", "view": "drifted", "click": "restricted", "purchase": "unreachable", "signup": "alive"}


def health(spark, d):
    """Events as a health log of the documents: each event is a check of document event_id % documents."""
    verdict = F.element_at(F.create_map(*(F.lit(x) for kv in VERDICTS.items() for x in kv)), F.col("event_type"))
    n = table(spark, d, "documents").agg(F.greatest(F.count("*"), F.lit(1)).alias("n"))
    e = table(spark, d, "events").join(F.broadcast(n))  # n is one row
    return e.select(F.col("event_id").alias("id"), F.pmod("event_id", "n").alias("bookmark_id"), C.epoch_seconds(F.col("ts")).alias("checked_at"), verdict.alias("verdict"), F.least(F.col("value") / 200, F.lit(1.0)).alias("confidence"))


def probes(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def facets(spark, d):
    """Ranked lists of two facets over the vectors: by inner product, and of the same label by the distance of ids."""
    v = table(spark, d, "embeddings").where("embedding is not null")
    asked = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), "label")
    content = R.nearest(v.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v")), asked.select("query_id", "q"), 50)
    met = v.select(F.col("vec_id").alias("doc_id"), "label").join(asked.select("query_id", "label"), "label").where("doc_id <> query_id")
    label = met.select("query_id", "doc_id", (F.lit(-1.0) * F.abs(F.col("doc_id") - F.col("query_id"))).alias("score"))
    named = lambda rows, facet: rows.select("query_id", F.lit(facet).alias("facet"), "doc_id", "score")
    return R.top(named(content, "content").unionByName(named(label, "label")), 50, "query_id", "facet")


def q_bm25(spark, d):
    return R.bm25(table(spark, d, "documents").select("doc_id", "text"), probes(spark, d), 10)


def q_knn(spark, d):
    return facets(spark, d).where("facet = 'content' and rank <= 10").drop("facet")


def q_mutual(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"))
    return R.mutual(v, 8, FARTHEST)


def q_session_edges(spark, d):
    runs = L.gap_sessions(saves(spark, d), "user_id", 7200)
    return T.scaled_edges(runs.select("user_id", "run", "id"), ["user_id", "run"], 30, 1.0)


def q_domain_edges(spark, d):
    pages = hosts(spark, d).select(C.registrable_domain(F.col("host")).alias("domain"), F.col("page_id").alias("id")).where("domain <> ''")
    return L.group_edges(pages, ["domain"], 25, 0.15)


def q_expand(spark, d):
    seeds = saves(spark, d).where("id % 97 = 0").select(F.col("id").alias("doc_id"), (F.lit(1.0) / (F.lit(1.0) + F.pmod("id", F.lit(10)))).alias("score"))
    return L.expand(seeds, q_session_edges(spark, d))


def q_upsert(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.sha2("url", 256).alias("url_hash"), C.html_title(F.col("html")).alias("title"), C.host_of(F.col("url")).alias("folder"))
    one = lambda p: p.groupBy("url_hash").agg(F.min_by("title", "page_id").alias("title"), F.min_by("folder", "page_id").alias("folder"), F.min("page_id").alias("date_added"))
    return L.upsert(one(pages.where("page_id % 3 <> 0")), one(pages.where("page_id % 2 = 0 or page_id % 3 = 0").withColumn("folder", F.lit(" "))))


def targets(spark, d):
    """The first document that holds a query's passage as it is; queries without one have no answer."""
    items = table(spark, d, "benchmark").where("length(text) > 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))
    docs = table(spark, d, "documents").select("doc_id", "text")
    return docs.join(F.broadcast(items), F.contains("text", "passage")).groupBy("query_id").agg(F.min("doc_id").alias("target"))


def q_recall(spark, d):
    """How well words find the document that holds the query's passage, by its language; a query whose target isn't among ten has rank 0."""
    lang = table(spark, d, "documents").select(F.col("doc_id").alias("target"), "lang")
    found = q_bm25(spark, d).select("query_id", F.col("doc_id").alias("target"), "rank")
    return L.recall_table(targets(spark, d).join(lang, "target").join(found, ["query_id", "target"], "left").select("query_id", "lang", F.coalesce("rank", F.lit(0)).alias("rank")), "lang")


def q_holm(spark, d):
    tests = table(spark, d, "nation").select(F.col("n_name").alias("name"), (F.col("n_nationkey") * F.col("n_nationkey") * F.lit(0.0004) + F.lit(0.0005)).alias("p"))
    return L.holm(tests)


def q_anchor_window(spark, d):
    p = F.percentile("ts", F.array(F.lit(0.1), F.lit(0.9)))
    w = saves(spark, d).groupBy("user_id").agg(F.count("*").alias("n"), p.alias("p")).where("n >= 2")
    return w.select("user_id", F.floor(F.col("p")[0]).alias("lo"), F.floor(F.col("p")[1]).alias("hi"))


def q_host_politeness(spark, d):
    per = hosts(spark, d).groupBy("host").agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("hosts"), F.count_if(F.col("n") == 1).alias("singletons"), F.max("n").alias("busiest"), (F.max("n") * F.lit(0.5)).alias("seconds"))


def queries():
    docs = lambda spark, d: table(spark, d, "documents")
    return {
        "bm25_top10": q_bm25,
        "knn_top10": q_knn,
        "mutual_knn_edges": q_mutual,
        "rrf_fusion": lambda s, d: R.rrf(facets(s, d), {"content": 1.0, "label": 0.7}),
        "rrf_combmax": lambda s, d: R.rrf(facets(s, d), {"content": 1.0, "label": 0.7}, max_bonus=2.361),
        "abstain_confidence": lambda s, d: R.abstain(R.confidence(facets(s, d)), 0.25),
        "interleave_merge": lambda s, d: R.interleave(facets(s, d).drop("score"), "content", "label"),
        "gap_sessions": lambda s, d: L.gap_sessions(saves(s, d), "user_id", 7200),
        "session_rows": lambda s, d: L.session_rows(L.gap_sessions(saves(s, d), "user_id", 7200), "user_id"),
        "session_edges": q_session_edges,
        "domain_edges": q_domain_edges,
        "expand_one_hop": q_expand,
        "import_bursts": lambda s, d: L.bursts(saves(s, d)),
        "anchor_window": q_anchor_window,
        "failure_runs": lambda s, d: L.failure_runs(health(s, d)),
        "confirmed_gone": lambda s, d: L.confirmed_gone(health(s, d)),
        "upsert_merge": q_upsert,
        "recall_mrr_by_type": q_recall,
        "holm": q_holm,
        "host_politeness": q_host_politeness,
        "registrable_domain": lambda s, d: hosts(s, d).withColumn("domain", C.registrable_domain(F.col("host"))),
        "html_title": lambda s, d: table(s, d, "pages").select("page_id", C.html_title(F.col("html")).alias("title")),
        "head_tail_truncate": lambda s, d: docs(s, d).select("doc_id", F.md5(C.head_tail(F.col("text"), 2000)).alias("cut")),
        "lang_tag": lambda s, d: docs(s, d).select("doc_id", C.language_tag(F.col("text")).alias("tag")),
        "snippet_clip": lambda s, d: docs(s, d).select("doc_id", C.snippet(F.col("text")).alias("snippet")),
        "token_df": lambda s, d: R.terms(docs(s, d), "doc_id", "text").groupBy("term").agg(F.count("*").alias("df")),
    }


SAVES = "saves AS (SELECT event_id AS id, user_id, floor(epoch_us(ts) / 1000000)::BIGINT AS ts FROM events)"
RUNS = f"""{SAVES}, marked AS (SELECT *, coalesce((ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, id) > 7200)::INTEGER, 1) AS start FROM saves),
    runs AS (SELECT id, user_id, ts, sum(start) OVER (PARTITION BY user_id ORDER BY ts, id)::BIGINT AS run FROM marked)"""
HEALTH = """log AS (SELECT event_id AS id, event_id % (SELECT greatest(count(*), 1) FROM documents) AS bookmark_id, floor(epoch_us(ts) / 1000000)::BIGINT AS checked_at, least(value / 200, 1.0::DOUBLE) AS confidence,
    CASE event_type WHEN 'error' THEN 'gone' WHEN 'view' THEN 'drifted' WHEN 'click' THEN 'restricted' WHEN 'purchase' THEN 'unreachable' WHEN 'signup' THEN 'alive' END AS verdict FROM events)"""
HOSTS = "hosts AS (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS host FROM pages)"
SUFFIXES = "(" + ", ".join(f"'{x}'" for x in C.TWO_LEVEL) + ")"
DOMAINS = f"""{HOSTS}, split AS (SELECT *, string_split(host, '.') AS l FROM hosts),
    domains AS (SELECT page_id, host, CASE WHEN len(l) <= 2 OR regexp_full_match(host, '[0-9.]*') THEN host
        WHEN l[len(l) - 1] IN {SUFFIXES} THEN array_to_string(l[len(l) - 2:], '.') ELSE array_to_string(l[len(l) - 1:], '.') END AS domain FROM split)"""
FACETS = """met AS (SELECT q.vec_id AS query_id, v.vec_id AS doc_id, v.label = q.label AS same,
        round(list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)), 6) AS dot
        FROM embeddings v JOIN embeddings q ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id),
    scored AS (SELECT query_id, 'content' AS facet, doc_id, dot AS score FROM met UNION ALL SELECT query_id, 'label', doc_id, -abs(doc_id - query_id)::DOUBLE FROM met WHERE same),
    lists AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, facet ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scored) WHERE rank <= 50)"""
EDGES = """small AS (SELECT {g} FROM members GROUP BY {g} HAVING count(*) BETWEEN 2 AND {m}), own AS (SELECT members.* FROM members JOIN small USING ({g})),
    edges AS (SELECT DISTINCT a.id AS src, b.id AS dst, {w}::DOUBLE AS weight FROM own a JOIN own b USING ({g}) WHERE a.id <> b.id)"""
SESSION_EDGES = f"""{RUNS}, members AS (SELECT user_id, run, id, count(*) OVER (PARTITION BY user_id, run) AS n FROM runs),
    edges AS (SELECT a.id AS src, b.id AS dst, max(round(least(1.0::DOUBLE, sqrt(2.0::DOUBLE / a.n)), 4)) AS weight FROM members a JOIN members b USING (user_id, run) WHERE a.id <> b.id AND a.n BETWEEN 2 AND 30 GROUP BY ALL)"""
TARGETS = "targets AS MATERIALIZED (SELECT item_id AS query_id, min(doc_id) AS target FROM benchmark b JOIN documents d ON length(b.text) > 0 AND contains(d.text, b.text) GROUP BY item_id)"
WORDS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')"
BM25 = f"""words AS (SELECT doc_id, {WORDS} AS w FROM documents), flat AS (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM words),
    posted AS (SELECT doc_id, dl, term, count(*) AS tf FROM flat GROUP BY ALL), df AS (SELECT term, count(*)::DOUBLE AS df FROM posted GROUP BY term),
    wanted AS (SELECT DISTINCT item_id AS query_id, unnest({WORDS}) AS term FROM benchmark), stats AS (SELECT count(*)::DOUBLE AS n, avg(len(w)) AS avgdl FROM words),
    found AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
        FROM posted JOIN df USING (term) JOIN wanted USING (term), stats GROUP BY query_id, doc_id),
    hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM found) WHERE rank <= 10)"""
RRF = "SELECT query_id, doc_id, round(sum(t) + {b}::DOUBLE * max(t), 9) AS score, count(*) AS facets FROM (SELECT *, CASE facet WHEN 'content' THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END / (60 + rank) AS t FROM lists) GROUP BY ALL"


def oracle_sql():
    return {
        "bm25_top10": f"WITH {BM25} SELECT * FROM hits",
        "knn_top10": f"WITH {FACETS} SELECT query_id, doc_id, score, rank FROM lists WHERE facet = 'content' AND rank <= 10",
        "mutual_knn_edges": f"""WITH d AS (SELECT a.vec_id AS src, b.vec_id AS dst, round(sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))), 6) AS dist
            FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id), n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS r FROM d) WHERE r <= 8 AND dist <= {FARTHEST})
            SELECT a.src, a.dst, round(0.8::DOUBLE * greatest(0.0::DOUBLE, 1 - a.dist / 2), 4) AS weight FROM n a JOIN n b ON a.src = b.dst AND a.dst = b.src""",
        "rrf_fusion": f"WITH {FACETS} " + RRF.format(b=0.0),
        "rrf_combmax": f"WITH {FACETS} " + RRF.format(b=2.361),
        "abstain_confidence": f"""WITH {FACETS}, c AS (SELECT query_id, facet, round(CASE WHEN count(*) < 3 THEN 1.0::DOUBLE WHEN max(score) - min(score) <= 0 THEN 0.0::DOUBLE
            ELSE (max(score) - median(score)) / (max(score) - min(score)) END, 9) AS confidence FROM lists GROUP BY ALL),
            b AS (SELECT *, max(confidence) OVER (PARTITION BY query_id) AS m, row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, facet DESC) AS r FROM c)
            SELECT query_id, facet, confidence, confidence >= 0.25 OR (m < 0.25 AND r = 1) AS kept FROM b""",
        "interleave_merge": f"""WITH {FACETS}, n AS (SELECT query_id, facet, max(rank) AS n FROM lists GROUP BY ALL),
            s AS (SELECT query_id, CASE WHEN count(*) < 2 THEN 0 ELSE min(n) END AS short FROM n GROUP BY ALL),
            p AS (SELECT query_id, doc_id, (rank > short)::INTEGER * 1000000 + CASE WHEN rank <= short THEN rank * 2 + (facet = 'label')::INTEGER ELSE (facet = 'label')::INTEGER * 100000 + rank END AS k FROM lists JOIN s USING (query_id)),
            f AS (SELECT query_id, doc_id, min(k) AS k FROM p GROUP BY ALL)
            SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY k, doc_id)::INTEGER AS place FROM f""",
        "gap_sessions": f"WITH {RUNS} SELECT * FROM runs",
        "session_rows": f"WITH {RUNS} SELECT user_id, run, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS size FROM runs GROUP BY ALL HAVING count(*) >= 2",
        "session_edges": f"WITH {SESSION_EDGES} SELECT * FROM edges",
        "domain_edges": f"WITH {DOMAINS}, members AS (SELECT domain, page_id AS id FROM domains WHERE domain <> ''), {EDGES.format(g='domain', m=25, w=0.15)} SELECT * FROM edges",
        "expand_one_hop": f"""WITH {SESSION_EDGES}, seeds AS (SELECT id, 1.0::DOUBLE / (1.0::DOUBLE + id % 10) AS score FROM saves WHERE id % 97 = 0),
            o AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS r FROM edges),
            p AS (SELECT dst, src, 0.5::DOUBLE * score * weight AS s FROM o JOIN seeds ON o.src = seeds.id WHERE r <= 20 AND dst NOT IN (SELECT id FROM seeds)),
            b AS (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY s DESC, src) AS k FROM p) SELECT dst AS doc_id, round(s, 9) AS score, src AS via FROM b WHERE k = 1""",
        "import_bursts": f"""WITH {SAVES}, w AS (SELECT *, count(*) OVER (ORDER BY ts RANGE BETWEEN CURRENT ROW AND 599 FOLLOWING) AS c FROM saves),
            m AS (SELECT id, max(c) FILTER (c > 3) OVER (ORDER BY ts RANGE BETWEEN 599 PRECEDING AND CURRENT ROW) AS n FROM w) SELECT id, n FROM m WHERE n IS NOT NULL""",
        "anchor_window": f"WITH {SAVES} SELECT user_id, floor(quantile_cont(ts, 0.1))::BIGINT AS lo, floor(quantile_cont(ts, 0.9))::BIGINT AS hi FROM saves GROUP BY user_id HAVING count(*) >= 2",
        "failure_runs": f"""WITH {HEALTH}, g AS (SELECT *, sum((verdict NOT IN ('gone', 'unreachable'))::INTEGER) OVER (PARTITION BY bookmark_id ORDER BY checked_at DESC, id DESC) AS good FROM log)
            SELECT bookmark_id, count(*) AS failures, min(checked_at) AS failing_since FROM g WHERE good = 0 GROUP BY bookmark_id""",
        "confirmed_gone": f"WITH {HEALTH} SELECT bookmark_id, count(*) AS checks FROM log WHERE verdict = 'gone' AND confidence >= 0.75 GROUP BY bookmark_id HAVING count(*) >= 2 AND max(checked_at) - min(checked_at) >= 604800",
        "upsert_merge": f"""WITH {HOSTS}, t AS (SELECT page_id, sha256(url) AS url_hash, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '[ \\t\\n\\r]+', ' ', 'g')) AS title, host AS folder FROM pages JOIN hosts USING (page_id)),
            o AS (SELECT url_hash, arg_min(title, page_id) AS title, arg_min(folder, page_id) AS folder, min(page_id) AS date_added FROM t WHERE page_id % 3 <> 0 GROUP BY url_hash),
            n AS (SELECT url_hash, arg_min(title, page_id) AS title, '' AS folder, min(page_id) AS date_added FROM t WHERE page_id % 2 = 0 OR page_id % 3 = 0 GROUP BY url_hash)
            SELECT url_hash, coalesce(nullif(n.title, ''), o.title, '') AS title, coalesce(nullif(n.folder, ''), o.folder, '') AS folder, least(o.date_added, n.date_added) AS date_added FROM o FULL JOIN n USING (url_hash)""",
        "recall_mrr_by_type": f"""WITH {BM25}, {TARGETS}, o AS (SELECT lang, coalesce(rank, 0) AS rank FROM targets t JOIN documents d ON d.doc_id = target LEFT JOIN hits h ON h.query_id = t.query_id AND h.doc_id = target)
            SELECT lang, count(*) AS n, round(avg((rank = 1)::INTEGER), 9) AS recall_1, round(avg((rank BETWEEN 1 AND 5)::INTEGER), 9) AS recall_5, round(avg((rank BETWEEN 1 AND 10)::INTEGER), 9) AS recall_10, round(avg(CASE WHEN rank > 0 THEN 1.0::DOUBLE / rank ELSE 0.0 END), 9) AS mrr_10
            FROM o GROUP BY ROLLUP (lang)""",
        "holm": """WITH t AS (SELECT n_name AS name, n_nationkey * n_nationkey * 0.0004::DOUBLE + 0.0005::DOUBLE AS p FROM nation),
            f AS (SELECT *, (p <= 0.05::DOUBLE / (count(*) OVER () - row_number() OVER (ORDER BY p, name) + 1))::INTEGER AS fine FROM t) SELECT name, p, min(fine) OVER (ORDER BY p, name ROWS UNBOUNDED PRECEDING) = 1 AS rejected FROM f""",
        "host_politeness": f"WITH {HOSTS}, n AS (SELECT host, count(*) AS n FROM hosts GROUP BY host) SELECT count(*) AS hosts, count(*) FILTER (n = 1) AS singletons, max(n) AS busiest, max(n) * 0.5::DOUBLE AS seconds FROM n",
        "registrable_domain": f"WITH {DOMAINS} SELECT page_id, host, domain FROM domains",
        "html_title": "SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '[ \\t\\n\\r]+', ' ', 'g')) AS title FROM pages",
        "head_tail_truncate": "SELECT doc_id, md5(CASE WHEN length(text) > 2000 THEN left(text, 1300) || chr(10) || '...' || chr(10) || right(text, 700) ELSE coalesce(text, '') END) AS cut FROM documents",
        "lang_tag": "SELECT doc_id, CASE WHEN coalesce(length(text), 0) = 0 THEN 'unknown' WHEN len(regexp_extract_all(left(text, 2000), '[\\x{3400}-\\x{9FFF}]')) / length(left(text, 2000)) > 0.05 THEN 'zh' ELSE 'en' END AS tag FROM documents",
        "snippet_clip": "SELECT doc_id, left(trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\r]+', ' ', 'g')), 300) AS snippet FROM documents",
        "token_df": f"WITH w AS (SELECT doc_id, unnest(list_distinct({WORDS})) AS term FROM documents) SELECT term, count(*) AS df FROM w GROUP BY term",
    }
