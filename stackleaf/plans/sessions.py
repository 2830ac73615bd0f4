"""Sessions over the whole timeline, their calibration, edges of all kinds and what is near a save, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import columns as C
from ..operators import library as L
from ..operators import timeline as T
from . import texts as X
from .more import GRID, q_supersession
from .queries import table

GAPS = (*GRID[:4], 1800, 2700, 3600, 5400, 7200, 10800, 14400)
EPS = 300


def timeline(spark, d):
    return X.bookmarks(spark, d).select("id", F.col("date_added").alias("ts"), "folder", "title", "host")


def grouped(spark, d):
    return T.sessions(timeline(spark, d), EPS)


def q_sessions(spark, d):
    return grouped(spark, d).select("id", "ts", "session")


def q_listing(spark, d):
    """Sessions of three or more, newest first, with their members in order: header, size, titles by time."""
    rows = grouped(spark, d).where("session >= 0")
    header = rows.groupBy("session").agg(F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), F.count("*").alias("size"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "id"))), lambda x: x["id"].cast("string")), ",").alias("members"))
    return header.where("size >= 3").orderBy(F.col("started_at").desc(), "session")


def q_stats(spark, d):
    rows = grouped(spark, d)
    sizes = rows.where("session >= 0").groupBy("session").agg(F.count("*").alias("size"))
    return sizes.agg(F.count("*").alias("sessions"), F.sum("size").alias("assigned"), F.percentile("size", F.lit(0.5)).alias("median_size")).join(rows.agg(F.count("*").alias("dated")))  # one row each


def q_scan(spark, d):
    return T.scan(timeline(spark, d).select("id", "ts", "folder"), GAPS)


def q_chosen(spark, d):
    return T.chosen(q_scan(spark, d))


def q_isolated(spark, d):
    """Saves with no other within half an hour."""
    near = T.neighbours(timeline(spark, d).select("id", "ts"))
    alone = (F.coalesce(F.col("ts") - F.col("before"), F.lit(10**9)) > 1800) & (F.coalesce(F.col("after") - F.col("ts"), F.lit(10**9)) > 1800)
    return near.select("id", alone.alias("alone"))


def q_beside(spark, d):
    """The number of a save's session neighbours and a digest of their titles in order."""
    rows = grouped(spark, d).where("session >= 0").select("session", "id", F.md5("title").alias("text"))
    return T.digests_of_others(rows, "session").withColumnRenamed("digest", "titles")


def q_peers(spark, d):
    """Session peers of every tenth save as an anchor: the strongest anchor counts."""
    rows = grouped(spark, d).where("session >= 0").select("session", "id")
    anchors = rows.where("id % 10 = 0").select("session", F.col("id").alias("anchor"), (1.0 / (1.0 + F.lit(0.2) * F.expr("id div 10 % 10"))).alias("strength"))
    return T.best_other(rows, anchors, ["session"]).select("id", F.round("strength", 9).alias("strength"))


def edges(spark, d):
    """All kinds of edges between bookmarks, rebuilt as a whole: sessions, domains, anchors, newer versions."""
    rows = timeline(spark, d)
    session = T.scaled_edges(grouped(spark, d).where("session >= 0").select("session", "id"), ["session"], 30, 1.0)
    domain = L.group_edges(rows.select(C.registrable_domain(F.col("host")).alias("domain"), "id").where("domain <> ''"), ["domain"], 25, 0.15)
    newer = q_supersession(spark, d)
    kinds = {"session": session, "same_domain": domain, "supersession": newer}
    out = None
    for kind, e in kinds.items():
        one = e.select("src", "dst", F.lit(kind).alias("kind"), "weight")
        out = one if out is None else out.unionByName(one)
    return out.dropDuplicates(["src", "dst", "kind"])


def q_related(spark, d):
    """Neighbours of every tenth bookmark by kind, the heaviest ten of each, the kind of the heaviest edge first."""
    e = edges(spark, d).where("src % 10 = 0")
    place = F.row_number().over(Window.partitionBy("src", "kind").orderBy(F.col("weight").desc(), "dst"))
    top = F.max("weight").over(Window.partitionBy("src", "kind"))
    kept = e.withColumns({"place": place.cast("int"), "top": top}).where("place <= 10")
    kind_place = F.dense_rank().over(Window.partitionBy("src").orderBy(F.col("top").desc(), "kind"))
    return kept.select("src", "dst", "kind", "weight", "place", kind_place.cast("int").alias("kind_place"))


def q_kinds(spark, d):
    """The graph's counts by kind and each kind's share."""
    c = edges(spark, d).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("src").alias("sources"), F.round(F.avg("weight"), 6).alias("mean_weight"))
    return c.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 9))  # a row a kind


def q_ages(spark, d):
    """Percentiles of the age in days and the shares beyond 10, 20 and 25 days, by nearest rank on the floor."""
    age = ((F.lit(1706745600) - F.col("ts")) / 86400).alias("age")
    a = timeline(spark, d).where("ts is not null").select(age)
    p = F.percentile("age", F.array(*map(F.lit, (0.05, 0.5, 0.95))))
    share = lambda days: F.round(F.avg((F.col("age") > days).cast("double")), 9)
    return a.agg(F.count("*").alias("n"), F.round(p[0], 6).alias("p05"), F.round(p[1], 6).alias("p50"), F.round(p[2], 6).alias("p95"), share(10).alias("over_10"), share(20).alias("over_20"), share(25).alias("over_25"))


def queries():
    return {
        "timeline_sessions": q_sessions,
        "session_listing": q_listing,
        "session_stats": q_stats,
        "eps_scan": q_scan,
        "eps_chosen": q_chosen,
        "isolated_saves": q_isolated,
        "session_neighbours": q_beside,
        "session_peers": q_peers,
        "edges_all": edges,
        "related_by_kind": q_related,
        "edge_kinds": q_kinds,
        "age_percentiles": q_ages,
    }


TIMELINE = f"{X.BOOKMARKS}, line AS (SELECT id, date_added AS ts, folder, title, host FROM marks WHERE date_added IS NOT NULL)"


def sessions(eps: str, rows: str = "line", out: str = "grouped", by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    more = f"{by}, " if by else ""
    return f"""{out}_s AS (SELECT *, coalesce((ts - lag(ts) OVER ({part}ORDER BY ts, id) > {eps})::INTEGER, 1) AS st FROM {rows}), {out}_r AS (SELECT *, sum(st) OVER ({part}ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS run FROM {out}_s),
    {out}_n AS (SELECT {more}run, row_number() OVER ({part}ORDER BY run) - 1 AS session FROM {out}_r GROUP BY {more}run HAVING count(*) >= 2), {out} AS (SELECT * EXCLUDE (st, run, session), coalesce(session, -1) AS session FROM {out}_r LEFT JOIN {out}_n USING ({more}run))"""


GROUPED = f"{TIMELINE}, {sessions(str(EPS))}"
SCAN = f"""{TIMELINE}, gaps AS (SELECT unnest([{', '.join(map(str, GAPS))}])::INTEGER AS eps), tried AS (SELECT * FROM line, gaps), {sessions('eps', 'tried', 'g', 'eps')}, kept AS (SELECT * FROM g WHERE session >= 0),
    sizes AS (SELECT eps, session, count(*) AS size FROM kept GROUP BY ALL), stats AS (SELECT eps, count(*) AS sessions, sum(size)::BIGINT AS covered, quantile_cont(size, 0.5) AS median_size FROM sizes GROUP BY eps),
    dealt AS (SELECT s AS shuffle, id, row_number() OVER (PARTITION BY s ORDER BY md5(s || ':' || id)) AS k FROM line, range(20) AS r(s)), src AS (SELECT folder, row_number() OVER (ORDER BY id) AS k FROM line), mixed AS (SELECT shuffle, id, folder FROM dealt JOIN src USING (k)),
    own AS (SELECT eps, session, folder, count(*) AS c FROM kept GROUP BY ALL), op AS (SELECT eps, session, sum(c) AS n, sum(c * (c - 1) / 2) AS same FROM own GROUP BY ALL), pure AS (SELECT eps, CASE WHEN sum(n * (n - 1) / 2) > 0 THEN sum(same) / sum(n * (n - 1) / 2) ELSE 0.0 END AS purity FROM op GROUP BY eps),
    mo AS (SELECT eps, shuffle, session, mixed.folder, count(*) AS c FROM kept JOIN mixed USING (id) GROUP BY ALL), mp AS (SELECT eps, shuffle, session, sum(c) AS n, sum(c * (c - 1) / 2) AS same FROM mo GROUP BY ALL),
    mq AS (SELECT eps, shuffle, CASE WHEN sum(n * (n - 1) / 2) > 0 THEN sum(same) / sum(n * (n - 1) / 2) ELSE 0.0 END AS purity FROM mp GROUP BY ALL), base AS (SELECT eps, avg(purity) AS baseline FROM mq GROUP BY eps),
    lifted AS (SELECT *, covered / (SELECT count(*) FROM line) AS cov, CASE WHEN baseline > 0 THEN purity / baseline ELSE 0.0 END AS l FROM stats JOIN pure USING (eps) JOIN base USING (eps)),
    scan AS (SELECT eps, sessions, round(cov, 9) AS coverage, median_size, round(purity, 9) AS purity, round(baseline, 9) AS baseline, round(l, 9) AS lift, round(cov * l, 9) AS objective FROM lifted)"""


def edges_sql() -> str:
    from . import more

    newer = more.oracle_sql()["supersession_edges"]
    suffixes = "(" + ", ".join(f"'{x}'" for x in C.TWO_LEVEL) + ")"
    return f"""{GROUPED}, sized AS (SELECT session, id, count(*) OVER (PARTITION BY session) AS n FROM grouped WHERE session >= 0), se AS (SELECT a.id AS src, b.id AS dst, 'session' AS kind, max(round(least(1.0, sqrt(2.0::DOUBLE / a.n)), 4)) AS weight FROM sized a JOIN sized b USING (session) WHERE a.id <> b.id AND a.n BETWEEN 2 AND 30 GROUP BY ALL),
    lab AS (SELECT id, host, string_split(host, '.') AS l FROM line), dom AS (SELECT id, CASE WHEN len(l) <= 2 OR regexp_full_match(host, '[0-9.]*') THEN host WHEN l[len(l) - 1] IN {suffixes} THEN array_to_string(l[len(l) - 2:], '.') ELSE array_to_string(l[len(l) - 1:], '.') END AS domain FROM lab),
    dn AS (SELECT *, count(*) OVER (PARTITION BY domain) AS n FROM dom WHERE domain <> ''), de AS (SELECT DISTINCT a.id AS src, b.id AS dst, 'same_domain' AS kind, 0.15::DOUBLE AS weight FROM dn a JOIN dn b USING (domain) WHERE a.id <> b.id AND a.n BETWEEN 2 AND 25),
    nv AS ({newer}), edges AS (SELECT * FROM se UNION ALL SELECT * FROM de UNION ALL SELECT src, dst, 'supersession', weight FROM nv)"""


def oracle_sql():
    e = edges_sql()
    return {
        "timeline_sessions": f"WITH {GROUPED} SELECT id, ts, session FROM grouped",
        "session_listing": f"WITH {GROUPED} SELECT session, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS size, string_agg(id::VARCHAR, ',' ORDER BY ts, id) AS members FROM grouped WHERE session >= 0 GROUP BY session HAVING count(*) >= 3",
        "session_stats": f"WITH {GROUPED}, z AS (SELECT count(*) AS size FROM grouped WHERE session >= 0 GROUP BY session) SELECT count(*) AS sessions, sum(size)::BIGINT AS assigned, quantile_cont(size, 0.5) AS median_size, (SELECT count(*) FROM line) AS dated FROM z",
        "eps_scan": f"WITH {SCAN} SELECT * FROM scan",
        "eps_chosen": f"WITH {SCAN} SELECT coalesce((SELECT eps FROM scan WHERE objective > 0 ORDER BY objective DESC, eps LIMIT 1), 1200)::INTEGER AS eps",
        "isolated_saves": f"WITH {TIMELINE}, n AS (SELECT id, ts, lag(ts) OVER (ORDER BY ts, id) AS b, lead(ts) OVER (ORDER BY ts, id) AS a FROM line) SELECT id, coalesce(ts - b, 1000000000) > 1800 AND coalesce(a - ts, 1000000000) > 1800 AS alone FROM n",
        "session_neighbours": f"WITH {GROUPED}, m AS (SELECT session, id, md5(title) AS t FROM grouped WHERE session >= 0) SELECT a.id, count(*) AS n, md5(string_agg(b.t, '|' ORDER BY b.id)) AS titles FROM m a JOIN m b USING (session) WHERE a.id <> b.id GROUP BY a.id",
        "session_peers": f"WITH {GROUPED}, m AS (SELECT session, id FROM grouped WHERE session >= 0) SELECT a.id, round(max(1.0 / (1.0 + 0.2::DOUBLE * (b.id // 10 % 10))), 9) AS strength FROM m a JOIN m b USING (session) WHERE b.id % 10 = 0 AND a.id <> b.id GROUP BY a.id",
        "edges_all": f"WITH {e} SELECT * FROM edges",
        "related_by_kind": f"""WITH {e}, p AS (SELECT *, row_number() OVER (PARTITION BY src, kind ORDER BY weight DESC, dst)::INTEGER AS place, max(weight) OVER (PARTITION BY src, kind) AS top FROM edges WHERE src % 10 = 0)
            SELECT src, dst, kind, weight, place, dense_rank() OVER (PARTITION BY src ORDER BY top DESC, kind)::INTEGER AS kind_place FROM p WHERE place <= 10""",
        "edge_kinds": f"WITH {e}, c AS (SELECT kind, count(*) AS n, count(DISTINCT src) AS sources, round(avg(weight), 6) AS mean_weight FROM edges GROUP BY kind) SELECT *, round(n / sum(n) OVER (), 9) AS share FROM c",
        "age_percentiles": f"""WITH {TIMELINE}, a AS (SELECT (1706745600 - ts) / 86400 AS age FROM line) SELECT count(*) AS n, round(quantile_cont(age, 0.05), 6) AS p05, round(quantile_cont(age, 0.5), 6) AS p50, round(quantile_cont(age, 0.95), 6) AS p95,
            round(avg((age > 10)::INTEGER), 9) AS over_10, round(avg((age > 20)::INTEGER), 9) AS over_20, round(avg((age > 25)::INTEGER), 9) AS over_25 FROM a""",
    }
