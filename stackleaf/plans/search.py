"""Composed search and its evaluation over the driver tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import columns as C
from ..functions import understanding as U
from ..operators import lexical as X
from ..operators import ranking as R
from ..operators import search as S
from ..operators import timeline as T
from . import more, sessions, texts
from .checks import pick
from .more import NOW
from .queries import TARGETS, table, targets
from .sessions import EPS, GROUPED, edges_sql
from .texts import SPLIT, bookmarks, cjk, segment

SUFFIXES = ("", " last week", " 最近", " in 2024")
TYPES = ("q_content", "q_vague", "q_episodic", "q_save_action")
LADDER = ("A", "B", "C", "D", "E", "C_notri", "C_max", "C_abstain")


def asked(spark, d):
    """The benchmark's texts as queries, some with words of time."""
    suffix = F.element_at(F.array(*map(F.lit, SUFFIXES)), (F.pmod("item_id", F.lit(4)) + 1).cast("int"))
    kind = F.element_at(F.array(*map(F.lit, TYPES)), (F.pmod("item_id", F.lit(4)) + 1).cast("int"))
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.coalesce("text", F.lit("")), suffix).alias("text"), kind.alias("qtype"))


def documents(spark, d):
    return bookmarks(spark, d).select(F.col("id").alias("doc_id"), "title", "body", C.snippet(F.col("body"), 200).alias("summary"), F.col("folder").alias("extra"))


def vectors(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("v")).where("v is not null")
    return v, v.where("vec_id % 10 = 0").select(F.expr("vec_id div 10").alias("query_id"), F.col("v").alias("q")).join(table(spark, d, "benchmark").select(F.col("item_id").alias("query_id")), "query_id", "left_semi")


def named(rows, facet):
    return rows.select("query_id", F.lit(facet).alias("facet"), "doc_id", "score")


def vector_lists(spark, d, k):
    v, q = vectors(spark, d)
    near = R.nearest(v.select(F.col("vec_id").alias("doc_id"), "v"), q, 4 * k, "l2", others=False)
    owners = v.select(F.col("vec_id").alias("intent"), F.expr("vec_id div 3").alias("owner"))
    return named(near.where(F.col("rank") <= k), "content"), named(S.intents(near, owners, k), "intent")


def lexical_lists(spark, d, k):
    docs, q = documents(spark, d), asked(spark, d)
    return named(X.word_list(docs, q, k), "lex_seg"), named(X.part_list(docs, q, k), "lex_tri")


def lists(spark, d, depth=S.DEPTH, facets=S.ALL):
    """The facets' lists, each read to ``depth``."""
    found = [x for kind, make in ((S.VECTOR, vector_lists), (S.LEXICAL, lexical_lists)) if set(kind) & set(facets) for x in make(spark, d, depth)]
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    # Dealt anew: Spark takes a union of parts by query as one by query, and a join after it fails where their partitions aren't the same in number.
    return R.top(out.where(F.col("facet").isin(*facets)).repartition("query_id", "facet"), depth, "query_id", "facet")


def understood(spark, d):
    q = asked(spark, d)
    return q.select("query_id", *(v.alias(k) for k, v in U.labels(F.col("text"), NOW).items() if k in ("lo", "hi", "confidence", "episodic", "gate")))


def places(spark, d):
    rows = texts.bookmarks(spark, d).select("id", F.col("date_added").alias("ts"), F.coalesce("host", F.lit("")).alias("folder"))
    grouped = T.sessions(rows.select("id", "ts"), EPS).select("id", "session")
    return rows.join(grouped, "id", "left").select(F.col("id").alias("doc_id"), "ts", F.coalesce("session", F.lit(-1)).alias("session"), "folder")


def cold(spark, d):
    return more.q_cold_whole(spark, d).select(F.col("bookmark_id").alias("doc_id"))


def searched(spark, d, name, found=None):
    config = S.CONFIGS[name]
    used = lists(spark, d, facets=config.facets) if found is None else found
    return S.search(config, used, asked(spark, d), documents(spark, d), understood(spark, d), places(spark, d), cold(spark, d))


def q_quick(spark, d):
    """Lexical lists three pages deep, fused: the first paint."""
    config = S.Config("quick", S.LEXICAL)
    page = S.paged(S.fused(lists(spark, d, 60, S.LEXICAL), config), 20)
    return page.select("query_id", "doc_id", "score", "place")


def q_expanded(spark, d):
    return S.expanded(searched(spark, d, "full"), sessions.edges(spark, d))


def q_signals(spark, d):
    deep = lists(spark, d, S.DEPTH + 1)
    return S.signals(deep, S.fused(deep.where(F.col("rank") <= S.DEPTH), S.CONFIGS["C"]), 10, 200, S.DEPTH, True)


def q_suggest(spark, d):
    """What the library holds for each conversation's opening: up to five sentences searched by words, reciprocal ranks added up."""
    from ..functions import wording as W

    opening = table(spark, d, "conversations").where("turn = 0").select("conv_id", F.posexplode(W.sentences(F.col("text"))).alias("n", "text"))
    probes = opening.select((F.col("conv_id") * 10 + F.col("n")).alias("query_id"), "text")
    found = X.word_list(documents(spark, d), probes, 8).select(F.expr("query_id div 10").alias("conv_id"), "doc_id", "rank")
    pooled = found.groupBy("conv_id", "doc_id").agg(F.round(F.sum(1.0 / (60 + F.col("rank"))), 6).alias("score"), F.count("*").alias("matched"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("score").desc(), "doc_id")).cast("int")
    return pooled.withColumn("place", place).where("place <= 8")


def q_window(spark, d):
    """Queries with a time alone: the saves in their window, newest first."""
    asked_ = understood(spark, d).where("lo is not null").select("query_id", "lo", "hi")
    line = places(spark, d).where("ts is not null").select("doc_id", "ts")
    met = line.join(F.broadcast(asked_), F.col("ts").between(F.col("lo"), F.col("hi")))  # the queries are a stated set
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("ts").desc(), "doc_id")).cast("int")
    return met.withColumn("place", place).where("place <= 50").select("query_id", "doc_id", "place")


def outcomes(spark, d):
    """(config, query_id, qtype, rank) for each rung and query with a target; rank 0: not on the page."""
    goal = asked(spark, d).join(targets(spark, d), "query_id").select("query_id", "qtype", "target")
    found, out = lists(spark, d), None
    for name in LADDER:
        hit = searched(spark, d, name, found.where(F.col("facet").isin(*S.CONFIGS[name].facets))).select("query_id", F.col("doc_id").alias("target"), "place")
        one = goal.join(hit, ["query_id", "target"], "left").select(F.lit(name).alias("config"), "query_id", "qtype", F.coalesce("place", F.lit(0)).alias("rank"))
        out = one if out is None else out.unionByName(one)
    return out


def measures():
    at = lambda k: F.round(F.avg(F.col("rank").between(1, k).cast("double")), 9).alias(f"recall_{k}")
    return F.count("*").alias("n"), at(1), at(5), at(10), F.round(F.avg(F.when(F.col("rank") > 0, 1.0 / F.col("rank")).otherwise(0.0)), 9).alias("mrr_10")


def q_rungs(spark, d):
    """Recall and reciprocal rank of each rung, over all queries (qtype null) and by type."""
    o = outcomes(spark, d)
    return o.groupingSets([["config"], ["config", "qtype"]], "config", "qtype").agg(*measures())


def q_deltas(spark, d):
    """Each rung beside the one before it: recall at five in points, queries gained and lost."""
    number = F.element_at(F.create_map(*(F.lit(x) for i, n in enumerate(LADDER) for x in (n, i))), F.col("config"))
    o = outcomes(spark, d).withColumns({"number": number, "hit": F.col("rank").between(1, 5)})
    last = F.lag("hit").over(Window.partitionBy("query_id").orderBy("number"))
    pairs = o.withColumn("last", last).where("last is not null")
    return pairs.groupBy("config").agg(F.round(100 * F.avg(F.col("hit").cast("int") - F.col("last").cast("int")), 6).alias("points"), F.count_if(F.col("hit") & ~F.col("last")).alias("gained"), F.count_if(~F.col("hit") & F.col("last")).alias("lost"))


def q_complement(spark, d):
    """Which of words and vectors hold a query's target in their lists, over all and by type, with shares."""
    goal = asked(spark, d).join(targets(spark, d), "query_id").select("query_id", "qtype", F.col("target").alias("doc_id"))
    held = goal.join(lists(spark, d), ["query_id", "doc_id"], "left").groupBy("query_id", "qtype").agg(F.max(F.coalesce(F.col("facet").isin(*S.LEXICAL), F.lit(False))).alias("lex"), F.max(F.coalesce(F.col("facet").isin(*S.VECTOR), F.lit(False))).alias("vec"))
    cell = F.when(F.col("lex") & F.col("vec"), "both").when(F.col("lex"), "lex_only").when(F.col("vec"), "vector_only").otherwise("neither")
    counted = held.withColumn("cell", cell).groupingSets([["cell"], ["cell", "qtype"]], "cell", "qtype").agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("qtype")), 9))  # a row a cell and type


def q_sole(spark, d):
    """Documents that lead one facet and are in no other: how many, and how deep the fused list buries them."""
    found = lists(spark, d)
    per = found.groupBy("query_id", "doc_id").agg(F.count("*").alias("facets"), F.min("rank").alias("best"), F.max("facet").alias("facet"))
    sole = per.where("facets = 1 and best = 1").join(S.fused(found, S.CONFIGS["C"]).select("query_id", "doc_id", F.col("rank").alias("fused")), ["query_id", "doc_id"])
    return sole.groupBy("facet").agg(F.count("*").alias("heads"), F.count_if(F.col("fused") > 10).alias("buried"), F.max("fused").alias("deepest"))


def q_pool(spark, d):
    """Where each target stands in the pool, and what factor would bring it to fifth place."""
    fused = S.fused(lists(spark, d), S.CONFIGS["C"])
    fifth = fused.where("rank = 5").select("query_id", F.col("score").alias("fifth"))
    return targets(spark, d).withColumnRenamed("target", "doc_id").join(fused, ["query_id", "doc_id"]).join(fifth, "query_id").select("query_id", "doc_id", "rank", F.round(F.col("fifth") / F.col("score"), 6).alias("needed"))


def q_changes(spark, d):
    """What decay and context change on the page: top one and top five, and the lists' likeness."""
    found = lists(spark, d)
    top = lambda name: searched(spark, d, name, found).where("place <= 10").groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "doc_id"))), lambda x: x["doc_id"]).alias(name))
    met = top("C").join(top("D"), "query_id")
    both = F.size(F.array_intersect("C", "D"))
    head = lambda c: F.slice(F.col(c), 1, 5)
    return met.agg(F.count("*").alias("n"), F.count_if(F.col("C")[0] != F.col("D")[0]).alias("top_changed"), F.count_if(head("C") != head("D")).alias("five_changed"), F.round(F.avg(both / (F.size("C") + F.size("D") - both)), 9).alias("jaccard"), F.round(F.avg(F.size(F.array_intersect(head("C"), head("D"))) / 5), 9).alias("overlap_5"))


def q_gates(spark, d):
    """How often the gate opens, by type and rule."""
    labels = U.labels(F.col("text"), NOW)
    rows = asked(spark, d).select("qtype", labels["time_rule"].alias("rule"), labels["episodic"].alias("episodic"), labels["gate"].alias("gate"))
    return rows.groupBy("qtype", F.coalesce("rule", F.lit("none")).alias("rule")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("episodic").cast("int")), 9).alias("episodic"), F.round(F.avg(F.col("gate").cast("int")), 9).alias("open"))


def q_probe(spark, d):
    """Intent probes: each query's own document's place in the list of content and words, unweighted; null where it isn't."""
    found = lists(spark, d, 30, ("content", *S.LEXICAL))
    fused = R.rrf(found, {"content": 1.0, "lex_seg": 1.0, "lex_tri": 1.0})
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")).cast("int")
    ranked = fused.withColumn("place", place).where("place <= 30").select("query_id", F.col("doc_id").alias("target"), "place")
    return targets(spark, d).join(ranked, ["query_id", "target"], "left")


def q_holds(spark, d):
    """Does a query's window hold the time its target was saved?"""
    met = targets(spark, d).join(understood(spark, d).select("query_id", "lo", "hi"), "query_id").join(places(spark, d).select(F.col("doc_id").alias("target"), "ts"), "target")
    return met.select("query_id", "target", (F.col("lo").isNotNull() & F.coalesce(F.col("ts").between(F.col("lo"), F.col("hi")), F.lit(False))).alias("holds"))


def queries():
    one = {f"search_config_{n}": (lambda s, d, n=n: searched(s, d, n)) for n in S.CONFIGS}
    return one | {
        "lexical_weighted_top10": lambda s, d: X.word_list(documents(s, d), asked(s, d), 10),
        "trigram_top10": lambda s, d: X.part_list(documents(s, d), asked(s, d), 10),
        "intent_best_rank": lambda s, d: R.top(vector_lists(s, d, 20)[1], 20, "query_id"),
        "quick_search": q_quick,
        "search_expansion": q_expanded,
        "page_signals": q_signals,
        "suggest_probes": q_suggest,
        "episodic_window": q_window,
        "eval_targets": targets,
        "eval_rungs": q_rungs,
        "eval_deltas": q_deltas,
        "facet_complement": q_complement,
        "sole_facet_heads": q_sole,
        "pool_probe": q_pool,
        "list_changes": q_changes,
        "gate_firing": q_gates,
        "intent_probe": q_probe,
        "window_holds_target": q_holds,
    }


COLUMNS = tuple(X.WEIGHTS.items())


def fold(x: str) -> str:
    return f"translate(lower({x}), '{X.MARKED}', '{X.PLAIN}')"


def words(x: str) -> str:
    return f"regexp_extract_all({fold(segment(x))}, '[\\p{{L}}\\p{{N}}]+')"


TERMS = f"list_distinct(regexp_extract_all({fold('''regexp_replace(seg, '["*():^-]+', ' ', 'g')''')}, '[\\p{{L}}\\p{{N}}]+'))"
GRAMS = f"""flatten(list_transform({SPLIT.format(x="regexp_replace(text, '[\"*():^-]+', ' ', 'g')")}, lambda w: CASE WHEN {cjk('w')} THEN list_transform(range(1, length(w) - 1), lambda i: substr(w, i, 3)) ELSE [w] END))"""
ASKED = f"""asked AS (SELECT item_id AS query_id, coalesce(text, '') || {pick(SUFFIXES, 'item_id')} AS text, {pick(TYPES, 'item_id')} AS qtype FROM benchmark),
    cutq AS (SELECT *, {segment('text')} AS seg, {GRAMS} AS g FROM asked), want AS (SELECT query_id, unnest({TERMS}) AS term FROM cutq),
    wantp AS (SELECT DISTINCT query_id, lower(p) AS term FROM (SELECT query_id, unnest(list_filter(g, lambda e, i: length(e) >= 3 AND list_position(g, e) = i)[:48]) AS p FROM cutq))"""
INDEX = f"""docs AS (SELECT id AS doc_id, title, body, left(trim(regexp_replace(body, '[ \\t\\n\\r]+', ' ', 'g'), ' '), 200) AS summary, folder AS extra FROM marks)"""


def bm25(hits: str, stats: str, want: str, k: str, out: str) -> str:
    return f"""{out}_d AS (SELECT term, count(*) AS df FROM {hits} GROUP BY term), {out}_p AS (SELECT query_id, doc_id, round(sum(CASE WHEN (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) > 1 THEN ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) ELSE 1e-6 END
        * f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score FROM {hits} JOIN {out}_d USING (term) JOIN {want} USING (term), {stats} GROUP BY query_id, doc_id),
    {out} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM {out}_p) WHERE rank <= {k})"""


WORD_HITS = f"""cutd AS MATERIALIZED (SELECT doc_id, {', '.join(f"{words(c)} AS {c}" for c, _ in COLUMNS)} FROM docs), sized AS (SELECT doc_id, ({' + '.join(f'len({c})' for c, _ in COLUMNS)})::BIGINT AS dl FROM cutd), ws AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM sized),
    flat AS ({' UNION ALL '.join(f'SELECT doc_id, unnest({c}) AS term, {w}::DOUBLE AS f FROM cutd' for c, w in COLUMNS)}), wh AS MATERIALIZED (SELECT doc_id, dl, term, sum(f) AS f FROM flat JOIN sized USING (doc_id) WHERE term IN (SELECT term FROM want) GROUP BY ALL)"""
COUNT = " + ".join(f"{w}::DOUBLE * ((length({c}) - length(replace({c}, term, ''))) // length(term))" for c, w in COLUMNS)
PART_HITS = f"""low AS MATERIALIZED (SELECT doc_id, {', '.join(f'lower({c}) AS {c}' for c, _ in COLUMNS)}, ({' + '.join(f'greatest(length({c}) - 2, 0)' for c, _ in COLUMNS)})::BIGINT AS dl FROM docs), ps AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM low),
    pt AS (SELECT DISTINCT term FROM wantp), ph AS MATERIALIZED (SELECT * FROM (SELECT doc_id, dl, term, {COUNT} AS f FROM low, pt WHERE contains(body, term) OR contains(title, term) OR contains(summary, term) OR contains(extra, term)) WHERE f > 0)"""
VECTORS = """vq AS (SELECT item_id AS query_id, embedding AS q FROM benchmark JOIN embeddings ON vec_id = item_id * 10), vd AS (SELECT query_id, vec_id AS doc_id, round(-sqrt(list_sum(list_transform(list_zip(embedding, q), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))), 6) AS score FROM vq, embeddings),
    vr AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM vd)"""


def intent(k: int) -> str:
    return f"""SELECT query_id, doc_id // 3 AS doc_id, max(score) AS score, min(rank) AS first FROM vr WHERE rank <= {4 * k} GROUP BY query_id, doc_id // 3"""


def lists_sql(k: int = S.DEPTH, facets=S.ALL) -> str:
    kinds = {"content": f"SELECT query_id, 'content' AS facet, doc_id, score FROM vr WHERE rank <= {k}", "intent": f"SELECT query_id, 'intent' AS facet, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first) AS rank FROM ({intent(k)})) WHERE rank <= {k}",
             "lex_seg": "SELECT query_id, 'lex_seg' AS facet, doc_id, score FROM seg", "lex_tri": "SELECT query_id, 'lex_tri' AS facet, doc_id, score FROM tri"}
    parts = [GROUPED, ASKED, INDEX]
    if set(facets) & set(S.VECTOR):
        parts.append(VECTORS)
    if "lex_seg" in facets:
        parts += [WORD_HITS, bm25("wh", "ws", "want", str(k), "seg")]
    if "lex_tri" in facets:
        parts += [PART_HITS, bm25("ph", "ps", "wantp", str(k), "tri")]
    union = " UNION ALL ".join(kinds[f] for f in facets)
    return ", ".join([*parts, f"lists AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, facet ORDER BY score DESC, doc_id)::INTEGER AS rank FROM ({union})) WHERE rank <= {k})"])


UNDERSTOOD = more.understand("SELECT query_id, qtype, trim(text) AS t, lower(trim(text)) AS low FROM asked")
LABELS = f"""{UNDERSTOOD}, und AS MATERIALIZED (SELECT query_id, qtype, win.lo AS lo, win.hi AS hi, win.rule AS rule, CASE WHEN win IS NOT NULL THEN 1.0::DOUBLE WHEN vague THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END AS confidence, episodic,
    episodic AND (coalesce(win.rule, '') <> 'absolute_year' OR vague OR regexp_matches(low, {more.quoted("|".join(U.SAVING))})) AS gate FROM f)"""
PLACES = "places AS MATERIALIZED (SELECT id AS doc_id, date_added AS ts, coalesce(session, -1) AS session, coalesce(host, '') AS folder FROM marks LEFT JOIN (SELECT id, session FROM grouped) USING (id))"


def fused_sql(c: S.Config, out: str, source: str = "lists") -> str:
    used = f"(SELECT * FROM {source} WHERE facet IN ({', '.join(repr(f) for f in c.facets)}))"
    if c.margin:
        used = f"""(SELECT x.* FROM {used} x JOIN (SELECT query_id, facet FROM (SELECT *, max(conf) OVER (PARTITION BY query_id) AS m, row_number() OVER (PARTITION BY query_id ORDER BY conf DESC, facet DESC) AS r FROM
            (SELECT query_id, facet, round(CASE WHEN count(*) < 3 THEN 1.0 WHEN max(score) - min(score) <= 0 THEN 0.0 ELSE (max(score) - median(score)) / (max(score) - min(score)) END, 9) AS conf FROM {used} GROUP BY ALL)) WHERE conf >= {c.margin} OR (m < {c.margin} AND r = 1)) USING (query_id, facet))"""
    weight = "CASE facet " + " ".join(f"WHEN '{f}' THEN {c.weight(f)}::DOUBLE" for f in c.facets) + " END"
    return f"""{out}_f AS (SELECT query_id, doc_id, round(sum(t) + {c.bonus!r}::DOUBLE * max(t), 9) AS score FROM (SELECT *, {weight} / (60 + rank) AS t FROM {used}) GROUP BY query_id, doc_id),
    {out} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM {out}_f)"""


def config_sql(c: S.Config, out: str) -> list[str]:
    parts, last = [fused_sql(c, f"{out}_0")], f"{out}_0"
    if c.context:
        wanted = ("true", "episodic", "gate")[c.gate]
        parts.append(f"""{out}_h AS MATERIALIZED (SELECT x.*, ts, session, folder, 1.0 / (1.0 + 0.2::DOUBLE * (rank - 1)) AS st FROM {last} x LEFT JOIN places USING (doc_id) WHERE rank <= 200),
            {out}_w AS (SELECT query_id, floor(quantile_cont(ts, 0.1))::BIGINT AS lo0, floor(quantile_cont(ts, 0.9))::BIGINT AS hi0 FROM {out}_h WHERE rank <= 10 AND ts IS NOT NULL GROUP BY query_id HAVING count(*) >= 2),
            {out}_s AS (SELECT query_id, session, max(st) AS bs FROM {out}_h WHERE rank <= 10 AND session >= 0 GROUP BY ALL), {out}_z AS (SELECT folder FROM places WHERE folder <> '' GROUP BY folder HAVING count(*) <= 40),
            {out}_d AS (SELECT query_id, folder, max(st) AS bf FROM {out}_h WHERE rank <= 10 AND folder IN (SELECT folder FROM {out}_z) GROUP BY ALL),
            {out}_b AS (SELECT h.query_id, h.doc_id, CASE WHEN {wanted} THEN round(least(1.0 + CASE WHEN coalesce(CASE WHEN u.lo IS NOT NULL THEN ts BETWEEN u.lo AND u.hi WHEN confidence > 0 THEN ts BETWEEN CASE WHEN lo0 = hi0 THEN lo0 - 1800 ELSE lo0 END AND CASE WHEN lo0 = hi0 THEN hi0 + 1800 ELSE hi0 END END, false) THEN 0.50::DOUBLE * confidence ELSE 0.0 END
                + 0.25::DOUBLE * coalesce(bs, 0.0) + 0.15::DOUBLE * coalesce(bf, 0.0), 1.60::DOUBLE), 9) ELSE 1.0 END AS factor
                FROM {out}_h h JOIN und u ON u.query_id = h.query_id LEFT JOIN {out}_w w ON w.query_id = h.query_id LEFT JOIN {out}_s s ON s.query_id = h.query_id AND s.session = h.session LEFT JOIN {out}_d d ON d.query_id = h.query_id AND d.folder = h.folder),
            {out}_c AS (SELECT x.query_id, x.doc_id, round(x.score * coalesce(factor, 1.0), 9) AS score FROM {last} x LEFT JOIN {out}_b USING (query_id, doc_id)),
            {out}_1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM {out}_c)""")
        last = f"{out}_1"
    if c.decay:
        parts.append(f"""{out}_k AS (SELECT x.query_id, x.doc_id, x.score, x.doc_id IN (SELECT bookmark_id FROM cold) AS cold FROM {last} x), {out}_l AS (SELECT *, coalesce(max(score) FILTER (NOT cold) OVER (PARTITION BY query_id) < 0.02, true) AS rescued FROM {out}_k),
            {out}_m AS (SELECT query_id, doc_id, round(CASE WHEN cold AND NOT rescued THEN score * 0.5 ELSE score END, 9) AS score FROM {out}_l), {out}_2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM {out}_m)""")
        last = f"{out}_2"
    if c.rerank:
        terms = lambda x: f"list_distinct(list_filter(string_split({segment(f'lower({x})')}, ' '), lambda w: length(w) > 1))"
        parts.append(f"""{out}_t AS (SELECT query_id, doc_id, score, rank, {terms('text')} AS q, {terms('title')} AS t, {terms('summary')} AS s FROM {last} JOIN asked USING (query_id) JOIN docs USING (doc_id) WHERE rank <= 10),
            {out}_o AS (SELECT *, round(CASE WHEN len(q) = 0 THEN 0.0 ELSE least((2.0::DOUBLE * len(list_intersect(q, t)) + len(list_intersect(q, s))) / (2.0::DOUBLE * len(q)), 1.0) END, 9) AS o FROM {out}_t),
            {out} AS MATERIALIZED (SELECT query_id, doc_id, score, rank, row_number() OVER (PARTITION BY query_id ORDER BY o DESC, rank)::INTEGER AS place FROM {out}_o)""")
    else:
        parts.append(f"{out} AS MATERIALIZED (SELECT query_id, doc_id, score, rank, rank AS place FROM {last} WHERE rank <= 10)")
    return parts


def with_configs(names, facets=S.ALL, k: int = S.DEPTH) -> str:
    cold_ = more.oracle_sql()["cold_set"]
    parts = [lists_sql(k, facets), LABELS, PLACES, f"cold AS MATERIALIZED ({cold_})"]
    for n in names:
        parts += config_sql(S.CONFIGS[n], f"c_{n}")
    return ", ".join(parts)


OUTCOMES = ", outcomes AS (" + " UNION ALL ".join(f"SELECT '{n}' AS config, {i} AS number, a.query_id, qtype, coalesce(place, 0) AS rank FROM targets t JOIN asked a USING (query_id) LEFT JOIN c_{n} h ON h.query_id = t.query_id AND h.doc_id = t.target" for i, n in enumerate(LADDER)) + ")"
MEASURES = "count(*) AS n, " + ", ".join(f"round(avg((rank BETWEEN 1 AND {k})::INTEGER), 9) AS recall_{k}" for k in (1, 5, 10)) + ", round(avg(CASE WHEN rank > 0 THEN 1.0::DOUBLE / rank ELSE 0.0 END), 9) AS mrr_10"


def oracle_sql():
    one = {f"search_config_{n}": f"WITH {with_configs([n], c.facets)} SELECT query_id, doc_id, score, rank, place FROM c_{n}" for n, c in S.CONFIGS.items()}
    rungs = f"WITH {with_configs(LADDER)}, {TARGETS}{OUTCOMES}"
    c0 = fused_sql(S.CONFIGS["C"], "fused")
    probe = fused_sql(S.Config("probe", ("content", *S.LEXICAL), weights=(("lex_tri", 1.0),)), "fused")
    return one | {
        "lexical_weighted_top10": f"WITH {GROUPED}, {ASKED}, {INDEX}, {WORD_HITS}, {bm25('wh', 'ws', 'want', '10', 'seg')} SELECT * FROM seg",
        "trigram_top10": f"WITH {GROUPED}, {ASKED}, {INDEX}, {PART_HITS}, {bm25('ph', 'ps', 'wantp', '10', 'tri')} SELECT * FROM tri",
        "intent_best_rank": f"WITH {VECTORS}, i AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first) AS p FROM ({intent(20)})) SELECT query_id, 'intent' AS facet, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM i WHERE p <= 20",
        "quick_search": f"WITH {lists_sql(60, S.LEXICAL)}, {fused_sql(S.Config('quick', S.LEXICAL), 'fused')} SELECT query_id, doc_id, score, rank AS place FROM fused WHERE rank <= 20",
        "search_expansion": f"""WITH {with_configs(['full'], S.CONFIGS['full'].facets)}, graph AS (WITH {edges_sql()} SELECT * FROM edges), o AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst, kind) AS r FROM graph),
            p AS (SELECT query_id, dst AS doc_id, round(0.6::DOUBLE * score * weight, 9) AS s, place AS seed, src, kind, r FROM c_full JOIN o ON src = doc_id WHERE r <= 20 AND place <= 10), fresh AS (SELECT p.* FROM p LEFT JOIN c_full h ON h.query_id = p.query_id AND h.doc_id = p.doc_id WHERE h.doc_id IS NULL),
            b AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY s DESC, seed, r) AS k FROM fresh), z AS (SELECT query_id, doc_id, s AS score, src AS via, kind, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id)::INTEGER AS place FROM b WHERE k = 1) SELECT * FROM z WHERE place <= 8""",
        "page_signals": f"""WITH {lists_sql(S.DEPTH + 1)}, cutl AS (SELECT * FROM lists WHERE rank <= {S.DEPTH}), {fused_sql(S.CONFIGS['C'], 'fused', 'cutl')}, o AS (SELECT query_id, max(rank) > {S.DEPTH} AS truncated FROM lists GROUP BY query_id), t AS (SELECT query_id, count(*) AS total FROM fused GROUP BY query_id)
            SELECT query_id, total, truncated, 210 < total OR truncated AS has_more, truncated AS depth_capped FROM o JOIN t USING (query_id)""",
        "suggest_probes": f"""WITH {GROUPED}, {INDEX}, opening AS (SELECT conv_id, trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)) AS t FROM conversations WHERE turn = 0),
            sent AS (SELECT *, list_filter(list_transform(regexp_split_to_array(regexp_replace(left(t, 4000), '([.!?。！？])[ \\t\\n\\r]+', '\\1' || chr(10), 'g'), '[\\n\\r]+'), lambda s: trim(s, ' ' || chr(9))), lambda s: length(s) >= 4) AS s FROM opening),
            probe AS (SELECT conv_id * 10 + unnest(range(len(p))) AS query_id, unnest(p) AS text FROM (SELECT conv_id, CASE WHEN length(t) = 0 THEN [] WHEN len(s) > 0 THEN s[:5] ELSE [left(t, 4000)] END AS p FROM sent)),
            cutq AS (SELECT *, {segment('text')} AS seg FROM probe), want AS (SELECT query_id, unnest({TERMS}) AS term FROM cutq), {WORD_HITS}, {bm25('wh', 'ws', 'want', '8', 'seg')},
            pooled AS (SELECT query_id // 10 AS conv_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score, count(*) AS matched FROM seg GROUP BY ALL), z AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, doc_id)::INTEGER AS place FROM pooled) SELECT * FROM z WHERE place <= 8""",
        "episodic_window": f"WITH {GROUPED}, {ASKED}, {LABELS}, {PLACES}, held AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY ts DESC, doc_id)::INTEGER AS place FROM und JOIN places ON ts BETWEEN lo AND hi) SELECT * FROM held WHERE place <= 50",
        "eval_targets": f"WITH {TARGETS} SELECT * FROM targets",
        "eval_rungs": f"{rungs} SELECT config, qtype, {MEASURES} FROM outcomes GROUP BY GROUPING SETS ((config), (config, qtype))",
        "eval_deltas": f"""{rungs}, p AS (SELECT *, rank BETWEEN 1 AND 5 AS hit, lag(rank BETWEEN 1 AND 5) OVER (PARTITION BY query_id ORDER BY number) AS last FROM outcomes)
            SELECT config, round(100 * avg(hit::INTEGER - last::INTEGER), 6) AS points, count(*) FILTER (hit AND NOT last) AS gained, count(*) FILTER (NOT hit AND last) AS lost FROM p WHERE last IS NOT NULL GROUP BY config""",
        "facet_complement": f"""WITH {lists_sql()}, {TARGETS}, held AS (SELECT a.query_id, qtype, coalesce(bool_or(facet IN ('lex_seg', 'lex_tri')), false) AS lex, coalesce(bool_or(facet IN ('content', 'intent')), false) AS vec FROM targets t JOIN asked a USING (query_id) LEFT JOIN lists l ON l.query_id = t.query_id AND l.doc_id = t.target GROUP BY a.query_id, qtype),
            cells AS (SELECT *, CASE WHEN lex AND vec THEN 'both' WHEN lex THEN 'lex_only' WHEN vec THEN 'vector_only' ELSE 'neither' END AS cell FROM held), n AS (SELECT cell, qtype, count(*) AS n FROM cells GROUP BY GROUPING SETS ((cell), (cell, qtype))) SELECT *, round(n / sum(n) OVER (PARTITION BY qtype), 9) AS share FROM n""",
        "sole_facet_heads": f"""WITH {lists_sql()}, {c0}, per AS (SELECT query_id, doc_id, count(*) AS facets, min(rank) AS best, max(facet) AS facet FROM lists GROUP BY query_id, doc_id)
            SELECT facet, count(*) AS heads, count(*) FILTER (rank > 10) AS buried, max(rank) AS deepest FROM per JOIN fused USING (query_id, doc_id) WHERE facets = 1 AND best = 1 GROUP BY facet""",
        "pool_probe": f"WITH {lists_sql()}, {c0}, {TARGETS} SELECT t.query_id, t.target AS doc_id, a.rank, round(b.score / a.score, 6) AS needed FROM targets t JOIN fused a ON a.query_id = t.query_id AND a.doc_id = t.target JOIN fused b ON b.query_id = t.query_id AND b.rank = 5",
        "list_changes": f"""WITH {with_configs(['C', 'D'])}, x AS (SELECT query_id, list(doc_id ORDER BY place) AS c FROM c_C GROUP BY query_id), y AS (SELECT query_id, list(doc_id ORDER BY place) AS d FROM c_D GROUP BY query_id), m AS (SELECT *, len(list_intersect(c, d)) AS shared FROM x JOIN y USING (query_id))
            SELECT count(*) AS n, count(*) FILTER (c[1] <> d[1]) AS top_changed, count(*) FILTER (c[:5] <> d[:5]) AS five_changed, round(avg(shared / (len(c) + len(d) - shared)), 9) AS jaccard, round(avg(len(list_intersect(c[:5], d[:5])) / 5), 9) AS overlap_5 FROM m""",
        "gate_firing": f"WITH {ASKED}, {LABELS} SELECT qtype, coalesce(rule, 'none') AS rule, count(*) AS n, round(avg(episodic::INTEGER), 9) AS episodic, round(avg(gate::INTEGER), 9) AS open FROM und GROUP BY ALL",
        "intent_probe": f"WITH {lists_sql(30, ('content', *S.LEXICAL))}, {probe}, {TARGETS} SELECT t.query_id, t.target, f.rank AS place FROM targets t LEFT JOIN fused f ON f.query_id = t.query_id AND f.doc_id = t.target AND f.rank <= 30",
        "window_holds_target": f"WITH {GROUPED}, {ASKED}, {LABELS}, {PLACES}, {TARGETS} SELECT t.query_id, t.target, lo IS NOT NULL AND coalesce(ts BETWEEN lo AND hi, false) AS holds FROM targets t JOIN und USING (query_id) JOIN places p ON p.doc_id = t.target",
    }
