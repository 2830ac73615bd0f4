"""Search as one plan for a batch of queries: facets, abstention, fusion, context, decay, page, reranking and expansion, by named configuration."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.wording import segment
from . import ranking as R
from .lifecycle import boost, decay

ALL = ("content", "intent", "lex_seg", "lex_tri")
VECTOR, LEXICAL = ("content", "intent"), ("lex_seg", "lex_tri")
#: The facets' weights, the pool's depth, the first place's bonus over four facets, anchors, candidates, and shares of expansion.
WEIGHTS = {"content": 1.0, "intent": 1.0, "lex_seg": 1.0, "lex_tri": 0.7}
DEPTH, ANCHORS, CANDIDATES, SEEDS, PER_SEED, FACTOR, EXPANDED, RERANKED = 50, 10, 200, 10, 20, 0.6, 8, 20
BONUS = ((60 + 1) * 3.7 - (60 + DEPTH) * 1.0) / (1.0 * (DEPTH - 1))


@dataclass(frozen=True)
class Config:
    """A named way to search: which facets, and what is done with their fused list."""

    name: str
    facets: tuple[str, ...] = ALL
    context: bool = False
    graph: bool = False
    rerank: bool = False
    decay: bool = False
    gate: int = 0  # 1: context for episodic queries only; 2: not for a bare year
    margin: float = 0.0
    bonus: float = 0.0
    weights: tuple[tuple[str, float], ...] = ()

    def weight(self, facet: str) -> float:
        return dict(self.weights).get(facet, WEIGHTS[facet])


CONFIGS = {
    c.name: c
    for c in (
        Config("A", ("content",)), Config("B", ("content", *LEXICAL)), Config("C"), Config("D", context=True, graph=True), Config("E", context=True, graph=True, rerank=True),
        Config("C_nolex", VECTOR), Config("D_nolex", VECTOR, context=True, graph=True), Config("A_ctx", ("content",), context=True, graph=True), Config("A_graph", ("content",), graph=True),
        Config("lex_only", LEXICAL), Config("seg_only", ("lex_seg",)), Config("tri_only", ("lex_tri",)), Config("A_gatedctx", ("content",), context=True, graph=True, gate=1),
        Config("A_gatedctx_v2", ("content",), context=True, graph=True, gate=2), Config("D_gated", context=True, graph=True, gate=1), Config("C_lowlex", weights=(("lex_seg", 0.3), ("lex_tri", 0.2))),
        Config("C_abstain", margin=0.25), Config("C_notri", ("content", "intent", "lex_seg")), Config("C_max", bonus=BONUS), Config("fused", context=True, graph=True, rerank=True, decay=True),
        Config("full", ("content",), graph=True, decay=True),
    )
}


def degraded(config: Config, present: set[str]) -> tuple[Config, str]:
    """The configuration that runs where only the facets ``present`` can, and the name it stands in for: lexical facets if none of its own can run."""
    if any(f in present or f in LEXICAL for f in config.facets):
        return config, ""
    return replace(config, name=f"{config.name}/lex", facets=LEXICAL, gate=0, margin=0.0, bonus=0.0, weights=()), config.name


def intents(hits: DataFrame, owners: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score, rank): hits (query_id, doc_id: an intent's id, score, rank) as their owners (intent, owner), each by its best hit."""
    met = hits.join(owners, hits["doc_id"] == owners["intent"])
    best = met.groupBy("query_id", "owner").agg(F.min("rank").alias("first"), F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("first")).cast("int")
    return best.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("owner").alias("doc_id"), "score", "rank")


def _ranked(scores: DataFrame, name: str) -> DataFrame:
    return scores.withColumn(name, F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")).cast("int"))


def fused(lists: DataFrame, config: Config) -> DataFrame:
    """(query_id, doc_id, score, rank) of facets' lists (query_id, facet, doc_id, score, rank)."""
    used = lists.where(F.col("facet").isin(*config.facets))
    if config.margin > 0:
        kept = R.abstain(R.confidence(used), config.margin).where("kept").select("query_id", "facet")
        used = used.join(kept, ["query_id", "facet"])
    found = R.rrf(used, {f: config.weight(f) for f in config.facets}, max_bonus=config.bonus)
    return _ranked(found.select("query_id", "doc_id", "score"), "rank")


def in_context(found: DataFrame, understood: DataFrame, places: DataFrame, config: Config, fanout: int = 40) -> DataFrame:
    """``found`` with scores raised by context: ``places`` are (doc_id, ts, session, folder), session -1 for none; ``understood`` (query_id, lo, hi, confidence,
    episodic, gate)."""
    wanted = F.lit(True) if config.gate == 0 else F.col("episodic") if config.gate == 1 else F.col("gate")
    asked = understood.select("query_id", "lo", "hi", "confidence", wanted.alias("wanted"))
    head = found.where(F.col("rank") <= max(CANDIDATES, ANCHORS)).join(places, "doc_id", "left").join(asked, "query_id")
    strength = 1.0 / (1.0 + F.lit(0.2) * (F.col("rank") - 1))
    anchors = head.where(F.col("rank") <= ANCHORS).withColumn("strength", strength)
    span = anchors.where("ts is not null").groupBy("query_id").agg(F.count("*").alias("n"), F.percentile("ts", F.array(F.lit(0.1), F.lit(0.9))).alias("p"))
    lo, hi = F.floor(F.col("p")[0]), F.floor(F.col("p")[1])
    span = span.where("n >= 2").select("query_id", F.when(lo == hi, lo - 1800).otherwise(lo).alias("alo"), F.when(lo == hi, hi + 1800).otherwise(hi).alias("ahi"))
    session = anchors.where("session >= 0").groupBy("query_id", "session").agg(F.max("strength").alias("by_session"))
    small = places.where("folder <> ''").groupBy("folder").agg(F.count("*").alias("n")).where(F.col("n") <= fanout).select("folder")
    folder = anchors.join(small, "folder").groupBy("query_id", "folder").agg(F.max("strength").alias("by_folder"))
    met = head.join(span, "query_id", "left").join(session, ["query_id", "session"], "left").join(folder, ["query_id", "folder"], "left")
    named = F.col("lo").isNotNull()
    inside = F.when(named, F.col("ts").between(F.col("lo"), F.col("hi"))).when(F.col("confidence") > 0, F.col("ts").between(F.col("alo"), F.col("ahi")))
    parts = F.when(F.col("wanted"), boost(F.lit(True), F.col("by_session"), F.col("by_folder"), F.when(F.coalesce(inside, F.lit(False)), F.col("confidence")).otherwise(0.0))).otherwise(1.0)
    factors = met.select("query_id", "doc_id", parts.alias("factor"))
    raised = found.join(factors, ["query_id", "doc_id"], "left")
    return _ranked(raised.select("query_id", "doc_id", F.round(F.col("score") * F.coalesce("factor", F.lit(1.0)), 9).alias("score")), "rank")


def faded(found: DataFrame, cold: DataFrame) -> DataFrame:
    """``found`` with the ids of ``cold`` (doc_id) demoted, unless that leaves nothing worth showing."""
    flags = found.join(cold.select("doc_id").distinct().withColumn("cold", F.lit(True)), "doc_id", "left").select("query_id", "doc_id", "score", F.coalesce("cold", F.lit(False)).alias("cold"))
    return _ranked(decay(flags).select("query_id", "doc_id", "score"), "rank")


def overlap(query: Column, title: Column, summary: Column) -> Column:
    """How much of a query's words stand in a title (which counts twice) and a summary."""
    terms = lambda t: F.array_distinct(F.filter(F.split(segment(F.lower(t)), " "), lambda w: F.length(w) > 1))
    q = terms(query)
    hit = 2.0 * F.size(F.array_intersect(q, terms(title))) + F.size(F.array_intersect(q, terms(summary)))
    return F.round(F.when(F.size(q) == 0, 0.0).otherwise(F.least(hit / (2.0 * F.size(q)), F.lit(1.0))), 9)


def paged(found: DataFrame, limit: int = 10, offset: int = 0) -> DataFrame:
    """``place`` (from 1) of the rows of the page."""
    return found.where(F.col("rank").between(offset + 1, offset + limit)).withColumn("place", (F.col("rank") - offset).cast("int"))


def reranked(page: DataFrame, queries: DataFrame, docs: DataFrame, depth: int = RERANKED) -> DataFrame:
    """The page's first ``depth`` rows in the order of their overlap with the query; the others stay where they are."""
    text = page.join(queries.select("query_id", "text"), "query_id").join(docs.select("doc_id", "title", "summary"), "doc_id")
    scored = text.withColumn("o", F.when(F.col("place") <= depth, overlap(F.col("text"), F.col("title"), F.col("summary"))).otherwise(-1.0))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("place") > depth, F.col("o").desc(), "place")).cast("int")
    return scored.withColumn("place", place).select("query_id", "doc_id", "score", "rank", "place")


def search(config: Config, lists: DataFrame, queries: DataFrame, docs: DataFrame, understood: DataFrame, places: DataFrame, cold: DataFrame, limit: int = 10) -> DataFrame:
    """(query_id, doc_id, score, rank, place) of the page, ``rank`` by score and ``place`` as shown."""
    found = fused(lists, config)
    if config.context:
        found = in_context(found, understood, places, config)
    if config.decay:
        found = faded(found, cold)
    page = paged(found, limit)
    return reranked(page, queries, docs) if config.rerank else page.select("query_id", "doc_id", "score", "rank", "place")


def expanded(page: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, doc_id, score, via, kind, place): one hop from a page's first rows over their heaviest edges (src, dst, kind, weight), without what the page shows."""
    seeds = page.where(F.col("place") <= SEEDS).select("query_id", F.col("doc_id").alias("src"), "score", F.col("place").alias("seed"))
    out = edges.withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy(F.col("weight").desc(), "dst", "kind"))).where(F.col("r") <= PER_SEED)
    paths = seeds.join(out, "src").select("query_id", F.col("dst").alias("doc_id"), F.round(F.lit(FACTOR) * F.col("score") * F.col("weight"), 9).alias("score"), "seed", "src", "kind", "r")
    paths = paths.join(page.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    best = paths.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"), F.min_by(F.struct("src", "kind"), F.struct(-F.col("score"), F.col("seed"), F.col("r"))).alias("x"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")).cast("int")
    return best.withColumn("place", place).where(F.col("place") <= EXPANDED).select("query_id", "doc_id", "score", F.col("x.src").alias("via"), F.col("x.kind").alias("kind"), "place")


def signals(lists: DataFrame, found: DataFrame, limit: int, offset: int, depth: int, capped: bool) -> DataFrame:
    """(query_id, total, truncated, has_more, depth_capped) of lists read one row deeper than ``depth``."""
    over = lists.groupBy("query_id").agg((F.max("rank") > depth).alias("truncated"))
    total = found.groupBy("query_id").agg(F.count("*").alias("total"))
    return over.join(total, "query_id").select("query_id", "total", "truncated", ((F.lit(limit + offset) < F.col("total")) | F.col("truncated")).alias("has_more"), (F.col("truncated") & F.lit(capped)).alias("depth_capped"))
