"""Rank fusion, abstention, lexical scores and nearest neighbours over batches of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Queries that travel with the tasks: at 1,024 components 80 MB.
CARRIED = 10_000


def ranked(scored: DataFrame, *by: str) -> DataFrame:
    """``rank`` from 1 within ``by``: higher scores first, ties by doc_id."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("score").desc(), "doc_id")).cast("int"))


def top(scored: DataFrame, k: int, *by: str) -> DataFrame:
    """The ``k`` best in each group; Spark limits groups before the exchange."""
    return ranked(scored, *by).where(F.col("rank") <= k)


def rrf(lists: DataFrame, weights: dict[str, float], k: int = 60, max_bonus: float = 0.0) -> DataFrame:
    """(query_id, doc_id, score, facets): reciprocal rank fusion of (query_id, facet, doc_id, rank); facets of weight 0 are left out."""
    used = {f: float(w) for f, w in weights.items() if w}
    weight = F.element_at(F.create_map(*(x for f, w in used.items() for x in (F.lit(f), F.lit(w)))), F.col("facet"))
    terms = lists.where(F.col("facet").isin(*used)).withColumn("term", weight / (F.lit(float(k)) + F.col("rank")))
    score = F.sum("term") + F.lit(float(max_bonus)) * F.max("term")
    return terms.groupBy("query_id", "doc_id").agg(F.round(score, 9).alias("score"), F.count("*").alias("facets"))


def confidence(scored: DataFrame, least: int = 3) -> DataFrame:
    """(query_id, facet, confidence): how far a facet's best score stands above its median, as a share of its range."""
    spread = F.max("score") - F.min("score")
    value = F.when(F.count("*") < least, 1.0).when(spread <= 0, 0.0).otherwise((F.max("score") - F.median("score")) / spread)
    return scored.groupBy("query_id", "facet").agg(F.round(value, 9).alias("confidence"))


def abstain(confidences: DataFrame, margin: float) -> DataFrame:
    """Facets at ``margin`` or above; of a query without any, the most confident one (the later name of equals)."""
    own = Window.partitionBy("query_id")
    best = F.max(F.struct("confidence", "facet")).over(own)
    keep = (F.col("confidence") >= margin) | ((F.max("confidence").over(own) < margin) & (best["facet"] == F.col("facet")))
    return confidences.withColumn("kept", keep)


def terms(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, term, tf, dl): lower-case words of letters and digits."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    listed = docs.select(F.col(id_col).alias("doc_id"), words.alias("w")).select("doc_id", F.size("w").cast("long").alias("dl"), F.explode("w").alias("term"))
    return listed.groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score, rank): the ``k`` best ``docs`` (doc_id, text) of each of ``queries`` (query_id, text) by their plain words; any term may match."""
    from . import lexical

    cut = lambda c: F.regexp_extract_all(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    asked = queries.select("query_id", F.explode(F.array_distinct(cut("text"))).alias("term"))
    terms = lexical.terms_of(asked)
    return lexical.scored(lexical.word_postings(docs.select("doc_id", cut("text").alias("w")), {"w": 1.0}, terms), terms, asked, k, plus=True)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "dot", block: int = 256, others: bool = True) -> DataFrame:
    """(query_id, doc_id, score, rank): the ``k`` vectors (doc_id, v) nearest to each query (query_id, q), with ``others`` not counting one of the query's own id, by inner
    product (dot) or distance (l2, as a negative score). Up to ``CARRIED`` queries, counted first, travel with the tasks, and each batch of vectors keeps
    its ``k`` best a query before the exchange; of more, blocks meet blocks of vectors."""
    if queries.count() > CARRIED:
        return _grid(queries, vectors, k, metric, others, 4096)
    asked = queries.where("q is not null").orderBy("query_id").toArrow()
    ids = asked.column("query_id").to_numpy()
    q = np.array(asked.column("q").to_pylist(), dtype=np.float64).reshape(len(ids), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                b = batch.slice(at, block)
                docs = b.column("doc_id").to_numpy()
                v = b.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(docs), -1)
                for i in range(0, len(ids), 1000):
                    found = _best(q[i : i + 1000], ids[i : i + 1000], v, docs, k, metric, others)
                    yield pa.record_batch([pa.array(x) for x in found], ["query_id", "doc_id", "score"])

    if not len(ids):
        return vectors.sparkSession.createDataFrame([], "query_id long, doc_id long, score double, rank int")
    return top(vectors.where("v is not null").select("doc_id", "v").mapInArrow(run, "query_id long, doc_id long, score double"), k, "query_id")


def _grid(queries: DataFrame, vectors: DataFrame, k: int, metric: str, others: bool, block: int) -> DataFrame:
    """As ``nearest`` for many queries: blocks of queries meet blocks of vectors, each pair in a task of its own, which keeps ``k`` a query."""
    asked, held = queries.where("q is not null"), vectors.where("v is not null")
    rows, cols = (max(1, -(-t.count() // block)) for t in (asked, held))
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select(dealt("query_id", rows).alias("a"), every(cols).alias("b"), F.lit(0).alias("side"), F.col("query_id").alias("id"), F.col("q").cast("array<double>").alias("v"))
    right = held.select(every(rows).alias("a"), dealt("doc_id", cols).alias("b"), F.lit(1).alias("side"), F.col("doc_id").alias("id"), F.col("v").cast("array<double>").alias("v"))

    def met(group: pa.Table) -> pa.Table:
        side, ids = group.column("side").to_numpy(), group.column("id").to_numpy()
        v = np.array(group.column("v").to_pylist(), dtype=np.float64)
        x, y, xi, yi = v[side == 0], v[side == 1], ids[side == 0], ids[side == 1]
        out = [[], [], []]
        for at in range(0, len(x) if len(y) else 0, 64):
            for o, c in zip(out, _best(x[at : at + 64], xi[at : at + 64], y, yi, k, metric, others), strict=True):
                o.append(c)
        made = [np.concatenate(o) if o else np.zeros(0) for o in out]
        return pa.table({"query_id": pa.array(made[0].astype(np.int64)), "doc_id": pa.array(made[1].astype(np.int64)), "score": pa.array(made[2].astype(np.float64))})

    return top(left.unionByName(right).groupBy("a", "b").applyInArrow(met, "query_id long, doc_id long, score double"), k, "query_id")


def _best(q: np.ndarray, ids: np.ndarray, v: np.ndarray, docs: np.ndarray, k: int, metric: str, others: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, ids, scores) of each query's ``k`` best vectors, ties by the smaller id."""
    raw = q @ v.T if metric == "dot" else -np.sqrt(np.maximum(((q[:, None, :] - v[None, :, :]) ** 2).sum(axis=2), 0.0))
    score = np.round(raw, 6) + 0.0
    own = (ids[:, None] == docs[None, :]) & others
    order = np.lexsort((np.broadcast_to(docs, score.shape), -np.where(own, -np.inf, score)), axis=1)[:, :k]
    rows, cols = np.repeat(np.arange(len(q)), order.shape[1]), order.ravel()
    keep = ~own[rows, cols]
    return ids[rows[keep]], docs[cols[keep]], score[rows[keep], cols[keep]]


def mutual(vectors: DataFrame, k: int, farthest: float, weight: float = 0.8, block: int = 4096) -> DataFrame:
    """(src, dst, weight), both ways: vectors (doc_id, v) that are each among the other's ``k`` nearest within distance ``farthest``. Exact: all pairs of blocks
    of vectors meet, so time grows with the square of the vectors."""
    near = _grid(vectors.select(F.col("doc_id").alias("query_id"), F.col("v").alias("q")), vectors, k, "l2", True, block).where(F.col("score") >= -farthest)
    edges = near.select(F.col("query_id").alias("src"), F.col("doc_id").alias("dst"), "score")
    back = edges.select(F.col("src").alias("dst"), F.col("dst").alias("src"))
    return edges.join(back, ["src", "dst"]).select("src", "dst", F.round(F.lit(weight) * F.greatest(F.lit(0.0), 1 + F.col("score") / 2), 4).alias("weight"))


def interleave(lists: DataFrame, first: str, second: str) -> DataFrame:
    """Two facets' lists taken in turn up to the shorter one's end, then the tails; a document keeps its first place."""
    sizes = lists.groupBy("query_id", "facet").agg(F.max("rank").alias("n")).groupBy("query_id").agg(F.min("n").alias("short"), F.count("*").alias("lists"))
    turn = F.when(F.col("facet") == first, 0).otherwise(1)
    short = F.when(F.col("lists") < 2, 0).otherwise(F.col("short"))
    placed = lists.where(F.col("facet").isin(first, second)).join(sizes, "query_id")
    key = F.when(F.col("rank") <= short, F.struct(F.lit(0).alias("tail"), F.col("rank").alias("a"), turn.alias("b"))).otherwise(F.struct(F.lit(1).alias("tail"), turn.alias("a"), F.col("rank").alias("b")))
    best = placed.groupBy("query_id", "doc_id").agg(F.min(key).alias("key"))
    return best.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("key", "doc_id")).cast("int")).drop("key")


def guarantee_bonus(depth: Column, weights: tuple[float, ...], k: int = 60) -> Column:
    """The share of its best term a document must gain so that first place in one facet beats last place in all; 0 where none is needed."""
    top, total = max(weights), sum(weights)
    return F.round(F.when(depth <= 1, 0.0).otherwise(F.greatest(F.lit(0.0), ((k + 1) * total - (k + depth) * top) / (top * (depth - 1)))), 9)


def page_window(limit: Column, offset: Column, over_fetch: int = 1, least: int = 50, most_rows: int = 200, ceiling: int = 2000) -> dict[str, Column]:
    """Columns limit, offset, depth (rows a facet gives) and ceiling_hit: the asked page within its bounds."""
    rows = F.greatest(F.lit(1), F.least(limit, F.lit(most_rows)))
    skipped = F.greatest(F.lit(0), F.least(offset, F.lit(ceiling - 1)))
    want = F.greatest(F.lit(least), (rows + skipped) * over_fetch)
    return {"limit": rows, "offset": skipped, "depth": F.least(want, F.lit(ceiling)), "ceiling_hit": want > ceiling}
