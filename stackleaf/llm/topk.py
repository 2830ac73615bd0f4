"""Exact top-k by inner product: ball trees per shard, branch and bound.

Vectors become whole numbers, floor(256 x). Shards of about ``shard_rows`` vectors each become a ball tree (centre and radius of every
node, split along the direction between two far points). Queries go in blocks against every shard. A block walks a tree with all its
queries at once: a query enters a node only if the node's upper bound, <q, centre> + |q| radius, reaches the query's current k-th
score, and of two children the one with the higher bounds comes first. The current k-th score is shared: a block first searches one shard, the one it was
dealt; the k-th scores found there are written and start the search of all other shards.

Sums of whole numbers in float64 are exact below 2^53, so scores are exact; larger components are refused. Bounds get a margin for the rounding of centre and radius.

Defined results: a vector that is null, empty or holds null or non-finite components takes no part, nor does one with a null id; a shorter vector is as if
filled with zeros; ties go to the smaller id; rows that repeat an id are candidates each (a query never gets its own id) and
one query; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

NONE = -(2**62)


class Ball:
    """A node: rows lo to hi of the tree's order, centre, radius, children."""

    __slots__ = ("lo", "hi", "centre", "radius", "left", "right")

    def __init__(self, vectors: np.ndarray, order: np.ndarray, lo: int, hi: int, leaf: int):
        own = vectors[order[lo:hi]]
        self.lo, self.hi, self.left, self.right = lo, hi, None, None
        self.centre = own.mean(axis=0)
        gaps = own - self.centre
        self.radius = float(np.sqrt((gaps * gaps).sum(axis=1).max())) * (1 + 1e-9) + 1e-6
        if hi - lo > leaf and self.radius > 1e-3:
            far = own[np.argmax((gaps * gaps).sum(axis=1))]
            other = own[np.argmax(((own - far) ** 2).sum(axis=1))]
            along = own @ (far - other)
            middle = (hi - lo) // 2
            order[lo:hi] = order[lo:hi][np.argsort(along, kind="stable")]
            self.left, self.right = Ball(vectors, order, lo, lo + middle, leaf), Ball(vectors, order, lo + middle, hi, leaf)


class BallTree:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = 256):
        order = np.arange(len(ids))
        self.root = Ball(vectors.astype(np.float64), order, 0, len(ids), leaf) if len(ids) else None
        self.ids, self.vectors = ids[order], vectors[order].astype(np.float64)
        self.visited = 0

    def search(self, queries: np.ndarray, own: np.ndarray, best: np.ndarray, who: np.ndarray) -> None:
        """Improve ``best`` and ``who`` (queries, k): scores in descending order and their ids; unfilled places hold NONE."""
        if self.root is None or not len(queries):
            return
        norms = np.sqrt((queries * queries).sum(axis=1))
        bound = lambda node, at: queries[at] @ node.centre + norms[at] * node.radius + 1e-3
        stack = [(self.root, np.arange(len(queries)), bound(self.root, np.arange(len(queries))))]
        while stack:
            node, at, upper = stack.pop()
            live = upper >= best[at, -1]
            at = at[live]
            if not len(at):
                continue
            if node.left is None:
                self.visited += 1
                self._leaf(node, queries, own, best, who, at)
                continue
            children = sorted(((c, bound(c, at)) for c in (node.left, node.right)), key=lambda x: x[1].sum())
            stack += [(c, at, upper) for c, upper in children]  # the higher bounds come off first

    def _leaf(self, node: Ball, queries: np.ndarray, own: np.ndarray, best: np.ndarray, who: np.ndarray, at: np.ndarray) -> None:
        ids = self.ids[node.lo : node.hi]
        scores = (queries[at] @ self.vectors[node.lo : node.hi].T).astype(np.int64)
        scores[own[at][:, None] == ids[None, :]] = NONE
        better = np.flatnonzero(scores.max(axis=1) >= best[at, -1])
        if not len(better):
            return
        at, scores, k = at[better], scores[better], best.shape[1]
        all_scores = np.concatenate([best[at], scores], axis=1)
        all_ids = np.concatenate([who[at], np.broadcast_to(ids, scores.shape)], axis=1)
        if all_scores.shape[1] > 4 * k:
            # All that reach the k-th score may matter: ties go by id. Rows with few of them are cut to that many.
            kth = np.partition(all_scores, -k, axis=1)[:, -k]
            width = max(k, int((all_scores >= kth[:, None]).sum(axis=1).max()))
            top = np.argpartition(-all_scores, min(width, all_scores.shape[1]) - 1, axis=1)[:, :width]
            all_scores, all_ids = np.take_along_axis(all_scores, top, 1), np.take_along_axis(all_ids, top, 1)
        order = np.lexsort((all_ids, -all_scores), axis=1)[:, :k]
        best[at], who[at] = np.take_along_axis(all_scores, order, 1), np.take_along_axis(all_ids, order, 1)


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): floor(256 x) of each component, for vectors that take part."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    fine = (F.size("x") > 0) & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.select(F.col(id_col).cast("long").alias("id"), x.alias("x")).where(F.col("id").isNotNull() & F.col("x").isNotNull() & fine).select("id", F.transform("x", lambda c: F.floor(c * 256).cast("long")).alias("v"))


def _packed(key: str) -> callable:
    """Rows of one key (together in the partition) as one row of raw ids and vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            rows = t.column("v").to_pylist()
            dims = max(map(len, rows))
            m = np.zeros((len(rows), dims), dtype=np.int64)
            for k, v in enumerate(rows):
                m[k, : len(v)] = v
            if float(np.abs(m).max(initial=0)) ** 2 * dims >= 2**53:
                raise ValueError("components are too large for exact inner products: dimensions times the square of floor(256 x) must stay below 2^53")
            small = m.astype(np.int16) if np.abs(m).max() < 2**15 else m
            return pa.record_batch([pa.array([held[0].column(key)[0].as_py()], pa.int32()), pa.array([t.column("id").to_numpy().tobytes()], pa.binary()), pa.array([small.tobytes()], pa.binary()), pa.array([dims], pa.int32())], [key, "ids", "vectors", "dims"])

        for b in batches:
            keys = b.column(key).to_numpy()
            cuts = np.flatnonzero(np.diff(keys)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                if hi > lo:
                    if held and held[0].column(key)[0].as_py() != keys[lo]:
                        yield done()
                        held = []
                    held.append(b.slice(lo, hi - lo))
        if held:
            yield done()

    return run


def _unpacked(ids: bytes, vectors: bytes, dims: int) -> tuple[np.ndarray, np.ndarray]:
    own = np.frombuffer(ids, dtype=np.int64)
    kind = np.int16 if len(vectors) == 2 * dims * len(own) else np.int64
    return own, np.frombuffer(vectors, dtype=kind).reshape(len(own), dims).astype(np.float64)


def _fitted(q: np.ndarray, dims: int) -> np.ndarray:
    return q[:, :dims] if q.shape[1] >= dims else np.concatenate([q, np.zeros((len(q), dims - q.shape[1]))], axis=1)


def _search(k: int):
    """(shard with its arrays, block with its arrays, start scores) to (block, query row, scores, ids). Rows of a shard are together: its tree is built once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, tree, dims = None, None, 0
        for b in batches:
            for r in range(b.num_rows):
                row = {c: b.column(c)[r].as_py() for c in b.schema.names}
                if row["shard"] != last:
                    last, dims = row["shard"], row["dims"]
                    tree = BallTree(*_unpacked(row["ids"], row["vectors"], dims))
                own, q = _unpacked(row["q_ids"], row["q_vectors"], row["q_dims"])
                best = np.frombuffer(row["start"], dtype=np.int64).reshape(len(own), k).copy() if row["start"] else np.full((len(own), k), NONE)
                # A start score stands for candidates of another shard; only better ones or ties are reported from here.
                who = np.full(best.shape, np.iinfo(np.int64).max)
                tree.search(_fitted(q, dims), own, best, who)
                found = who != np.iinfo(np.int64).max
                rows = np.broadcast_to(np.arange(len(own))[:, None], best.shape)[found]
                yield pa.record_batch([pa.array(np.full(len(rows), row["block"], np.int32)), pa.array(own[rows]), pa.array(rows), pa.array(best[found]), pa.array(who[found])], ["block", "query_id", "q_row", "score", "vec_id"])

    return run


FOUND = "block int, query_id long, q_row long, score long, vec_id long"


def top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, every: int = 50, shard_rows: int = 8192, block_rows: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every``, its ``k`` best among all others."""
    rows = materialize(whole_vectors(vectors, id_col, vector_col), "topk-vectors")
    queries = rows.where(F.pmod("id", F.lit(every)) == 0).dropDuplicates(["id"])
    shards, blocks = max(1, -(-rows.count() // shard_rows)), max(1, -(-queries.count() // block_rows))

    def pack(df: DataFrame, key: str, n: int) -> DataFrame:
        keyed = df.withColumn(key, F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
        return materialize(keyed.repartition(n, key).sortWithinPartitions(key, "id").mapInArrow(_packed(key), f"{key} int, ids binary, vectors binary, dims int"), f"topk-{key}")

    stored = pack(rows.withColumn("id", F.col("id")), "shard", shards)
    asked = pack(queries, "block", blocks).select("block", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), F.col("dims").alias("q_dims"))

    def run(pairs: DataFrame, name: str) -> DataFrame:
        # A block's queries travel to the shard, which stays where it is: blocks are a fiftieth of the vectors.
        met = stored.join(pairs, "shard").sortWithinPartitions("shard", "block")
        return materialize(met.mapInArrow(_search(k), FOUND), name)

    home = F.pmod("block", F.lit(shards)).cast("int")
    first = run(asked.select("*", home.alias("shard"), F.lit(None).cast("binary").alias("start")), "topk-home")
    ranked = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    kth = first.groupBy("block", "q_row").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s"))
    listed = kth.groupBy("block").agg(F.collect_list(F.struct("q_row", "s")).alias("kth"))

    def started(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for ids, lists in zip(b.column("q_ids").to_pylist(), b.column("kth").to_pylist(), strict=True):
                start = np.full((len(ids) // 8, k), NONE)
                for x in lists or ():
                    if len(x["s"]) >= k:
                        start[x["q_row"]] = x["s"][k - 1]
                out.append(start.tobytes())
            yield pa.record_batch([*(b.column(c) for c in ("block", "q_ids", "q_vectors", "q_dims")), pa.array(out, pa.binary())], ["block", "q_ids", "q_vectors", "q_dims", "start"])

    primed = materialize(asked.join(listed, "block", "left").mapInArrow(started, "block int, q_ids binary, q_vectors binary, q_dims int, start binary"), "topk-primed")
    others = primed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where(F.col("shard") != home)
    found = first.unionByName(run(others, "topk-rest")) if shards > 1 else first
    return found.withColumn("rank", F.row_number().over(ranked).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
