"""Exact dedup by a log-structured merge index over text digests.

Every map task is a memtable: it takes (digest, id, count), keeps one entry a digest and flushes sorted runs. The runs
go to shards by digest; a shard merges them in levels (compaction) and keeps, for each digest, the count and one
identifier. Each run carries a small filter, so that a lookup skips runs that can't hold a digest. Documents whose
digest the index holds more than once are hits; their bytes are compared with those of the row that stays, and
what differs (a digest collision) is grouped anew by its whole text.

The contract keeps the largest identifier, so compaction runs with ``keep="largest"``; ``"smallest"`` is the other way.

Defined results: a null text is the empty text; null ids lose to any other id, and if all ids of a group are null, keep_id
is null and all its rows count as kept; rows that repeat one id are all kept if that id stays; an empty table gives no rows;
columns other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, materialize, pieces

NO_ID = -(2**63)


class Run:
    """Entries sorted by digest, one a digest, with a filter over 16 digest bits."""

    def __init__(self, digest: np.ndarray, ids: np.ndarray, counts: np.ndarray):
        self.digest, self.ids, self.counts = digest, ids, counts
        self.filter = np.zeros(1 << 16, dtype=bool)
        self.filter[slots(digest)] = True

    def __len__(self) -> int:
        return len(self.digest)


def slots(digest: np.ndarray) -> np.ndarray:
    """The last two digest bytes, as the filter's slot."""
    raw = np.ascontiguousarray(digest).view(np.uint8).reshape(len(digest), digest.dtype.itemsize)
    return raw[:, -1].astype(np.int64) * 256 + raw[:, -2 if raw.shape[1] > 1 else -1]


def merged(digest: np.ndarray, ids: np.ndarray, counts: np.ndarray, keep: str) -> Run:
    """One entry a digest: the sum of counts and the identifier that ``keep`` names."""
    order = np.lexsort((ids if keep == "largest" else -ids, digest))
    digest, ids, counts = digest[order], ids[order], counts[order]
    last = np.ones(len(digest), dtype=bool)
    last[:-1] = digest[1:] != digest[:-1]
    sums = np.cumsum(counts)[last]
    return Run(digest[last], ids[last], np.diff(sums, prepend=0))


class MergeIndex:
    """Memtable of at most ``rows`` entries over levels of sorted runs; ``fan`` runs of a level merge into the next."""

    def __init__(self, width: int, keep: str = "largest", rows: int = 1 << 16, fan: int = 4):
        self.width, self.keep, self.rows, self.fan = width, keep, rows, fan
        self.pending: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0
        self.levels: list[list[Run]] = [[]]

    def put(self, digest: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        self.pending.append((digest, ids, counts))
        self.held += len(digest)
        if self.held >= self.rows:
            self.flush()

    def flush(self) -> None:
        if not self.held:
            return
        self.levels[0].append(merged(*(np.concatenate(x) for x in zip(*self.pending, strict=True)), self.keep))
        self.pending, self.held = [], 0
        for k in range(len(self.levels)):
            if len(self.levels[k]) < self.fan:
                return
            run = self._join(self.levels[k])
            self.levels[k] = []
            if k + 1 == len(self.levels):
                self.levels.append([])
            self.levels[k + 1].append(run)

    def _join(self, runs: list[Run]) -> Run:
        return merged(*(np.concatenate([getattr(r, x) for r in runs]) for x in ("digest", "ids", "counts")), self.keep)

    def compact(self) -> Run | None:
        """All runs as one."""
        self.flush()
        runs = [r for level in self.levels for r in level]
        if not runs:
            return None
        self.levels = [[self._join(runs)]]
        return self.levels[0][0]

    def get(self, digest: bytes) -> tuple[int, int] | None:
        """(identifier, count) of a digest over all runs; runs whose filter has no such slot are skipped."""
        self.flush()
        key = np.array([digest], dtype=f"S{self.width}")
        found = []
        for run in (r for level in self.levels for r in level):
            if run.filter[slots(key)[0]]:
                at = int(np.searchsorted(run.digest, key[0]))
                if at < len(run) and run.digest[at] == key[0]:
                    found.append((int(run.ids[at]), int(run.counts[at])))
        if not found:
            return None
        return (max if self.keep == "largest" else min)(x for x, _ in found), sum(n for _, n in found)


def _digests(column: pa.Array, width: int) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=f"S{width}")


def _hashed(id_col: str, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            sha = [hashlib.sha256(x.lower()).digest() for x in as_bytes(b.column(text_col))]
            yield pa.record_batch([b.column(id_col).cast(pa.int64()), pa.array(sha, pa.binary())], ["id", "sha"])

    return run


def _entries(run: Run, width: int, keep: str) -> Iterator[pa.RecordBatch]:
    raw = run.digest.view(np.uint8).reshape(len(run), width)
    for i in range(0, len(run), 10_000):
        part = slice(i, i + 10_000)
        yield pa.record_batch(
            [pa.array([x.tobytes() for x in raw[part]], pa.binary()), pa.array(run.ids[part], mask=run.ids[part] == _none(keep)), pa.array(run.counts[part])],
            ["digest", "keep_id", "n"],
        )


def _none(keep: str) -> int:
    return NO_ID if keep == "largest" else 2**63 - 1


def _indexed(width: int, keep: str, flushed: bool):
    """flushed: give each memtable's run as it is flushed (map side); else ingest runs and give the compacted shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = MergeIndex(width, keep)
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column("keep_id").fill_null(_none(keep)).to_numpy(zero_copy_only=False)
            index.put(_digests(b.column("digest"), width), ids, b.column("n").to_numpy(zero_copy_only=False))
            if flushed and index.held == 0 and sum(len(r) for level in index.levels for r in level) > 1 << 20:
                yield from _entries(index.compact(), width, keep)
                index = MergeIndex(width, keep)
        last = index.compact()
        if last is not None:
            yield from _entries(last, width, keep)

    return run


ENTRY = "digest binary, keep_id long, n long"


def build_index(rows: DataFrame, width: int, keep: str) -> DataFrame:
    """(digest, keep_id, n) of each distinct digest in ``rows`` (id, digest). Numpy's S type ends at trailing zero bytes on
    reading only; the entries are read from the raw buffer, so that digests that end in zeros stay whole."""
    one = rows.select("digest", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("n"))
    runs = one.mapInArrow(_indexed(width, keep, True), ENTRY)
    return runs.repartition("digest").mapInArrow(_indexed(width, keep, False), ENTRY)


def _positions(bits: int):
    """Four filter positions of a digest: three bytes each of the digest, filled with zeros to 12."""
    full = F.concat("digest", F.lit(bytes(12)))
    return F.array(*(F.conv(F.hex(F.substring(full, 1 + 3 * k, 3)), 16, 10).cast("long") % bits for k in range(4)))


def positions(digests: list[bytes], bits: int) -> np.ndarray:
    """The same positions, an array of (digests, 4)."""
    raw = np.frombuffer(b"".join(x[:12].ljust(12, b"\0") for x in digests), dtype=np.uint8).reshape(-1, 4, 3).astype(np.int64)
    return (raw[:, :, 0] * 65536 + raw[:, :, 1] * 256 + raw[:, :, 2]) % bits


def _bitmap(index: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of fixed size over an index's digests; ``bits`` / 64 words at most reach the driver."""
    at = F.explode(_positions(bits)).alias("at")
    words = index.select(at).groupBy((F.col("at") / 64).cast("long").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("b"))
    got = words.toArrow()
    out = np.zeros(bits // 64, dtype=np.int64)
    out[got.column("w").to_numpy()] = got.column("b").to_numpy()
    return out


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", digest_bytes: int = 16, filter_bits: int = 1 << 24) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of ``docs``.

    ``filter_bits`` bounds the broadcast filter that says which texts are worth shipping for the byte check; a full filter
    ships more texts and changes no result.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    base = materialize(narrow.mapInArrow(_hashed("id", "text"), "id long, sha binary"), "exact-digests").withColumn("digest", F.substring("sha", 1, digest_bytes))
    index = materialize(build_index(base, digest_bytes, keep).where("n > 1"), "exact-index")
    bitmap = spark.sparkContext.broadcast(_bitmap(index, filter_bits).tobytes())

    def shipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bitmap.value, dtype=np.int64)
        for b in pieces(batches):
            low = [x.lower() for x in as_bytes(b.column("text"))]
            digest = [hashlib.sha256(x).digest()[:digest_bytes] for x in low]
            at = positions(digest, filter_bits)
            hit = np.flatnonzero(np.all((bits[at >> 6] >> (at & 63)) & 1, axis=1))
            if len(hit):
                yield pa.record_batch([b.column("id").take(pa.array(hit)), pa.array([digest[i] for i in hit], pa.binary()), pa.array([low[i] for i in hit], pa.binary())], ["id", "digest", "body"])

    seen = narrow.mapInArrow(shipped, "id long, digest binary, body binary")
    members = materialize(seen.join(index, "digest"), "exact-members")
    # Written, so that the join's two sides are plain exchanges and Spark can split a group that holds very many rows.
    stays = materialize(members.where(F.col("id").eqNullSafe(F.col("keep_id"))).dropDuplicates(["digest"]).select("digest", F.col("body").alias("stay")), "exact-stays")
    checked = members.join(stays, "digest").select("id", "digest", (F.col("body") == F.col("stay")).alias("same"), F.when(F.col("body") != F.col("stay"), F.col("body")).alias("body"))
    differs = checked.where("not same")
    joined = base.join(index, "digest", "left").select("id", "sha", "keep_id", "n")
    if not differs.isEmpty():
        # Digest collisions: these digests' rows are grouped by their whole text.
        bad = materialize(differs.select("digest").distinct(), "exact-collisions")
        best = F.max("id") if keep == "largest" else F.min("id")
        exact = members.join(bad, "digest", "left_semi").groupBy("digest", "body").agg(best.alias("keep_id"), F.count("*").alias("n")).select(F.unhex(F.sha2("body", 256)).alias("sha"), "keep_id", "n")
        fine = base.join(bad, "digest", "left_anti").join(index, "digest", "left").select("id", "sha", "keep_id", "n")
        joined = fine.unionByName(base.join(bad, "digest", "left_semi").join(exact, "sha", "left").select("id", "sha", "keep_id", "n"))
    keep_id = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return joined.select(
        F.col("id").alias("doc_id"), keep_id.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), F.col("id").eqNullSafe(keep_id).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )
