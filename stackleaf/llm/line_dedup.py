"""Line dedup through a sharded minimal perfect hash.

Map side: a document gives each of its distinct line keys once, as a 128-bit hash in two halves. An aggregation with
partial sums (so a line that a third of all documents hold costs one row a task) counts documents and finds the smallest
id. The first half is the hash key; a shard of its keys that occur in two or more documents becomes a minimal perfect
hash: bit arrays in levels, where a key sits in the first level in which no other key of its shard hits its bit, and its
index is the rank of that bit. The index addresses three compact arrays: the second half as fingerprint, the number of
documents and the smallest id. A key of only one document can't lose lines and stays out; its fingerprint then differs.

Probe side: if all shards fit ``broadcast_bytes`` (their size is summed first), documents probe the broadcast arrays as they are
read. Else the line hashes travel to their shard's arrays, each shard's probes salted over several tasks, and hits return to
the documents by id. Both ways give the same rows.

Defined results: null and empty text are one empty line; rows that repeat an id count as one document and lose lines alike;
a row whose id is null has no place in the order, so it neither makes a line count as repeated nor loses any (its text is returned whole);
an empty table gives no rows; other columns than the id and the text come back as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, as_bytes, materialize, pieces

GAMMA = 2.0
LEVELS = 40


def mix(h: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply) of h under a seed."""
    x = h.astype(np.uint64) ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash of one shard: per level a bit array of GAMMA bits a remaining key; rank gives the index."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes.astype(np.int64), words.astype(np.uint64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).astype(np.int64))])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, words, left = [], [], np.unique(keys)
        for level in range(LEVELS):
            if not len(left):
                break
            size = -(-max(64, int(GAMMA * len(left))) // 64) * 64
            at = (mix(left, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            words.append(np.packbits(alone, bitorder="little").view(np.uint64))
            left = left[~alone[at]]
        if len(left):
            raise ValueError("keys remain after the last level")  # 64-bit keys are distinct: less than once in 2**40 builds
        return cls(np.array(sizes, dtype=np.int64), np.concatenate(words) if words else np.zeros(0, np.uint64))

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Each key's index, -1 for some that aren't in it; others get any index, which the fingerprint then denies."""
        out, todo = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(todo):
                break
            bit = (mix(keys[todo], level) % np.uint64(size)).astype(np.int64) + self.starts[level]
            word, off = bit >> 6, (bit & 63).astype(np.uint64)
            hit = (self.words[word] >> off) & np.uint64(1) == 1
            below = self.words[word[hit]] & ((np.uint64(1) << off[hit]) - np.uint64(1))
            out[todo[hit]] = self.ranks[word[hit]] + np.bitwise_count(below)
            todo = todo[~hit]
        return out


class Shard:
    """A perfect hash with the arrays it addresses."""

    def __init__(self, sizes, words, prints, counts, firsts):
        self.hash = PerfectHash(np.frombuffer(sizes, np.int64), np.frombuffer(words, np.uint64))
        self.prints, self.counts, self.firsts = np.frombuffer(prints, np.int64), np.frombuffer(counts, np.int64), np.frombuffer(firsts, np.int64)

    def first(self, keys: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """The smallest id that holds each key, or the largest long for keys that aren't indexed."""
        at = self.hash.index(keys.view(np.uint64))
        found = np.full(len(keys), np.iinfo(np.int64).max)
        got = np.flatnonzero(at >= 0)
        got = got[self.prints[at[got]] == prints[got]]
        found[got] = self.firsts[at[got]]
        return found


def shard_arrays(keys: np.ndarray, prints: np.ndarray, counts: np.ndarray, firsts: np.ndarray) -> tuple[bytes, ...]:
    ph = PerfectHash.build(keys.view(np.uint64))
    at = ph.index(keys.view(np.uint64))
    out = []
    for values in (prints, counts, firsts):
        a = np.zeros(len(keys), dtype=np.int64)
        a[at] = values
        out.append(a.tobytes())
    return (ph.sizes.tobytes(), ph.words.tobytes(), *out)


def line_keys(text: bytes, least: int) -> tuple[list[bytes], list[tuple[int, int] | None]]:
    """A text's lines, and each line's 128-bit hash, or None where its key is under ``least`` code points."""
    lines = text.split(b"\n")
    hashes: list[tuple[int, int] | None] = []
    for line in lines:
        key = line.strip(SPACE).lower()
        if len(key) < least or len(key) < 4 * least and len(key.decode("utf-8", "replace")) < least:
            hashes.append(None)
        else:
            h = xxhash.xxh3_128_intdigest(key)
            hashes.append(((h >> 64) - (h >> 127 << 64), (h & (2**64 - 1)) - ((h >> 63 & 1) << 64)))
    return lines, hashes


def _hashes(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            ids, h1, h2 = [], [], []
            for i, text in zip(b.column("id").to_pylist(), as_bytes(b.column("text")), strict=True):
                if i is not None:
                    for x in {x for x in line_keys(text, least)[1] if x}:
                        ids.append(i)
                        h1.append(x[0])
                        h2.append(x[1])
            yield pa.record_batch([pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(ids, pa.int64())], ["h1", "h2", "id"])

    return run


def _built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards of (shard, h1, h2, n, first), rows of one shard together; one shard is held at a time."""
    held: list[pa.RecordBatch] = []

    def done() -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        cols = [t.column(c).to_numpy() for c in ("h1", "h2", "n", "first")]
        # Two keys of one shard may share h1 only if 64 bits collide: the later goes without an entry of its own.
        _, at = np.unique(cols[0], return_index=True)
        return pa.record_batch([pa.array([held[0].column("shard")[0].as_py()], pa.int32()), *(pa.array([x], pa.binary()) for x in shard_arrays(*(c[at] for c in cols)))], ["shard", "sizes", "words", "prints", "counts", "firsts"])

    for b in batches:
        shards = b.column("shard").to_numpy()
        cuts = np.flatnonzero(np.diff(shards)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(shards)], strict=True):
            if hi > lo:
                if held and held[0].column("shard")[0].as_py() != shards[lo]:
                    yield done()
                    held = []
                held.append(b.slice(lo, hi - lo))
    if held:
        yield done()


SHARD = "shard int, sizes binary, words binary, prints binary, counts binary, firsts binary"


def line_index(docs: DataFrame, least: int = 10, shard_rows: int = 200_000) -> tuple[DataFrame, int, int]:
    """The written shards over ``docs`` (id, text), their number and their bytes."""
    lines = docs.mapInArrow(_hashes(least), "h1 long, h2 long, id long")
    counts = materialize(_repeated(lines), "line-counts")
    shards = max(1, -(-counts.count() // shard_rows))
    keyed = counts.withColumn("shard", _shard_of("h1", shards))
    built = materialize(keyed.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(_built, SHARD), "line-shards")
    size = built.select(F.sum(sum(F.length(c) for c in ("words", "prints", "counts", "firsts")))).first()[0] or 0
    return built, shards, size


def _repeated(lines: DataFrame) -> DataFrame:
    """Keys of two or more documents. The partial aggregation keeps smallest and largest id: they differ if ids do, so that
    rows that repeat an id count once without a distinct over all lines."""
    return lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("h1", "h2", "n", "first")


def _shard_of(h1: str, shards: int):
    return F.pmod(F.col(h1), F.lit(shards)).cast("int")


def _probed(rows: Broadcast, shards: int, least: int):
    """Documents probe the broadcast shards: (row, kept text, lines, dropped)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {k: Shard(*x) for k, *x in rows.value}
        for b in pieces(batches):
            texts, ids = as_bytes(b.column("text")), b.column("id").to_pylist()
            split = [line_keys(x, least) for x in texts]
            flat = [(k, *h) for k, (_, hs) in enumerate(split) if ids[k] is not None for h in set(hs) if h]
            dropped: list[set] = [set() for _ in texts]
            if flat:
                doc, h1, h2 = (np.array(x, dtype=np.int64) for x in zip(*flat, strict=True))
                own = np.array([ids[k] for k in doc.tolist()], dtype=np.int64)
                shard = h1 % shards  # as pmod: never negative
                for s in np.unique(shard):
                    if int(s) in held:
                        at = np.flatnonzero(shard == s)
                        first = held[int(s)].first(h1[at], h2[at])
                        for k in at[first < own[at]]:
                            dropped[doc[k]].add((int(h1[k]), int(h2[k])))
            yield _result(b, [_keep(x, d) for x, d in zip(split, dropped, strict=True)])

    return run


def _keep(split: tuple, dropped: set) -> tuple[bytes, int, int]:
    lines, hashes = split
    keep = [x for x, h in zip(lines, hashes, strict=True) if h is None or h not in dropped]
    return b"\n".join(keep), len(lines), len(lines) - len(keep)


def _result(b: pa.RecordBatch, kept: list[tuple[bytes, int, int]]) -> pa.RecordBatch:
    texts, n, gone = zip(*kept, strict=True)
    skip = {"id", "text", "hits"}
    names = [c for c in b.schema.names if c not in skip]
    cols = [*(b.column(c) for c in names), b.column("id"), pa.array(texts, pa.binary()).cast(pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in texts]), pa.array(n, pa.int64()), pa.array(gone, pa.int64())]
    return pa.record_batch(cols, [*names, "id", "text", "kept_sha256", "n_lines", "n_dropped"])


def _routed(docs: DataFrame, built: DataFrame, shards: int, least: int, salts: int) -> DataFrame:
    """(id, hits): each document's hashes that it loses; hashes go to (shard, salt), where the shard's arrays wait."""
    lines = docs.mapInArrow(_hashes(least), "h1 long, h2 long, id long").withColumn("shard", _shard_of("h1", shards)).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    copies = built.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"h1": [], "h2": [], "id": []}
        if right.num_rows and left.num_rows:
            row = right.to_pylist()[0]
            h1, h2, own = (left.column(c).to_numpy() for c in ("h1", "h2", "id"))
            lost = Shard(*(row[c] for c in ("sizes", "words", "prints", "counts", "firsts"))).first(h1, h2) < own
            out = {"h1": h1[lost], "h2": h2[lost], "id": own[lost]}
        return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})

    hits = lines.groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt")).applyInArrow(probe, "h1 long, h2 long, id long")
    return hits.groupBy("id").agg(F.collect_set(F.struct("h1", "h2")).alias("hits"))


def _cut_by_hits(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            hits = [{(x["h1"], x["h2"]) for x in h or ()} for h in b.column("hits").to_pylist()]
            yield _result(b, [_keep(line_keys(t, least), h) for t, h in zip(as_bytes(b.column("text")), hits, strict=True)])

    return run


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 10, broadcast_bytes: int = 32 << 20, salts: int = 16) -> DataFrame:
    """The rows of ``docs`` with the kept text in place of the text, and kept_sha256, n_lines, n_dropped; underscores follow an added name that a column of
    ``docs`` has."""
    spark = docs.sparkSession
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    named = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *(F.col(c).alias(f"x{k}") for k, c in enumerate(others)))
    narrow = named.select("id", "text")
    built, shards, size = line_index(narrow, least)
    types = {f.name: f.dataType.simpleString() for f in named.schema}
    schema = ", ".join([*(f"x{k} {types[f'x{k}']}" for k in range(len(others))), "id long", "text string", "kept_sha256 string", "n_lines long", "n_dropped long"])
    if size <= broadcast_bytes:
        rows = spark.sparkContext.broadcast([tuple(r) for r in built.collect()])
        out = named.mapInArrow(_probed(rows, shards, least), schema)
    else:
        hits = _routed(narrow, built, shards, least, salts)
        out = named.join(hits, "id", "left").mapInArrow(_cut_by_hits(least), schema)
    back = {id_col: F.col("id"), text_col: F.col("text")} | {c: F.col(f"x{k}") for k, c in enumerate(others)}
    added, taken = [], set(docs.columns)
    for c in ("kept_sha256", "n_lines", "n_dropped"):
        name = c
        while name in taken:
            name += "_"
        taken.add(name)
        added.append(F.col(c).alias(name))
    return out.select(*(back[c].alias(c) for c in docs.columns), *added)
