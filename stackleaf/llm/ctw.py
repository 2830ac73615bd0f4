"""LM scoring by context-tree weighting over bytes, with a unigram word model as its base.

A byte is eight binary decisions; each decision (the byte's bits so far) has its own context tree over the ``DEPTH`` bytes before. A node
holds the counts of zeros and ones that the training texts left there, its Krichevsky-Trofimov estimate, and the weight of this
estimate against its children's: P_w = (P_kt + product of the children's P_w) / 2, from the deepest nodes up. A decision's probability
mixes the estimates along the path with these weights; the code length of a text is the sum over its bytes and an end symbol (0xFF, never in
UTF-8, which also stands for the bytes before a text). A context that training never saw goes on with the estimate of its suffix.

The counts come from all training texts: every task sums its byte n-grams, Spark sums the tasks'. The model is the whole tree, every node
that training saw, so it grows with the input; no one holds it. Nodes of ``LOW`` bytes or more are built and weighed in shards by the last
``LOW`` bytes of their context, which also work out what they say of each n-gram that occurs in any text; the shards' sums weigh the shorter contexts
(at most 255 * 256^(LOW - 1) nodes), which finish each n-gram's logarithm. Of these the ``CELLS`` commonest travel with the tasks; the
others are joined by their key, as rare tokens are.

Base: tokens are counted over all training texts. Those that hold at least 1 / ``TOKENS`` of all tokens (at most TOKENS of them) travel with
the tasks; the others are joined by their hash (64 bits), with sums a row and token first.

Defined results: a null text is empty (its score is that of the end symbol); a null id is not held out; rows that repeat an id are
learned and scored each; without training tokens base_score is 0 for N = V = 0 and all decisions are even; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, materialize, pieces

DEPTH, LOW, CELLS, TOKENS = 5, 3, 1 << 20, 1 << 17
#: N-grams that a task takes together, in whole shards.
TOGETHER = 200_000
END = xxhash.xxh64_intdigest(b" end")  # words hold no space


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for x >= 0.5: eight steps up, then Stirling's series."""
    shift = sum(np.log(x + k) for k in range(8))
    z = x + 8
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - math.log(math.pi)


def grams(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The code (context bytes, then the byte; oldest first) at each byte of each text and at its end, and the texts' starts in it."""
    pad = b"\xff" * depth
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
    data = np.frombuffer(b"".join(pad + t + b"\xff" for t in texts), dtype=np.uint8)
    code = np.zeros(len(data) - depth, dtype=np.uint64)
    for k in range(depth + 1):
        code = (code << np.uint64(8)) | data[k : len(data) - depth + k]
    # A text's codes begin at its padding's start; the last ``depth`` positions before the next text belong to none.
    starts = np.concatenate([[0], np.cumsum(sizes + depth)])[:-1]
    keep = np.ones(len(code), dtype=bool)
    for k in range(depth):
        at = starts[1:] - depth + k
        keep[at] = False
    return code[keep], np.concatenate([[0], np.cumsum(sizes)])[:-1]


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, n = k[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[first], np.add.reduceat(n, first)


@dataclass
class Level:
    """Nodes of one depth, sorted by key (context, then the byte's bits so far after a one)."""

    keys: np.ndarray
    estimate: np.ndarray  # of a one
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's place, -1 where there is no such node."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)


def nodes_of(codes: np.ndarray, n: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted keys of the nodes of a depth, their zeros and ones, from codes of at least this depth."""
    codes, n = summed([codes & np.uint64(2 ** (8 * depth + 8) - 1)], [n])
    keys, ones = [], []
    for b in range(8):
        keys.append((codes >> np.uint64(8) << np.uint64(8)) | (np.uint64(1) << np.uint64(b)) | ((codes & np.uint64(255)) >> np.uint64(8 - b)))
        ones.append(np.where((codes >> np.uint64(7 - b)) & np.uint64(1), n, 0))
    distinct, back = np.unique(np.concatenate(keys), return_inverse=True)
    one, all_ = (np.bincount(back, x, minlength=len(distinct)).astype(np.float64) for x in (np.concatenate(ones), np.tile(n, 8)))
    return distinct, all_ - one, one


class ContextTree:
    def __init__(self, nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]], low: int = 0, below: tuple | None = None):
        """nodes: for each depth from ``low`` the sorted keys, their zeros and ones; below: keys, zeros, ones and totals (ln P_w) of the next
        depth's nodes, where these are elsewhere. ``total`` has the like of the least depth."""
        self.levels: list[tuple[int, Level]] = []
        for d in range(low + len(nodes) - 1, low - 1, -1):
            keys, zeros, ones = nodes[d - low]
            own = log_kt(zeros, ones)
            if below is None:
                total, weight = own, np.ones(len(keys))
            else:
                at = np.searchsorted(keys, below[0] & np.uint64(2 ** (8 * d + 8) - 1))
                total = np.logaddexp(own, np.bincount(at, below[3], minlength=len(keys)) if len(keys) else own) - math.log(2)
                weight = np.exp(own - math.log(2) - total)
            self.levels.insert(0, (d, Level(keys, (ones + 0.5) / (zeros + ones + 1.0), weight)))
            below = (keys, zeros, ones, total)
        self.total = below

    def ones(self, context: np.ndarray, prefix: np.ndarray, deeper: np.ndarray | None = None) -> np.ndarray:
        """The probability of a one after each context and bits so far; deeper: what longer contexts say. NaN: no such node."""
        live, path = np.arange(len(context)), []
        for d, level in self.levels:
            at = level.find(((context[live] & np.uint64(2 ** (8 * d) - 1)) << np.uint64(8)) | prefix[live])
            live, at = live[at >= 0], at[at >= 0]
            if not len(live):
                break
            path.append((live, at, level))
        q = np.full(len(context), np.nan) if deeper is None else deeper.copy()
        for live, at, level in reversed(path):
            w = np.where(np.isnan(q[live]), 1.0, level.weight[at])
            q[live] = w * level.estimate[at] + (1 - w) * np.nan_to_num(q[live])
        return q

    def bits(self, codes: np.ndarray, deeper: np.ndarray | None = None) -> np.ndarray:
        """(codes, 8): ``ones`` at each bit of each code's byte."""
        context, byte = codes >> np.uint64(8), codes & np.uint64(255)
        found = [self.ones(context, (np.uint64(1) << np.uint64(b)) | (byte >> np.uint64(8 - b)), None if deeper is None else deeper[:, b]) for b in range(8)]
        return np.stack(found, axis=1)

    def slow(self, codes: np.ndarray, deeper: np.ndarray | None = None) -> np.ndarray:
        """log10 of the probability of each code's byte after its context."""
        q = self.bits(codes, deeper)
        q = np.where(np.isnan(q), 0.5, q)
        bit = (codes[:, None] >> np.arange(7, -1, -1, dtype=np.uint64)) & np.uint64(1)
        return np.log10(np.where(bit, q, 1 - q)).sum(axis=1)


def tokens(text: bytes) -> list[int]:
    """The hashes of a text's tokens: its words and one end."""
    return [*map(xxhash.xxh64_intdigest, text.lower().split()), END]


def _counted(depth: int):
    """(kind, key, n): kind 0 byte n-grams (those of held-out texts count 0), kind 1 tokens; summed over the task, flushed when many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[[], [], 0], [[], [], 0]]

        def flush(kind: int) -> Iterator[pa.RecordBatch]:
            if held[kind][0]:
                k, n = summed(*held[kind][:2])
                for i in range(0, len(k), 50_000):
                    yield pa.record_batch([pa.array(np.full(len(k[i : i + 50_000]), kind, np.int32)), pa.array(k[i : i + 50_000].view(np.int64)), pa.array(n[i : i + 50_000])], ["kind", "key", "n"])
                held[kind] = [[], [], 0]

        for b in pieces(batches, 256):
            texts = [t.lower() for t in as_bytes(b.column("text"))]
            out = b.column("held_out").to_pylist()
            held_out, texts = [t for t, x in zip(texts, out, strict=True) if x], [t for t, x in zip(texts, out, strict=True) if not x]
            found = [(0, t, one) for t, one in ((held_out, 0), (texts, 1)) if t]
            found = [(kind, grams(t, depth)[0], one) for kind, t, one in found] + [(1, np.array([h for t in texts for h in tokens(t)], dtype=np.uint64), 1)]
            for kind, codes, one in found:
                k, n = np.unique(codes, return_counts=True)
                n = n * one
                held[kind][0].append(k)
                held[kind][1].append(n)
                held[kind][2] += len(k)
                if held[kind][2] > 1 << 21:
                    k, n = summed(*held[kind][:2])
                    held[kind] = [[k], [n], len(k)]
                    if len(k) > 1 << 20:
                        yield from flush(kind)
        for kind in (0, 1):
            yield from flush(kind)

    return run


def count(texts: DataFrame, depth: int) -> DataFrame:
    """The written counts (kind, key, n) of texts (held_out, text)."""
    return materialize(texts.mapInArrow(_counted(depth), "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")), "ctw-counts")


def learn(texts: DataFrame, depth: int = DEPTH) -> tuple[ContextTree, DataFrame]:
    """The whole tree over the bytes of ``texts`` (text) in the driver's memory, so of a small table; and the written counts (kind, key, n)."""
    counts = count(texts.select(F.lit(False).alias("held_out"), "text"), depth)
    rows = counts.where("kind = 0").toArrow()
    codes, n = rows.column("key").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    return ContextTree([nodes_of(codes, n, d) for d in range(depth + 1)] if len(codes) else []), counts


def _sharded(depth: int, low: int):
    """(kind, key, n, q, zeros, ones, total) of n-grams (shard, key, n) sorted by shard. Kind 0: each n-gram with what contexts of ``low`` bytes or more
    say of its bits; kind 1: sums of the nodes of ``low`` bytes by the node of one byte less."""

    def made(codes: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        seen = n > 0
        tree = ContextTree([nodes_of(codes[seen], n[seen], d) for d in range(low, depth + 1)] if seen.any() else [], low)
        for i in range(0, len(codes), 20_000):
            c = codes[i : i + 20_000]
            none = pa.nulls(len(c), pa.float64())
            q = tree.bits(c)
            yield pa.record_batch([pa.array(np.zeros(len(c), np.int32)), pa.array(c.view(np.int64)), pa.array(n[i : i + 20_000]), pa.array([x.tobytes() for x in q], pa.binary()), none, none, none], NAMES)
        if low and tree.total is not None:
            keys, *values = tree.total
            up, back = np.unique(keys & np.uint64(2 ** (8 * low) - 1), return_inverse=True)
            sums = [pa.array(np.bincount(back, v, minlength=len(up))) for v in values]
            yield pa.record_batch([pa.array(np.ones(len(up), np.int32)), pa.array(up.view(np.int64)), pa.nulls(len(up), pa.int64()), pa.nulls(len(up), pa.binary()), *sums], NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append([b.column(c).to_numpy() for c in ("shard", "key", "n")])
            size += b.num_rows
            if size >= TOGETHER:
                shard, key, n = (np.concatenate(x) for x in zip(*held, strict=True))
                cut = int(np.searchsorted(shard, shard[-1]))  # the last shard may go on
                if cut:
                    yield from made(key[:cut].view(np.uint64), n[:cut])
                held, size = [[shard[cut:], key[cut:], n[cut:]]], len(shard) - cut if cut else 0
        if held:
            _, key, n = (np.concatenate(x) for x in zip(*held, strict=True))
            if len(key):
                yield from made(key.view(np.uint64), n)

    return run


NAMES = ["kind", "key", "n", "q", "zeros", "ones", "total"]


def code_logs(grams_: DataFrame, depth: int) -> DataFrame:
    """(key, n, log): log10 of the probability that the whole tree over n-grams (key, n) gives each n-gram's last byte."""
    low = min(LOW, depth)
    shard = F.expr(f"shiftrightunsigned(key, 8) & {2 ** (8 * low) - 1}L").alias("shard")
    dealt = grams_.select(shard, "key", "n").repartition("shard").sortWithinPartitions("shard")
    parts = materialize(dealt.mapInArrow(_sharded(depth, low), "kind int, key long, n long, q binary, zeros double, ones double, total double"), "ctw-shards")
    got = parts.where("kind = 1").groupBy("key").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("total").alias("total")).orderBy("key").toArrow()
    keys, zeros, ones, total = got.column("key").to_numpy().view(np.uint64), *(got.column(c).to_numpy() for c in NAMES[4:])
    nodes = []
    for d in range(low):
        up, back = np.unique(keys & np.uint64(2 ** (8 * d + 8) - 1), return_inverse=True)
        nodes.append((up, *(np.bincount(back, x, minlength=len(up)).astype(np.float64) for x in (zeros, ones))))
    top = grams_.sparkSession.sparkContext.broadcast(ContextTree(nodes, 0, (keys, zeros, ones, total)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                q = np.frombuffer(b"".join(b.column("q").to_pylist()), dtype=np.float64).reshape(-1, 8)
                yield pa.record_batch([b.column("key"), b.column("n"), pa.array(top.value.slow(b.column("key").to_numpy().view(np.uint64), q))], ["key", "n", "log"])

    return materialize(parts.where("kind = 0").select("key", "n", "q").mapInArrow(run, "key long, n long, log double"), "ctw-logs")


def commonest(logs: DataFrame, most: int) -> int:
    """How often an n-gram must occur so that at most ``most`` do."""
    sizes = logs.groupBy(F.floor(F.log2(F.col("n") + 1)).alias("e")).agg(F.count("*").alias("c")).orderBy(F.col("e").desc()).collect()
    held, least = 0, 1 << 62
    for r in sizes:
        held += r.c
        if held > most:
            break
        least = (1 << r.e) - 1
    return least


class Hashed:
    """Distinct keys and their values, found by hash with linear steps; at most half of the places are taken."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        # No n-gram has all bits set: codes of 48 bits.
        self.keys = np.full(1 << self.bits, np.iinfo(np.uint64).max, dtype=np.uint64)
        self.values = np.zeros(1 << self.bits)
        at, left = self.place(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[at[left]] == np.iinfo(np.uint64).max
            spots, first = np.unique(at[left[free]], return_index=True)
            put = left[free][first]
            self.keys[spots], self.values[spots] = keys[put], values[put]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is there, and its value (0 if not)."""
        at = self.place(keys)
        got = self.keys[at]
        hit = got == keys
        out = np.where(hit, self.values[at], 0.0)
        left = np.flatnonzero(~hit & (got != np.iinfo(np.uint64).max))
        at = at[left]
        while len(left):
            at = (at + 1) & ((1 << self.bits) - 1)
            got, want = self.keys[at], keys[left]
            same = got == want
            hit[left[same]], out[left[same]] = True, self.values[at[same]]
            go = ~same & (got != np.iinfo(np.uint64).max)
            left, at = left[go], at[go]
        return hit, out


def _scored(often, common, depth: int):
    """(row, id, n_tokens, known, base, score, rare hashes, rare n-grams): base and score without the rare ones, which are joined later."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, logs = common.value
        part, row = TaskContext.get().partitionId(), 0
        for b in pieces(batches, 256):
            texts = [t.lower() for t in as_bytes(b.column("text"))]
            codes, starts = grams(texts, depth)
            hit, logs_of = often.value.find(codes)
            score = np.add.reduceat(logs_of, starts)
            ends = np.cumsum(np.add.reduceat((~hit).astype(np.int64), starts))
            rare_codes = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(codes[~hit].view(np.int64)))
            lists = [tokens(t) for t in texts]
            sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
            flat = np.array([h for x in lists for h in x], dtype=np.uint64)
            owner = np.repeat(np.arange(len(lists)), sizes)
            at = np.minimum(np.searchsorted(keys, flat), max(0, len(keys) - 1))
            hit = keys[at] == flat if len(keys) else np.zeros(len(flat), dtype=bool)
            known = np.bincount(owner[hit], minlength=len(lists))
            base = np.bincount(owner[hit], logs[at[hit]], minlength=len(lists)) if len(keys) else np.zeros(len(lists))
            ends = np.cumsum(np.bincount(owner[~hit], minlength=len(lists)))
            rare = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat[~hit].view(np.int64)))
            rows = (np.int64(part) << 33) + np.arange(row, row + len(lists))
            row += len(lists)
            yield pa.record_batch([pa.array(rows), b.column("id"), b.column("held_out"), pa.array(sizes), pa.array(known.astype(np.int64)), pa.array(base.astype(np.float64)), pa.array(score), rare, rare_codes], ["row", "id", "held_out", "n_tokens", "known", "base", "score", "rare", "rare_codes"])

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, out: int = 2, depth: int = DEPTH, cells: int = CELLS, common_tokens: int = TOKENS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``."""
    spark = docs.sparkSession
    held = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(modulus)) == out, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), held.alias("held_out"), F.col(text_col).alias("text"))
    counts = count(rows.select("held_out", "text"), depth)
    codes = code_logs(counts.where("kind = 0").select("key", "n"), depth)
    least = commonest(codes, cells)
    found = codes.where(F.col("n") >= least).select("key", "log").toArrow()
    code_keys = found.column("key").to_numpy().view(np.uint64)
    sent = spark.sparkContext.broadcast(Hashed(code_keys, found.column("log").to_numpy()))
    words = counts.where("kind = 1").select("key", "n")
    n, v = words.agg(F.sum("n"), F.count("*")).first()
    n = n or 0
    often = max(1, -(-n // common_tokens))
    top = words.where(F.col("n") >= often).toArrow()
    keys = top.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    common = spark.sparkContext.broadcast((keys[order], np.log10(top.column("n").to_numpy()[order] + 1.0)))
    schema = "row long, id long, held_out boolean, n_tokens long, known long, base double, score double, rare array<long>, rare_codes array<long>"
    scored = materialize(rows.mapInArrow(_scored(sent, common, depth), schema), "ctw-scores")
    rare = scored.select("row", F.explode("rare").alias("key")).groupBy("row", "key").agg(F.count("*").alias("tf"))
    met = rare.join(words.where(F.col("n") < often), "key").groupBy("row").agg(F.sum("tf").alias("more"), F.sum(F.col("tf") * F.log10(F.col("n") + 1)).alias("logs"))
    rare_codes = scored.select("row", F.explode("rare_codes").alias("key")).groupBy("row", "key").agg(F.count("*").alias("tf"))
    rest = rare_codes.join(codes.where(F.col("n") < least).select("key", "log"), "key").groupBy("row").agg(F.sum(F.col("tf") * F.col("log")).alias("rest"))
    full = scored.drop("rare", "rare_codes").join(met, "row", "left").join(rest, "row", "left")
    per_token = math.log10(n + v + 1)
    return full.select(
        F.col("id").alias("doc_id"), "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(per_token)).alias("base_score"), (F.col("score") + F.coalesce("rest", F.lit(0.0))).alias("score"),
    )
