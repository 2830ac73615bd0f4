"""Links between texts that share most of their word shingles, beyond what SimHash fingerprints can tell.

Candidates share a band: the smallest hashes of the shingle set under four of 48 functions (twelve bands). Texts that are 0.8 alike share
a band with probability 0.998. In a bucket of up to ``SMALL`` texts all pairs are candidates. In a larger one each member first meets two of
its texts, the one of the smallest id and one by a hash of text and band, which joins most copies. Then all pairs of the texts of large
buckets that could be alike are found by their rarest shingles (prefix filter): of two sets that are as alike as asked the smaller has a
common shingle among its first n - ceil(2t / (1 + t) n) + 1, the larger among its first n - ceil(t n) + 1, and the first one they share leaves
enough behind it in both. A template that many texts share stands behind their own shingles and is met only where it alone could make two
texts alike enough; lists of a shingle longer than ``LIST`` are compared in blocks, and texts that are joined already aren't compared.
Candidates are verified on whole shingle sets, in rounds: first for each text the candidate of a smaller id that shares most bands, then all
those between texts that the rounds before and the fingerprints have left in different components. What the rounds skip are links
within a component, which don't change it.

Defined results: texts without words have no shingles and get no link here; rows without an id link by fingerprint only; repeated rows
and texts of equal shingles are one text, of the smallest id; an empty table gives no links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, materialize, pieces, sorted_join

BANDS, ROWS = 12, 4
#: Texts with a candidate are looked up by a broadcast of their ids up to so many (16 MB), counted first; by a shuffle beyond.
BROADCAST_IDS = 2_000_000
#: Members of a bucket that all meet; texts of a shingle's list that Spark joins; texts in a block of a longer one.
SMALL, LIST, BLOCK = 16, 64, 1_000
#: Texts that hold a shingle before it counts as common; common shingles that travel with the tasks (32 MB).
RARE, COMMON = 8, 2_000_000

_random = np.random.default_rng(5)
FACTORS = _random.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
MASKS = _random.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)[:, None]


def band_keys(distinct: np.ndarray) -> list[int]:
    """One key a band; none for an empty set."""
    if not len(distinct):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(distinct), 2048):
        np.minimum(least, ((distinct[i : i + 2048] ^ MASKS) * FACTORS).min(axis=1), out=least)
    return [xxhash.xxh64_intdigest(least[k * ROWS : (k + 1) * ROWS].tobytes(), k) - (1 << 63) for k in range(BANDS)]


def digest(hashes: np.ndarray) -> int:
    """Tells apart the sequences of shingles."""
    return xxhash.xxh64_intdigest(hashes.tobytes(), 7) - (1 << 63)


def sketched(narrow: DataFrame, shingle: int) -> DataFrame:
    """(id, fp, dig, n, bands) of each row (id, text): fingerprint, digest of the shingles, their distinct number, band keys."""
    from .simhash import fold, shingle_hashes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            fp, dig, n, bands = [], [], [], []
            for text in as_bytes(b.column("text")):
                hashes = shingle_hashes(text, shingle)
                distinct = np.unique(hashes)
                fp.append(fold(hashes))
                dig.append(digest(hashes))
                n.append(len(distinct))
                bands.append(band_keys(distinct))
            made = [pa.array(np.array(fp, dtype=np.uint64).view(np.int64)), pa.array(dig, pa.int64()), pa.array(n, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.record_batch([b.column("id").cast(pa.int64()), *made], ["id", "fp", "dig", "n", "bands"])

    return narrow.mapInArrow(run, "id long, fp long, dig long, n long, bands array<long>")


def candidates(printed: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(a, b, shared): texts as structs (id, dig, fp, n), a's id below b's, that met in ``shared`` bands and whose sizes allow the similarity;
    and the texts (id, dig, fp, n) of large buckets, of which only some pairs met."""
    texts = printed.where("id is not null and n > 0").groupBy("dig", "fp", "n").agg(F.min("id").alias("id"), F.first("bands").alias("bands"))
    texts = materialize(texts, "alike-texts")
    members = texts.select(F.explode("bands").alias("key"), F.struct("id", "dig", "fp", "n").alias("m"))
    drawn = F.struct(F.xxhash64("m.dig", "key").alias("h"), "m")
    picked = materialize(members.groupBy("key").agg(F.count("*").alias("size"), F.min("m").alias("low"), F.min(drawn)["m"].alias("any")).where("size > 1"), "alike-buckets")
    large = picked.where(F.col("size") > SMALL)
    centers = large.select("key", F.explode(F.array_distinct(F.array("low", "any"))).alias("c"))
    few = materialize(sorted_join(members, picked.where(F.col("size") <= SMALL).select("key"), "key"), "alike-few")
    fits = (F.col("m.fp") != F.col("c.fp")) & (F.least("m.n", "c.n") >= F.greatest("m.n", "c.n") * F.lit(similarity) - 1e-6)
    small = sorted_join(few, few.withColumnRenamed("m", "c"), "key").where((F.col("m.id") < F.col("c.id")) & fits)
    met = sorted_join(members, centers, "key").where(fits).union(small).select(F.least("m", "c").alias("a"), F.greatest("m", "c").alias("b"))
    crowd = sorted_join(members, large.select("key"), "key").select("m.*").distinct()
    return materialize(met.groupBy("a", "b").agg(F.count("*").alias("shared")), "alike-candidates"), materialize(crowd, "alike-crowd")


def _common_tokens(sets: DataFrame):
    """A broadcast (tokens, classes) of the shingles that over ``RARE`` texts hold, by powers of two of their number; at most ``COMMON`` of them: the least number
    of texts doubles until no more are left. The order by class and hash is the same for all texts, whatever it leaves out."""

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 64):
            x, n = np.unique(np.concatenate([np.frombuffer(v.as_buffer(), dtype=np.int64) for v in b.column("hashes")] or [np.zeros(0, dtype=np.int64)]), return_counts=True)
            yield pa.record_batch([pa.array(x), pa.array(n)], ["token", "n"])

    held = sets.mapInArrow(shingles, "token long, n long").groupBy("token").agg(F.sum("n").alias("df")).where(F.col("df") > RARE)
    held = materialize(held.select("token", F.floor(F.log2("df")).alias("class")), "alike-common")
    least, left = 0, 0
    for r in held.groupBy("class").agg(F.count("*").alias("c")).orderBy(F.col("class").desc()).collect():
        left += r.c
        if left > COMMON:
            least = r["class"] + 1
            break
    found = held.where(F.col("class") >= least).orderBy("token").toArrow()
    return sets.sparkSession.sparkContext.broadcast((found.column("token").to_numpy(), found.column("class").to_numpy()))


def crowd_pairs(crowd: DataFrame, sets: DataFrame, similarity: float, longest: int | None = None, block: int | None = None) -> DataFrame:
    """(a, b): all pairs of the texts (id, dig, fp, n, label) of ``crowd``, as structs (id, dig, fp, n), of different labels that could be as alike as asked."""
    longest, block = longest or LIST, block or BLOCK
    t = similarity

    own = materialize(sets.join(crowd.select("dig").distinct(), "dig", "left_semi"), "alike-shingles")
    common = _common_tokens(own)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, classes = common.value
        for b in pieces(batches, 64):
            for dig, v in zip(b.column("dig").to_pylist(), b.column("hashes"), strict=True):
                x = np.frombuffer(v.as_buffer(), dtype=np.int64)
                n = len(x)
                at = np.minimum(np.searchsorted(tokens, x), max(0, len(tokens) - 1))
                kind = np.where(tokens[at] == x, classes[at], 0) if len(tokens) else np.zeros(n, dtype=np.int64)
                first = x[np.lexsort((x, kind))][: n - math.ceil(t * n - 1e-6) + 1]
                place = np.arange(1, len(first) + 1)
                low = place <= n - math.ceil(2 * t / (1 + t) * n - 1e-6) + 1
                yield pa.record_batch([pa.array(np.full(len(first), dig, dtype=np.int64)), pa.array(np.full(len(first), n, dtype=np.int64)), pa.array(first), pa.array(place), pa.array(low)], ["dig", "n", "token", "at", "low"])

    first = own.mapInArrow(prefixes, "dig long, n long, token long, at long, low boolean").drop("n")
    x = F.struct("n", "dig", "id", "fp", "label", "at", "low").alias("x")
    lists = materialize(sorted_join(first, crowd, "dig").select("token", x), "alike-lists")
    sizes = lists.groupBy("token").agg(F.count("*").alias("size"), F.min("x.label").alias("l1"), F.max("x.label").alias("l2"), F.max("x.low").alias("met")).where("size > 1 and l1 <> l2 and met")
    sizes = materialize(sizes.select("token", "size"), "alike-sizes")

    one = sorted_join(lists, sizes.where(F.col("size") <= longest), "token").drop("size")
    both = sorted_join(one, one.withColumnRenamed("x", "y"), "token")
    least = F.ceil(F.lit(t / (1 + t)) * (F.col("x.n") + F.col("y.n")) - F.lit(1e-6))
    behind = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at")) + 1
    before = F.struct("x.n", "x.dig") < F.struct("y.n", "y.dig")
    few = both.where(before & F.col("x.low") & (F.col("x.label") != F.col("y.label")) & (F.col("x.n") >= F.lit(t) * F.col("y.n") - 1e-6) & (behind >= least))
    few = few.select(F.col("x.dig").alias("p"), F.col("y.dig").alias("q"))

    def compared(group: pa.Table) -> pa.Table:
        own, other = group["own"][0].as_py(), group["other"][0].as_py()
        part = group["part"].to_numpy()
        n, dig, at, label, low = (group[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("n", "dig", "at", "label", "low"))
        found = []
        for rows, cols in ((own, other), (other, own))[: 1 + (own != other)]:
            i, cols = np.flatnonzero((part == rows) & low), np.flatnonzero(part == cols)
            for k in range(0, len(i), 256):
                r = i[k : k + 256][:, None]
                c = cols[None, :]
                fit = ((n[r] < n[c]) | ((n[r] == n[c]) & (dig[r] < dig[c]))) & (label[r] != label[c]) & (n[r] >= t * n[c] - 1e-6)
                fit &= np.minimum(n[r] - at[r], n[c] - at[c]) + 1 >= np.ceil(t / (1 + t) * (n[r] + n[c]) - 1e-6)
                u, v = np.nonzero(fit)
                found.append((dig[r[u, 0]], dig[cols[v]]))
        p, q = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, dtype=np.int64) for k in (0, 1))
        return pa.table({"p": pa.array(p, pa.int64()), "q": pa.array(q, pa.int64())})

    many = sorted_join(lists, sizes.where(F.col("size") > longest), "token").withColumn("parts", F.ceil(F.col("size") / block).cast("int"))
    many = many.withColumn("part", F.pmod(F.xxhash64("x.dig"), F.col("parts")).cast("int"))
    many = many.select("token", "x.n", "x.dig", "x.at", "x.label", "x.low", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("with"))
    many = many.withColumns({"own": F.least("part", "with"), "other": F.greatest("part", "with")}).drop("with")
    many = many.groupBy("token", "own", "other").applyInArrow(compared, "p long, q long")
    pairs = materialize(few.union(many).distinct(), "alike-crowd-pairs")
    end = lambda dig, name: crowd.select(F.col("dig").alias(dig), F.struct("id", "dig", "fp", "n").alias(name))
    return pairs.join(end("p", "m"), "p").join(end("q", "c"), "q").select(F.least("m", "c").alias("a"), F.greatest("m", "c").alias("b"))


def shingle_sets(narrow: DataFrame, pairs: DataFrame, crowd: DataFrame, shingle: int, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """(dig, hashes): the sorted distinct shingle hashes of each text in ``pairs`` and ``crowd``, eight bytes each."""
    from .simhash import shingle_hashes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 64):
            found = [shingle_hashes(x, shingle) for x in as_bytes(b.column("text"))]
            yield pa.record_batch([pa.array(map(digest, found), pa.int64()), pa.array([np.unique(x).tobytes() for x in found], pa.binary())], ["dig", "hashes"])

    ends = materialize(pairs.select(F.explode(F.array("a.id", "b.id")).alias("id")).union(crowd.select("id")).distinct(), "alike-ends")
    few = ends.count() <= broadcast_ids
    sets = narrow.join(F.broadcast(ends) if few else ends, "id", "left_semi").mapInArrow(run, "dig long, hashes binary")
    return materialize(sets.groupBy("dig").agg(F.first("hashes").alias("hashes")), "alike-sets")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): the fingerprints of the pairs whose sets are as similar as asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for one, two in zip(batch.column("ha"), batch.column("hb"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (one, two))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    flat = pairs.select(F.col("a.dig").alias("da"), F.col("b.dig").alias("db"), F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
    first = sorted_join(flat, sets.select(F.col("dig").alias("da"), F.col("hashes").alias("ha")), "da")
    both = sorted_join(first, sets.select(F.col("dig").alias("db"), F.col("hashes").alias("hb")), "db").select("a", "b", "ha", "hb")
    return materialize(both.mapInArrow(run, "a long, b long").distinct(), "alike-links")


def similar_links(narrow: DataFrame, printed: DataFrame, near: DataFrame, shingle: int, similarity: float, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """(a, b): links between fingerprints of ``printed`` that, with the links ``near``, join texts of the given similarity into components."""
    from .simhash import components

    met, crowd = candidates(printed, similarity)
    sets = shingle_sets(narrow, met, crowd, shingle, broadcast_ids)

    def first_of(pairs: DataFrame, by: Column) -> DataFrame:
        return materialize(pairs.groupBy("b").agg(F.max(F.struct(by.alias("by"), "a"))["a"].alias("a")).select("a", "b"), "alike-best")

    def apart(pairs: DataFrame, links: DataFrame) -> DataFrame:
        labels = materialize(components(near.union(links)), "alike-components")
        of = lambda end: labels.select(F.col("node").alias(f"{end}_node"), F.col("label").alias(f"{end}_label"))
        rest = pairs.join(of("a"), F.col("a.fp") == F.col("a_node"), "left").join(of("b"), F.col("b.fp") == F.col("b_node"), "left")
        return materialize(rest.where(F.coalesce("a_label", "a.fp") != F.coalesce("b_label", "b.fp")).select("a", "b"), "alike-rest")

    links = verified(first_of(met, F.col("shared")), sets, similarity)
    links = links.union(verified(apart(met, links), sets, similarity))
    if crowd.isEmpty():
        return links
    labels = materialize(components(near.union(links)), "alike-components")
    named = crowd.join(labels, F.col("fp") == F.col("node"), "left").select("id", "dig", "fp", "n", F.coalesce("label", "fp").alias("label"))
    more = crowd_pairs(materialize(named, "alike-crowd"), sets, similarity)
    more = materialize(more, "alike-more")
    links = links.union(verified(first_of(more, F.lit(0)), sets, similarity))
    return links.union(verified(apart(more, links), sets, similarity))
