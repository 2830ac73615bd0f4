"""SimHash near-dedup with Golay-code fuzzy hashing.

A fingerprint's 64 bits are three segments of 23, 23 and 18 bits (the last filled with zeros to 23). The binary Golay code of
length 23 is perfect: each word lies within 3 bits of exactly one codeword. Two words that differ in one bit at most share
a codeword between the one's own and the other's codewords within 4 bits: one for a word within 2 bits of its codeword,
six for a word at 3 bits. Of at most 3 differing bits, two of the three segments hold at most one each (pigeonhole), so for
each of the three pairs of segments the one fingerprint gives its own codeword indices as a key, and the other all
combinations of its nearby ones. Fingerprints that share a key are joined and their differing bits counted.

Only distinct fingerprints are joined, so copies of a text cost nothing; links go on to components by minimum labels.

Defined results: a text without words (null, empty, white space) has fingerprint 0 and links like any other; rows that repeat
an id are one document in their component; null ids take part and only count for component_id if no other id is there;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, materialize, pieces, sorted_join

#: Fixed value: the generator polynomial x^11+x^10+x^6+x^5+x^4+x^2+1 of the binary Golay code.
GENERATOR = 0b110001110101
SEGMENTS = ((41, 23), (18, 23), (0, 18))


def _remainder(words: np.ndarray) -> np.ndarray:
    """The syndrome: words of 23 bits modulo the generator."""
    r = words.astype(np.int64)
    for k in range(22, 10, -1):
        r = np.where(r >> k & 1, r ^ (GENERATOR << (k - 11)), r)
    return r


def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each of the 2048 syndromes: the error pattern of 3 bits at most, and up to six patterns of 4 bits at most (filled with the first)."""
    near = np.zeros((2048, 6), dtype=np.int64)
    found = np.zeros(2048, dtype=np.int64)
    for weight in range(5):
        errors = np.array([sum(1 << b for b in bits) for bits in combinations(range(23), weight)], dtype=np.int64)
        for syndrome, error in zip(_remainder(errors).tolist(), errors.tolist(), strict=True):
            if weight < 4 or (near[syndrome, 0].bit_count() == 3 and weight == 4):
                near[syndrome, found[syndrome]] = error
                found[syndrome] += 1
    assert found.max() == 6 and found.min() == 1
    for s, n in enumerate(found.tolist()):
        near[s, n:] = near[s, 0]
    return near[:, 0].copy(), near


class Golay:
    def __init__(self):
        self.leader, self.near = golay_tables()
        high = _remainder(np.arange(1 << 12, dtype=np.int64) << 11)
        self.high = high

    def syndrome(self, words: np.ndarray) -> np.ndarray:
        return self.high[words >> 11] ^ (words & 0x7FF)

    def own(self, words: np.ndarray) -> np.ndarray:
        """The index (12 bits) of the codeword that each word decodes to."""
        return (words ^ self.leader[self.syndrome(words)]) >> 11

    def nearby(self, words: np.ndarray) -> np.ndarray:
        """(words, 6): indices of the codewords within 4 bits; repeats where there is only one."""
        return (words[:, None] ^ self.near[self.syndrome(words)]) >> 11


def segments(prints: np.ndarray) -> list[np.ndarray]:
    p = prints.astype(np.uint64)
    return [((p >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64) for shift, width in SEGMENTS]


PAIRS = ((0, 1), (0, 2), (1, 2))


def own_keys(prints: np.ndarray, code: Golay) -> np.ndarray:
    """(prints, 3): one key a pair of segments."""
    own = [code.own(s) for s in segments(prints)]
    return np.stack([(k << 24) | (own[i] << 12) | own[j] for k, (i, j) in enumerate(PAIRS)], axis=1)


def probe_keys(prints: np.ndarray, code: Golay) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all combinations of nearby codewords, each once."""
    near = [code.nearby(s) for s in segments(prints)]
    single = [n[:, 1] == n[:, 0] for n in near]
    rows, keys = [], []
    for k, (i, j) in enumerate(PAIRS):
        for a in range(6):
            for b in range(6):
                at = np.flatnonzero(~((single[i] & (a > 0)) | (single[j] & (b > 0))))
                rows.append(at)
                keys.append((k << 24) | (near[i][at, a] << 12) | near[j][at, b])
    return np.concatenate(rows), np.concatenate(keys)


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 of a text's word shingles in order, repeats included; fewer words: of the whole sequence; none: empty."""
    words = text.lower().split()
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)] if words else [], dtype=np.uint64)
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - shingle + 1].tolist()
    return np.fromiter(map(xxhash.xxh64_intdigest, map(line.__getitem__, map(slice, starts, ends[shingle - 1 :].tolist())), repeat(42)), dtype=np.uint64, count=len(starts))


def fold(hashes: np.ndarray) -> int:
    """The SimHash: a bit is 1 if set in over half of the hashes."""
    total = np.zeros(64, dtype=np.int64)
    raw = hashes.view(np.uint8).reshape(-1, 8)
    for i in range(0, len(raw), 255):
        total += np.unpackbits(raw[i : i + 255], axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    bits = total * 2 > len(hashes)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The SimHash of a text's word shingles; without words 0."""
    return fold(shingle_hashes(text, shingle))


def _printed(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            fp = np.array([fingerprint(x, shingle) for x in as_bytes(b.column("text"))], dtype=np.uint64).view(np.int64)
            yield pa.record_batch([b.column("id").cast(pa.int64()), pa.array(fp)], ["id", "fp"])

    return run


def _keyed(own: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Golay()
        for b in pieces(batches, 4096):
            fp = b.column("fp").to_numpy()
            if own:
                rows, keys = np.repeat(np.arange(len(fp)), 3), own_keys(fp.view(np.uint64), code).ravel()
            else:
                rows, keys = probe_keys(fp.view(np.uint64), code)
            yield pa.record_batch([pa.array(keys.astype(np.int32)), pa.array(fp[rows])], ["key", "fp"])

    return run


def differing(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def links(prints: DataFrame, most: int = 3) -> DataFrame:
    """(a, b), a < b: all pairs of distinct fingerprints (fp) of ``prints`` that differ in ``most`` bits or fewer (3 at most)."""
    if not 0 <= most <= 3:
        raise ValueError("the segments' codewords cover at most 3 differing bits")
    own = prints.mapInArrow(_keyed(True), "key int, fp long").withColumnRenamed("fp", "a")
    near = prints.mapInArrow(_keyed(False), "key int, fp long").withColumnRenamed("fp", "b")
    # A fingerprint has up to 108 keys, which Spark's estimate of the size doesn't know of.
    return sorted_join(own, near, "key").where((F.col("a") < F.col("b")) & (differing("a", "b") <= most)).select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node each node of ``edges`` (a, b) reaches. Large-star and small-star rounds in turn: each node
    links its larger (then its smaller) neighbours to the smallest, until links no longer change; every round is written."""
    pairs = materialize(edges.select("a", "b"), "links")
    if pairs.isEmpty():
        return pairs.select(F.col("a").alias("node"), F.col("b").alias("label"))
    last = None
    while True:
        both = pairs.union(pairs.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # large has (node, smaller neighbour): small-star goes on from there.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x")).select("x.a", "x.b").where("a <> b").distinct()
        pairs = materialize(small, "links")
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    return pairs.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label"))


def _named(printed: DataFrame, firsts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``printed``, from the links (a, b) between fingerprints."""
    labels = materialize(components(pairs), "simhash-components")
    # The label is the smallest fingerprint; the smallest id of the component stands for it.
    named = firsts.join(labels, firsts["fp"] == labels["node"], "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    ids = named.groupBy("label").agg(F.min("first").alias("component_id"))
    of = materialize(named.join(ids, "label").select("fp", "component_id"), "simhash-of")
    # One row a fingerprint on one side: Spark splits a fingerprint that very many documents share.
    return printed.join(of, "fp").select(F.col("id").alias("doc_id"), "fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, most: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``; fp is the fingerprint as a signed long."""
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    printed = materialize(narrow.mapInArrow(_printed(shingle), "id long, fp long"), "simhash-prints")
    firsts = materialize(printed.groupBy("fp").agg(F.min("id").alias("first")), "simhash-firsts")
    return _named(printed, firsts, links(firsts.select("fp"), most))


def near_duplicates_by_similarity(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, most: int = 3, similarity: float = 0.8) -> DataFrame:
    """As ``near_duplicates``, with links also between texts whose sets of shingles have a Jaccard similarity of ``similarity`` or more.
    Fingerprints of texts that are 0.8 alike differ in about ten bits, far beyond what segments of 64 bits can be probed for."""
    from .shingle_links import similar_links, sketched

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    printed = materialize(sketched(narrow, shingle), "simhash-prints")
    firsts = materialize(printed.groupBy("fp").agg(F.min("id").alias("first")), "simhash-firsts")
    near = materialize(links(firsts.select("fp"), most), "simhash-links")
    alike = similar_links(narrow, printed, near, shingle, similarity)
    return _named(printed.select("id", "fp"), firsts, near.union(alike))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, most: int = 3, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` whose id is their component's smallest; all columns. Rows without an id stay."""
    found = near_duplicates_by_similarity(docs, id_col, text_col, shingle, most, similarity)
    gone = materialize(found.where("doc_id > component_id").select("doc_id").distinct(), "simhash-gone")
    return docs.join(gone, docs[id_col] == gone["doc_id"], "left_anti")
