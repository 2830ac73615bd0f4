"""SentencePiece encoding by forward filtering and backward sampling over the piece lattice, and lossless decoding.

A vocabulary's pieces become byte strings (the mark U+2581 is a space, byte pieces are their byte), with probabilities: a unigram
model's own, or, for a BPE model, whose scores are ranks only, 1 / (rank + 1) by Zipf's law, summing to one. A text's UTF-8 bytes are
segmented without any normalisation; every byte has a byte piece, so every text has a segmentation and decoding is joining bytes.

Two neighbouring bytes that no piece holds next to each other separate the lattice, so a text falls into chunks (mostly words with the
space before). Forward filtering runs once for each distinct chunk of a batch: at each end, the weight of each piece length is the
piece's probability times the filtered probability where it starts. Backward sampling then draws, for each occurrence by itself, from its end
to its start. The random numbers are hashes of seed, row key, the chunk's number in its text and the step: they depend on nothing else.

Defined results: a null text is the empty text, with no pieces; a null row key is a key of its own; rows that repeat a key and a text get
the same segmentation; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, limit_batches, pieces
from .line_dedup import mix

#: Fixed value: SentencePiece's mark for a space.
SPACE_MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def vocabulary(path: str = MODEL) -> list[tuple[int, bytes, float]]:
    """(id, bytes, probability) of a model file's pieces; control and unknown pieces are left out."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    found = []
    for i in range(sp.get_piece_size()):
        if sp.is_byte(i):
            found.append((i, bytes([int(sp.id_to_piece(i)[3:5], 16)]), None))
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            found.append((i, sp.id_to_piece(i).replace(SPACE_MARK, " ").encode(), sp.get_score(i)))
    scores = np.array([x[2] for x in found if x[2] is not None])
    ranks = bool(len(scores)) and np.array_equal(scores, np.round(scores)) and scores.min() <= 1 - len(scores)
    last = len(scores)
    weigh = lambda s: 1 / (1 + (last if s is None else -s)) if ranks else float(np.exp(scores.min() - 10 if s is None else s))
    total = sum(weigh(s) for *_, s in found)
    best: dict[bytes, tuple[int, bytes, float]] = {}
    for i, b, s in found:
        if b and (b not in best or best[b][2] < weigh(s) / total):
            best[b] = (i, b, weigh(s) / total)
    missing = [b for b in range(256) if bytes([b]) not in best]
    if missing:
        raise ValueError(f"no piece for the bytes {missing}: texts that hold them can't be encoded losslessly")
    return sorted(best.values())


def double_array(children: list[dict[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, check, slot): a trie's nodes as slots, the root 0; the child by byte c of the node in slot s is in slot base[s] + c if check there is s."""
    size = 2 * len(children) + 4096
    used = np.zeros(size + 512, dtype=bool)
    used[0] = True
    base_of, slot, begin = np.zeros(len(children), dtype=np.int64), np.zeros(len(children), dtype=np.int64), {}
    order = sorted(range(len(children)), key=lambda k: -len(children[k]))
    many = [k for k in order if len(children[k]) > 1]
    for k in many:
        c = np.array(sorted(children[k]))
        at = begin.get(len(c), 0)
        while True:
            fit = np.flatnonzero(~used[np.arange(at, at + 2048)[:, None] + c].any(axis=1))
            if len(fit):
                break
            at += 2048
            if at + 4096 > len(used):
                used = np.concatenate([used, np.zeros(len(used), dtype=bool)])
        base_of[k] = begin[len(c)] = at + fit[0]
        used[base_of[k] + c] = True
    single = [k for k in order if len(children[k]) == 1]
    if len(single) > np.count_nonzero(~used[256:]):
        used = np.concatenate([used, np.zeros(len(single), dtype=bool)])
    for k, free in zip(single, np.flatnonzero(~used[256:]) + 256, strict=False):
        base_of[k] = free - next(iter(children[k]))
    for k, edges in enumerate(children):
        for c, to in edges.items():
            slot[to] = base_of[k] + c
    length = int(max(slot.max(), base_of.max())) + 257
    base, check = np.zeros(length, dtype=np.int32), np.full(length, -1, dtype=np.int32)
    base[slot] = base_of
    for k, edges in enumerate(children):
        for to in edges.values():
            check[slot[to]] = slot[k]
    return base, check, slot


class Lattice:
    """The pieces as a double-array trie, and the pairs of bytes that pieces hold. Built once, in the driver; a few megabytes, so it travels to the tasks."""

    def __init__(self, vocab: list[tuple[int, bytes, float]]):
        self.ids = np.array([i for i, _, _ in vocab], dtype=np.int32)
        self.bytes = {i: b for i, b, _ in vocab}
        self.probability = np.array([p for *_, p in vocab], dtype=np.float64)
        self.joined = np.zeros((256, 256), dtype=bool)
        children: list[dict[int, int]] = [{}]
        ends = {}
        for k, (_, b, _) in enumerate(vocab):
            at = 0
            for c in b:
                if c not in children[at]:
                    children[at][c] = len(children)
                    children.append({})
                at = children[at][c]
            ends[at] = k
            raw = np.frombuffer(b, dtype=np.uint8)
            self.joined[raw[:-1], raw[1:]] = True
        self.base, self.check, slot = double_array(children)
        self.ends = np.full(len(self.base), -1, dtype=np.int32)
        self.ends[slot[list(ends)]] = list(ends.values())

    def chunks(self, text: bytes) -> list[bytes]:
        raw = np.frombuffer(text, dtype=np.uint8)
        cuts = (np.flatnonzero(~self.joined[raw[:-1], raw[1:]]) + 1).tolist()
        return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)] if text else []

    def filtered(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(chunk starts, weights, pieces): at each byte as an end, cumulative weights over piece lengths and the pieces; chunks concatenated."""
        sizes = np.fromiter(map(len, chunks), dtype=np.int64, count=len(chunks))
        starts = np.concatenate([[0], np.cumsum(sizes)])
        data = np.frombuffer(b"".join(chunks), dtype=np.uint8)
        limit = np.repeat(starts[1:], sizes)
        found, at, state, length = [], np.arange(len(data)), np.zeros(len(data), dtype=np.int32), 0
        while len(at):
            to = self.base[state] + data[at + length]
            length += 1
            ok = self.check[to] == state
            at, state = at[ok], to[ok]
            piece = self.ends[state]
            end = np.flatnonzero(piece >= 0)
            found.append((at[end] + length - 1, piece[end]))
            ok = at + length < limit[at]
            at, state = at[ok], state[ok]
        while len(found) > 1 and not len(found[-1][0]):
            found.pop()
        which = np.full((len(data), len(found)), -1, dtype=np.int32)
        for k, (end, piece) in enumerate(found):
            which[end, k] = piece
        weights = np.zeros(which.shape, dtype=np.float32)
        # Chunks in order of size: those that reach step t are a suffix of the order.
        order = np.argsort(sizes, kind="stable")
        window = np.zeros((len(chunks), len(found)))  # filtered probabilities of the ends before, as multiples of the last
        if len(found):
            window[:, 0] = 1.0
        begin = np.searchsorted(sizes[order], np.arange(int(sizes.max(initial=0))), side="right")
        for t, lo in enumerate(begin.tolist()):
            own = order[lo:]
            to = starts[own] + t
            p = which[to]
            w = np.where(p >= 0, self.probability[p], 0.0) * window[own]
            total = w.sum(axis=1)
            weights[to] = np.cumsum(w, axis=1) / total[:, None]
            window[own, 1:] = window[own, :-1] / total[:, None]
            window[own, 0] = 1.0
        return starts, weights, which

    def sample(self, texts: list[bytes], keys: np.ndarray, most: int = 40_000) -> list[np.ndarray]:
        """For each text its piece ids, drawn with the text's key; ``most`` chunks are worked on at a time, however long a text is."""
        parts: list[list[np.ndarray]] = [[] for _ in texts]
        waiting: list[tuple[int, int, list[bytes]]] = []
        held = 0

        def flush() -> None:
            rows = np.array([t for t, _, _ in waiting], dtype=np.int64)
            drawn = self._drawn([c for *_, c in waiting], keys[rows], np.array([n for _, n, _ in waiting], dtype=np.int64))
            for t, ids in zip(rows.tolist(), drawn, strict=True):
                parts[t].append(ids)
            waiting.clear()

        for t, text in enumerate(texts):
            chunks = self.chunks(text)
            for n in range(0, len(chunks), most):
                waiting.append((t, n, chunks[n : n + most]))
                held += len(waiting[-1][2])
                if held >= most:
                    flush()
                    held = 0
        if waiting:
            flush()
        return [np.concatenate(x) if x else np.zeros(0, dtype=np.int32) for x in parts]

    def _drawn(self, parts: list[list[bytes]], keys: np.ndarray, first_numbers: np.ndarray) -> list[np.ndarray]:
        """The pieces of each part: a run of a text's chunks, with the text's key and the first chunk's number in the text."""
        index: dict[bytes, int] = {}
        lists = [[index.setdefault(c, len(index)) for c in x] for x in parts]
        counts = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        chunk = np.array([c for x in lists for c in x], dtype=np.int64)
        starts, weights, which = self.filtered(list(index))
        firsts = np.concatenate([[0], np.cumsum(counts)])
        number = np.arange(len(chunk)) - np.repeat(firsts[:-1] - first_numbers, counts)
        key = mix(np.repeat(keys.astype(np.uint64), counts) + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 3)
        live, at, drawn, steps, step = np.arange(len(chunk)), starts[chunk + 1] - 1, [], np.zeros(len(chunk), dtype=np.int64), 0
        while len(live):
            u = ((mix(key[live] + np.uint64(step), 5) >> np.uint64(40)).astype(np.float64) + 0.5) / 2**24
            row = weights[at]
            k = (row < u[:, None].astype(np.float32)).sum(axis=1)
            piece = which[at, np.minimum(k, row.shape[1] - 1)]
            short = piece < 0  # rounding at the upper end: the longest piece that there is
            if short.any():
                rows = which[at[short]]
                k[short] = rows.shape[1] - 1 - np.argmax(rows[:, ::-1] >= 0, axis=1)
                piece[short] = rows[np.arange(len(rows)), k[short]]
            drawn.append((live, piece))
            steps[live] += 1
            at = at - k - 1
            go = at >= starts[chunk[live]]
            live, at, step = live[go], at[go], step + 1
        ends = np.cumsum(steps)
        out = np.empty(ends[-1], dtype=np.int32)
        for s, (live, piece) in enumerate(drawn):
            out[ends[live] - 1 - s] = self.ids[piece]
        bounds = np.concatenate([[0], ends])[firsts].tolist()
        # Pieces were drawn from the end, so that the first drawn is the chunk's last.
        return [out[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))


def row_keys(ids: list, seed: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(str(i).encode(), seed) for i in ids], dtype=np.uint64)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = MODEL, seed: int = 1) -> DataFrame:
    """(id, ids, n_bytes, decoded): each row's sampled pieces, the text's bytes, and the bytes that the pieces decode to."""
    spark: SparkSession = docs.sparkSession
    limit_batches(spark)
    shared = spark.sparkContext.broadcast(Lattice(vocabulary(path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = shared.value
        for b in pieces(batches, 128):
            texts = as_bytes(b.column("text"))
            ids = lattice.sample(texts, row_keys(b.column("id").to_pylist(), seed))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids).astype(np.int32)))
            yield pa.record_batch([b.column("id"), lists, pa.array([len(t) for t in texts], pa.int64()), pa.array([lattice.decode(x) for x in ids], pa.binary())], ["id", "ids", "n_bytes", "decoded"])

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, "id long, ids array<int>, n_bytes long, decoded binary")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = MODEL, seed: int = 1) -> DataFrame:
    """(doc_id, n_bytes, n_pieces, ids_sha256, lossless) of ``encode``: the hash is over the ids as 32-bit little-endian integers."""
    import hashlib

    limit_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Lattice(vocabulary(path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = shared.value
        for b in pieces(batches, 128):
            texts = as_bytes(b.column("text"))
            ids = lattice.sample(texts, row_keys(b.column("id").to_pylist(), seed))
            rows = [(len(t), len(x), hashlib.sha256(x.astype("<i4").tobytes()).hexdigest(), lattice.decode(x) == t) for t, x in zip(texts, ids, strict=True)]
            n, k, sha, ok = zip(*rows, strict=True)
            yield pa.record_batch([b.column("id"), pa.array(n, pa.int64()), pa.array(k, pa.int64()), pa.array(sha), pa.array(ok)], ["doc_id", "n_bytes", "n_pieces", "ids_sha256", "lossless"])

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_bytes long, n_pieces long, ids_sha256 string, lossless boolean")
