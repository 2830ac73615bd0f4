"""Removal of byte strings that repeat anywhere, by suffix arrays over shards.

Every window of ``span`` bytes has an anchor: its k-gram with the smallest hash, the leftmost of equals. Equal windows have equal
anchors, so a window can only repeat among the windows of its anchor's k-gram. The windows of one anchor in a document are a run;
the run's bytes (its context) hold exactly these windows, and each window of the corpus is in exactly one context.

1. Anchors are counted over the corpus (partial sums first). K-grams that occur once end here. A filter of fixed size holds the others; what it
   lets through by mistake costs a shipment and changes nothing.
2. Contexts go to their k-gram's shard. Contexts that are equal within a piece of a task are covered at once, and only one goes on, so a
   passage that a third of all documents hold sends one row a piece.
   A k-gram that more than ``hot`` contexts share would overload its shard. Its contexts are dealt by their whole text instead, where equal ones are covered and
   become one. Its windows hold either the bytes before the k-gram or those after it, so each context that is left
   is split in two, keyed by the k-gram with half of the missing bytes at that side. Equal windows go the same way, as their k-gram stands at the
   same place in them. This repeats while a key is hot, until the key is the whole window.
3. In a shard, equal contexts are covered whole. Where a k-gram has different contexts, those that could share ``span`` bytes (by the longest
   common extensions to the right and to the left) form the shard's text, each up to the end of its extensions and equal ones once. Its suffix array comes from induced sorting: classify suffixes as S or L,
   sort the leftmost-smaller substrings recursively, induce the whole order from theirs; the permuted common prefixes (Phi) then give
   each suffix's common prefix with its predecessor. A start whose common prefix with a neighbour reaches ``span`` is covered.
4. Covered runs return to their documents, where they are joined and removed. Only texts whose document has a run (by a filter of fixed size) are
   shuffled for that; the others are finished where they are read.

A repeated string of ``span`` bytes consists of repeated strings of fewer bytes. So the steps run first for strings of ``passage`` bytes over all texts, which
gives the bytes in repeated passages (reported, not removed), and then for ``span`` bytes over the runs of these passages, which hold every longer repeat.

Defined results: null and empty texts are empty and lose nothing; matches never cross rows; rows that repeat id and text are copies of each
other, as any two rows; null ids take part; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, materialize, pieces
from .line_dedup import mix

K = 32


def kgram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the k bytes (a multiple of 8) at each position; len(data) - k + 1 of them."""
    n = len(data) - k + 1
    word = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), 0, (1,)).copy()
    h = np.zeros(n, dtype=np.uint64)
    for b in range(0, k, 8):
        h ^= word[b : b + n]
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return mix(h, 1)


Runs = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def runs(texts: list[bytes], span: int, k: int = K, chunk_bytes: int = 1 << 16) -> Runs:
    """(text, first window, last window, anchor, hash) of each run; positions within the text. Texts are taken a few at a time,
    so that the arrays over their bytes stay in the processor's cache."""
    none = np.zeros(0, dtype=np.int64)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    kept = np.flatnonzero(sizes >= span)
    if not len(kept):
        return none, none, none, none, none.view(np.uint64)
    chunk = np.cumsum(sizes[kept]) // chunk_bytes
    found = [_runs(texts, part, sizes, span, k) for part in np.split(kept, np.flatnonzero(np.diff(chunk)) + 1)]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _runs(texts: list[bytes], kept: np.ndarray, sizes: np.ndarray, span: int, k: int) -> Runs:
    """The runs of the texts ``kept``, each of ``span`` bytes or more."""
    data = np.frombuffer(b"".join(texts[t] for t in kept), dtype=np.uint8)
    starts = np.concatenate([[0], np.cumsum(sizes[kept])])
    h = kgram_hashes(data, k)
    low = (h >> np.uint64(32) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
    width, step = span - k + 1, 1
    while 2 * step <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if step < width:
        low = np.minimum(low[: len(low) - (width - step)], low[width - step :])
    anchor = (low & np.uint64(2**32 - 1)).astype(np.int64)
    owner = np.repeat(np.arange(len(kept)), sizes[kept])[: len(anchor)]
    window = np.flatnonzero(np.arange(len(anchor)) + span <= starts[owner + 1])
    owner, anchor = owner[window], anchor[window]
    first = np.ones(len(window), dtype=bool)
    first[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(first)
    last = np.concatenate([at[1:] - 1, [len(window) - 1]])
    base = starts[owner[at]]
    return kept[owner[at]], window[at] - base, window[last] - base, anchor[at] - base, h[anchor[at]]


def suffix_array(s: list[int], size: int) -> list[int]:
    """The suffix array of ``s`` (values under ``size``, the last one smaller than all others) by induced sorting."""
    n = len(s)
    if n == 1:
        return [0]
    values = np.array(s)
    # 1: S, smaller than the suffix after it. Equal neighbours have the kind of the next position that differs; the last is S.
    step = np.sign(np.diff(values))
    differs = np.where(step != 0, np.arange(n - 1), n)
    differs = np.minimum.accumulate(differs[::-1])[::-1]
    types = np.ones(n, dtype=bool)
    types[:-1] = step[np.minimum(differs, n - 2)] > 0
    kind = types.tobytes()
    ends = np.cumsum(np.bincount(values, minlength=size)).tolist()
    begins = [0, *ends[:-1]]
    lms = (np.flatnonzero(types[1:] & ~types[:-1]) + 1).tolist()

    def induce(order: list[int]) -> list[int]:
        sa, tail = [-1] * n, ends[:]
        for i in reversed(order):
            c = s[i]
            tail[c] -= 1
            sa[tail[c]] = i
        head = begins[:]
        for i in sa:
            if i > 0 and not kind[i - 1]:
                c = s[i - 1]
                sa[head[c]] = i - 1
                head[c] += 1
        tail = ends[:]
        for k in range(n - 1, -1, -1):
            i = sa[k]
            if i > 0 and kind[i - 1]:
                c = s[i - 1]
                tail[c] -= 1
                sa[tail[c]] = i - 1
        return sa

    sa = induce(lms)
    until = np.zeros(n, dtype=np.int64)
    until[lms] = [b + 1 for b in [*lms[1:], n - 1]]
    placed = np.array(sa)
    placed = placed[until[placed] > 0]
    names, name, last = np.zeros(n, dtype=np.int64), -1, None
    for i, z in zip(placed.tolist(), until[placed].tolist(), strict=True):
        piece = s[i:z]
        if piece != last:
            name += 1
            last = piece
        names[i] = name
    reduced = names[lms].tolist()
    if name + 1 < len(lms):
        ranked = [lms[i] for i in suffix_array(reduced, name + 1)]
    else:
        ranked = lms[:]
        for i, r in zip(lms, reduced, strict=True):
            ranked[r] = i
    return induce(ranked)


def permuted_prefixes(s: list[int], sa: list[int]) -> list[int]:
    """For each position, its suffix's common prefix with the suffix before it in the array."""
    n = len(s)
    before = [-1] * n
    for a, b in zip(sa, sa[1:], strict=False):
        before[b] = a
    out, h = [0] * n, 0
    for i in range(n):
        j = before[i]
        if j < 0:
            h = 0
            continue
        while i + h < n and j + h < n and s[i + h] == s[j + h]:
            h += 1
        out[i] = h
        if h:
            h -= 1
    return out


def repeated_starts(texts: list[bytes], span: int) -> list[np.ndarray]:
    """For each text, the starts of its ``span``-byte strings that also start elsewhere in any of them."""
    s: list[int] = []
    starts = []
    for t in texts:
        starts.append(len(s))
        s += [b + 2 for b in t]
        s.append(1)
    s.append(0)
    sa = suffix_array(s, 258)
    prefix = np.array(permuted_prefixes(s, sa))
    order = np.array(sa)
    found = np.zeros(len(s), dtype=bool)
    # A common prefix that holds a separator is no match: the starts that count have ``span`` bytes of their own text left.
    near = prefix[order] >= span
    found[order[near]] = True
    found[order[:-1][near[1:]]] = True
    return [np.flatnonzero(found[a : max(a, a + len(t) - span + 1)]) for a, t in zip(starts, texts, strict=True)]


def shared(a: bytes, b: bytes) -> int:
    """The length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n  # a[:lo] is common, a[:hi] isn't
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def extensions(parts: list[bytes]) -> list[int]:
    """Each part's longest common prefix with any other."""
    order = sorted(range(len(parts)), key=parts.__getitem__)
    out = [0] * len(parts)
    for a, b in zip(order, order[1:], strict=False):
        n = shared(parts[a], parts[b])
        out[a], out[b] = max(out[a], n), max(out[b], n)
    return out


def spans_of(starts: np.ndarray, span: int) -> list[tuple[int, int]]:
    """Runs of covered bytes of sorted starts."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > span) + 1
    return [(int(x[0]), int(x[-1]) + span) for x in np.split(starts, cut)]


def _positions(h: np.ndarray, bits: int) -> np.ndarray:
    return np.stack([(mix(h, 11 + k) % np.uint64(bits)).astype(np.int64) for k in range(3)], axis=1)


def _counted(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            h, n = np.unique(runs(as_bytes(b.column("text")), span)[4].view(np.int64), return_counts=True)
            yield pa.record_batch([pa.array(h), pa.array(n)], ["h", "n"])

    return run


def _filter_words(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = _positions(b.column("h").to_numpy().view(np.uint64), bits).ravel()
            yield pa.record_batch([pa.array(at >> 6), pa.array(np.left_shift(np.uint64(1), (at & 63).astype(np.uint64)).view(np.int64))], ["w", "b"])

    return run


SHIPPED = "kind int, h long, ctx binary, body binary, off int, many boolean, id long, th long, lo int, hi int"


def _shipment(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in SHIPPED.split(", ")]
    types = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def _shipped(span: int, bits: int, filter_bytes):
    """kind 0: contexts for the shards; kind 1: covered runs known here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = None if filter_bytes is None else np.frombuffer(filter_bytes.value, dtype=np.int64)
        for b in pieces(batches):
            texts, ids, hashes, bases = as_bytes(b.column("text")), *(b.column(c).to_pylist() for c in ("id", "th", "base"))
            text, lo, hi, anchor, h = runs(texts, span)
            hit = np.arange(len(h)) if words is None else np.flatnonzero(_hit(words, bits, h))
            groups: dict[tuple[int, bytes], list[tuple]] = {}
            for k in hit.tolist():
                t, a, z = int(text[k]), int(lo[k]), int(hi[k]) + span
                body = texts[t][a:z]
                groups.setdefault((int(h[k : k + 1].view(np.int64)[0]), xxhash.xxh3_128_digest(body)), []).append((body, int(anchor[k]) - a, ids[t], hashes[t], bases[t] + a, bases[t] + z))
            rows = []
            for (key, ctx), members in groups.items():
                body, off, i, th, a, z = members[0]
                if len(members) == 1:
                    rows.append((0, key, ctx, body, off, False, i, th, a, z))
                else:
                    rows.append((0, key, ctx, body, off, True, None, None, None, None))
                    rows += [(1, None, None, None, None, None, i, th, a, z) for _, _, i, th, a, z in members]
            for k in range(0, len(rows), 4096):
                yield _shipment(rows[k : k + 4096])

    return run


def wider(size: int, span: int) -> int:
    """The length of the grams that split the contexts around grams of ``size`` bytes."""
    return size + (span - size + 1) // 2


def _split(span: int, size: int):
    """Contexts (kind 0) around grams of ``size`` bytes to contexts around wider ones; each window goes to exactly one."""
    longer = wider(size, span)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            rows = []
            for body, off, many, i, th, lo in zip(*(b.column(c).to_pylist() for c in ("body", "off", "many", "id", "th", "lo")), strict=True):
                windows = len(body) - span + 1
                cut = min(max(off - (longer - size) + 1, 0), windows)  # windows that start before it hold the bytes before the gram
                for side, a, z, at in ((0, 0, cut, off - (longer - size)), (1, cut, windows, off)):
                    if a < z:
                        part = body[a : z - 1 + span]
                        key = xxhash.xxh64_intdigest(body[at : at + longer], 2 * size + side) - (1 << 63)
                        place = (None, None) if lo is None else (lo + a, lo + z - 1 + span)
                        rows.append((0, key, xxhash.xxh3_128_digest(part), part, at - a, many, i, th, *place))
            for k in range(0, len(rows), 4096):
                yield _shipment(rows[k : k + 4096])

    return run


#: Keys are broadcast up to so many (32 MB), counted first; beyond that both sides are dealt by key and salt.
BROADCAST_KEYS, SALTS = 1 << 20, 16


def _marked(contexts: DataFrame, keys: DataFrame) -> DataFrame:
    """``hot``: is a context's key among the written ``keys``, of which one may have very many contexts?"""
    flagged = keys.withColumn("hot", F.lit(True))
    if keys.count() <= BROADCAST_KEYS:
        met = contexts.join(F.broadcast(flagged), "h", "left")
    else:
        salted = flagged.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = contexts.withColumn("salt", F.pmod(F.xxhash64("ctx", "id", "lo"), F.lit(SALTS)).cast("int")).join(salted, ["h", "salt"], "left").drop("salt")
    return met.withColumn("hot", F.coalesce("hot", F.lit(False)))


def _repeats(contexts: DataFrame, span: int, hot: int, batch_bytes: int, few: int) -> DataFrame:
    """The covered runs (id, th, lo, hi) of the contexts. In each round the contexts of keys with at most ``hot`` contexts are judged in their key's shard;
    those of the others are dealt by their whole text, equal ones become one, and what is left is split and goes to the next round."""
    size, found = K, None
    while True:
        keys = materialize(contexts.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("h"), "suffix-hot-keys")
        shard = F.when(F.col("hot"), F.xxhash64("h", "ctx")).otherwise(F.col("h")).alias("shard")
        dealt = _marked(contexts, keys).select("*", shard).repartition("shard").sortWithinPartitions("shard", "h", "ctx").drop("shard", "kind")
        done = materialize(dealt.mapInArrow(_judged(span, batch_bytes, few), SHIPPED), "suffix-judged")
        runs_ = done.where("kind = 1").select("id", "th", "lo", "hi")
        found = runs_ if found is None else found.unionByName(runs_)
        if size == span or keys.isEmpty():  # a key that is the whole window has one context left
            return found
        contexts, size = materialize(done.where("kind = 0").mapInArrow(_split(span, size), SHIPPED), "suffix-split"), wider(size, span)


#: Contexts of one k-gram that are compared in pairs where only passages are looked for.
FEW = 16


def _judged(span: int, batch_bytes: int, few: int = 0):
    """A shard's contexts, those of a k-gram together and equal ones next to each other, to covered runs (kind 1); of hot keys only equal
    contexts are covered, and one of each comes back (kind 0)."""

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return _shipment([(1, None, None, None, None, None, *r) for r in rows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, waiting, held = None, {}, [], 0
        done: list[tuple] = []

        def close() -> None:
            nonlocal held
            members = list(group.values())
            if 1 < len(members) <= few:
                # Equal strings hold the k-gram at the same place, so two contexts share what their extensions around it span.
                for a, m in enumerate(members):
                    for o in members[:a]:
                        left = shared(m["body"][: m["off"]][::-1], o["body"][: o["off"]][::-1])
                        right = shared(m["body"][m["off"] :], o["body"][o["off"] :])
                        if left + right >= span:
                            for x in (m, o):
                                if x["own"] and not x["many"]:
                                    i, th, lo, _ = x["own"]
                                    done.append((i, th, lo + x["off"] - left, lo + x["off"] + right))
            elif len(members) > 1:
                right = extensions([m["body"][m["off"] :] for m in members])
                left = extensions([m["body"][: m["off"]][::-1] for m in members])
                # What a context shares with others ends where its extensions end, so the rest of it needn't be sorted. Contexts that
                # are equal up to there are covered up to there, and one of them stands for all.
                parts: dict[bytes, list[tuple | None]] = {}
                for m, r, f in zip(members, right, left, strict=True):
                    if r + f >= span:
                        a, z, own = m["off"] - f, m["off"] + r, m["own"] if not m["many"] else None
                        parts.setdefault(m["body"][a:z], []).append(own and (own[0], own[1], own[2] + a, own[2] + z))
                done.extend(own for owners in parts.values() if len(owners) > 1 for own in owners if own)
                if len(parts) > 1:
                    waiting.extend((part, owners[0] if len(owners) == 1 else None) for part, owners in parts.items())
                    held += sum(map(len, parts))
            group.clear()

        def sort() -> None:
            nonlocal held
            for starts, (_, own) in zip(repeated_starts([w[0] for w in waiting], span), waiting, strict=True):
                if own:
                    done.extend((own[0], own[1], own[2] + a, own[2] + z) for a, z in spans_of(starts, span))
            waiting.clear()
            held = 0

        last, kept = None, []

        def passed() -> None:
            nonlocal last
            if last is not None:
                h, ctx, body, off, many, own = last
                kept.append((0, h, ctx, body, off, many, *((None,) * 4 if many or own is None else own)))
            last = None

        for b in batches:
            for h, ctx, body, off, many, i, th, lo, hi, hot in zip(*(b.column(c).to_pylist() for c in ("h", "ctx", "body", "off", "many", "id", "th", "lo", "hi", "hot")), strict=True):
                own = (i, th, lo, hi) if lo is not None else None
                if hot:
                    if last is not None and last[:2] == (h, ctx):
                        done.extend(o for o in (last[5], own) if o)
                        last = (h, ctx, body, off, True, None)
                    else:
                        passed()
                        if many and own:
                            done.append(own)
                        last = (h, ctx, body, off, many, None if many else own)
                    continue
                if h != key:
                    close()
                    key = h
                    if held > batch_bytes:
                        sort()
                m = group.get(ctx)
                if m is None:
                    m = group[ctx] = {"body": body, "off": off, "many": many, "own": own}
                else:
                    if not m["many"] and m["own"]:
                        done.append(m["own"])
                    m["many"] = True
                if m["many"] and own:
                    done.append(own)
            if len(done) > 10_000:
                yield out(done)
                done.clear()
            if len(kept) > 2_000:
                yield _shipment(kept)
                kept.clear()
        close()
        passed()
        if waiting:
            sort()
        if done:
            yield out(done)
        if kept:
            yield _shipment(kept)

    return run


def joined(spans: list) -> list[tuple[int, int]]:
    """The maximal runs of spans (lo, hi)."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans or ()):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


RESULT = "id long, n_bytes long, n_removed long, n_spans long, n_repeated long, kept_sha256 string, kept binary, spans array<struct<lo:int,hi:int>>"


def _result(rows: list[tuple[int, bytes, list[tuple[int, int]], int]]) -> pa.RecordBatch:
    """The finished rows of (id, text, runs to remove, bytes in repeated passages)."""
    made = []
    for i, text, runs_, repeated in rows:
        kept, at = [], 0
        for lo, hi in runs_:
            kept.append(text[at:lo])
            at = hi
        left = b"".join([*kept, text[at:]])
        made.append((i, len(text), len(text) - len(left), len(runs_), repeated, hashlib.sha256(left).hexdigest(), left, [{"lo": a, "hi": z} for a, z in runs_]))
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))]
    cols = zip(*made, strict=True) if made else [[]] * len(types)
    return pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["id", "n_bytes", "n_removed", "n_spans", "n_repeated", "kept_sha256", "kept", "spans"])


def _row_keys(ids: pa.Array, th: pa.Array) -> np.ndarray:
    """One key for (id, th); a null id is a key of its own."""
    return mix(ids.cast(pa.int64()).fill_null(-(1 << 62)).to_numpy(zero_copy_only=False).view(np.uint64), 5) ^ th.to_numpy().view(np.uint64)


def _hit(words: np.ndarray, bits: int, keys: np.ndarray) -> np.ndarray:
    at = _positions(keys, bits)
    return np.all((words[at >> 6] >> (at & 63)) & 1, axis=1)


def _known(keys: DataFrame, most_bits: int):
    """A broadcast filter (bytes) of the written hashes ``h``, and its bits: 16 a key, at most ``most_bits``. A full filter lets more through and loses nothing."""
    bits = min(most_bits, max(1 << 10, 1 << (16 * keys.count()).bit_length()))
    words = keys.select("h").mapInArrow(_filter_words(bits), "w long, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bitmap = np.zeros(bits // 64, dtype=np.int64)
    bitmap[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return keys.sparkSession.sparkContext.broadcast(bitmap.tobytes()), bits


def covered(rows: DataFrame, span: int, filter_bits: int | None, batch_bytes: int, hot: int, few: int = 0) -> DataFrame:
    """(id, th, spans), written: the runs of bytes of the texts (id, th, base, text) that repeated strings of ``span`` bytes cover; ``base`` is added to positions.
    Without ``filter_bits`` k-grams aren't counted first, and all contexts go to their shards."""
    if filter_bits is None:
        return _covered(rows, span, None, 0, batch_bytes, hot, few)
    counted = rows.select("text").mapInArrow(_counted(span), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1")
    known, bits = _known(materialize(counted.select("h"), "suffix-kgrams"), filter_bits)
    return _covered(rows, span, known, bits, batch_bytes, hot, few)


def _covered(rows: DataFrame, span: int, known, bits: int, batch_bytes: int, hot: int, few: int) -> DataFrame:
    shipped = materialize(rows.mapInArrow(_shipped(span, bits, known), SHIPPED), "suffix-contexts")
    found = _repeats(shipped.where("kind = 0"), span, hot, batch_bytes, few).unionByName(shipped.where("kind = 1").select("id", "th", "lo", "hi"))
    return materialize(found.groupBy("id", "th").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")), "suffix-spans")


def _with(rows: DataFrame, spans: DataFrame, name: str, how: str) -> DataFrame:
    found = spans.select(F.col("id").alias("id2"), F.col("th").alias("th2"), F.col("spans").alias(name))
    return rows.join(found, F.col("id").eqNullSafe(F.col("id2")) & (F.col("th") == F.col("th2")), how).drop("id2", "th2")


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 400, passage: int = 256, filter_bits: int = 1 << 28, batch_bytes: int = 1 << 20, hot: int = 1 << 10
) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, n_repeated, kept_sha256, kept, spans) for every row: the bytes left and the runs removed; ``n_repeated`` bytes lie in
    strings of ``passage`` bytes (at most ``span``) that also start elsewhere."""
    if not 2 * K <= passage <= span:
        raise ValueError(f"passage must be {2 * K} bytes or more, and span not less")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), F.lit(0).alias("base"), text.cast("binary").alias("text"))
    passages = covered(rows, passage, filter_bits, batch_bytes, hot, FEW if passage < span else 0)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([pa.array(_row_keys(b.column("id"), b.column("th")).view(np.int64))], ["h"])

    known, bits = _known(materialize(passages.select("id", "th").mapInArrow(keyed, "h long"), "suffix-rows"), filter_bits)

    def busy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.frombuffer(known.value, dtype=np.int64)
        for b in pieces(batches):
            yield b.filter(pa.array(_hit(words, bits, _row_keys(b.column("id"), b.column("th")))))

    def calm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.frombuffer(known.value, dtype=np.int64)
        for b in pieces(batches):
            own = b.filter(pa.array(~_hit(words, bits, _row_keys(b.column("id"), b.column("th")))))
            yield _result([(i, t, [], 0) for i, t in zip(own.column("id").to_pylist(), as_bytes(own.column("text")), strict=True)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            parts = [(i, h, lo, t[lo:hi]) for i, h, t, s in zip(*(b.column(c).to_pylist() for c in ("id", "th", "text", "passages")), strict=True) for lo, hi in joined(s) if hi - lo >= span]
            cols = zip(*parts, strict=True) if parts else [[]] * 4
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["id", "th", "base", "text"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            found = zip(*(b.column(c).to_pylist() for c in ("id", "text", "gone", "passages")), strict=True)
            yield _result([(i, t, joined(g), sum(hi - lo for lo, hi in joined(p))) for i, t, g, p in found])

    met = rows.select("id", "th", "base", "text").mapInArrow(busy, "id long, th long, base int, text binary").drop("base")
    met = materialize(_with(met, passages, "passages", "left"), "suffix-met")
    if passage == span:
        gone = passages
    else:
        gone = covered(met.where("passages is not null").mapInArrow(cut, "id long, th long, base int, text binary"), span, None, batch_bytes, hot)  # nearly all k-grams there repeat
    done = _with(met, gone, "gone", "left").select("id", "text", "gone", "passages").mapInArrow(finish, RESULT)
    return done.unionByName(rows.mapInArrow(calm, RESULT))
