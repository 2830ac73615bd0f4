"""Quality classifier: random Fourier features over document statistics, ridge by normal equations, isotonic calibration.

A text's statistics (shares of character kinds, word and line shapes, repetition; no label, language, source or id) are standardised over
the labelled rows and mapped to ``FEATURES`` cosines, whose inner products approximate a Gaussian kernel. Each partition sums its
part of the normal equations for each of five folds; the sums meet in the driver, whose size is fixed: at most
``PARTS`` partitions of five (FEATURES+1)^2 matrices. For each fold, the equations without it give scores for it, and those
out-of-fold scores, as counts in 4,096 bins, give the isotonic calibration by pooling adjacent violators. The whole sum gives the model.

Training takes at most about ``max_rows`` labelled rows (default 200,000), chosen by a hash of the id; every row is scored.

Defined results: null and empty texts have the statistics of an empty text and a score like any other; rows that repeat an id count as often
as they are there, and of several labels for an id the smallest counts; null ids can't be labelled (nor held out) but are scored; without
labels of both kinds the score is the labels' mean, or 0.5 without labels; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, materialize, pieces

FEATURES, FOLDS, PARTS, BINS = 256, 5, 16, 4096

#: The characters whose shares are statistics of their own.
MARKS = b".,!?|*#$%&@:;/=-_()\"'<>{}[]\\~^+"


def statistics(text: bytes) -> list[float]:
    """The statistics of one text; shares under a square root, which spreads small ones."""
    n = len(text)
    counts = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256) if n else np.zeros(256, dtype=np.int64)
    words = text.split()
    w = len(words)
    lines = text.split(b"\n")
    upper, lower, digits, wide = counts[65:91].sum(), counts[97:123].sum(), counts[48:58].sum(), counts[128:].sum()
    shares = [upper, lower, digits, wide, counts[10], n - upper - lower - digits - wide - counts[32] - counts[10], *(counts[c] for c in MARKS)]
    out = [math.sqrt(x / n) if n else 0.0 for x in shares]
    p = counts[counts > 0] / n if n else np.ones(1)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=w)
    out += [math.log1p(n), math.log1p(w), float(-(p * np.log2(p)).sum()), len(zlib.compress(text, 1)) / n if n else 0.0]
    out += [float(sizes.mean()), float(sizes.std()), float((sizes <= 3).mean()), float((sizes >= 12).mean())] if w else [0.0] * 4
    out += [len(set(words)) / w, len(set(zip(words, words[1:], strict=False))) / max(1, w - 1)] if w else [0.0] * 2
    out += [len(set(lines)) / len(lines), math.log1p(n / len(lines)), sum(x[:1].isupper() for x in words) / w if w else 0.0]
    return out


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches):
        x = pa.array([statistics(t) for t in as_bytes(b.column("text"))], pa.list_(pa.float32()))
        yield pa.record_batch([b.column("id").cast(pa.int64()), x], ["id", "x"])


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x): every row's statistics, written."""
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return materialize(narrow.mapInArrow(_measured, "id long, x array<float>"), "quality-stats")


def held_out(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6) @ self.directions + self.phases
        return np.concatenate([np.cos(z) * math.sqrt(2 / len(self.phases)), np.ones((len(x), 1))], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.calibrated(self.features(x) @ self.weights)

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        # A thousandth of the raw score keeps the order within a level of the calibration.
        return 0.999 * np.interp(raw, self.knots, self.values) + 0.001 * np.clip((raw + 1) / 3, 0, 1)


def pooled(positions: np.ndarray, ones: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression by pooling adjacent violators: the pools' mean positions and mean labels."""
    pools: list[list[float]] = []
    for p, s, n in zip(positions.tolist(), ones.tolist(), counts.tolist(), strict=True):
        pools.append([p * n, s, n])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([a / n for a, _, n in pools]), np.array([s / n for _, s, n in pools])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", max_rows: int = 200_000, ridge: float = 1e-4, seed: int = 7) -> Model:
    """The model of ``labels`` (id, 0 or 1) over ``stats``."""
    marked = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(label_col).cast("double").alias("y"))
    joined = stats.join(marked, "id")
    total = joined.count()
    part = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_000)) < math.ceil(1e6 * min(1.0, max_rows / max(total, 1)))
    rows = materialize(joined.where(part).withColumn("fold", F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(FOLDS)).cast("int")).coalesce(PARTS), "quality-train")

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("x"))
                yield pa.record_batch([pa.array([b.num_rows], pa.int64()), pa.array([x.sum(0).tolist()]), pa.array([(x**2).sum(0).tolist()]), pa.array([float(np.sum(b.column("y").to_numpy()))])], ["n", "s", "q", "y"])

    sums = rows.mapInArrow(moments, "n long, s array<double>, q array<double>, y double").toArrow().to_pylist()
    n, ones = sum(r["n"] for r in sums), sum(r["y"] for r in sums)
    size = len(statistics(b""))
    mean = np.sum([r["s"] for r in sums], axis=0) / n if n else np.zeros(size)
    var = np.sum([r["q"] for r in sums], axis=0) / n - mean**2 if n else np.ones(size)
    rng = np.random.default_rng(seed)
    model = Model(mean, np.sqrt(np.maximum(var, 1e-6)), rng.normal(size=(size, FEATURES)) / math.sqrt(size), rng.uniform(0, 2 * math.pi, FEATURES), np.zeros(FEATURES + 1), np.zeros(1), np.array([ones / n if n else 0.5]))
    if not 0 < ones < n:
        return model

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, v, counts = np.zeros((FOLDS, FEATURES + 1, FEATURES + 1)), np.zeros((FOLDS, FEATURES + 1)), np.zeros(FOLDS)
        for b in pieces(batches, 4096):
            z, y, fold = model.features(_matrix(b.column("x"))), b.column("y").to_numpy(), b.column("fold").to_numpy()
            for k in range(FOLDS):
                zk = z[fold == k]
                a[k] += zk.T @ zk
                v[k] += zk.T @ y[fold == k]
                counts[k] += len(zk)
        yield pa.record_batch([pa.array([x.tobytes()], pa.binary()) for x in (a, v, counts)], ["a", "v", "n"])

    a, v, counts = np.zeros((FOLDS, FEATURES + 1, FEATURES + 1)), np.zeros((FOLDS, FEATURES + 1)), np.zeros(FOLDS)
    for r in rows.mapInArrow(equations, "a binary, v binary, n binary").toLocalIterator():
        a += np.frombuffer(r["a"]).reshape(a.shape)
        v += np.frombuffer(r["v"]).reshape(v.shape)
        counts += np.frombuffer(r["n"])
    solve = lambda k: np.linalg.solve(k[0] + (ridge * k[2] + 1e-2) * np.eye(FEATURES + 1), k[1])
    model.weights = solve((a.sum(0), v.sum(0), counts.sum()))
    without = np.stack([solve((a.sum(0) - a[k], v.sum(0) - v[k], counts.sum() - counts[k])) for k in range(FOLDS)])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 4096):
            fold = b.column("fold").to_numpy()
            raw = np.einsum("ij,ij->i", model.features(_matrix(b.column("x"))), without[fold])
            at = np.clip((raw + 1) / 3 * BINS, 0, BINS - 1).astype(np.int64)
            yield pa.record_batch([pa.array(at), b.column("y")], ["bin", "y"])

    bins = rows.mapInArrow(binned, "bin long, y double").groupBy("bin").agg(F.sum("y").alias("s"), F.count("*").alias("n")).toArrow().sort_by("bin")
    at, s, m = (bins.column(c).to_numpy() for c in ("bin", "s", "n"))
    model.knots, model.values = pooled((at + 0.5) / BINS * 3 - 1, s, m)
    return model


def score(stats: DataFrame, model: Model) -> DataFrame:
    """(id, score) for every row of ``stats``."""
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 4096):
            yield pa.record_batch([b.column("id"), pa.array(shared.value.score(_matrix(b.column("x"))))], ["id", "score"])

    return stats.mapInArrow(run, "id long, score double")


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            x = np.array([statistics(t) for t in as_bytes(b.column(text_col))], dtype=np.float32).astype(np.float64)
            yield b.filter(pa.array(shared.value.score(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)
