"""The trained models against direct computations: context trees by recursion, ridge and isotonic fits by numpy; bounds and refusals."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stackleaf.llm import common, ctw, quality, topk


def tree_scores(train, texts, depth):
    """log10 of the probability of each text by the whole context tree, decision by decision."""
    counts = {}

    def decisions(text):
        data = b"\xff" * depth + text.lower() + b"\xff"
        for i in range(depth, len(data)):
            for b in range(8):
                yield data[i - depth : i], (1 << b) | (data[i] >> (8 - b)), data[i] >> (7 - b) & 1

    for t in train:
        for context, prefix, bit in decisions(t):
            for d in range(depth + 1):
                counts.setdefault((d, context[depth - d :], prefix), [0, 0])[bit] += 1

    def log_kt(z, o):
        return math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.lgamma(z + o + 1) - math.log(math.pi)

    children = {}
    for d, context, prefix in counts:
        if d:
            children.setdefault((d - 1, context[1:], prefix), []).append((d, context, prefix))
    memo = {}

    def log_pw(node):
        if node not in memo:
            own = log_kt(*counts[node])
            memo[node] = own if node[0] == depth else np.logaddexp(own, sum(map(log_pw, children[node]))) - math.log(2)
        return memo[node]

    def one(context, prefix, d=0):
        node = (d, context[depth - d :], prefix)
        if node not in counts:
            return None
        z, o = counts[node]
        estimate = (o + 0.5) / (z + o + 1)
        deeper = one(context, prefix, d + 1) if d < depth else None
        if deeper is None:
            return estimate
        w = math.exp(log_kt(z, o) - math.log(2) - log_pw(node))
        return w * estimate + (1 - w) * deeper

    out = []
    for t in texts:
        total = 0.0
        for context, prefix, bit in decisions(t):
            p = one(context, prefix)
            p = 0.5 if p is None else p
            total += math.log10(p if bit else 1 - p)
        out.append(total)
    return out


@pytest.mark.parametrize(("depth", "cells"), [(1, 1 << 20), (3, 1 << 20), (4, 40)])
def test_scores_equal_the_whole_tree(spark, depth, cells):
    """Held-out texts, contexts never seen, repeated and empty texts; with few n-grams in the tasks the others are joined."""
    texts = ["the cat sat on the mat", "the cat ate the rat", "", None, "zzzz \x00 qqq", "THE CAT SAT ON THE MAT", "été à la mer", "a" * 60, "abcabcabcabd", "the dog sat"] * 2
    raw = [(t or "").encode() for t in texts]
    train = [t for i, t in enumerate(raw) if zlib.crc32(str(i).encode()) % 7 != 2]
    assert 0 < len(train) < len(raw)
    want = tree_scores(train, raw, depth)
    got = {r.doc_id: r.score for r in ctw.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), depth=depth, cells=cells).collect()}
    assert all(math.isclose(got[i], w, abs_tol=1e-9 * max(1, len(raw[i]))) for i, w in enumerate(want))


def isotonic(y, w):
    """The min-max formula, over all blocks."""
    mean = lambda a, b: sum(p * q for p, q in zip(y[a : b + 1], w[a : b + 1], strict=True)) / sum(w[a : b + 1])
    return [max(min(mean(a, b) for b in range(k, len(y))) for a in range(k + 1)) for k in range(len(y))]


def test_pooling_is_isotonic_regression():
    r = np.random.default_rng(2)
    for _ in range(40):
        n = r.integers(1, 9, 12)
        ones = r.integers(0, n + 1)
        at = np.arange(12.0)
        knots, values = quality.pooled(at, ones, n)
        want = isotonic((ones / n).tolist(), n.tolist())
        assert np.all(np.diff(values) > 0)
        # A pool's value is that of its members.
        sizes, k = [], 0
        for v in values:
            m = sum(math.isclose(x, v, abs_tol=1e-9) for x in want)
            sizes.append(m)
            k += m
        assert k == 12 and math.isclose(sum(v * s for v, s in zip(values, sizes, strict=True)), sum(want), abs_tol=1e-9)


def test_weights_are_the_ridge_solution(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where(quality.held_out(F.col("doc_id"), 5) != 0)
    stats = quality.measure(docs)
    model = quality.fit(stats, labels)
    rows = stats.join(labels.select(F.col("doc_id").alias("id"), "quality"), "id").collect()
    x, y = np.array([r.x for r in rows], dtype=np.float64), np.array([float(r.quality) for r in rows])
    assert np.allclose(model.mean, x.mean(0), atol=1e-5)
    z = model.features(x)
    want = np.linalg.solve(z.T @ z + (1e-4 * len(y) + 1e-2) * np.eye(z.shape[1]), z.T @ y)
    assert np.allclose(model.weights, want, atol=1e-6)
    # The cosines' inner products approximate the kernel exp(-|x - y|^2 / (2 * size)).
    u = np.clip((x[:200] - model.mean) / model.scale, -6, 6)
    kernel = np.exp(-((u[:, None] - u[None]) ** 2).sum(2) / (2 * u.shape[1]))
    assert np.abs(z[:200, :-1] @ z[:200, :-1].T - kernel).mean() < 0.08
    raw = np.linspace(-1, 2, 300)
    assert np.all(np.diff(model.calibrated(raw)) >= 0)


def test_large_components_are_refused(spark):
    rows = [(i, [1e7 * (i + 1)] * 4) for i in range(100)]
    with pytest.raises(Exception, match="too large for exact"):
        topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()  # noqa: N815

    with pytest.raises(RuntimeError, match="checkpoint"):
        common.shared_dir(Session())
