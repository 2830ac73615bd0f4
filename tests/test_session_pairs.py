"""What is asked of all pairs of a session is told without making them."""

import hashlib

import pytest
from pyspark.sql import functions as F

from stackleaf.operators import timeline as T

ROWS = [(s, i, f"t{i * 7 % 5}") for s, ids in enumerate([range(3, 150), [4, 900], [1000, 1001, 1002], [2001]]) for i in ids] + [(0, 77, "again"), (2, 1001, "b"), (2, 1001, "a")]
PLAIN = [(s, i) for s, i, _ in ROWS]


def members(spark):
    return spark.createDataFrame(ROWS, "session long, id long, text string")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("small", "part"), [(64, 1024), (2, 10), (1000, 10)])
def test_digests_of_others(spark, small, part):
    want = {}
    for i in {i for _, i, _ in ROWS}:
        met = sorted((j, t) for s, k in PLAIN if k == i for r, j, t in ROWS if r == s and j != i)
        if met:
            want[i] = (len(met), hashlib.md5("|".join(t for _, t in met).encode()).hexdigest())
    got = T.digests_of_others(members(spark), "session", small, part).collect()
    assert len(got) == len(want) and {r.id: (r.n, r.digest) for r in got} == want


def test_no_pairs_in_the_shuffle(spark):
    rows = spark.range(3000).select(F.lit(0).alias("session"), "id", F.md5(F.col("id").cast("string")).alias("text"))
    got = {r.id: r.n for r in T.digests_of_others(rows, "session").collect()}
    assert got == dict.fromkeys(range(3000), 2999)
    from stackleaf.plans import sessions

    assert "digests_of_others" in sessions.q_beside.__code__.co_names


def test_a_part_holds_a_piece_at_a_time(spark, monkeypatch):
    """Several pieces a session, ids that stand twice, and texts that are null: no row of the exchange has a whole session, and the digests are those of all others."""
    monkeypatch.setattr(T, "PIECE", 100)
    rows = [(s, i, None if i % 11 == 0 else f"{i % 7}|" * (i % 3)) for s in (5, 6) for i in range(s * 1000, s * 1000 + 950)] + [(5, i, "x") for i in range(5000, 5950, 50)] * 2
    rows += [(7, i, None) for i in range(9000, 9070)] + [(8, 9500, "one")] * 70
    sent = []
    kept = T.written
    monkeypatch.setattr(T, "written", lambda df, name: kept(sent.append(df) or df, name))
    got = T.digests_of_others(spark.createDataFrame(rows, "session long, id long, text string"), "session", 64, 200, 300).collect()
    want = {}
    for s in (5, 6, 7):
        own = sorted((i, t or "", t is None) for r, i, t in rows if r == s)
        for k in {i for i, _, _ in own}:
            c = sum(i == k for i, _, _ in own)
            texts = [t for i, t, null in own if i != k and not null for _ in range(c)]
            want[k] = ((len(own) - c) * c, hashlib.md5("|".join(texts).encode()).hexdigest())
    assert len(got) == len(want) and {r.id: (r.n, r.digest) for r in got} == want
    plans = "".join(plan(df) for df in sent)
    assert "MapInArrow" in plans and "FlatMapGroupsInArrow" not in plans


def test_best_other(spark):
    rows = members(spark).select("session", "id")
    strength = lambda i: 1.0 / (1.0 + 0.2 * (i // 10 % 10))
    anchors = rows.where("id % 10 = 0").select("session", F.col("id").alias("anchor"), (1.0 / (1.0 + F.lit(0.2) * F.expr("id div 10 % 10"))).alias("strength"))
    want = {}
    for s, i in PLAIN:
        found = [strength(j) for r, j in PLAIN if r == s and j % 10 == 0 and j != i]
        if found:
            want[i] = max(found + ([want[i]] if i in want else []))
    found = T.best_other(rows, anchors, ["session"])
    assert {r.id: r.strength for r in found.collect()} == pytest.approx(want)


def test_peers_of_one_long_session_are_not_paired(spark):
    rows = spark.range(400_000).select(F.lit(0).alias("session"), "id")
    anchors = rows.where("id % 10 = 0").select("session", F.col("id").alias("anchor"), F.lit(1.0).alias("strength"))
    assert T.best_other(rows, anchors, ["session"]).count() == 400_000  # 16 billion pairs


@pytest.mark.parametrize("width", [7, 65_536])
def test_larger(spark, width):
    want = {(s, i): (PLAIN.count((s, i)), sum(r == s and j > i for r, j in PLAIN)) for s, i in PLAIN}
    assert {(r.session, r.id): (r.n, r.later) for r in T.larger(members(spark), ["session"], width=width).collect()} == want


def test_pairs_of_one_long_session_are_counted(spark):
    n = 300_000
    rows = spark.range(n).select(F.lit(0).alias("session"), "id")
    assert T.larger(rows, ["session"]).agg(F.sum(F.col("n") * F.col("later"))).first()[0] == n * (n - 1) // 2
