"""Bursts of saves that no fixed bin shows."""

from stackleaf.operators import library as L


def test_bursts_straddle_bins(spark):
    times = [598, 599, 600, 601, 3000, 3100, 5990, 6000, 6001, 6002, 6598, 6600, 9000, -2, -1, 0, 1]
    rows = spark.createDataFrame(list(enumerate(times)), "id long, ts long")
    want = {}
    for start in times:
        held = [i for i, t in enumerate(times) if start <= t < start + 600]
        for i in held if len(held) > 3 else []:
            want[i] = max(want.get(i, 0), len(held))
    got = {r.id: r.n for r in L.bursts(rows).collect()}
    assert got == want and {0, 1, 2, 3} <= set(got) and 4 not in got
