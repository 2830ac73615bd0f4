"""Versions of tables: merges, appends, migrations, and writes that were cut off."""

from pyspark.sql import functions as F

from stackleaf.operators import search, store, timeline
from stackleaf.sinks.tables import Store, report


def test_versions(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    assert s.read("pages") is None
    rule = lambda old, new: store.merged(old, new, "id", {"title": "fill", "at": "least"})
    rows = lambda *x: spark.createDataFrame(list(x), "id long, title string, at long")
    assert s.merge("pages", rows((1, "a", 5), (2, "b", 7)), rule) == 1
    assert s.merge("pages", rows((2, " ", 3), (3, "c", 9)), rule) == 2
    want = [(1, "a", 5), (2, "b", 3), (3, "c", 9)]
    assert sorted(map(tuple, s.read("pages").collect())) == want
    assert s.merge("pages", rows((2, " ", 3), (3, "c", 9)), rule) == 3 and sorted(map(tuple, s.read("pages").collect())) == want
    # A writer that was lost leaves a folder without its mark, which isn't read.
    rows((9, "z", 1)).write.parquet(f"file://{tmp_path}/store/pages/v=9")
    (tmp_path / "store/pages/v=9/_SUCCESS").unlink()
    assert sorted(map(tuple, s.read("pages").collect())) == want
    s.append("log", rows((1, "x", 1)))
    s.append("log", rows((1, "x", 1)))
    assert s.read("log").count() == 2
    assert s.migrate("log", [lambda t: t.withColumn("n", F.lit(1))], 0) == 1 and "n" in s.read("log").columns
    report(s.read("log"), f"file://{tmp_path}/report")
    assert spark.read.json(f"file://{tmp_path}/report").count() == 2


def test_bodies_change_only_with_their_hash(spark):
    old = spark.createDataFrame([(1, "a", "ha", "ok"), (2, "b", "hb", "ok")], "id long, body string, body_hash string, status string")
    new = spark.createDataFrame([(2, "b", "hb", "ok"), (1, "c", "hc", "ok"), (3, "d", "hd", "ok")], old.schema)
    assert sorted((r.id, r.body, r.changed) for r in store.bodies(old, new).collect()) == [(1, "c", True), (2, "b", False), (3, "d", True)]
    failed = spark.createDataFrame([(1, "refused", "403"), (9, "dns", "no name")], "id long, status string, error string")
    assert sorted((r.id, r.body, r.status) for r in store.failures(old, failed).collect()) == [(1, "a", "refused"), (2, "b", "ok"), (9, None, "dns")]


def test_sessions_cross_bins(spark):
    """A run across the bins' edges is one session; singles are -1; a gap equal to the limit stays."""
    times = [10, 95, 105, 205, 206, 900, 1000, 5000, None]
    rows = spark.createDataFrame(list(enumerate(times)), "id long, ts long")
    got = {r.id: r.session for r in timeline.sessions(rows, 100, width=100).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 1, 6: 1, 7: -1}


def test_degraded_configurations():
    full = search.CONFIGS["full"]
    assert search.degraded(full, {"content"}) == (full, "")
    got, name = search.degraded(full, set())
    assert got.name == "full/lex" and got.facets == search.LEXICAL and got.decay and name == "full"
    assert search.degraded(search.CONFIGS["B"], set())[1] == ""
    assert abs(search.BONUS - 2.361) < 1e-3 and len(search.CONFIGS) == 21
