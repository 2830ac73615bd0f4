"""The library's queries against their SQL in DuckDB, and operators on small rows."""

import duckdb
import pytest
from pyspark.sql import functions as F

from stackleaf import plans
from stackleaf.functions import columns as C
from stackleaf.operators import library as L
from stackleaf.operators import ranking as R

DIR = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "events", "embeddings", "benchmark", "labels", "nation", "conversations")


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


QUERIES, SQL = plans.all_queries(), plans.all_sql()
#: Of the named configurations those run here that differ in what they do; the others differ in their facets only.
CONFIGS = {f"search_config_{n}" for n in ("A", "C_abstain", "C_max", "D_gated", "fused", "full")}
NAMES = sorted(n for n in QUERIES if not n.startswith("search_config_") or n in CONFIGS)


@pytest.mark.parametrize("name", NAMES)
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{DIR}/{t}.parquet'")
    df = QUERIES[name](spark, DIR)
    sql = con.sql(SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(sql.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    want = sorted((tuple(plain(r[sql.columns.index(c)]) for c in cols) for r in sql.fetchall()), key=str)
    assert got == want


def test_domains(spark):
    rows = spark.createDataFrame([("a.b.example.co.uk",), ("www.example.com",), ("10.0.0.1",), ("example.com",), ("",)], "h string")
    assert [r[0] for r in rows.select(C.registrable_domain(F.col("h"))).collect()] == ["example.co.uk", "example.com", "10.0.0.1", "example.com", ""]


def test_gap_equal_to_eps_stays(spark):
    rows = spark.createDataFrame([(1, 7, 0), (2, 7, 100), (3, 7, 201)], "id long, u long, ts long")
    assert [r.run for r in L.gap_sessions(rows, "u", 100).orderBy("id").collect()] == [1, 1, 2]


def test_rrf(spark):
    rows = spark.createDataFrame([(1, "a", 5, 1), (1, "b", 5, 2), (1, "z", 6, 1)], "query_id long, facet string, doc_id long, rank int")
    got = R.rrf(rows, {"a": 1.0, "b": 0.5, "z": 0.0}).collect()
    assert [(r.doc_id, r.facets) for r in got] == [(5, 2)] and abs(got[0].score - (1 / 61 + 0.5 / 62)) < 1e-8


@pytest.mark.parametrize("carried", [10_000, -1])
def test_nearest_of_few_and_many_queries(spark, monkeypatch, carried):
    """Queries that travel with the tasks and blocks that meet blocks give the same, ties by the smaller id."""
    import numpy as np

    monkeypatch.setattr(R, "CARRIED", carried)
    monkeypatch.setattr(R, "_grid", lambda *a, grid=R._grid: grid(*a[:-1], 7))
    r = np.random.default_rng(1)
    v = r.integers(-2, 3, (40, 4)).astype(float)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(99, None)], "doc_id long, v array<float>")
    asked = rows.where("doc_id % 5 = 0").selectExpr("doc_id as query_id", "v as q")
    got = {(x.query_id, x["rank"]): (x.doc_id, x.score) for x in R.nearest(rows, asked, 3, "l2").collect()}
    for i in range(0, 40, 5):
        best = sorted((round(float(np.sqrt(((v[i] - w) ** 2).sum())), 6), j) for j, w in enumerate(v) if j != i)[:3]
        assert [got[i, k + 1] for k in range(3)] == [(j, -d if d else 0.0) for d, j in best]
    assert R.mutual(rows, 3, 9.0).count() % 2 == 0


def test_entry_without_training_operators(tmp_path):
    """Without the training-data operators the entry still imports and registers the library."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "stackleaf", tmp_path / "stackleaf", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') for n in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert said.stdout.split() == [str(len(QUERIES)), "False"]


def test_addresses(spark):
    """Escapes are read and written anew, in paths and queries; other schemes stay."""
    from stackleaf.functions import urls

    pairs = {
        "http://WWW.a.example:80/x//y%20z/%7Ek/?b=1%202&a=%E4%B8%AD+x&utm_source=q#frag": "https://a.example/x/y%20z/~k?a=%E4%B8%AD+x&b=1+2",
        "https://e.example/a%2Fb/caf%C3%A9;v=1?q=a*b~c": "https://e.example/a/b/caf%C3%A9;v=1?q=a%2Ab~c",
        "https://e.example/é?ü=ö": "https://e.example/%C3%A9?%C3%BC=%C3%B6",
        "https://e.example?x": "https://e.example/?x=",
        "https://e.example/%zz?a=%": "https://e.example/%zz?a=%25",
        " ftp://x/y ": "ftp://x/y",
    }
    rows = spark.createDataFrame([(u,) for u in pairs], "u string")
    assert {r[0]: r[1] for r in rows.select("u", urls.normalize(F.col("u"))).collect()} == pairs


def test_counts_of_units_ago(spark):
    from stackleaf.functions import understanding as U

    day, now = 86_400, 1_706_745_600
    said = {"三个月前": 90, "3天前 存的": 3, "十二周前": 84, "二十一天前": 21, "两年前": 730, "a couple of weeks ago": 14, "十天前": 10, "一百天前": None, "plain words": None}
    rows = spark.createDataFrame([(t,) for t in said], "t string").select("t", U.time_window(F.col("t"), now).alias("w"))
    for r in rows.collect():
        if said[r.t] is not None:
            assert (r.w.lo + max(day, (now - said[r.t] * day) - r.w.lo)) == now - said[r.t] * day and r.w.rule == "n_ago"
        elif r.t == "plain words":
            assert r.w is None
