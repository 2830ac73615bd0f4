"""Joins of sides that are far larger than Spark estimates are not left to the driver's memory."""

import numpy as np
import pytest

from stackleaf.llm import shingle_links, simhash


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_probes_are_not_broadcast(spark, tmp_path):
    fp = np.random.default_rng(2).integers(-(1 << 63), 1 << 63, 500).tolist()
    spark.createDataFrame([(x,) for x in (*fp, fp[0] ^ 7)], "fp long").write.parquet(f"{tmp_path}/fp")
    found = simhash.links(spark.read.parquet(f"{tmp_path}/fp"))
    assert "BroadcastHashJoin" not in plan(found)
    assert [tuple(r) for r in found.collect()] == [(min(fp[0], fp[0] ^ 7), max(fp[0], fp[0] ^ 7))]


@pytest.mark.parametrize("copies", (3, 40))
def test_bands_and_lists_are_not_broadcast(spark, monkeypatch, copies):
    plans = {}
    write = shingle_links.materialize

    def noted(df, name):
        plans.setdefault(name, plan(df))
        return write(df, name)

    monkeypatch.setattr(shingle_links, "materialize", noted)
    base = [f"w{i}" for i in range(60)]
    rows = [(k, " ".join([*base, *(f"own{k}x{j}" for j in range(3))])) for k in range(copies)] + [(1000 + k, " ".join(f"v{k}y{j}" for j in range(30))) for k in range(20)]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates_by_similarity(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: 0 if k < 1000 else k for k, _ in rows}
    joined = ("alike-few", "alike-candidates", "alike-crowd", "alike-links", *(("alike-lists", "alike-crowd-pairs") if "alike-lists" in plans else ()))
    assert not [n for n in joined if "BroadcastHashJoin" in plans[n]]
