"""Query files, found profiles, made libraries, runs of stages, model calls and the queue as a stream."""

import json

import pytest

from stackleaf.operators import assist, jobs
from stackleaf.sinks.tables import Store
from stackleaf.sources import discovery, queryfiles, synthetic
from stackleaf.streaming import flows


def test_query_files(spark, tmp_path):
    good = [{"text": "leeks", "qtype": "q_vague", "target_url": "http://soup.example/leek/?utm_source=x"}, {"text": "beds", "qtype": "q_content", "target_url": "https://beds.example"}]
    (tmp_path / "a.jsonl").write_text("// made by hand\n" + "\n".join(map(json.dumps, good)) + "\n\n")
    library = spark.createDataFrame([(4, "https://soup.example/leek"), (5, "https://beds.example/")], "id long, url string")
    got = queryfiles.bound(queryfiles.read_queries(spark, str(tmp_path)), library)
    assert sorted((r.text, r.target_id) for r in got.collect()) == [("beds", 5), ("leeks", 4)]
    assert [r.line for r in queryfiles.lines(spark, str(tmp_path)).where("header").collect()] == ["// made by hand"]
    with pytest.raises(Exception, match="unknown target"):
        queryfiles.bound(queryfiles.read_queries(spark, str(tmp_path)), library.limit(1)).collect()
    (tmp_path / "b.jsonl").write_text('{"text": "x", "qtype": "q_other"}')
    with pytest.raises(Exception, match="no query"):
        queryfiles.read_queries(spark, str(tmp_path)).collect()


def test_discovery(tmp_path):
    for name in ("Default", "Profile 2", "System Profile"):
        (tmp_path / ".config/chromium" / name).mkdir(parents=True)
        (tmp_path / ".config/chromium" / name / "Bookmarks").write_text("{}")
    assert len(discovery.bookmark_files(str(tmp_path), "linux")) == 2 and discovery.bookmark_files(str(tmp_path), "plan9") == []


def test_synthetic(spark):
    made = synthetic.pages(spark, 60)
    rows = made.orderBy("id").collect()
    assert rows == synthetic.pages(spark, 60).orderBy("id").collect() and len({r.url for r in rows}) == 60
    assert all(0 <= b.date_added - a.date_added <= 900 for a, b in zip(rows, rows[1:], strict=False) if a.session == b.session)
    assert all(b.date_added - a.date_added > 86400 for a, b in zip(rows, rows[1:], strict=False) if a.session != b.session) and max(r.date_added for r in rows) < 1_760_000_000
    q = synthetic.questions(made)
    assert q.count() == 180 and q.select("query_id").distinct().count() == 180


def test_jobs(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    job = jobs.Job(spark, store, {"edges": lambda s: s.read("sessions").limit(2), "sessions": lambda s: spark.range(5).toDF("id"), "fetch": lambda s: None})
    assert [(p["stage"], p["state"]) for p in job.run()] == [("fetch", "done"), ("sessions", "done"), ("edges", "done")] and store.read("edges").count() == 2
    job.stages["sessions"] = lambda s: job.stop() or spark.range(1).toDF("id")
    assert job.run()[-1] == {"stage": "edges", "state": "stopped"}
    with job._lock, pytest.raises(jobs.Busy):
        job.run()


def test_assist(spark):
    class Broken:
        name = "broken"

        def chat(self, system, user):
            raise RuntimeError

        def embed(self, texts):
            raise RuntimeError

    chain = assist.Chain([Broken(), assist.Offline(16)])
    assert chain.chat("", "alpha beta alpha")["topics"][0] == "alpha" and chain.name == "offline"
    got = assist.embedded(spark.createDataFrame([(1, "a b"), (2, None)], "id long, text string"), chain).collect()
    assert {r.id: round(sum(x * x for x in r.embedding), 6) for r in got} == {1: 1.0, 2: 0.0}
    rows = spark.createDataFrame([(1, "plain", ""), (2, "today", "time:relative"), (3, "plain", "")], "query_id long, text string, rules string")
    assert {r.query_id: r.labels for r in assist.labelled(rows, chain).collect()} == {1: "semantic", 2: "", 3: "semantic"}


def test_queue_stream(spark, tmp_path):
    events = [(1, 7, "add", 100, None), (2, 7, "lease", 110, None), (3, 7, "fail", 120, None), (4, 8, "add", 130, None), (5, 7, "lease", 500, None), (6, 7, "complete", 510, "text"), (7, 8, "complete", 520, "early"), (8, 9, "lease", 530, None)]
    schema = "event_id long, id long, kind string, at long, body string"
    for n, part in enumerate((events[:4], events[4:], events[:6])):  # the third runs again what is known
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        flows.queue_stream(stream, f"file://{tmp_path}/store").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
        rows = {r.id: r for r in Store(spark, f"file://{tmp_path}/store").read("queue").orderBy("id").collect()}
        if n == 0:
            assert (rows[7].state, rows[7].attempts, rows[7].next_attempt_at) == ("pending", 1, 420)
        assert rows[8].state == "pending" and 9 not in rows
    assert (rows[7].state, rows[7].attempts) == ("done", 2)
