"""Streams over files: what they hold at the end equals the batch results."""

from pyspark.sql import functions as F

from stackleaf.operators import library as L
from stackleaf.sinks.tables import Store
from stackleaf.streaming import flows


def test_sessions(spark, tmp_path):
    rows = [(1, 0), (1, 100), (1, 201), (2, 50), (2, 60), (2, 400), (1, 90_000), (2, 90_000)]
    saves = spark.createDataFrame(rows, "user_id long, s long").select("user_id", F.timestamp_seconds("s").alias("ts"))
    saves.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = flows.session_stream(spark.readStream.schema(saves.schema).parquet(f"{tmp_path}/in"), "user_id", 100, "10 seconds")
    stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out").select("user_id", F.unix_timestamp("started_at"), F.unix_timestamp("ended_at"), "size").collect()
    assert sorted(map(tuple, got)) == [(1, 0, 100, 2), (2, 50, 60, 2)]


def test_latest(spark, tmp_path):
    rows = [(i, i * 7 % 5, i * 13 % 11, "gone" if i % 3 else "alive") for i in range(40)]
    log = spark.createDataFrame(rows, "id long, bookmark_id long, checked_at long, verdict string")
    log.repartition(4, "id").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    flows.latest_stream(stream, f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(120)
    got = Store(spark, f"{tmp_path}/out").read("latest").select(*log.columns).collect()
    assert len(list((tmp_path / "out" / "latest").glob("v=*"))) <= 2
    assert sorted(map(tuple, got)) == sorted(map(tuple, L.latest(log).collect()))
