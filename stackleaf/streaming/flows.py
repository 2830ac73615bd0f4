"""Streams of saves, health checks and queue events: session windows with late data, the last check of each bookmark, and the fetch queue, kept as versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.library import latest
from ..operators.lifecycle import ATTEMPTS, LEASE, RETRY
from ..sinks.tables import Store


def session_stream(saves: DataFrame, key: str, eps: int, late: str = "1 hour") -> DataFrame:
    """(key, started_at, ended_at, size) of runs of two or more saves (key, ts timestamp) at most ``eps`` seconds apart, each once the watermark has
    passed it. Saves later than ``late`` are left out, as their run has ended; a rebuild over the whole table takes them in."""
    window = F.session_window("ts", f"{eps * 1000 + 1} milliseconds")  # a gap of eps stays in the run
    runs = saves.withWatermark("ts", late).groupBy(window, key).agg(F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), F.count("*").alias("size"))
    return runs.where("size >= 2").select(key, "started_at", "ended_at", "size")


def latest_stream(log: DataFrame, path: str) -> DataStreamWriter:
    """Keeps the last check of each bookmark (id, bookmark_id, checked_at, ...) as the table ``latest`` of the store at ``path``, whose last two versions stay.
    The last check of a table and a batch is the same however often the batch is merged, so one that runs again after a failure changes nothing."""

    def merge(batch: DataFrame, number: int) -> None:
        Store(batch.sparkSession, path).merge("latest", batch, lambda old, new: latest(old.select(*new.columns).unionByName(new)).select(*new.columns))

    return log.writeStream.foreachBatch(merge)


def queue_stream(events: DataFrame, path: str) -> DataStreamWriter:
    """The fetch queue as the table ``queue`` (id, state, attempts, queued_at, leased_at, next_attempt_at, seen) of the store at ``path``, driven by events (event_id,
    id, kind, at, body): add, lease, complete, fail. An item's events apply in the order of (at, event_id); those at or before ``seen`` are known, so a batch may
    run again. Added again, an item that is done or failed waits anew; one that waits stays as it is."""
    schema = "id long, state string, attempts int, queued_at long, leased_at long, next_attempt_at long, seen string"

    def step(key, group, state):
        import pandas as pd

        own = state.iloc[0].to_dict() if len(state) else {"id": int(key[0]), "state": "none", "attempts": 0, "queued_at": None, "leased_at": None, "next_attempt_at": None, "seen": ""}
        for e in group.sort_values(["at", "event_id"]).to_dict("records"):
            mark = f"{int(e['at']):020d}:{int(e['event_id']):020d}"
            if mark <= own["seen"]:
                continue
            at, own["seen"] = int(e["at"]), mark
            if e["kind"] == "add" and own["state"] in ("none", "done", "failed"):
                own |= {"state": "pending", "attempts": 0, "queued_at": at, "leased_at": None, "next_attempt_at": None}
            elif e["kind"] == "lease" and (own["state"] == "pending" or (own["state"] == "leased" and at - int(own["leased_at"]) > LEASE)):
                own |= {"state": "leased", "attempts": int(own["attempts"]) + 1, "leased_at": at, "next_attempt_at": None}
            elif e["kind"] == "complete" and own["state"] == "leased" and str(e["body"] or "").strip():
                own |= {"state": "done", "leased_at": None, "next_attempt_at": None}
            elif e["kind"] in ("fail", "complete") and own["state"] == "leased":
                tries = int(own["attempts"])
                over = tries >= ATTEMPTS
                own |= {"state": "failed" if over else "pending", "leased_at": None, "next_attempt_at": None if over else at + RETRY[min(tries, len(RETRY)) - 1]}
        return pd.DataFrame([own]) if own["state"] != "none" else pd.DataFrame(columns=[x.split()[0] for x in schema.split(", ")])

    def merge(batch: DataFrame, number: int) -> None:
        def rule(old: DataFrame, new: DataFrame) -> DataFrame:
            # Only items with events are worked on, each by itself; the others go on as they are.
            touched = old.join(new.select("id").distinct(), "id", "left_semi")
            met = new.groupBy("id").cogroup(touched.groupBy("id")).applyInPandas(step, schema)
            return old.join(new.select("id").distinct(), "id", "left_anti").select(*met.columns).unionByName(met)

        store = Store(batch.sparkSession, path)
        old = store.read("queue")
        store.write("queue", rule(old if old is not None else batch.sparkSession.createDataFrame([], schema), batch))

    return events.writeStream.foreachBatch(merge)
