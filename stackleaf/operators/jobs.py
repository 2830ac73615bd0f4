"""Stages of an index run: in order, one run at a time, with progress, and stopped between stages or by cancelling Spark's jobs."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..sinks.tables import Store

#: The stages of a whole run, in their order.
ORDER = ("fetch", "enrich", "embed_content", "filter_intents", "embed_intents", "sessions", "edges")


class Busy(RuntimeError):
    """Another run is going on."""


@dataclass
class Job:
    """Runs named stages, each from the store to a table that is written to the store; a stage that has nothing to do returns None."""

    spark: SparkSession
    store: Store
    stages: dict[str, Callable[[Store], DataFrame | None]]
    progress: list[dict] = field(default_factory=list)
    _lock: threading.Lock = field(default_factory=threading.Lock)
    _stop: threading.Event = field(default_factory=threading.Event)

    def run(self, only: tuple[str, ...] = ORDER) -> list[dict]:
        """The stages that there are, in order; the progress of each. A run that is stopped says so and leaves what is written."""
        if not self._lock.acquire(blocking=False):
            raise Busy("a run is going on")
        try:
            self._stop.clear()
            self.progress = []
            for name in (n for n in only if n in self.stages):
                if self._stop.is_set():
                    self.progress.append({"stage": name, "state": "stopped"})
                    break
                self.spark.sparkContext.setJobGroup(f"index:{name}", name, True)
                began = time.time()
                rows = self.stages[name](self.store)
                version = self.store.write(name, rows) if rows is not None else None
                self.progress.append({"stage": name, "state": "done", "version": version, "seconds": round(time.time() - began, 3)})
            return self.progress
        finally:
            self._lock.release()

    def stop(self) -> None:
        """Stops after the stage that runs; its jobs are cancelled."""
        self._stop.set()
        for name in self.stages:
            self.spark.sparkContext.cancelJobGroup(f"index:{name}")
