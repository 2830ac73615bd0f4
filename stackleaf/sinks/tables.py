"""Tables as versions in a shared folder: a write is a new version, which counts once it is whole, so readers never see half a merge and a lost writer leaves nothing
behind that is read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Store:
    """Named tables under a folder that all executors reach."""

    def __init__(self, spark: SparkSession, folder: str, keep: int = 2):
        self.spark, self.folder, self.keep = spark, folder.rstrip("/"), keep

    def _versions(self, name: str) -> list[int]:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        whole = lambda p: fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
        return sorted(int(s.getPath().getName()[2:]) for s in fs.listStatus(path) if s.getPath().getName().startswith("v=") and whole(s.getPath()))

    def read(self, name: str) -> DataFrame | None:
        """The table's last whole version; None if it was never written."""
        found = self._versions(name)
        return self.spark.read.parquet(f"{self.folder}/{name}/v={found[-1]}") if found else None

    def write(self, name: str, rows: DataFrame, partition_by: tuple[str, ...] = ()) -> int:
        """The rows as the table's next version, whose number is returned; versions beyond the last ``keep`` go."""
        found = self._versions(name)
        number = found[-1] + 1 if found else 1
        rows.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{self.folder}/{name}/v={number}")
        for old in found[: max(0, len(found) + 1 - self.keep)]:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/v={old}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return number

    def merge(self, name: str, new: DataFrame, rule: Callable[[DataFrame, DataFrame], DataFrame], partition_by: tuple[str, ...] = ()) -> int:
        """What ``rule`` makes of the stored and the new rows, as the next version; without a stored table the new rows are merged into none."""
        old = self.read(name)
        return self.write(name, rule(old if old is not None else new.limit(0), new), partition_by)

    def append(self, name: str, rows: DataFrame) -> int:
        """The stored rows and the new ones, for logs."""
        return self.merge(name, rows, lambda old, new: old.unionByName(new))

    def migrate(self, name: str, steps: list[Callable[[DataFrame], DataFrame]], done: int) -> int:
        """The steps after the first ``done`` applied to the table, as one new version; how many are done now. The version before stays as the backup."""
        rows = self.read(name)
        if rows is not None and done < len(steps):
            for step in steps[done:]:
                rows = step(rows)
            self.write(name, rows)
        return len(steps)


def report(rows: DataFrame, path: str) -> None:
    """Results as JSON lines."""
    rows.write.mode("overwrite").json(path)
