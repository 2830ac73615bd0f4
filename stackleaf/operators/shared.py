"""Tables written to the folder that the driver and all executors share, for what is read several times."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of an Arrow batch while a table is written: a text has any length, and many places where a term stands.
ROWS = 1_024

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir. A local session gets a temporary one where none is named; on a cluster that would lose
    data, so it is an error there."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="stackleaf-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, until the session ends: lineage ends there, so what made it runs once. Python gets batches of ``ROWS`` rows."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = spark.conf.get(key)
    if not 0 < int(rows) <= ROWS:
        spark.conf.set(key, str(ROWS))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, rows)
    if not _written:
        atexit.register(_clean)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def _clean() -> None:
    for spark, path in _written:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session is already gone; its folder is then its owner's to empty
            return
