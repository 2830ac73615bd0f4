"""Helpers the training-data operators share: the shared folder, written tables, Arrow batches."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Fixed value: the white space of every contract, as bytes for ``bytes.strip`` and as a Java/RE2 class.
SPACE = b" \t\n\x0b\x0c\r"
WORD_RE = "[^\\x20\\x09-\\x0D]+"

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, which the session names in spark.checkpoint.dir. Only a local session, whose tasks run on this machine, gets a
    temporary one where none is named; on a cluster that would lose data, so it is an error there."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="stackleaf-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def limit_batches(spark: SparkSession, rows: int = 500) -> None:
    """Arrow batches of few rows: very long texts may stand together (after a sort by size), and a worker holds a batch at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back: lineage ends there, lost executors lose nothing."""
    spark = df.sparkSession
    limit_batches(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(_clean)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def sorted_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """An inner join that is never a broadcast: for sides that are far larger than Spark estimates from what they are made of (several rows of each one, values
    that repeat in a file), which the driver would have to hold."""
    return left.hint("merge").join(right.hint("merge"), key)


def _clean() -> None:
    for spark, path in _written:
        try:
            jvm, p = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
            del jvm
        except Exception:  # noqa: BLE001  the session is already gone; its folder is then its owner's to empty
            return


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Arrow batches in pieces of at most ``rows`` rows, which bounds what one step holds."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    limit_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
