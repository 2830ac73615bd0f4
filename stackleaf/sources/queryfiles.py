"""Query files: a JSON object a line, comment lines before and between, targets named by address."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls

#: The types a query may have.
TYPES = ("q_content", "q_vague", "q_episodic", "q_save_action")
SCHEMA = "text string, qtype string, target_url string, target_id long, note string, subtype string, chunk string"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, header) of all lines that aren't empty; ``header`` marks comments, which say where a file comes from."""
    rows = spark.read.text(path).select(F.input_file_name().alias("path"), F.btrim("value").alias("line")).where("line <> ''")
    return rows.withColumn("header", F.startswith("line", F.lit("//")))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """The queries of all files under ``path``; a line that isn't JSON, or of no known type, is an error that names it."""
    rows = lines(spark, path).where("not header").select("path", "line", F.from_json("line", SCHEMA).alias("q")).select("path", "line", "q.*")
    fine = F.col("text").isNotNull() & F.col("qtype").isin(*TYPES)
    return rows.withColumn("qtype", F.when(fine, F.col("qtype")).otherwise(F.raise_error(F.concat(F.lit("no query: "), F.col("line"))))).drop("line")


def bound(queries: DataFrame, library: DataFrame) -> DataFrame:
    """``target_id`` of the queries by the normal address of their target in ``library`` (id, url). An unknown target is an error: leaving it out
    would change what shares are taken of."""
    known = library.select("id", urls.normalize(F.col("url")).alias("url_norm")).groupBy("url_norm").agg(F.min("id").alias("known_id"))
    met = queries.withColumn("url_norm", urls.normalize(F.col("target_url"))).join(known, "url_norm", "left")
    found = F.coalesce("known_id", F.raise_error(F.concat(F.lit("unknown target: "), F.coalesce("target_url", F.lit("none")))).cast("long"))
    return met.withColumn("target_id", found).drop("url_norm", "known_id")
