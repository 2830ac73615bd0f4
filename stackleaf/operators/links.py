"""Relations between saved pages: newer versions of a page, folder peers, kept intents, differences of two libraries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def supersession_edges(pages: DataFrame, weight: float = 0.70, least: float = 0.80, apart: int = 86_400) -> DataFrame:
    """(src, dst, weight), older to newer, of pages (id, domain, title, date) of one domain, ``apart`` seconds or more apart, whose title words are ``least``
    alike. Sets that are so alike share one of their first few words in any fixed order (prefix filter), here rarest first, so only pages that
    share such a word meet."""
    words = F.array_distinct(F.filter(F.split(F.trim("title"), "[ \\t\\n\\r]+"), lambda x: F.length(x) > 1))
    rows = pages.select("id", "domain", "date", words.alias("words")).where("size(words) > 0")
    flat = rows.select("id", "domain", F.size("words").alias("n"), F.explode("words").alias("word"))
    seen = flat.groupBy("domain", "word").agg(F.count("*").alias("df"))
    order = Window.partitionBy("id", "domain").orderBy("df", "word")
    first = flat.join(seen, ["domain", "word"]).withColumn("at", F.row_number().over(order)).where(F.col("at") <= F.col("n") - F.ceil(F.lit(least) * F.col("n") - F.lit(1e-9)) + 1)
    first = first.select("id", "domain", "word")
    met = first.join(first.withColumnRenamed("id", "other"), ["domain", "word"]).where("id < other").select("id", "other").distinct()
    full = met.join(rows, "id").join(rows.select(F.col("id").alias("other"), F.col("date").alias("date2"), F.col("words").alias("words2")), "other")
    both = F.size(F.array_intersect("words", "words2"))
    full = full.withColumn("j", both / (F.size("words") + F.size("words2") - both)).where((F.col("j") >= least) & (F.abs(F.col("date") - F.col("date2")) >= apart))
    older = F.col("date") < F.col("date2")
    return full.select(F.when(older, F.col("id")).otherwise(F.col("other")).alias("src"), F.when(older, F.col("other")).otherwise(F.col("id")).alias("dst"), F.round(F.lit(weight) * F.col("j"), 4).alias("weight"))


def folder_peers(anchors: DataFrame, members: DataFrame, most: int = 40) -> DataFrame:
    """(id, strength): the members (id, folder) of the named folders, of ``most`` members or fewer, that hold an anchor (id, strength); the strongest counts."""
    small = members.where("folder <> ''").groupBy("folder").agg(F.count("*").alias("n")).where(F.col("n") <= most).select("folder")
    held = members.join(anchors, "id").join(small, "folder").groupBy("folder").agg(F.max("strength").alias("strength"))
    return members.join(held, "folder").groupBy("id").agg(F.max("strength").alias("strength"))


def keep_intents(probed: DataFrame, n: int, k: int) -> DataFrame:
    """``bucket`` and ``kept`` of intents (bookmark_id, id, probe_rank; null: not found): the ``n`` best ranked up to ``k`` of each bookmark stay."""
    rank = F.col("probe_rank")
    bucket = F.when(rank.isNull(), "not_found").when(rank == 1, "1").when(rank <= 3, "2-3").when(rank <= k, "4-k").otherwise(">k")
    place = F.row_number().over(Window.partitionBy("bookmark_id").orderBy(rank.asc_nulls_last(), "id"))
    return probed.withColumns({"bucket": bucket, "kept": F.coalesce((rank <= k) & (place <= n), F.lit(False))})


def library_diff(one: DataFrame, two: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """One row: keys in both, only in the first, only in the second, and for each field how many common keys agree in it."""
    met = one.withColumn("in1", F.lit(True)).alias("a").join(two.withColumn("in2", F.lit(True)).alias("b"), key, "full_outer")
    both = F.col("in1").isNotNull() & F.col("in2").isNotNull()
    same = [F.count_if(both & F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}"))).alias(f"same_{f}") for f in fields]
    return met.agg(F.count_if(both).alias("common"), F.count_if(F.col("in2").isNull()).alias("only_first"), F.count_if(F.col("in1").isNull()).alias("only_second"), *same)
