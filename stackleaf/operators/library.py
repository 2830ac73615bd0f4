"""Sessions, edges, link health, saves and evaluation: set-oriented over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FAILING = ("gone", "unreachable")


def gap_sessions(rows: DataFrame, key: str, eps: int) -> DataFrame:
    """``run``: number of the run within ``key`` of rows (id, ts) at most ``eps`` seconds after the one before."""
    order = Window.partitionBy(key).orderBy("ts", "id")
    starts = F.coalesce((F.col("ts") - F.lag("ts").over(order) > eps).cast("int"), F.lit(1))
    return rows.withColumn("start", starts).withColumn("run", F.sum("start").over(order).cast("long")).drop("start")


def session_rows(runs: DataFrame, key: str, least: int = 2) -> DataFrame:
    return runs.groupBy(key, "run").agg(F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), F.count("*").alias("size")).where(F.col("size") >= least)


def group_edges(members: DataFrame, group: list[str], most: int, weight: float) -> DataFrame:
    """(src, dst, weight), both ways, between the members of groups of 2 to ``most``: larger groups are hubs, which relate nothing."""
    small = members.groupBy(*group).agg(F.count("*").alias("n")).where(F.col("n").between(2, most)).drop("n")
    own = members.join(small, group)
    other = own.withColumnRenamed("id", "dst")
    return own.withColumnRenamed("id", "src").join(other, group).where("src <> dst").select("src", "dst", F.lit(weight).alias("weight")).distinct()


def expand(seeds: DataFrame, edges: DataFrame, factor: float = 0.5, per_seed: int = 20) -> DataFrame:
    """(doc_id, score, via): one hop from ``seeds`` (doc_id, score) over each seed's heaviest edges; the best path to a document that is no seed."""
    out = edges.withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy(F.col("weight").desc(), "dst"))).where(F.col("r") <= per_seed)
    paths = out.join(seeds.withColumnRenamed("doc_id", "src"), "src").select(F.col("dst").alias("doc_id"), (F.lit(factor) * F.col("score") * F.col("weight")).alias("s"), "src")
    paths = paths.join(seeds, "doc_id", "left_anti")
    best = paths.groupBy("doc_id").agg(F.min(F.struct((-F.col("s")).alias("s"), "src")).alias("b"))
    return best.select("doc_id", F.round(-F.col("b.s"), 9).alias("score"), F.col("b.src").alias("via"))


def bursts(saves: DataFrame, seconds: int = 600, more: int = 3) -> DataFrame:
    """(id, n): the saves (id, ts) that a window of ``seconds`` from a save's time covers, if it holds over ``more`` saves; n is the most of these windows.
    Windows reach into the next of fixed bins, so each bin's seconds go to the one before for counts, and to the next for marks."""
    ranged = lambda lo, hi: Window.partitionBy("bin").orderBy("ts").rangeBetween(lo, hi)
    own = F.floor(F.col("ts") / seconds)
    per = saves.where("ts is not null").groupBy("ts").agg(F.count("*").alias("c"))
    both = per.withColumn("bin", F.explode(F.array(own, own - 1)))
    dense = both.withColumn("n", F.sum("c").over(ranged(0, seconds - 1))).where((F.col("bin") == own) & (F.col("n") > more)).select("ts", "n")
    ahead = per.join(dense, "ts", "left").withColumn("bin", F.explode(F.array(own, own + 1)))
    marked = ahead.withColumn("n", F.max("n").over(ranged(1 - seconds, 0))).where((F.col("bin") == own) & F.col("n").isNotNull())
    return saves.join(marked.select("ts", "n"), "ts").select("id", "n")


def latest(log: DataFrame) -> DataFrame:
    """The last row of each bookmark, by time and then id."""
    return log.groupBy("bookmark_id").agg(F.max_by(F.struct(*log.columns), F.struct("checked_at", "id")).alias("x")).select("x.*")


def failure_runs(log: DataFrame) -> DataFrame:
    """(bookmark_id, failures, failing_since): the checks since the last one that did not fail."""
    fails = F.col("verdict").isin(*FAILING)
    good = F.max(F.when(~fails, F.struct("checked_at", "id"))).over(Window.partitionBy("bookmark_id"))
    since = log.withColumn("good", good).where(fails & (F.col("good").isNull() | (F.struct("checked_at", "id") > F.col("good"))))
    return since.groupBy("bookmark_id").agg(F.count("*").alias("failures"), F.min("checked_at").alias("failing_since"))


def confirmed_gone(log: DataFrame, days: int = 7, least: float = 0.75) -> DataFrame:
    """(bookmark_id, checks): two or more sure ``gone`` checks, the first and the last ``days`` apart."""
    sure = log.where((F.col("verdict") == "gone") & (F.col("confidence") >= least)).groupBy("bookmark_id")
    return sure.agg(F.count("*").alias("checks"), (F.max("checked_at") - F.min("checked_at")).alias("apart")).where((F.col("checks") >= 2) & (F.col("apart") >= days * 86400)).drop("apart")


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """(url_hash, title, folder, date_added): dates only move back, blank fields never overwrite."""
    met = old.alias("o").join(new.alias("n"), "url_hash", "full_outer")
    filled = lambda c: F.coalesce(F.nullif(F.trim(F.col(f"n.{c}")), F.lit("")), F.col(f"o.{c}"), F.lit("")).alias(c)
    return met.select("url_hash", filled("title"), filled("folder"), F.least("o.date_added", "n.date_added").alias("date_added"))


def recall_table(outcomes: DataFrame, by: str) -> DataFrame:
    """Recall at 1, 5 and 10 and MRR at 10 of (query_id, by, rank); rank 0 is not found. One row a group and one over all (null)."""
    at = lambda k: F.round(F.avg(F.col("rank").between(1, k).cast("double")), 9).alias(f"recall_{k}")
    mrr = F.round(F.avg(F.when(F.col("rank").between(1, 10), 1.0 / F.col("rank")).otherwise(0.0)), 9).alias("mrr_10")
    return outcomes.rollup(by).agg(F.count("*").alias("n"), at(1), at(5), at(10), mrr)


def holm(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """``rejected`` by Holm's step-down over (name, p): one row a test, so the window is small."""
    order = Window.orderBy("p", "name")
    limit = F.lit(alpha) / (F.count("*").over(Window.partitionBy()) - F.row_number().over(order) + 1)
    fine = tests.withColumn("fine", (F.col("p") <= limit).cast("int"))
    return fine.withColumn("rejected", F.min("fine").over(order.rowsBetween(Window.unboundedPreceding, 0)) == 1).drop("fine")
