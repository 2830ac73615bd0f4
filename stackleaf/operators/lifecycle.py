"""What becomes of bookmarks: cold ones, their demotion, boosts by context, retries, a leased work queue, calibration of sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Verdicts that let a bookmark go cold; shares of a boost and its ceiling; seconds between retries in the queue.
DEAD = ("gone", "drifted", "soft_gone")
W_WINDOW, W_SESSION, W_FOLDER, MAX_BOOST = 0.50, 0.25, 0.15, 1.60
RETRY = (300, 1_800, 7_200)
LEASE, ATTEMPTS = 300, 3


def cold_flags(bookmarks: DataFrame, cutoff: int, supersession: DataFrame | None = None) -> DataFrame:
    """``unopened``, ``old``, ``dead`` and ``cold`` of bookmarks (bookmark_id, open_count, date_added, verdict). With the edges ``supersession`` (src, dst; older
    to newer) also ``superseded``, and cold is unopened, old and either dead or superseded; without them unopened, old and dead."""
    flags = bookmarks.withColumns({"unopened": F.col("open_count") == 0, "old": F.coalesce(F.col("date_added") < cutoff, F.lit(False)), "dead": F.coalesce(F.col("verdict").isin(*DEAD), F.lit(False))})
    if supersession is None:
        return flags.withColumn("cold", F.col("unopened") & F.col("old") & F.col("dead"))
    older = supersession.select(F.col("src").alias("bookmark_id")).distinct().withColumn("superseded", F.lit(True))
    flags = flags.join(older, "bookmark_id", "left").withColumn("superseded", F.coalesce("superseded", F.lit(False)))
    return flags.withColumn("cold", F.col("unopened") & F.col("old") & (F.col("dead") | F.col("superseded")))


def decay(scored: DataFrame, factor: float = 0.5, rescue: float = 0.02) -> DataFrame:
    """Scores of (query_id, doc_id, score, cold): cold ones times ``factor``, unless no other document of the query reaches ``rescue``."""
    hot = F.max(F.when(~F.col("cold"), F.col("score"))).over(Window.partitionBy("query_id"))
    rescued = F.coalesce(hot < rescue, F.lit(True))
    out = scored.withColumn("rescued", rescued)
    return out.withColumn("score", F.round(F.when(F.col("cold") & ~F.col("rescued"), F.col("score") * factor).otherwise(F.col("score")), 9)).drop("cold")


def boost(in_window: Column, session: Column, folder: Column, confidence: float) -> Column:
    """The bounded factor of a fused score."""
    parts = F.when(in_window, W_WINDOW * confidence).otherwise(0.0) + W_SESSION * F.coalesce(session, F.lit(0.0)) + W_FOLDER * F.coalesce(folder, F.lit(0.0))
    return F.round(F.least(1.0 + parts, F.lit(MAX_BOOST)), 9)


def retry_after(failures: Column) -> Column:
    """Seconds to the next check: a day, doubled with each failure, 30 days at most."""
    return F.least(F.lit(86400.0) * F.pow(F.lit(2.0), F.least(failures, F.lit(20)) - 1), F.lit(2_592_000.0)).cast("long")


def queue_retry(attempts: Column) -> Column:
    return F.when(attempts <= 1, RETRY[0]).when(attempts == 2, RETRY[1]).otherwise(RETRY[2])


def reclaim(queue: DataFrame, now: int) -> DataFrame:
    """Leases that ran out are pending again."""
    lost = (F.col("state") == "leased") & (F.col("leased_at").isNull() | (F.col("leased_at") < now - LEASE))
    return queue.withColumns({"state": F.when(lost, "pending").otherwise(F.col("state")), "leased_at": F.when(~lost, F.col("leased_at"))})


def lease(queue: DataFrame, now: int, n: int) -> DataFrame:
    """The ``n`` longest waiting items that may be tried now, leased; ties by id."""
    ready = reclaim(queue, now).where((F.col("state") == "pending") & (F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= now)))
    return ready.orderBy("queued_at", "id").limit(n).withColumns({"state": F.lit("leased"), "leased_at": F.lit(now).cast("long"), "attempts": F.col("attempts") + 1})


def finish(leased: DataFrame, now: int) -> DataFrame:
    """Items of (attempts, body) after their try: done with a body; failed after three tries; else pending until a later time."""
    got = F.coalesce(F.length(F.trim("body")) > 0, F.lit(False))
    state = F.when(got, "done").when(F.col("attempts") >= ATTEMPTS, "failed").otherwise("pending")
    out = leased.withColumn("state", state).withColumn("leased_at", F.lit(None).cast("long"))
    return out.withColumn("next_attempt_at", F.when(F.col("state") == "pending", F.lit(now) + queue_retry(F.col("attempts"))).cast("long"))


def calibration(rows: DataFrame, key: str, folder: str, grid: tuple[int, ...]) -> DataFrame:
    """(eps, sessions, coverage, purity) of session runs of (id, key, ts, folder) for each gap of ``grid``: the share of rows in runs of two or
    more, and the share of these runs' pairs that are in one folder."""
    tried = rows.withColumn("eps", F.explode(F.array(*map(F.lit, grid)))).withColumn("own", F.struct("eps", key))
    order = Window.partitionBy("own").orderBy("ts", "id")
    starts = F.coalesce((F.col("ts") - F.lag("ts").over(order) > F.col("eps")).cast("int"), F.lit(1))
    runs = tried.withColumn("start", starts).withColumn("run", F.sum("start").over(order))
    pairs = lambda c: F.col(c) * (F.col(c) - 1) / 2
    counts = runs.groupBy("eps", key, "run", folder).agg(F.count("*").alias("c"))
    per = counts.groupBy("eps", key, "run").agg(F.sum("c").alias("n"), F.sum(pairs("c")).alias("same"))
    some = lambda c: F.sum(F.when(F.col("n") >= 2, c).otherwise(0))
    totals = per.groupBy("eps").agg(F.count_if(F.col("n") >= 2).alias("sessions"), F.round(some(F.col("n")) / F.sum("n"), 9).alias("coverage"), some(F.col("same")).alias("s"), some(pairs("n")).alias("p"))
    return totals.select("eps", "sessions", "coverage", F.round(F.when(F.col("p") > 0, F.col("s") / F.col("p")).otherwise(0.0), 9).alias("purity"))
