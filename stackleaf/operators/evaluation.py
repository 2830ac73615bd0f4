"""Paired statistics over outcomes of two configurations: exact tests, resampled intervals, list overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mcnemar(pairs: DataFrame) -> DataFrame:
    """(gained, lost, p): the exact two-sided test over the pairs (a, b) of hits that disagree; one row."""
    n = pairs.agg(F.count_if(F.col("b") & ~F.col("a")).alias("gained"), F.count_if(F.col("a") & ~F.col("b")).alias("lost"))
    d, k = (F.col("gained") + F.col("lost")).cast("double"), F.least("gained", "lost")
    start = F.struct((-d * F.log(F.lit(2.0))).alias("term"), F.lit(0.0).alias("sum"))
    step = lambda s, i: F.struct((s["term"] + F.log((d - i) / (i + 1.0))).alias("term"), (s["sum"] + F.exp(s["term"])).alias("sum"))
    tail = F.aggregate(F.sequence(F.lit(0).cast("long"), k), start, step)["sum"]
    return n.select("gained", "lost", F.round(F.when(d == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail)), 5).alias("p"))


def draw(seed: int, replicate: Column, place: Column, n: Column) -> Column:
    """A place from 0 to n - 1, the same in every run."""
    key = F.concat_ws(":", F.lit(str(seed)), replicate.cast("string"), place.cast("string"))
    return F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long"), n)


def bootstrap_ci(diffs: DataFrame, resamples: int = 1000, seed: int = 11) -> DataFrame:
    """(lo, hi): the 95 % percentile interval of the mean of (place, diff), places from 0 without gaps, in percentage points."""
    n = diffs.agg(F.count("*").alias("n"))
    drawn = diffs.select(F.col("place").alias("slot")).join(F.broadcast(n)).select("n", "slot", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("replicate"))  # n is one row
    drawn = drawn.select("replicate", draw(seed, F.col("replicate"), F.col("slot"), F.col("n")).alias("place"))
    means = drawn.join(diffs, "place").groupBy("replicate").agg(F.avg("diff").alias("mean"))
    ordered = means.agg(F.sort_array(F.collect_list("mean")).alias("m"))  # one value a replicate
    at = lambda k: F.round(F.col("m")[k] * 100, 2)
    return ordered.select(at(max(0, int(0.025 * resamples) - 1)).alias("lo"), at(min(resamples - 1, int(0.975 * resamples))).alias("hi"))


def overlap_at(lists: DataFrame, first: str, second: str, k: int) -> DataFrame:
    """(query_id, overlap): the share of the top ``k`` that two facets' lists have in common, by the shorter of both."""
    top = lists.where(F.col("facet").isin(first, second) & (F.col("rank") <= k))
    of = lambda f: F.count_if(F.col("facet") == f)
    both = top.groupBy("query_id", "doc_id").agg((F.count("*") == 2).alias("both")).groupBy("query_id").agg(F.count_if("both").alias("common"))
    sizes = top.groupBy("query_id").agg(F.least(of(first), of(second)).alias("n"))
    return both.join(sizes, "query_id").select("query_id", F.round(F.col("common") / F.greatest("n", F.lit(1)), 9).alias("overlap"))
