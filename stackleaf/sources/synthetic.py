"""A library of any size with known answers, made by rule where it is read: sessions of saves in bursts, pages about one of eight subjects, three queries a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SUBJECTS = ("baking", "cycling", "gardens", "maps", "music", "printing", "sailing", "weather")
PARTS = ("plan", "tool", "guide", "notes", "review", "history", "index", "sample")


def drawn(seed: int, key: Column, salt: str, n: int) -> Column:
    """A number from 0 to n - 1 for the key, the same in every run."""
    return F.pmod(F.xxhash64(F.lit(seed), key, F.lit(salt)), F.lit(n))


def pages(spark: SparkSession, size: int = 120, seed: int = 7, now: int = 1_760_000_000, per_session: int = 6) -> DataFrame:
    """(id, url, title, body, folder, session, date_added): ``per_session`` pages a session, 40 to 900 seconds apart; sessions 3 to 21 days apart, the last one before ``now``."""
    i = F.col("id")
    session = F.expr(f"id div {per_session}")
    last = (size - 1) // per_session
    subject = F.element_at(F.array(*map(F.lit, SUBJECTS)), (drawn(seed, session, "subject", len(SUBJECTS)) + 1).cast("int"))
    part = F.element_at(F.array(*map(F.lit, PARTS)), (drawn(seed, i, "part", len(PARTS)) + 1).cast("int"))
    sign = F.concat(F.lit("mark"), i.cast("string"))
    # A session's time is bounded by its number, so that rows don't depend on each other: 12 days a session, up to 4.5 more or less.
    begun = F.lit(now) - (F.lit(last) - session + 1) * 12 * 86400 + drawn(seed, session, "begun", 9 * 86400) - F.lit(9 * 43200)
    within = F.pmod(i, F.lit(per_session)) * 470 + drawn(seed, i, "gap", 430)
    words = F.concat_ws(" ", subject, part, sign, F.lit("about"), subject, F.lit("and its"), part, F.lit("for those who keep"), sign)
    return spark.range(size).select(
        "id", F.concat(F.lit("https://"), subject, F.lit(".example/"), part, F.lit("/"), i.cast("string")).alias("url"), F.concat_ws(" ", subject, part, i.cast("string")).alias("title"), F.repeat(F.concat(words, F.lit(". ")), 4).alias("body"), subject.alias("folder"),
        session.alias("session"), (begun + within).cast("long").alias("date_added"),
    )


def questions(made: DataFrame, now: int = 1_760_000_000) -> DataFrame:
    """(query_id, text, qtype, target_id): for each page by its content, vaguely, and by when it was saved."""
    days = F.greatest(F.lit(1), F.floor((F.lit(now) - F.col("date_added")) / 86400)).cast("string")
    sign = F.concat(F.lit("mark"), F.col("id").cast("string"))
    rows = F.array(
        F.struct(F.lit("q_content").alias("qtype"), F.concat_ws(" ", "folder", sign).alias("text")), F.struct(F.lit("q_vague").alias("qtype"), F.concat(F.lit("something on "), F.col("folder")).alias("text")),
        F.struct(F.lit("q_episodic").alias("qtype"), F.concat(F.col("folder"), F.lit(" from "), days, F.lit(" days ago")).alias("text")),
    )
    return made.select(F.col("id").alias("target_id"), F.posexplode(rows).alias("n", "q")).select((F.col("target_id") * 3 + F.col("n")).alias("query_id"), "q.text", "q.qtype", "target_id")
