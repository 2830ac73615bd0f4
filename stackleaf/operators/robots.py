"""Crawling rules: robots files to rules, decisions on paths, and a polite schedule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def records(files: DataFrame) -> DataFrame:
    """(host, pos, field, value, grp) of files (host, text): the lines that hold a field; ``grp`` numbers the groups of agent lines in a row."""
    lines = files.select("host", F.posexplode(F.split("text", "\r?\n")).alias("pos", "raw"))
    line = F.btrim(F.split_part(F.col("raw"), F.lit("#"), F.lit(1)), F.lit(" \t"))
    kept = lines.select("host", "pos", line.alias("line")).where(F.contains("line", F.lit(":")))
    at = F.instr("line", ":")
    named = kept.select("host", "pos", F.lower(F.btrim(F.substr("line", F.lit(1), at - 1))).alias("field"), F.btrim(F.substr("line", at + 1), F.lit(" \t")).alias("value"))
    order = Window.partitionBy("host").orderBy("pos")
    agent = F.col("field") == "user-agent"
    starts = agent & F.coalesce(F.lag(F.col("field")).over(order) != "user-agent", F.lit(True))
    return named.withColumn("starts", starts.cast("int")).withColumn("grp", F.sum("starts").over(order)).where("grp > 0").drop("starts")


def rules(files: DataFrame, agent: str) -> DataFrame:
    """(host, allow, pattern) that hold for ``agent``: of a named group where there is one, else of ``*``; and rows of pattern null for delays (delay)."""
    rec = records(files)
    asked = F.lower("value")
    named = (asked != "*") & F.contains(F.lit(agent.lower()), asked)
    groups = rec.where("field = 'user-agent'").groupBy("host", "grp").agg(F.max(named).alias("named"), F.max(F.col("value") == "*").alias("wild"))
    # A group that names the agent counts once it holds a record.
    own = rec.where("field <> 'user-agent'").join(groups.where("named or wild"), ["host", "grp"])
    saw = own.groupBy("host").agg(F.max("named").alias("saw"))
    used = own.join(saw, "host").where(F.when(F.col("saw"), F.col("named")).otherwise(F.col("wild")))
    pattern = F.when(F.startswith("value", F.lit("/")), F.col("value")).otherwise(F.concat(F.lit("/"), F.col("value")))
    paths = used.where("field in ('allow', 'disallow') and value <> ''").select("host", (F.col("field") == "allow").alias("allow"), pattern.alias("pattern"), F.lit(None).cast("double").alias("delay"))
    delays = used.where("field = 'crawl-delay'").select("host", "pos", F.col("value").try_cast("double").alias("delay")).where("delay is not null")
    last = delays.groupBy("host").agg(F.max_by("delay", "pos").alias("delay"))
    return paths.unionByName(last.select("host", F.lit(None).cast("boolean").alias("allow"), F.lit(None).cast("string").alias("pattern"), "delay"))


def to_regex(pattern: Column) -> Column:
    """A path pattern, in which ``*`` is any run and a last ``$`` the end, as an anchored expression."""
    end = F.endswith(pattern, F.lit("$"))
    bare = F.when(end, F.substr(pattern, F.lit(1), F.length(pattern) - 1)).otherwise(pattern)
    quoted = F.regexp_replace(F.regexp_replace(bare, "([.+?^${}()|\\[\\]\\\\])", "\\\\$1"), "\\*", ".*")
    return F.concat(F.lit("^"), quoted, F.when(end, "$").otherwise(""))


def decided(paths: DataFrame, rules_: DataFrame) -> DataFrame:
    """``allowed`` of (id, host, path, reached): the longest pattern that matches decides, allow before disallow; without one, or without
    a file to read, all is allowed."""
    wanted = rules_.where("pattern is not null").select("host", "allow", "pattern", to_regex(F.col("pattern")).alias("regex"))
    met = paths.where("reached").join(wanted, "host").where(F.expr("path rlike regex"))
    best = met.groupBy("id").agg(F.max_by("allow", F.struct(F.length("pattern"), F.col("allow"))).alias("allow"))
    return paths.join(best, "id", "left").withColumn("allowed", F.coalesce("allow", F.lit(True))).drop("allow")


def schedule(pages: DataFrame, rules_: DataFrame, least: float = 0.5, most: float = 5.0) -> DataFrame:
    """``starts_at`` seconds of (id, host): a host's pages one interval apart, which a published delay can only raise, ``most`` at most.
    A host's pages are numbered by its rows alone, in the order of ids."""
    asked = rules_.where("pattern is null and delay > 0").select("host", F.least("delay", F.lit(most)).alias("delay"))
    gap = F.greatest(F.coalesce("delay", F.lit(least)), F.lit(least))
    place = F.row_number().over(Window.partitionBy("host").orderBy("id")) - 1
    return pages.join(asked, "host", "left").select("id", "host", F.round(place * gap, 6).alias("starts_at"))
