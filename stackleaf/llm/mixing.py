"""Mixing sources to target weights by systematic sampling.

A source's target is its share of all words by weight, at most ``most`` times its own words; what a full source can't take goes
to the others by weight until none is above (water filling, in closed form: sources in order of limit / weight fill up one
after another). A document's expected copies are target / source words. Within a source, documents stand in order of size and
id; the copies' prefix sum plus one offset of the source, drawn from a hash of seed and source, crosses integer boundaries,
and a document is taken once for each boundary that it crosses. Order by size spreads the copies evenly over sizes, so that
the words taken differ from the target by about the longest document at most.

Rows are written once with a number each. Only number, source, size and id are range-partitioned (by source, size, id, number) and written
again; a row's rank is its place in its written partition plus the source's rows in the partitions before, so no source is ever in one task and long
texts don't meet in one. Copies come back to the rows by number. What is collected per (partition, source) has at most partitions + sources rows.

Defined results: a null text has size 0; a null source is a source of its own, after all others; a source without words has target 0
and gives no copies; null ids come first in their source's order; rows alike in size and id are separate rows in the order they
were read; an empty table gives no rows; other columns come back as they are, also one named like the added column, which then gets another name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import WORD_RE, materialize

#: The weights, repeating over the sources in order.
WEIGHTS = (5, 2, 1)


def words_in(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_RE)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row a source, null last in the order that weights follow."""
    order = F.col("source").asc_nulls_last()
    # Every window here goes over the sources, one row each, never over documents.
    listed = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(Window.orderBy(order)) - 1, F.lit(len(weights))) + 1).cast("int")).cast("long"))
    listed = listed.withColumn("cap", F.col("source_size") * most)
    fill = Window.orderBy((F.col("cap") / F.col("w")).asc(), order)
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    listed = listed.withColumn("rest", total - F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("ws", F.sum("w").over(after))
    # cap / w <= rest / ws, in whole numbers: the source is full, as are all before it.
    listed = listed.withColumn("full", F.col("cap") * F.col("ws") <= F.col("rest") * F.col("w"))
    level = F.struct(F.col("rest"), F.col("ws"))
    first = F.first(F.when(~F.col("full"), level), ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    listed = listed.withColumn("level", first)
    return listed.select("source", "source_size", F.when(F.col("full"), F.col("cap").cast("double")).otherwise((F.col("level.rest") * F.col("w")).cast("double") / F.col("level.ws").cast("double")).alias("target"))


def offset(source: str, seed: str) -> Column:
    """The offset in [0, 1) that a source draws."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("null")))
    return F.conv(F.substring(F.md5(named), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep_text: bool = True, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """The rows of ``docs`` and, last, a struct ``mix`` (size, source_size, target, copies), with underscores behind its name while a column of
    ``docs`` has it; without the columns other than the id if not keep_text."""
    if not isinstance(docs.schema[source_col].dataType, T.StringType):
        raise TypeError(f"{source_col} must be a string column")
    columns = docs.columns if keep_text else [id_col]
    name = "mix"
    while name in columns:
        name += "_"
    narrow = docs.select(F.struct(*map(F.col, columns)).alias("row"), F.col(source_col).alias("source"), F.col(id_col).alias("id"), words_in(text_col).alias("size"))
    rows = materialize(narrow.withColumn("number", F.monotonically_increasing_id()), "mix-rows")
    order = (F.col("source").asc_nulls_last(), *map(F.col, ("size", "id", "number")))
    ranged = rows.select("number", "source", "size", "id").repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(ranged.withColumn("pos", F.monotonically_increasing_id()), "mix-ranks").withColumn("part", F.shiftright("pos", 33))
    parts = placed.groupBy("part", "source").agg(F.count("*").alias("n"), F.min("pos").alias("pos0"), F.sum("size").alias("words"))
    parts = materialize(parts, "mix-parts")
    goals = targets(parts.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).select("part", "source", (F.col("start") - F.col("pos0")).alias("shift"))
    each = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    goals = goals.withColumns({"each": each, "u": offset("source", seed)})
    starts = starts.join(goals.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumnsRenamed({"part": "p", "source": "s"})
    ranked = placed.join(starts, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s"))).withColumn("rank", F.col("pos") + F.col("shift"))
    # Rounding of the prefix sum can't give a document more than its limit.
    copies = F.least(F.floor(F.col("each") * (F.col("rank") + 1) + F.col("u")) - F.floor(F.col("each") * F.col("rank") + F.col("u")), F.lit(most)).cast("long")
    mixed = ranked.select("number", F.col("id").alias(id_col), F.struct("size", "source_size", "target", copies.alias("copies")).alias(name))
    if not keep_text:
        return mixed.drop("number")
    return rows.select("number", "row").join(mixed.select("number", F.col(name).alias("found")), "number").select("row.*", F.col("found").alias(name))


def emit(mixed: DataFrame) -> DataFrame:
    """Each row of ``mix`` once for each copy; the columns of the documents."""
    *columns, name = mixed.columns
    copies = F.explode(F.array_repeat(F.lit(1), F.col(f"`{name}`.copies").cast("int")))
    return mixed.select(*(F.col(f"`{c}`") for c in columns), copies).select(*(F.col(f"`{c}`") for c in columns))
