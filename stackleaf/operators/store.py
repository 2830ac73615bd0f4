"""Writes as merges of tables: each takes what is stored and what is new, and gives what is stored next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merged(old: DataFrame, new: DataFrame, key: str, rules: dict[str, str]) -> DataFrame:
    """A row for each key of either table. Rules by column: new (the new value where the key is new or again there), keep (the old value stays), fill (the new
    value unless it is null or blank), least, greatest."""

    def value(c: str, rule: str) -> Column:
        o, n = F.col(f"o.{c}"), F.col(f"n.{c}")
        if rule == "least":
            return F.least(o, n)
        if rule == "greatest":
            return F.greatest(o, n)
        if rule == "keep":
            return F.when(F.col("o.there"), o).otherwise(n)
        if rule == "fill":
            return F.coalesce(F.when(F.length(F.btrim(n.cast("string"))) > 0, n), o)
        return F.when(F.col("n.there"), n).otherwise(o)

    marked = lambda t: t.withColumn("there", F.lit(True))
    met = marked(old).alias("o").join(marked(new).alias("n"), key, "full_outer")
    return met.select(key, *(value(c, r).alias(c) for c, r in rules.items()))


def bodies(old: DataFrame, new: DataFrame) -> DataFrame:
    """Stored bodies (id, body, body_hash, status) after fetched ones; ``changed`` where a new body's hash is another than the stored one's."""
    n = new.select("id", F.col("body").alias("nb"), F.col("body_hash").alias("nh"), F.col("status").alias("ns"), F.lit(True).alias("fetched"))
    met = old.join(n, "id", "full_outer")
    got = F.coalesce(F.col("fetched"), F.lit(False))
    pick = lambda a, b: F.when(got, F.col(a)).otherwise(F.col(b))
    return met.select("id", pick("nb", "body").alias("body"), pick("nh", "body_hash").alias("body_hash"), pick("ns", "status").alias("status"), (got & ~F.col("nh").eqNullSafe(F.col("body_hash"))).alias("changed"))


def failures(old: DataFrame, failed: DataFrame) -> DataFrame:
    """Stored bodies after failures (id, status, error): a body that is known stays, only its status and error change; others get a row without one."""
    f = failed.select("id", F.col("status").alias("fs"), "error", F.lit(True).alias("failed"))
    met = old.join(f, "id", "full_outer")
    return met.select("id", "body", "body_hash", F.when(F.col("failed"), F.col("fs")).otherwise(F.col("status")).alias("status"), "error")


def replaced(children: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """The rows of ``children`` with all those of a parent that has new ones replaced by these."""
    return children.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def orphans(rows: DataFrame, key: str, owners: DataFrame, owner: str) -> DataFrame:
    """The rows whose key no owner has."""
    return rows.join(owners.select(F.col(owner).alias(key)).distinct(), key, "left_anti")


def normalized(v: Column) -> Column:
    """A vector of length one; one of zeros as it is."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two vectors: 0 if one is all zeros, null if one is."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, z: s + z)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).when(size == 0, 0.0)


def added(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The new rows that no stored row has the keys of; the first of those that repeat."""
    return new.dropDuplicates(keys).join(old.select(*keys).distinct(), keys, "left_anti")


def opened(old: DataFrame, opens: DataFrame) -> DataFrame:
    """Bookmarks (id, open_count, last_opened_at) after open events (id, at)."""
    e = opens.groupBy("id").agg(F.count("*").alias("more"), F.max("at").alias("last"))
    met = old.join(e, "id", "left")
    return met.select("id", (F.col("open_count") + F.coalesce("more", F.lit(0))).alias("open_count"), F.greatest("last_opened_at", "last").alias("last_opened_at"))


def purged(tables: dict[str, tuple[DataFrame, str]], gone: DataFrame) -> dict[str, DataFrame]:
    """The tables (each with the name of its bookmark column) without the rows of the bookmarks ``gone`` (id); edges go by either end."""
    out = {}
    for name, (rows, column) in tables.items():
        for c in column.split(","):
            rows = rows.join(gone.select(F.col("id").alias(c)), c, "left_anti")
        out[name] = rows
    return out


def embedded(tokens: DataFrame, dim: int = 64) -> DataFrame:
    """(id, i, x): signed feature hashing of (id, token, n): each token goes to two places, the second with half the weight, and vectors have length one."""
    weight = 1.0 + F.log(F.col("n").cast("double"))

    def place(salt: str, share: float) -> Column:
        h = F.conv(F.substring(F.sha2(F.concat(F.lit(salt), F.col("token")), 256), 1, 12), 16, 10).cast("long")
        sign = F.when(F.pmod(F.floor(h / dim), F.lit(2)) == 1, 1.0).otherwise(-1.0)
        return F.struct(F.pmod(h, F.lit(dim)).alias("i"), (sign * weight * share).alias("x"))

    flat = tokens.select("id", F.explode(F.array(place("", 1.0), place("b", 0.5))).alias("p")).select("id", "p.i", "p.x")
    cells = flat.groupBy("id", "i").agg(F.sum("x").alias("x"))
    norms = cells.groupBy("id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return cells.join(norms, "id").select("id", "i", F.round(F.when(F.col("norm") > 0, F.col("x") / F.col("norm")).otherwise(0.0), 9).alias("x")).where("x <> 0")
