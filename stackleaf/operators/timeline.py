"""Sessions, numbers and neighbours over one timeline that no single task could hold: windows stay within bins, and only one row a bin is ordered as a whole."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import written

DAY = 86_400
#: Parts that one group's members are dealt to at most, and ids in a piece of a group's texts.
PARTS, PIECE = 96, 1_024


def numbered(rows: DataFrame, group: list[str], bin_: Column, order: list[str], name: str) -> DataFrame:
    """``name``: the place from 0 of each row in its group by (bin, order); ``bin_`` must rise with the order."""
    binned = rows.withColumn("bin_", bin_)
    sizes = binned.groupBy(*group, "bin_").agg(F.count("*").alias("size_"))
    before = F.coalesce(F.sum("size_").over(Window.partitionBy(*group).orderBy("bin_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(*group, "bin_", before.alias("start_"))
    place = F.row_number().over(Window.partitionBy(*group, "bin_").orderBy(*order)) - 1
    return binned.withColumn("place_", place).join(starts, [*group, "bin_"]).withColumn(name, F.col("start_") + F.col("place_")).drop("bin_", "start_", "place_")


def neighbours(rows: DataFrame, width: int = DAY) -> DataFrame:
    """``before`` and ``after``: the times of the rows (id, ts) next to each; null at the ends. Rows without a time are left out."""
    binned = rows.where("ts is not null").withColumn("bin_", F.floor(F.col("ts") / width))
    ends = binned.groupBy("bin_").agg(F.min("ts").alias("min_"), F.max("ts").alias("max_"))
    whole = Window.orderBy("bin_")  # one row a bin
    ends = ends.select("bin_", F.lag("max_").over(whole).alias("last_"), F.lead("min_").over(whole).alias("next_"))
    own = Window.partitionBy("bin_").orderBy("ts", "id")
    near = binned.withColumns({"b_": F.lag("ts").over(own), "a_": F.lead("ts").over(own)}).join(ends, "bin_")
    return near.withColumns({"before": F.coalesce("b_", "last_"), "after": F.coalesce("a_", "next_")}).drop("bin_", "b_", "a_", "last_", "next_")


def sessions(rows: DataFrame, eps: int, width: int = DAY) -> DataFrame:
    """``session`` of rows (id, ts): runs of rows at most ``eps`` seconds after the one before, numbered from 0 in the order of time; -1 for runs of one."""
    return _sessions(neighbours(rows, width).withColumn("eps", F.lit(eps)), [], width).drop("eps")


def _sessions(near: DataFrame, group: list[str], width: int) -> DataFrame:
    """``session`` of the rows (id, ts, before, eps) of each group."""
    near = near.withColumn("start_", F.coalesce((F.col("ts") - F.col("before") > F.col("eps")).cast("int"), F.lit(1))).withColumn("bin_", F.floor(F.col("ts") / width))
    per = near.groupBy(*group, "bin_").agg(F.sum("start_").alias("n_"))
    before = F.sum("n_").over(Window.partitionBy(*group).orderBy("bin_").rowsBetween(Window.unboundedPreceding, -1))
    offset = per.select(*group, "bin_", F.coalesce(before, F.lit(0)).alias("o_"))
    order = Window.partitionBy(*group, "bin_").orderBy("ts", "id")
    runs = near.withColumn("l_", F.sum("start_").over(order.rowsBetween(Window.unboundedPreceding, 0))).join(offset, [*group, "bin_"]).withColumn("run_", F.col("o_") + F.col("l_") - 1)
    sizes = runs.groupBy(*group, "run_").agg(F.count("*").alias("size_")).where("size_ >= 2")
    dense = numbered(sizes, group, F.floor(F.col("run_") / 65_536), ["run_"], "session").select(*group, "run_", "session")
    return runs.drop("start_", "bin_", "l_", "o_", "before", "after").join(dense, [*group, "run_"], "left").withColumn("session", F.coalesce("session", F.lit(-1)).cast("long")).drop("run_")


def purity(members: DataFrame, by: list[str]) -> DataFrame:
    """(by, purity): of the pairs that sessions (by, session, folder) hold, the share in one folder."""
    pairs = lambda c: F.col(c) * (F.col(c) - 1) / 2
    counts = members.groupBy(*by, "session", "folder").agg(F.count("*").alias("c")).groupBy(*by, "session").agg(F.sum("c").alias("n"), F.sum(pairs("c")).alias("same"))
    total = F.sum(pairs("n"))
    return counts.groupBy(*by).agg(F.when(total > 0, F.sum("same") / total).otherwise(0.0).alias("purity"))


def scan(rows: DataFrame, grid: tuple[int, ...], shuffles: int = 20) -> DataFrame:
    """(eps, sessions, coverage, median_size, purity, baseline, lift, objective) for each gap over rows (id, ts, folder): the purity beside its mean over
    shuffled folders, which a hash of shuffle and id orders."""
    tried = neighbours(rows).withColumn("eps", F.explode(F.array(*map(F.lit, grid))))
    kept = _sessions(tried, ["eps"], DAY).where("session >= 0")
    n = rows.where("ts is not null").agg(F.count("*").alias("total"))
    sizes = kept.groupBy("eps", "session").agg(F.count("*").alias("size"))
    stats = sizes.groupBy("eps").agg(F.count("*").alias("sessions"), F.sum("size").alias("covered"), F.percentile("size", F.lit(0.5)).alias("median_size"))
    dated = rows.where("ts is not null").select("id", "folder")
    dealt = dated.withColumn("shuffle", F.explode(F.sequence(F.lit(0), F.lit(shuffles - 1)))).withColumn("h", F.md5(F.concat_ws(":", "shuffle", "id")))
    place = numbered(dealt.select("shuffle", "id", "h"), ["shuffle"], F.substring("h", 1, 2), ["h"], "k")
    source = numbered(dated, [], F.floor(F.col("id") / 65_536), ["id"], "k").select("k", "folder")
    mixed = place.join(source, "k").select("shuffle", "id", "folder")
    base = purity(kept.select("eps", "id", "session").join(mixed, "id"), ["eps", "shuffle"]).groupBy("eps").agg(F.avg("purity").alias("baseline"))
    all_ = stats.join(purity(kept, ["eps"]), "eps").join(base, "eps").join(F.broadcast(n))  # n is one row
    lift = F.when(F.col("baseline") > 0, F.col("purity") / F.col("baseline")).otherwise(0.0)
    coverage = F.col("covered") / F.col("total")
    return all_.select("eps", "sessions", F.round(coverage, 9).alias("coverage"), "median_size", F.round("purity", 9).alias("purity"), F.round("baseline", 9).alias("baseline"), F.round(lift, 9).alias("lift"), F.round(coverage * lift, 9).alias("objective"))


def chosen(scanned: DataFrame, fallback: int = 1200) -> DataFrame:
    """(eps): the gap of the best objective, the smallest of equals; ``fallback`` where none is above 0."""
    best = scanned.agg(F.max("objective").alias("o"), F.max_by("eps", F.struct("objective", -F.col("eps"))).alias("e"))
    return best.select(F.when(F.coalesce(F.col("o") > 0, F.lit(False)), F.col("e")).otherwise(F.lit(fallback)).alias("eps"))


def best_other(members: DataFrame, anchors: DataFrame, group: list[str]) -> DataFrame:
    """(id, strength) of the members (group, id) whose group has an anchor (group, anchor, strength) other than themselves: the strength of the best one. Each group keeps its
    two best strengths of different anchors, so no pairs are made."""
    per = anchors.groupBy(*group, "anchor").agg(F.max("strength").alias("strength")).groupBy(*group).agg(F.max(F.struct("strength", "anchor")).alias("first_"))
    rest = anchors.join(per, group).where("anchor <> first_.anchor").groupBy(*group).agg(F.max("strength").alias("second_"))
    own = F.when(F.col("id") != F.col("first_.anchor"), F.col("first_.strength")).otherwise(F.col("second_"))
    met = members.join(per, group).join(rest, group, "left").withColumn("strength", own)
    return met.where("strength is not null").groupBy("id").agg(F.max("strength").alias("strength"))


def larger(members: DataFrame, group: list[str], key: str = "id", width: int = 65_536) -> DataFrame:
    """(group, key, n, later) for each distinct key of a group: its rows, and the group's rows of a larger key. Sums stay within bins of ``width`` keys; only one
    row a bin is ordered as a whole."""
    each = members.groupBy(*group, key).agg(F.count("*").alias("n")).withColumn("bin_", F.floor(F.col(key) / width))
    behind = lambda c, by, order: F.coalesce(F.sum(c).over(Window.partitionBy(*by).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = each.groupBy(*group, "bin_").agg(F.sum("n").alias("size_"))
    bins = bins.select(*group, "bin_", behind("size_", group, "bin_").alias("behind_"))
    own = each.withColumn("own_", behind("n", [*group, "bin_"], key)).join(bins, [*group, "bin_"])
    return own.select(*group, key, "n", (F.col("own_") + F.col("behind_")).alias("later"))


def digests_of_others(members: DataFrame, group: str, small: int = 64, part: int = 1_024, width: int = 4_096) -> DataFrame:
    """(id, n, digest) of the members (group, id, text) of groups with another id: how many rows the group has of other ids, and the MD5 of their texts by id, joined by
    "|". A group's texts are cut into pieces by id, and its members dealt to parts, which read the pieces one by one: what is before a member is hashed once for all, and
    each member's own hash takes the pieces behind it. The time grows with the square of a group; a task holds a piece and its members' hashes, and a group's texts are
    sent once to each of ``PARTS`` parts at most. ids of several groups, which must be put together, are paired with their groups' rows."""
    members = written(members.select(group, "id", "text"), "members")
    spread = members.groupBy("id").agg(F.min(group).alias("a_"), F.max(group).alias("b_")).where("a_ <> b_").select("id")
    other = members.select(group, F.col("id").alias("other"), F.col("text").alias("t"))
    met = members.join(spread, "id").select(group, "id").join(other, group).where("id <> other")
    joined = lambda x, c: F.md5(F.array_join(F.transform(x, lambda y: y[c]), "|"))
    wide = met.groupBy("id").agg(F.count("*").alias("n"), joined(F.array_sort(F.collect_list(F.struct("other", "t"))), "t").alias("digest"))

    # A row for each id of a group, numbered by id; a piece has so many of them. kinds_: in how many rows an id stands.
    each = members.groupBy(group, "id").agg(F.array_sort(F.collect_list(F.struct("text"))).alias("t_")).withColumn("bin_", F.floor(F.col("id") / width))
    bins = each.groupBy(group, "bin_").agg(F.count("*").alias("ids_"), F.sum(F.size("t_")).alias("rows_"), F.collect_set(F.size("t_")).alias("kinds_"))
    whole = Window.partitionBy(group)  # one row a bin
    start = F.coalesce(F.sum("ids_").over(whole.orderBy("bin_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start_")
    bins = bins.select(group, "bin_", start, F.sum("rows_").over(whole).alias("rows"), F.array_distinct(F.flatten(F.collect_set("kinds_").over(whole))).alias("kinds"))
    place = F.col("start_") + F.row_number().over(Window.partitionBy(group, "bin_").orderBy("id")) - 1
    pieces = each.join(bins, [group, "bin_"]).withColumn("piece", F.floor(place / max(PIECE, small))).groupBy(group, "piece")
    pieces = pieces.agg(F.first("rows").alias("rows"), F.first("kinds").alias("kinds"), F.array_sort(F.collect_list(F.struct("id", "t_"))).alias("x"))

    texts = lambda x: F.flatten(F.transform(x, lambda y: y["t_"]))
    repeated = lambda of, c: F.flatten(F.transform(of, lambda y: F.array_repeat(y, c)))
    few = pieces.where(F.col("rows") <= small).select("rows", "x", F.explode("x").alias("own"))  # one piece a group
    few = few.select(F.col("own.id").alias("id"), (F.col("rows") - F.size("own.t_")).alias("o_"), F.size("own.t_").alias("c_"), F.filter("x", lambda y: y["id"] != F.col("own.id")).alias("x"))
    few = few.where("o_ > 0").select("id", (F.col("o_") * F.col("c_")).alias("n"), joined(repeated(texts(F.col("x")), F.col("c_")), "text").alias("digest"))

    # Each text stands behind a bar; a hash leaves out its first one.
    barred = lambda y: F.coalesce(F.concat(F.lit("|"), y["text"]), F.lit(""))
    parts = F.least(F.ceil(F.col("rows") / part), F.lit(PARTS)).cast("int")
    many = pieces.where(F.col("rows") > small).withColumn("t_", F.transform(texts(F.col("x")), barred))
    many = many.select(group, "piece", "rows", "kinds", parts.alias("parts"), F.col("x.id").alias("ids"), F.transform("x", lambda y: F.size(y["t_"])).alias("counts"), F.transform("t_", F.octet_length).alias("sizes"), F.array_join("t_", "").alias("whole"))
    many = many.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    # Parts are small to read and long to hash, so no two of a group come to one task; the partitions are kept as they are.
    many = many.repartitionById(PARTS, F.pmod(F.hash(group) + F.col("part"), F.lit(PARTS)).cast("int")).sortWithinPartitions(group, "part", "piece")
    many = written(many.mapInArrow(_others_hashed, "id long, n long, digest string"), "digests")
    return few.unionByName(many).join(spread, "id", "left_anti").unionByName(wide)


def _others_hashed(batches):
    """(id, n, digest) of each part's members, from rows (piece, rows, kinds, parts, ids, counts, sizes, whole, part) that are in order of group, part and piece."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("digest", pa.string())])

    def grown(h, data):
        """The hash ``h`` with ``data`` added; None stands for a hash of nothing."""
        if not len(data):
            return h
        if h is None:
            return hashlib.md5(data[1:], usedforsecurity=False)
        h.update(data)
        return h

    def done(rows, own):
        found = [(i, (rows - c) * c, (h or hashlib.md5(usedforsecurity=False)).hexdigest()) for c, members in own.items() if rows > c for i, h in members]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*found, strict=True)) or [[]] * 3, schema.types, strict=True)], schema=schema)

    rows, before, own = 0, {}, {}
    for batch in batches:
        for r in range(batch.num_rows):
            one = lambda name: batch[name][r]  # noqa: B023, E731
            if one("piece").as_py() == 0:
                if own:
                    yield done(rows, own)
                rows, kinds = one("rows").as_py(), one("kinds").as_py()
                before, own = dict.fromkeys(kinds), {c: [] for c in kinds}
            parts, mine, piece = (one(name).as_py() for name in ("parts", "part", "piece"))
            ids, counts, sizes = (one(name).values.to_numpy() for name in ("ids", "counts", "sizes"))
            text = memoryview(one("whole").as_buffer())
            ends = np.cumsum(counts)
            at = np.concatenate([[0], np.cumsum(sizes)])
            first, behind = at[ends - counts], at[ends]
            for c, members in own.items():
                whole = text if c == 1 else memoryview(b"".join(bytes(text[a:b]) * c for a, b in zip(at[:-1], at[1:], strict=True)))
                members[:] = [(i, grown(h, whole)) for i, h in members]
                end, h = 0, before[c]
                for k in np.flatnonzero((counts == c) & ((np.arange(len(ids)) + piece * PIECE) % parts == mine)):
                    a, b = int(first[k]) * c, int(behind[k]) * c
                    h, end = grown(h, whole[end:a]), a
                    members.append((int(ids[k]), grown(h and h.copy(), whole[b:])))
                before[c] = grown(h, whole[end:])
    if own:
        yield done(rows, own)


def scaled_edges(members: DataFrame, group: list[str], most: int, weight: float) -> DataFrame:
    """(src, dst, weight), both ways, between the members (group, id) of groups of 2 to ``most``: the weight falls with the root of the group's size."""
    small = members.groupBy(*group).agg(F.count("*").alias("n")).where(F.col("n").between(2, most))
    own = members.join(small, group)
    other = members.join(small.drop("n"), group).withColumnRenamed("id", "dst")
    w = F.round(F.least(F.lit(weight), F.lit(weight) * F.sqrt(F.lit(2.0) / F.col("n"))), 4)
    return own.withColumnRenamed("id", "src").join(other, group).where("src <> dst").groupBy("src", "dst").agg(F.max(w).alias("weight"))
