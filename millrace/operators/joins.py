"""Joins on time that no single key or task has to hold: points in intervals by bins or only counted, and the latest row
before each.

They give what a join of all pairs with the condition would, and none collects a key's rows in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.sources import shared

#: Bins of a level that make one of the next, and levels.
FACTOR, LEVELS = 64, 4


def cover(first: Column, last: Column, level: int = 0) -> Column:
    """Array of (level, bin) that together cover the bins first to last of a level once: the ends by bins of their level, the
    whole groups of FACTOR between them by bins of the next one. At most 2 * FACTOR bins a level, however long it is."""
    kind = "array<struct<level:int,bin:bigint>>"
    bins = lambda a, b: F.when(a <= b, F.transform(F.sequence(a, F.greatest(a, b)), lambda x: F.struct(F.lit(level).alias("level"), x.alias("bin")))).otherwise(F.array().cast(kind))
    if level == LEVELS - 1:
        return bins(first, last)
    up, down = F.ceil(first / FACTOR), F.floor((last + 1) / FACTOR) - 1
    parted = F.concat(bins(first, up * FACTOR - 1), bins((down + 1) * FACTOR, last), cover(up, down, level + 1))
    return F.when(first > last, F.array().cast(kind)).when(last - first < 2 * FACTOR, bins(first, last)).otherwise(parted)


def points_in_intervals(intervals: DataFrame, points: DataFrame, start: str, stop: str, at: str, width: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Every pair of an interval and a point with start <= at < stop and equal keys (if any): the columns `interval` and
    `point`, structs of both rows. Times are timestamps, `width` the seconds of a bin.

    An interval meets the bins that cover it and a point has one bin a level, so they are joined by bin and key: a busy key
    is spread over its bins, and without keys time alone spreads the rows. Empty intervals and null times match nothing.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    bin_of = lambda us: F.floor(us / F.lit(int(width * 1e6)))
    due = intervals.where(F.col(start) < F.col(stop))
    left = due.select(F.struct("*").alias("interval"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.inline(cover(bin_of(micros(start)), bin_of(micros(stop) - 1))).alias("_level", "_bin"))
    levels = F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda x: F.struct(x.cast("int").alias("level"), F.floor(bin_of(micros(at)) / F.pow(F.lit(float(FACTOR)), x)).alias("bin")))
    right = points.where(F.col(at).isNotNull()).select(F.struct("*").alias("point"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.inline(levels).alias("_level", "_bin"))
    met = left.join(right, ["_level", "_bin", *[f"_k{i}" for i in range(len(keys))]])
    return met.where((F.col(f"point.{at}") >= F.col(f"interval.{start}")) & (F.col(f"point.{at}") < F.col(f"interval.{stop}"))).select("interval", "point")


def counts_in_intervals(intervals: DataFrame, points: DataFrame, start: str, stop: str, at: str, ids: list[str], keys: tuple[str, ...] = (), by: tuple[str, ...] = ()) -> DataFrame:
    """ids (columns of the intervals), by (columns of the points, of few values) and `n`: the pairs of `points_in_intervals`
    counted by these columns, without making them.

    The points in an interval are those before its end less those before its start. Points, counted by time, and ends of
    intervals are dealt to ranges of keys, by and time; a range's running count begins with that of the ranges before.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    held = lambda rows, c: rows.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)).where(c) if keys else rows.where(c)
    group = F.struct(*[F.col(f"`{c}`") for c in (*keys, *by)]) if keys or by else F.struct(F.lit(0))
    due = held(intervals, F.col(start) < F.col(stop))
    ends = F.explode(F.array(F.struct(micros(start).alias("at"), F.lit(-1).alias("sign")), F.struct(micros(stop).alias("at"), F.lit(1).alias("sign"))))
    asked = due.select(F.struct(*ids).alias("id"), *keys, ends.alias("end")).select("id", *keys, "end.at", "end.sign")
    given = held(points, F.col(at).isNotNull()).select(*keys, *by, micros(at).alias("at")).groupBy(*keys, *by, "at").agg(F.count("*").alias("n"))
    given = shared.saved(given, "points-by-time")
    if by:
        kinds = shared.saved(given.select(*by).distinct(), "point-kinds")
        asked = asked.crossJoin(F.broadcast(kinds) if kinds.count() <= 100_000 else kinds)
    a = asked.select("id", group.alias("group"), "at", "sign", F.lit(0).cast("long").alias("n"))
    b = given.select(F.lit(None).cast(a.schema["id"].dataType).alias("id"), group.alias("group"), "at", F.lit(2).alias("sign"), "n")
    # ends come before the points of their time, which so are inside at a start and outside at a stop
    order = ["at", "sign"]
    dealt = shared.saved(a.unionByName(b).repartitionByRange("group", *order).withColumn("part", F.spark_partition_id()), "interval-ends")
    edges = dealt.groupBy("part").agg(F.min("group").alias("low"), F.max("group").alias("high"))
    edge = shared.saved(edges.select("part", F.explode(F.array_distinct(F.array("low", "high"))).alias("group")), "interval-edges")
    sums = dealt.join(F.broadcast(edge), ["part", "group"]).groupBy("part", "group").agg(F.sum("n").alias("sum"))
    before = Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("part", "group", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("carried"))
    within = Window.partitionBy("part", "group").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    passed = dealt.withColumn("own", F.sum("n").over(within)).where("id IS NOT NULL").join(F.broadcast(carried), ["part", "group"], "left")
    n = F.sum(F.col("sign") * (F.col("own") + F.coalesce("carried", F.lit(0))))
    return passed.groupBy("id", *[F.col("group")[c].alias(c) for c in by]).agg(n.alias("n")).where("n > 0").select("id.*", *by, "n")


def latest_before(left: DataFrame, right: DataFrame, key: str, at: str, tie: str, parts: int | None = None) -> DataFrame:
    """Every row of left with `latest`, the (at, tie) of the last row of right with its key at or before its time; of equal
    times the largest `tie` counts. Rows without key or time have none.

    All rows are dealt to ranges of key and time. Within a range the last row so far is known by an ordered pass; what a
    range ends with goes on to the next ones of its key by a second pass over the ranges' ends, of which there are two a
    range at most. So a key with all rows is as many tasks' work as its rows fill.
    """
    seen = F.struct(F.col(at).alias("at"), F.col(tie).alias("tie"))
    row = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    none = F.lit(None)
    a = left.select(row.alias("row"), F.col(key).alias("key"), F.col(at).alias("at"), F.lit(1).alias("side"), none.cast(right.schema[tie].dataType).alias("tie"))
    b = right.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(none.cast(a.schema["row"].dataType).alias("row"), F.col(key).alias("key"), seen["at"].alias("at"), F.lit(0).alias("side"), seen["tie"].alias("tie"))
    order = ["at", "side", "tie"]
    both = a.unionByName(b)
    both = both.repartitionByRange(parts, "key", *order) if parts else both.repartitionByRange("key", *order)
    dealt = shared.saved(both.withColumn("part", F.spark_partition_id()), "asof")
    found = F.when(F.col("side") == 0, F.struct("at", "tie"))
    # only the first and last keys of a range go beyond it
    edges = dealt.groupBy("part").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    edge = shared.saved(edges.select("part", F.explode(F.array_distinct(F.array("low", "high"))).alias("key")).where("key is not null"), "asof-edges")
    ends = dealt.where("side = 0").join(F.broadcast(edge), ["part", "key"]).groupBy("part", "key").agg(F.max(F.struct("at", "tie")).alias("end"))
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = edge.join(ends, ["part", "key"], "left").select("part", "key", F.last("end", ignorenulls=True).over(before).alias("carried"))
    within = Window.partitionBy("part", "key").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    passed = dealt.withColumn("own", F.last(found, ignorenulls=True).over(within)).where("side = 1")
    latest = F.when(F.col("at").isNotNull(), F.coalesce("own", "carried"))
    return passed.join(F.broadcast(carried), ["part", "key"], "left").select("row.*", latest.alias("latest"))
