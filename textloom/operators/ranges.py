"""Points and intervals joined without an equality of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.select import prefix_sums
from textloom.session import saved


def points_in_intervals(points: DataFrame, at: Column, intervals: DataFrame, start: Column, end: Column) -> DataFrame:
    """All columns of both sides for each point within an interval, both ends included; column names must differ.

    at, start and end are whole numbers (times in microseconds, say).  An interval gets the level of its length in
    bits, and is put in the one or two bins of that level, 2**level wide, that it touches; a point is looked up in one
    bin of each level that occurs, 64 at most.  So both sides meet by equality of level and bin, whatever the lengths
    are, and each pair once.  Nulls, and intervals that end before they start, match nothing.
    """
    level = F.length(F.bin(F.col("_end") - F.col("_start"))).cast("int")
    own = intervals.withColumns({"_start": start.cast("long"), "_end": end.cast("long")}).where("_start <= _end").withColumn("_level", level)
    touched = own.withColumn("_bin", F.explode(F.array_distinct(F.array(F.expr("shiftright(_start, _level)"), F.expr("shiftright(_end, _level)")))))
    levels = [r[0] for r in own.select("_level").distinct().collect()]
    asked = points.withColumn("_at", at.cast("long")).where("_at is not null").withColumn("_level", F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>"))).withColumn("_bin", F.expr("shiftright(_at, _level)"))
    return asked.join(touched, ["_level", "_bin"]).where("_at between _start and _end").drop("_level", "_bin", "_at", "_start", "_end")


def _placed(intervals: DataFrame, start: Column, end: Column, points: DataFrame, at: Column, value: Column) -> DataFrame:
    """Points and interval ends in one order, each with the number of points before it (_place).

    A point (_side 1) has its time and value; an interval's start (_side 0) comes before points of its time, and its
    end (_side 2) after them, so that the points within are those from the start's place to the end's.
    """
    own = intervals.withColumns({"_start": start.cast("long"), "_end": end.cast("long")}).where("_start <= _end").withColumn("_id", F.monotonically_increasing_id())
    ends = own.select("_id", "_key", F.explode(F.array(F.struct(F.col("_start").alias("_t"), F.lit(0).alias("_side")), F.struct(F.col("_end").alias("_t"), F.lit(2).alias("_side")))).alias("e")).select("_id", "_key", "e.*")
    asked = points.select(at.cast("long").alias("_t"), F.lit(1).alias("_side"), value.alias("_value")).where("_t is not null")
    both = ends.unionByName(asked, allowMissingColumns=True)
    return saved(prefix_sums(both, ["_t", "_side", "_value", "_id"], (F.col("_side") == 1).cast("int"), "_place"), "placed")


#: Of a binary tree over the places of all points, levels of at most so many nodes are broadcast.
TOP_NODES = 1 << 14


def count_and_least(intervals: DataFrame, key: str, start: Column, end: Column, points: DataFrame, at: Column, point: str) -> DataFrame:
    """(key, n, least): how many points are within the intervals of each key, and the least of them; keys without one are left out.

    No pair of a point and an interval is made.  Points are numbered by time, so an interval holds a run of numbers,
    whose length is the count.  The least comes from a binary tree over the numbers: a run is made up of at most two
    nodes of each level.
    """
    placed = _placed(intervals.withColumn("_key", F.col(key)), start, end, points, at, F.col(point))
    runs = placed.where("_side <> 1").groupBy("_id").agg(F.first("_key").alias("_key"), F.min("_place").alias("_low"), F.max("_place").alias("_high")).where("_low < _high")
    runs = saved(runs.select("_key", "_low", "_high"), "runs")
    levels = max(1, (placed.where("_side = 1").count() - 1).bit_length())
    top = max(0, levels - TOP_NODES.bit_length() + 1)
    nodes = placed.where("_side = 1").select("_place", "_value", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("_level"))
    tree = saved(nodes.groupBy("_level", F.expr("shiftright(_place, _level)").alias("_node")).agg(F.min("_value").alias("_least")), "tree")
    low, high = "shiftright(_low + shiftleft(1L, j) - 1, j)", "shiftright(_high, j)"
    odd = lambda x: f"{x} & 1 = 1"
    node = lambda x: f"named_struct('_level', j, '_node', {x})"
    parts = F.expr(f"filter(flatten(transform(sequence(0, {levels}), j -> array(if({low} < {high} and {odd(low)}, {node(low)}, null), if({low} < {high} and {odd(high)}, {node(f'{high} - 1')}, null)))), p -> p is not null)")
    each = runs.select("_key", F.explode(parts).alias("p")).select("_key", "p.*")
    upper = each.where(F.col("_level") >= top).join(F.broadcast(tree.where(F.col("_level") >= top)), ["_level", "_node"])
    lower = each.where(F.col("_level") < top).join(tree.where(F.col("_level") < top), ["_level", "_node"])
    least = upper.select("_key", "_least").unionByName(lower.select("_key", "_least")).select("_key", F.lit(0).cast("long").alias("_n"), "_least")
    counted = runs.select("_key", (F.col("_high") - F.col("_low")).alias("_n"), F.lit(None).cast(least.schema["_least"].dataType).alias("_least"))
    return counted.unionByName(least).groupBy("_key").agg(F.sum("_n").alias("n"), F.min("_least").alias("least")).select(F.col("_key").alias(key), "n", "least")


def first_within(intervals: DataFrame, key: str, start: Column, end: Column, points: DataFrame, at: Column, point: str) -> DataFrame:
    """(key, point): of the points within each interval the earliest, of equal times the least; intervals without one are left out.

    Points are numbered by time; an interval looks up the one point of its start's number.
    """
    placed = _placed(intervals.withColumn("_key", F.col(key)), start, end, points, at, F.col(point))
    runs = placed.where("_side <> 1").groupBy("_id").agg(F.first("_key").alias("_key"), F.min("_place").alias("_place"), F.max("_place").alias("_high")).where("_place < _high")
    numbered = placed.where("_side = 1").select("_place", "_t", "_value")
    return runs.join(numbered, "_place").groupBy("_key").agg(F.min(F.struct("_t", "_value")).alias("m")).select(F.col("_key").alias(key), F.col("m._value").alias(point))
