"""Selection: top-k, quotas, water-filling, sharding, mixes, budgets."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions.text import hash_order
from textloom.session import saved


def top_k(df: DataFrame, groups: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group in order, with their rank; Spark cuts each task's groups to k before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col("rank") <= k)


def hash_sample(df: DataFrame, groups: list[str], key: str, k: int, salt: str = "") -> DataFrame:
    """k rows of each group, those of smallest hash."""
    return top_k(df, groups, [hash_order(F.col(key), salt=salt), F.col(key)], k).drop("rank")


def shuffled_head(df: DataFrame, key: str, n: int, salt: str = "") -> DataFrame:
    return df.orderBy(hash_order(F.col(key), salt=salt), key).limit(n)


def water_level(available: DataFrame, column: str, want: int) -> DataFrame:
    """One row (level): the largest whole L with sum(min(L, available)) <= want, but no more than the largest amount.

    So where all amounts together are no more than wanted the level is the largest one, as any above it fills no more;
    without any rows it is 0.
    By counts of equal amounts, in ascending order: sums below plus the amount times those left is piecewise linear.
    """
    amounts = available.groupBy(F.col(column).cast("long").alias("x")).agg(F.count("*").alias("c"))
    w = Window.orderBy("x")  # different amounts only
    cum = amounts.select("x", F.coalesce(F.sum(F.col("x") * F.col("c")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("below"), F.sum("c").over(w.rowsBetween(0, Window.unboundedFollowing)).alias("left"), F.coalesce(F.lag("x").over(w), F.lit(0)).alias("floor"))
    level = F.least(F.col("x"), F.floor((F.lit(want) - F.col("below")) / F.col("left")))
    return cum.where(level >= F.col("floor")).agg(F.coalesce(F.max(level), F.lit(0)).cast("long").alias("level"))


def capped_allocation(df: DataFrame, key: str, amount: str, cap: int, budget: int) -> DataFrame:
    """(key, take): in order of key each gets its amount, at most cap, until the budget is used up."""
    capped = F.least(F.col(amount), F.lit(cap))
    before = prefix_sums(df.select(key, capped.alias("_capped")), [key], F.col("_capped"), "_before")
    return before.select(key, F.greatest(F.lit(0), F.least(F.col("_capped"), F.lit(budget) - F.col("_before"))).cast("long").alias("take"))


def prefix_sums(df: DataFrame, order: list[str], amount: Column, name: str) -> DataFrame:
    """Rows with the sum of `amount` over all rows before them in order, without one task seeing all.

    Ranges of the order are written once, so that they are the same whenever they are read; they are summed apart and
    offset by the sums of the ranges before, of which there are as many as Spark has shuffle partitions.
    """
    ranged = saved(df.withColumn("_amount", amount.cast("long")).repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("_p").agg(F.sum("_amount").alias("_n"))
    offsets = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    within = F.coalesce(F.sum("_amount").over(Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.join(F.broadcast(offsets), "_p").withColumn(name, (F.col("_base") + within).cast("long")).drop("_p", "_base", "_amount")


def dense_numbers(df: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """Rows numbered from 0 in order, without one task seeing all."""
    return prefix_sums(df, order, F.lit(1), name)


def numbers_within(df: DataFrame, groups: list[str], order: list[str], name: str = "number") -> DataFrame:
    """Rows numbered from 0 in order within their group, of which one may hold most rows.

    Ranges of groups and order are written once and numbered apart.  A range continues one group at most, its first:
    what is broadcast is a row a range.
    """
    ranged = saved(df.repartitionByRange(*groups, *order).withColumn("_p", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("_p", *groups).agg(F.count("*").alias("_n"))
    key = F.struct(*groups)
    ends = sizes.groupBy("_p").agg(F.min(key).alias("_first"), F.max(key).alias("_last"), F.max_by("_n", key).alias("_tail"))
    # of the last group of each range: how many rows of it came by the range's end, where ranges hold it alone
    w = Window.orderBy("_p")
    starts = ends.withColumn("_run", F.sum((~F.col("_first").eqNullSafe(F.lag("_last").over(w)) | ~F.col("_first").eqNullSafe(F.col("_last"))).cast("int")).over(w))
    whole = F.sum("_tail").over(Window.partitionBy("_run").orderBy("_p"))
    base = starts.withColumn("_upto", whole).withColumn("_base", F.when(F.col("_first").eqNullSafe(F.lag("_last").over(w)), F.lag("_upto").over(w)).otherwise(0)).select("_p", "_first", "_base")
    within = F.row_number().over(Window.partitionBy("_p", *groups).orderBy(*order)) - 1
    placed = ranged.withColumn("_within", within).join(F.broadcast(base), "_p")
    return placed.withColumn(name, (F.col("_within") + F.when(key.eqNullSafe(F.col("_first")), F.col("_base")).otherwise(0)).cast("long")).drop("_p", "_first", "_base", "_within")


def round_robin(number: Column, shards: int) -> Column:
    return F.pmod(number, F.lit(shards))


def units(number: Column, size: int) -> Column:
    return F.floor(number / size).cast("long")


def skip_not_stop(df: DataFrame, group: str, order: str, size: str, budget: int) -> DataFrame:
    """(group, order, size) of the items taken: in order, each that still fits the budget; others are skipped, not stopped at."""
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(size).cast("long").alias("s"))))
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<o:bigint,s:bigint>>").alias("taken"))

    def step(acc: Column, item: Column) -> Column:
        fits = acc["used"] + item["s"] <= budget
        return F.struct(F.when(fits, acc["used"] + item["s"]).otherwise(acc["used"]).alias("used"), F.when(fits, F.concat(acc["taken"], F.array(item))).otherwise(acc["taken"]).alias("taken"))

    folded = df.withColumn(order, F.col(order).cast("long")).groupBy(group).agg(items.alias("items"))
    return folded.select(group, F.explode(F.aggregate("items", zero, step)["taken"]).alias("t")).select(group, F.col("t.o").alias(order), F.col("t.s").alias(size))


def longest_first_shards(sizes: DataFrame, key: str, size: str, shards: int) -> DataFrame:
    """(key, shard): largest first, each to the lightest shard so far.

    Each step needs the one before, so the rows (aggregated totals: a key and a number each) stream through one task
    in sorted order; it holds the shards' loads alone.  The sort before it is by ranges, in many tasks.
    """

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        load = [0] * shards
        for pdf in batches:
            out = []
            for s in pdf[size]:
                at = min(range(shards), key=lambda i: (load[i], i))
                load[at] += s
                out.append(at)
            yield pd.DataFrame({key: pdf[key], "shard": out})

    return sizes.select(key, size).orderBy(F.desc(size), key).coalesce(1).mapInPandas(place, f"{key} {sizes.schema[key].dataType.simpleString()}, shard int")
