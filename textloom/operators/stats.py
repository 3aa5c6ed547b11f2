"""Judge statistics, intervals, bootstraps, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def win_rate(verdict: Column, flipped: Column) -> tuple[Column, Column]:
    """(rate, n): mean of win 1, tie 1/2, loss 0 over verdicts A, B, T (A and B swapped where flipped); null if any is invalid."""
    ours = F.when(verdict == "T", 0.5).when(verdict.isin("A", "B"), F.when((verdict == "A") != flipped, 1.0).otherwise(0.0))
    invalid = F.count_if(ours.isNull())
    return F.when((invalid == 0) & (F.count("*") > 0), F.avg(ours)), F.count("*")


def majority(verdicts: DataFrame, keys: list[str], verdict: str = "verdict") -> DataFrame:
    """(keys, verdict): what most valid judges say; a tie of the leading ones is T, a single judge's is its own, none is null."""
    counted = verdicts.groupBy(*keys, verdict).agg(F.when(F.col(verdict).isNotNull(), F.count("*")).otherwise(0).alias("n"))
    best = counted.groupBy(*keys).agg(F.max("n").alias("top"), F.max_by(verdict, "n").alias("v"), F.collect_list(F.struct("n", verdict)).alias("all"))
    leaders = F.size(F.filter("all", lambda x: x["n"] == F.col("top")))
    return best.select(*keys, F.when(F.col("top") == 0, None).when(leaders > 1, "T").otherwise(F.col("v")).alias("majority"))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson interval of a share, within 0 and 1; null for n = 0."""
    p, m = hits / F.nullif(n, F.lit(0)), F.nullif(n, F.lit(0)).cast("double")
    middle, half = (p + z * z / (2 * m)) / (1 + z * z / m), z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m)) / (1 + z * z / m)
    return F.greatest(F.lit(0.0), middle - half), F.least(F.lit(1.0), middle + half)


def upper_median(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """(groups, upper_median): the value at index n // 2 in ascending order.

    Equal values are counted first, so a group with many rows is no more than its different values in one task.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*groups)
    placed = counts.withColumn("_to", F.sum("_c").over(w.orderBy(value))).withColumn("_n", F.sum("_c").over(w))
    middle = F.floor(F.col("_n") / 2)
    return placed.where((F.col("_to") > middle) & (F.col("_to") - F.col("_c") <= middle)).select(*groups, F.col(value).alias("upper_median"))


def seed_summary(df: DataFrame, groups: list[str], seed: str, value: str, seeds: int) -> DataFrame:
    """Mean, sample deviation (0 for one seed), least, most, n; incomplete if seeds or values are missing."""
    return df.groupBy(*groups).agg(
        F.avg(value).alias("mean"),
        F.coalesce(F.stddev_samp(value), F.when(F.count(value) == 1, 0.0)).alias("std"),
        F.min(value).alias("least"),
        F.max(value).alias("most"),
        F.count(value).alias("n"),
        F.when((F.count_distinct(seed) < seeds) | (F.count_if(F.col(value).isNull()) > 0), "incomplete").otherwise("complete").alias("status"),
    )


def bootstrap_means(values: DataFrame, value: str, order: str, resamples: int, salt: str = "b") -> DataFrame:
    """(r, mean): means of resamples drawn with replacement by hash, so that any engine draws the same.

    Values (a question set of bounded size) are numbered from 0; draw i of resample r takes the value of number
    first 15 hex digits of md5(salt:r:i) modulo n.  The values are joined by number, resamples run in parallel.
    """
    numbered = values.select(F.row_number().over(Window.orderBy(order)).alias("k"), F.col(value).alias("x")).withColumn("k", F.col("k") - 1)
    n = numbered.count()
    spark = values.sparkSession
    draws = spark.range(resamples).select(F.col("id").alias("r"), F.explode(F.sequence(F.lit(0), F.lit(max(n - 1, 0)))).alias("i"))
    at = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(salt), "r", "i")), 1, 15), 16, 10).cast("long") % F.lit(max(n, 1))
    return draws.withColumn("k", at).join(numbered, "k").groupBy("r").agg(F.avg("x").alias("mean"))


def bootstrap_interval(means: DataFrame, low: int, high: int) -> DataFrame:
    """One row (low, high, p_le_0): the means at these indices in ascending order, and the share of means at most 0."""
    ranked = means.withColumn("i", F.row_number().over(Window.orderBy("mean", "r")) - 1)
    return ranked.agg(F.max(F.when(F.col("i") == low, F.col("mean"))).alias("low"), F.max(F.when(F.col("i") == high, F.col("mean"))).alias("high"), F.avg((F.col("mean") <= 0).cast("int")).alias("p_le_0"))


def top_values(df: DataFrame, groups: list[str], value: str, k: int) -> DataFrame:
    """The k most frequent values of each group (ties by value), with counts and ranks."""
    counted = df.groupBy(*groups, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*groups).orderBy(F.desc("n"), value)
    return counted.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
