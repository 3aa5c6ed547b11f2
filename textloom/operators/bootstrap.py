"""Bootstrap of paired differences over any number of rows, by weights instead of draws."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers that one digest gives.
PER_DIGEST = 16
#: A row counts as often in a resample as there are cuts at or below its number of 16 bits: Poisson with mean 1.
CUTS = tuple(math.floor(65536 * c) for c in accumulate(math.exp(-1) / math.factorial(k) for k in range(8)))


def weights(key: str, resamples: int, salt: str) -> np.ndarray:
    """How often the row of this key is in each resample."""
    digests = (hashlib.sha256(f"{salt}:{key}:{block}".encode()).digest() for block in range(-(-resamples // PER_DIGEST)))
    return np.searchsorted(CUTS, np.frombuffer(b"".join(digests), ">u2")[:resamples], side="right")


def paired_means(pairs: DataFrame, key: str, first: str, second: str, resamples: int, salt: str = "pair", groups: tuple[str, ...] = ()) -> DataFrame:
    """(groups, r, mean): for each resample the mean of first - second over the rows that have both.

    Each row has a weight in each resample, from a hash of its key, so rows need no numbers and resamples no join: a
    task adds up its rows and sends a row for each group and resample.  mean is null for a resample without a row.
    Keys stand for themselves: rows of one key have the same weights.
    """
    own = pairs.where(F.col(first).isNotNull() & F.col(second).isNotNull()).select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), (F.col(first) - F.col(second)).cast("double").alias("x"), F.to_json(F.struct(*groups) if groups else F.struct(F.lit(1).alias("one"))).alias("g"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for k, x, g in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if g not in total:
                    total[g] = np.zeros((2, resamples))
                w = weights(k, resamples, salt)
                total[g][0] += w
                total[g][1] += w * x
        for g, t in total.items():
            yield pa.RecordBatch.from_pydict({"g": [g] * resamples, "r": np.arange(resamples), "w": t[0], "s": t[1]})

    summed = own.mapInArrow(add, "g string, r long, w double, s double").groupBy("g", "r").agg(F.sum("w").alias("w"), F.sum("s").alias("s"))
    kinds = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in groups)
    out = summed.withColumn("g", F.from_json("g", kinds)) if groups else summed
    return out.select(*[F.col(f"g.{c}").alias(c) for c in groups], "r", F.try_divide("s", "w").alias("mean"))


def paired_interval(means: DataFrame, groups: tuple[str, ...] = (), share: float = 0.95) -> DataFrame:
    """(groups, low, high, p_not_better): of paired_means() the values between which `share` of them lie, and the share at most 0."""
    ordered = F.array_sort(F.collect_list("mean"))  # resamples
    n = F.size("m")
    tail = (1 - share) / 2
    return means.groupBy(*groups).agg(ordered.alias("m"), F.avg((F.col("mean") <= 0).cast("int")).alias("p_not_better")).select(*groups, F.get("m", F.floor(n * tail).cast("int")).alias("low"), F.get("m", (F.ceil(n * (1 - tail)) - 1).cast("int")).alias("high"), "p_not_better")
