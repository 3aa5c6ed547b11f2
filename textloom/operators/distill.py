"""Top-k log-probabilities as arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.select import prefix_sums

FLOOR = -1e4


def top_ranked(tokens: Column, k: int) -> Column:
    """Of {id, rank, lp} structs the ids in order of rank, k at most."""
    by_rank = F.array_sort(F.transform(tokens, lambda t: F.struct(t["rank"].alias("rank"), t["id"].alias("id"), t["lp"].alias("lp"))))
    return F.transform(F.slice(by_rank, 1, k), lambda t: F.struct(t["id"].alias("id"), F.greatest(t["lp"], F.lit(FLOOR)).alias("lp")))


def padded(values: Column, k: int, fill: Column) -> Column:
    return F.concat(values, F.array_repeat(fill, F.greatest(F.lit(0), F.lit(k) - F.size(values))))


def softmax(logprobs: Column) -> Column:
    top = F.array_max(logprobs)
    e = F.transform(logprobs, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def mixed_loss(hard_logprob: Column, teacher: Column, student: Column, alpha: float) -> Column:
    """(1 - alpha) * cross-entropy of the label + alpha * cross-entropy of the teacher's softmax against the student's."""
    soft = F.aggregate(F.zip_with(softmax(teacher), softmax(student), lambda t, s: -t * F.log(s)), F.lit(0.0), lambda a, x: a + x)
    return (1 - alpha) * -hard_logprob + alpha * soft


def one_hot(width: int, at: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: (i == at).cast("double"))


def ragged(values: Column, start: Column, end: Column) -> Column:
    """Rows [start, end) of a flat array with offsets."""
    return F.slice(values, start + 1, end - start)


def ragged_offsets(rows: DataFrame, key: str, values: str) -> DataFrame:
    """(key, start, stop): where each row's values lie when all are put end to end in order of key."""
    sized = prefix_sums(rows.select(key, F.size(values).alias("_n")), [key], F.col("_n"), "start")
    return sized.select(key, "start", (F.col("start") + F.col("_n")).cast("long").alias("stop"))
