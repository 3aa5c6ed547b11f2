"""Review protocols: who judged what, how verdicts combine, what has to be done again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.select import numbers_within


def segments_cover(text: Column, segments: Column) -> Column:
    """Whether the segments, in order and verbatim, cover all of the text but white space."""
    start = F.struct(F.lit(1).alias("at"), F.lit(True).alias("ok"))

    def step(acc: Column, segment: Column) -> Column:
        found = F.call_function("locate", segment, text, acc["at"])
        gap = F.substr(text, acc["at"], F.greatest(F.lit(0), found - acc["at"]))
        ok = acc["ok"] & (found > 0) & (F.trim(F.regexp_replace(gap, r"\s+", " ")) == "")
        return F.struct(F.when(ok, found + F.length(segment)).otherwise(acc["at"]).alias("at"), ok.alias("ok"))

    return F.aggregate(segments, start, step, lambda acc: acc["ok"] & (F.trim(F.regexp_replace(F.substr(text, acc["at"]), r"\s+", " ")) == ""))


def unit_problems(units: DataFrame, judged: DataFrame, key: str) -> DataFrame:
    """(key, problem): units that nobody judged, that were judged more than once, and judgments of unknown units."""
    once = units.select(key).distinct().withColumn("known", F.lit(True))
    counted = judged.groupBy(key).agg(F.count("*").alias("n"))
    problem = F.when(F.col("known").isNull(), "unknown").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated")
    return once.join(counted, key, "full").select(key, problem.alias("problem")).where("problem is not null")


def reduced_status(verdicts: DataFrame, keys: list[str], verdict: str, precedence: list[str]) -> DataFrame:
    """(keys, status): the verdict that comes first in precedence, of all those given; null where none is in it."""
    order = F.array(*map(F.lit, precedence))
    rank = F.array_position(order, F.col(verdict))
    return verdicts.groupBy(*keys).agg(F.min(F.when(rank > 0, rank)).alias("rank")).select(*keys, F.try_element_at(order, F.col("rank").cast("int")).alias("status"))


def binding_state(pairs: list[tuple[Column, Column]]) -> Column:
    """current if every recorded value equals the one it was made from (nulls too), else pending."""
    same = F.lit(True)
    for recorded, actual in pairs:
        same = same & recorded.eqNullSafe(actual)
    return F.when(same, "current").otherwise("pending")


def redo_plan(units: DataFrame, reports: DataFrame, key: str) -> DataFrame:
    """(key, action): units without a report that holds.

    reports: (key, malformed, gap).  Malformed reports are dropped; a unit with a report that has an evidence gap and
    none without is archived and done again, a unit with neither is done.
    """
    kept = reports.where(~F.coalesce("malformed", F.lit(True))).groupBy(key).agg(F.min(F.coalesce(F.col("gap"), F.lit(False)).cast("int")).alias("all_gaps"))
    action = F.when(F.col("all_gaps").isNull(), "do").when(F.col("all_gaps") == 1, "archive_and_redo")
    return units.select(key).distinct().join(kept, key, "left").select(key, action.alias("action")).where("action is not null")


def repaired(original: DataFrame, retries: DataFrame, keys: list[str], verdict: str, valid: list[str]) -> DataFrame:
    """(keys, verdict): the original where it is valid, else the first valid retry by attempt, else null."""
    good = retries.where(F.col(verdict).isin(*valid)).groupBy(*keys).agg(F.min_by(verdict, "attempt").alias("_retry"))
    own = F.when(F.col(verdict).isin(*valid), F.col(verdict))
    return original.join(good, keys, "left").select(*keys, F.coalesce(own, "_retry").alias(verdict))


def self_selected(first: Column, second: Column) -> Column:
    """B only if preferred in both orders (B is named B in the first order, A in the second); else A."""
    return F.when((first == "B") & (second == "A"), "B").otherwise("A")


def preference_pairs(candidates: DataFrame, group: str, key: str, score: str, accept: float) -> DataFrame:
    """(group, chosen, rejected): best and worst candidate where they differ in score and the best reaches accept."""
    best = F.max_by(key, F.struct(F.col(score), -F.col(key))).alias("chosen")
    worst = F.min_by(key, F.struct(F.col(score), F.col(key))).alias("rejected")
    ends = candidates.groupBy(group).agg(best, worst, F.max(score).alias("_top"), F.min(score).alias("_low"))
    return ends.where((F.col("_top") > F.col("_low")) & (F.col("_top") >= accept)).select(group, "chosen", "rejected")


def first_passing(samples: DataFrame, group: str, number: str, passed: Column) -> DataFrame:
    """(group, number): the smallest sample number that passed; groups without one are left out."""
    return samples.where(passed).groupBy(group).agg(F.min(number).alias(number))


def permuted(candidates: DataFrame, group: str, key: str, salt: str) -> DataFrame:
    """Candidates with their place (from 0) in a permutation that depends on group and salt alone."""
    order = F.md5(F.concat_ws("|", F.lit(salt), F.col(group).cast("string"), F.col(key).cast("string")))
    return numbers_within(candidates.withColumn("_order", order), [group], ["_order", key], "place").drop("_order")


def rating(share: Column, ran: Column, partly: float = 0.5) -> Column:
    """correct if all rules hold and the run succeeded, partly from `partly` of the rules on, else wrong."""
    return F.when((share >= 1) & ran, "correct").when(share >= partly, "partly").otherwise("wrong")
