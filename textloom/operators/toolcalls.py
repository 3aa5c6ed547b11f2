"""Tool calls: matching against what was expected, scores, coverage, grounding, replay, renaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions.text import matches


def call_matches(name: Column, arguments: Column, want_name: Column, allowed: Column) -> Column:
    """Whether a call (name, map of arguments) is what was expected (name, map of allowed value lists).

    Values compare without case; "*" allows any, "" means that the argument may be missing.
    """
    given = F.map_entries(arguments)
    fine = F.forall(given, lambda e: F.coalesce(F.exists(F.element_at(allowed, e["key"]), lambda v: (v == "*") | (F.lower(v) == F.lower(e["value"]))), F.lit(False)))
    whole = F.forall(F.map_entries(allowed), lambda e: F.map_contains_key(arguments, e["key"]) | F.array_contains(e["value"], F.lit("")))
    return F.coalesce((name == want_name) & fine & whole, F.lit(False))


def any_alternative(name: Column, arguments: Column, alternatives: Column) -> Column:
    """call_matches for at least one of an array of (name, allowed)."""
    return F.exists(alternatives, lambda a: call_matches(name, arguments, a["name"], a["allowed"]))


def item_score(expected_call: Column, called: Column, matched: Column, malformed: Column, n_calls: Column) -> Column:
    """1 for the right single call or a right refusal to call, else 0; malformed blocks and several calls count as wrong."""
    right = F.when(expected_call, called & matched & (n_calls == 1)).otherwise(~called)
    return F.when(right & ~malformed, 1.0).otherwise(0.0)


def decision(expected_call: Column, called: Column) -> Column:
    """Cell of the confusion table of calling and not calling."""
    return F.when(expected_call, F.when(called, "call").otherwise("missed_call")).otherwise(F.when(called, "needless_call").otherwise("no_call"))


def coverage(calls: DataFrame, expected: DataFrame, conv: str, tool: str, least_tools: int = 2, least_recall: float = 0.5) -> DataFrame:
    """(conv, n_tools, recall, covered): different tools used, share of the expected ones among them; null recall without any expected."""
    used = calls.select(conv, tool).distinct().withColumn("used", F.lit(True))
    wanted = expected.select(conv, tool).distinct().withColumn("wanted", F.lit(True))
    both = used.join(wanted, [conv, tool], "full")
    hit = F.count_if(F.col("used") & F.col("wanted"))
    counts = both.groupBy(conv).agg(F.count("used").alias("n_tools"), F.try_divide(hit, F.count("wanted")).alias("recall"))
    return counts.withColumn("covered", (F.col("n_tools") >= least_tools) & (F.coalesce("recall", F.lit(0.0)) >= least_recall))


def grounded(answer: Column, source: Column, pattern: str) -> Column:
    """What the pattern finds in the answer and not, as a whole match, in the source."""
    return F.array_except(matches(answer, pattern), matches(source, pattern))


def claims(text: Column, verb: str, window: int = 20) -> Column:
    """Whether the text claims the action: the verb occurs without a negation in the `window` characters before it."""
    found = F.regexp_extract_all(text, F.lit(rf"(?is)(.{{0,{window}}}(?:{verb}))"), F.lit(1))
    return F.exists(found, lambda c: ~c.rlike(r"(?i)(?:^|[^a-z])(?:not|never|no|cannot|can't|didn't|without)[^a-z]"))


def unbacked_claims(turns: DataFrame, actions: DataFrame, verb: str) -> DataFrame:
    """(conv_id, turn): turns that claim an action before any success of it; actions: (conv_id, turn) of successes."""
    first = actions.groupBy("conv_id").agg(F.min("turn").alias("first"))
    said = turns.where(claims(F.col("text"), verb)).select("conv_id", "turn")
    return said.join(first, "conv_id", "left").where(F.col("first").isNull() | (F.col("first") >= F.col("turn"))).select("conv_id", "turn")


def numbered_calls(events: DataFrame, conv: str, order: list[str]) -> DataFrame:
    """Events with call_id "call_n": calls numbered in order within a conversation, each result with the number of its ordinal call."""
    w = Window.partitionBy(conv, "kind").orderBy(*order)
    return events.withColumn("call_id", F.concat(F.lit("call_"), F.row_number().over(w).cast("string")))


def whole_batches(calls: DataFrame, keys: list[str], violates: Column) -> DataFrame:
    """Calls with `blocked`: all of a turn are, if one of them violates a rule."""
    return calls.withColumn("blocked", F.bool_or(F.coalesce(violates, F.lit(False))).over(Window.partitionBy(*keys)))


def renamed_calls(text: Column, names: list[str], prefix: str) -> Column:
    """Tool names in call blocks with the prefix; null where a name stands outside of the blocks too (it would leak)."""
    either = "|".join(names)
    outside = F.regexp_replace(text, r"(?s)<tool_call>.*?</tool_call>", "")
    leaks = outside.rlike(rf"(?:^|[^A-Za-z0-9_])(?:{either})(?:[^A-Za-z0-9_]|$)")
    return F.when(~leaks, F.regexp_replace(text, rf'("name"\s*:\s*")({either})"', rf'$1{prefix}$2"'))


def replayed(steps: DataFrame, conv: str, order: list[str], sets: Column, start: str) -> DataFrame:
    """Steps with `state`: what the last step before it (in order) that sets one has set, else start.

    `sets` is the state a step sets, or null; so a whole conversation is replayed in one running window.
    """
    before = Window.partitionBy(conv).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return steps.withColumn("state", F.coalesce(F.last(sets, ignorenulls=True).over(before), F.lit(start)))


def rescued_call(text: Column, names: list[str]) -> Column:
    """Body of a call written without its marks: exactly one JSON object with a known name, or a bare known name in a fence."""
    either = "|".join(names)
    objects = F.regexp_extract_all(text, F.lit(rf'(\{{\s*"name"\s*:\s*"(?:{either})"[^{{}}]*(?:\{{[^{{}}]*\}})?[^{{}}]*\}})'), F.lit(1))
    bare = F.regexp_extract_all(text, F.lit(rf"```[a-z]*\s*({either})\s*(?:\(\s*\))?\s*```"), F.lit(1))
    marked = text.contains("<tool_call>")
    return F.when(marked, None).when((F.size(objects) == 1) & F.get_json_object(F.get(objects, F.lit(0)), "$.name").isNotNull(), F.get(objects, F.lit(0))).when(
        (F.size(objects) == 0) & (F.size(bare) == 1), F.concat(F.lit('{"name": "'), F.get(bare, F.lit(0)), F.lit('", "arguments": {}}'))
    )
