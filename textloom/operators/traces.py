"""Transcripts and tool calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions.text import matches, numbers


def turn_window(conv: str = "conv_id", turn: str = "turn"):
    return Window.partitionBy(conv).orderBy(turn)


def role_violations(turns: DataFrame) -> DataFrame:
    """(conv_id, violations, ends_well): steps the order user, assistant, (tool, assistant)* doesn't allow; system may only open."""
    w = turn_window()
    before = F.lag("role").over(w)
    bad = (
        F.when(before.isNull(), ~F.col("role").isin("system", "user"))
        .when(F.col("role") == "system", True)
        .when(F.col("role") == "user", ~before.isin("assistant", "system"))
        .when(F.col("role") == "tool", before != "assistant")
        .otherwise(~before.isin("user", "tool"))
    )
    return turns.withColumn("bad", bad).groupBy("conv_id").agg(F.count_if("bad").alias("violations"), (F.max_by("role", "turn") == "assistant").alias("ends_well"))


def last_answer(turns: DataFrame) -> DataFrame:
    """(conv_id, answer): the last turn's text if the assistant has the last word."""
    return turns.groupBy("conv_id").agg(F.max_by(F.struct("role", "text"), "turn").alias("m")).where("m.role = 'assistant'").select("conv_id", F.col("m.text").alias("answer"))


def history_trim(turns: DataFrame, limit: int = 24000) -> DataFrame:
    """Newest turns of up to limit characters in all, from the first user turn among them on."""
    back = turn_window().rowsBetween(Window.currentRow, Window.unboundedFollowing)
    kept = turns.withColumn("rest", F.sum(F.coalesce(F.length("text"), F.lit(0))).over(back)).where(F.col("rest") <= limit)
    first_user = F.min(F.when(F.col("role") == "user", F.col("turn"))).over(Window.partitionBy("conv_id"))
    return kept.withColumn("start", first_user).where("turn >= start").drop("rest", "start")


def turn_prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, n_before, chars_before): for each assistant turn the history it answers."""
    w = turn_window().rowsBetween(Window.unboundedPreceding, -1)
    chars = F.coalesce(F.sum(F.coalesce(F.length("text"), F.lit(0))).over(w), F.lit(0))
    return turns.withColumn("n_before", F.count("*").over(w)).withColumn("chars_before", chars).where("role = 'assistant'").select("conv_id", "turn", "n_before", "chars_before")


def ungrounded_numbers(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, n_numbers, n_ungrounded): different numbers of each assistant turn, and those in no turn before."""
    each = turns.select("conv_id", "turn", "role", F.explode(F.array_distinct(numbers(F.coalesce(F.col("text"), F.lit(""))))).alias("x"))
    first = each.withColumn("first", F.min("turn").over(Window.partitionBy("conv_id", "x")))
    counted = first.where("role = 'assistant'").groupBy("conv_id", "turn").agg(F.count("*").alias("n_numbers"), F.count_if(F.col("first") == F.col("turn")).alias("n_ungrounded"))
    return turns.where("role = 'assistant'").select("conv_id", "turn").join(counted, ["conv_id", "turn"], "left").fillna(0)


def evidence_before(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, evidence_ids): ids of everything said before each assistant turn, by digest."""
    known = F.substring(F.sha2(F.concat_ws("|", "conv_id", "turn", "role", "text"), 256), 1, 12)
    before = turn_window().rowsBetween(Window.unboundedPreceding, -1)
    marked = turns.withColumn("eid", known).withColumn("evidence_ids", F.collect_list("eid").over(before))
    return marked.where("role = 'assistant'").select("conv_id", "turn", F.array_sort("evidence_ids").alias("evidence_ids"))


def citation_problems(turns: DataFrame, citations: DataFrame) -> DataFrame:
    """(conv_id, turn, problem) for each citing turn (conv_id, turn, cited array, supported): unknown_evidence, no_evidence or empty.

    As cited_gaps() over evidence_before(), without listing for each turn all that was said before it: a cited id is
    known if it was first said in an earlier turn.
    """
    eid = F.substring(F.sha2(F.concat_ws("|", "conv_id", "turn", "role", "text"), 256), 1, 12)
    first = turns.groupBy("conv_id", eid.alias("eid")).agg(F.min("turn").alias("said"))
    each = citations.select("conv_id", "turn", "supported", F.size("cited").alias("n"), F.explode_outer(F.array_distinct("cited")).alias("eid"))
    found = each.join(first, ["conv_id", "eid"], "left")
    unknown = F.col("eid").isNotNull() & F.coalesce(F.col("said") >= F.col("turn"), F.lit(True))
    by_turn = found.groupBy("conv_id", "turn").agg(F.bool_or(unknown).alias("unknown"), F.bool_or(F.col("supported") & (F.col("n") == 0)).alias("none"))
    return by_turn.select("conv_id", "turn", F.when(F.col("unknown"), "unknown_evidence").when(F.col("none"), "no_evidence").otherwise("").alias("problem"))


def cited_gaps(cited: Column, available: Column, supported: Column) -> Column:
    """What a citation lacks: unknown ids, or no id although supported; empty if nothing."""
    return F.when(F.size(F.array_except(cited, available)) > 0, "unknown_evidence").when(supported & (F.size(cited) == 0), "no_evidence").otherwise("")


def hermes_calls(text: Column) -> Column:
    """Bodies of <tool_call> blocks as (name, arguments JSON); a body that isn't JSON has a null name and itself as arguments."""
    bodies = F.regexp_extract_all(text, F.lit(r"(?s)<tool_call>\s*(.*?)\s*</tool_call>"), F.lit(1))
    return F.transform(bodies, lambda b: F.struct(F.get_json_object(b, "$.name").alias("name"), F.coalesce(F.get_json_object(b, "$.arguments"), b).alias("arguments")))


def outside_calls(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?s)<tool_call>.*?</tool_call>", ""))


def paired_calls(events: DataFrame) -> DataFrame:
    """(conv_id, n, call, result): calls and results of a conversation matched by their order; either may be missing."""
    number = F.row_number().over(Window.partitionBy("conv_id", "kind").orderBy("turn", "pos"))
    each = events.withColumn("n", number)
    calls = each.where("kind = 'call'").select("conv_id", "n", F.col("body").alias("call"))
    results = each.where("kind = 'result'").select("conv_id", "n", F.col("body").alias("result"))
    return calls.join(results, ["conv_id", "n"], "full")


def argument_problems(calls: DataFrame, schema: DataFrame) -> DataFrame:
    """(call_id, problem): calls (call_id, tool, args map<string,string>) held against schema (tool, arg, kind, required, allowed[]).

    The schema, a row an argument, is broadcast: dealt out by tool, the calls of a frequent one would be one task's.
    """
    tools = F.broadcast(schema.select("tool").distinct())
    unknown = calls.join(tools, "tool", "left_anti").select("call_id", F.lit("unknown_tool").alias("problem"))
    known = calls.join(tools, "tool", "left_semi")
    need = known.join(F.broadcast(schema.where("required")), "tool").where(~F.map_contains_key("args", F.col("arg"))).select("call_id", F.concat(F.lit("missing:"), "arg").alias("problem"))
    given = known.select("call_id", "tool", F.explode("args").alias("arg", "value"))
    checked = given.join(F.broadcast(schema), ["tool", "arg"], "left")
    typed = (
        F.when(F.col("kind").isNull(), F.concat(F.lit("extra:"), "arg"))
        .when((F.col("kind") == "integer") & ~F.col("value").rlike(r"^-?\d+$"), F.concat(F.lit("type:"), "arg"))
        .when((F.col("kind") == "boolean") & ~F.col("value").isin("true", "false"), F.concat(F.lit("type:"), "arg"))
        .when((F.size("allowed") > 0) & ~F.array_contains("allowed", F.col("value")), F.concat(F.lit("enum:"), "arg"))
    )
    return unknown.union(need).union(checked.select("call_id", typed.alias("problem")).where("problem is not null"))


def grounded_ids(answer: Column, source: Column) -> Column:
    """Ids of five digits or more in the answer that the source doesn't have as a whole number; an array id counts by its job."""
    ids = F.transform(matches(answer, r"\b[0-9]{5,}(?:_[0-9]+)?\b"), lambda i: F.substring_index(i, "_", 1))
    return F.array_except(ids, matches(source, r"[0-9]+"))


def leaks_tools(text: Column, names: list[str]) -> Column:
    return text.rlike(r"</?tool_call>|\b(?:" + "|".join(names) + r")\s*\(")


PROMISE = r"(?i)\b(?:i will|i'll|let me|going to)\b"
