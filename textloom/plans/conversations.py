"""Transcripts: order of roles, histories, grounding, evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.text import NUMBER, last_sentence
from textloom.operators import traces as K
from textloom.plans.registry import Registry
from textloom.session import table

R = Registry()
QUERIES, SQL = R.queries, R.sql


@R.query("select conv_id, arg_max(text, turn) as answer from conversations group by conv_id having arg_max(role, turn) = 'assistant'")
def conv_last_answer(spark: SparkSession, d: str) -> DataFrame:
    return K.last_answer(table(spark, d, "conversations"))


@R.query(
    """
with l as (select *, lag(role) over (partition by conv_id order by turn) as b from conversations),
v as (select conv_id, turn, role, case when b is null then role not in ('system', 'user') when role = 'system' then true when role = 'user' then b not in ('assistant', 'system')
  when role = 'tool' then b <> 'assistant' else b not in ('user', 'tool') end as bad from l)
select conv_id, count(*) filter (where bad) as violations, arg_max(role, turn) = 'assistant' as ends_well from v group by conv_id"""
)
def conv_role_violations(spark: SparkSession, d: str) -> DataFrame:
    return K.role_violations(table(spark, d, "conversations"))


@R.query(
    """
select conv_id, turn, n_before, chars_before from (
  select conv_id, turn, role, count(*) over w as n_before, cast(coalesce(sum(coalesce(length(text), 0)) over w, 0) as bigint) as chars_before
  from conversations window w as (partition by conv_id order by turn rows between unbounded preceding and 1 preceding)) where role = 'assistant'"""
)
def conv_turn_prefix(spark: SparkSession, d: str) -> DataFrame:
    return K.turn_prefixes(table(spark, d, "conversations"))


@R.query(
    """
with r as (select *, sum(coalesce(length(text), 0)) over (partition by conv_id order by turn rows between current row and unbounded following) as rest from conversations),
k as (select *, min(case when role = 'user' then turn end) over (partition by conv_id) as start from r where rest <= 600)
select conv_id, turn, role from k where turn >= start"""
)
def conv_history_trim(spark: SparkSession, d: str) -> DataFrame:
    return K.history_trim(table(spark, d, "conversations"), 600).select("conv_id", "turn", "role")


@R.query(
    rf"""
with e as (select distinct conv_id, turn, role, try_cast(replace(unnest(regexp_extract_all(coalesce(text, ''), '{NUMBER}')), ',', '') as double) as x from conversations),
f as (select *, min(turn) over (partition by conv_id, x) as first from e),
c as (select conv_id, turn, count(*) as n_numbers, count(*) filter (where first = turn) as n_ungrounded from f where role = 'assistant' group by all)
select conv_id, turn, coalesce(n_numbers, 0) as n_numbers, coalesce(n_ungrounded, 0) as n_ungrounded from conversations left join c using (conv_id, turn) where role = 'assistant'"""
)
def conv_number_grounding(spark: SparkSession, d: str) -> DataFrame:
    return K.ungrounded_numbers(table(spark, d, "conversations"))


@R.query(
    """
with k as (select *, substr(sha256(concat_ws('|', conv_id::varchar, turn::varchar, role, text)), 1, 12) as eid from conversations),
b as (select conv_id, turn, role, list(eid) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) as ids from k)
select conv_id, turn, coalesce(array_to_string(list_sort(ids), ','), '') as evidence from b where role = 'assistant'"""
)
def evidence_before_turn(spark: SparkSession, d: str) -> DataFrame:
    return K.evidence_before(table(spark, d, "conversations")).select("conv_id", "turn", F.array_join("evidence_ids", ",").alias("evidence"))


@R.query(
    """
with k as (select *, substr(sha256(concat_ws('|', conv_id::varchar, turn::varchar, role, text)), 1, 12) as eid from conversations), l as (select *, lag(eid) over w as before, lead(eid) over w as after from k window w as (partition by conv_id order by turn)),
c as (select *, case turn % 4 when 0 then [after] when 1 then [before] when 2 then [before, eid] else [] end as cited from l where role = 'assistant'), e as (select c.conv_id, c.turn, len(list_filter(cited, lambda x: x is not null)) as n, count(*) filter (not exists (select 1 from k where k.conv_id = c.conv_id and k.turn < c.turn and k.eid = u.x)) as bad
  from c left join lateral (select unnest(cited) as x) u on true where u.x is not null or len(cited) = 0 group by all)
select conv_id, turn, case when n > 0 and bad > 0 then 'unknown_evidence' when n = 0 then 'no_evidence' else '' end as problem from e"""
)
def cited_turns(spark: SparkSession, d: str) -> DataFrame:
    """Answers cite a later turn, the one before, themselves or nothing, by their number."""
    turns = table(spark, d, "conversations")
    eid = F.substring(F.sha2(F.concat_ws("|", "conv_id", "turn", "role", "text"), 256), 1, 12)
    w = K.turn_window()
    by = F.col("turn") % 4
    known = turns.withColumn("eid", eid).withColumns({"before": F.lag("eid").over(w), "after": F.lead("eid").over(w)}).where("role = 'assistant'")
    cited = F.array_compact(F.when(by == 0, F.array("after")).when(by == 1, F.array("before")).when(by == 2, F.array("before", "eid")).otherwise(F.array().cast("array<string>")))
    citations = known.where(((by != 0) | F.col("after").isNotNull()) & ((by != 1) | F.col("before").isNotNull())).select("conv_id", "turn", cited.alias("cited"), F.lit(True).alias("supported"))
    return K.citation_problems(turns, citations)


@R.query("select conv_id, turn, case when conv_id % 5 = 0 then 'unknown_evidence' when conv_id % 7 = 0 then 'no_evidence' else '' end as gap from conversations where role = 'assistant' and turn > 0")
def citation_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Every answer cites the turn before it, if any; every fifth conversation's something else too, every seventh's nothing."""
    turns = K.evidence_before(table(spark, d, "conversations")).where("turn > 0")
    one = F.slice("evidence_ids", 1, 1)
    cited = F.when(F.col("conv_id") % 5 == 0, F.concat(one, F.array(F.lit("zzz")))).when(F.col("conv_id") % 7 == 0, F.array().cast("array<string>")).otherwise(one)
    return turns.select("conv_id", "turn", K.cited_gaps(cited, F.col("evidence_ids"), F.lit(True)).alias("gap"))


@R.query(
    r"""
select conv_id, case when count(*) filter (where role = 'assistant') = 0 then 'no_answer' when count(*) filter (where role = 'system') > 0 then 'system'
  when arg_max(role, turn) <> 'assistant' then 'open' when count(*) filter (where coalesce(text, '') = '') > 0 then 'empty' when count(*) > 6 then 'long' else '' end as why_not
from conversations group by conv_id"""
)
def conv_eligibility(spark: SparkSession, d: str) -> DataFrame:
    why = (
        F.when(F.count_if(F.col("role") == "assistant") == 0, "no_answer").when(F.count_if(F.col("role") == "system") > 0, "system").when(F.max_by("role", "turn") != "assistant", "open")
        .when(F.count_if(F.coalesce("text", F.lit("")) == "") > 0, "empty").when(F.count("*") > 6, "long").otherwise("")
    )
    return table(spark, d, "conversations").groupBy("conv_id").agg(why.alias("why_not"))


@R.query(r"select conv_id, turn, string_split_regex(rtrim(text), '[.!?]\s+')[-1] as last, regexp_matches(string_split_regex(rtrim(text), '[.!?]\s+')[-1], '(?i)\b(?:i will|i''ll|let me|going to)\b') as promise from conversations where role = 'assistant'")
def conv_promises(spark: SparkSession, d: str) -> DataFrame:
    last = last_sentence(F.col("text"))
    return table(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", last.alias("last"), last.rlike(K.PROMISE).alias("promise"))


@R.query("select conv_id, turn, copy from conversations, (select unnest(range(1, 3)) as copy) where role = 'assistant' and turn > 1 union all select conv_id, turn, 1 from conversations where role = 'assistant' and turn <= 1")
def conv_upsampled(spark: SparkSession, d: str) -> DataFrame:
    copies = F.sequence(F.lit(1), F.when(F.col("turn") > 1, 2).otherwise(1))
    return table(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.explode(copies).alias("copy")).withColumn("copy", F.col("copy").cast("long"))
