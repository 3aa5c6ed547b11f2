"""Judging and review, over verdicts that follow from digests of the sample tables' ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import review as L
from textloom.plans.registry import Registry
from textloom.session import table

R = Registry()
QUERIES, SQL = R.queries, R.sql


def digit(*parts: Column | str) -> Column:
    """0 to 15, from the first hex digit of an md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 1), 16, 10).cast("long")


def sql_digit(*parts: str) -> str:
    return f"cast('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 1) as bigint)"


def verdict(n: Column) -> Column:
    return F.when(n < 6, "A").when(n < 11, "B").when(n < 14, "T")


def sql_verdict(n: str) -> str:
    return f"case when {n} < 6 then 'A' when {n} < 11 then 'B' when {n} < 14 then 'T' end"


JUDGED = f"""
v as (select doc_id, source, j as judge, {sql_verdict(sql_digit("'ab'", 'doc_id', 'j'))} as ab, {sql_verdict(sql_digit("'ba'", 'doc_id', 'j'))} as ba
      from documents, (select unnest(range(0, 3)) as j))
"""


def judged(spark: SparkSession, d: str) -> DataFrame:
    """Three judges' verdicts in both orders on every document."""
    each = table(spark, d, "documents").select("doc_id", "source", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("judge")).withColumn("judge", F.col("judge").cast("long"))
    return each.withColumn("ab", verdict(digit(F.lit("ab"), "doc_id", "judge"))).withColumn("ba", verdict(digit(F.lit("ba"), "doc_id", "judge")))


@R.query(
    r"""
select doc_id, doc_id % 3 <> 0 or trim(regexp_replace(string_split(text, chr(10))[-1], '\s+', ' ', 'g')) = '' as covered from documents where text is not null"""
)
def segment_cover(spark: SparkSession, d: str) -> DataFrame:
    """Lines as segments; every third document lacks its last line."""
    lines = F.split("text", "\n")
    own = F.when(F.col("doc_id") % 3 == 0, F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
    return table(spark, d, "documents").where("text is not null").select("doc_id", L.segments_cover(F.col("text"), own).alias("covered"))


@R.query(
    """
with u as (select doc_id from documents where doc_id % 7 <> 0), j as (select doc_id from labels union all select doc_id from labels where doc_id % 5 = 0),
n as (select doc_id, count(*) as n from j group by doc_id)
select doc_id, problem from (select coalesce(u.doc_id, n.doc_id) as doc_id, case when u.doc_id is null then 'unknown' when n is null then 'missing' when n > 1 then 'repeated' end as problem
  from u full join n on u.doc_id = n.doc_id) where problem is not null"""
)
def unit_cover(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels").select("doc_id")
    return L.unit_problems(table(spark, d, "documents").where("doc_id % 7 <> 0"), labels.union(labels.where("doc_id % 5 = 0")), "doc_id")


@R.query(
    f"""
with s as (select doc_id, case when {sql_digit("'s'", 'doc_id', 'j')} < 9 then 'supported' when {sql_digit("'s'", 'doc_id', 'j')} < 13 then 'unsupported' else 'uncertain' end as verdict
  from documents, (select unnest(range(0, 3)) as j))
select doc_id, case when bool_or(verdict = 'unsupported') then 'unsupported' when bool_or(verdict = 'uncertain') then 'uncertain' else 'supported' end as strict_first,
  case when bool_or(verdict = 'uncertain') then 'uncertain' when bool_or(verdict = 'unsupported') then 'unsupported' else 'supported' end as doubt_first from s group by doc_id"""
)
def status_precedence(spark: SparkSession, d: str) -> DataFrame:
    n = digit(F.lit("s"), "doc_id", "judge")
    s = judged(spark, d).select("doc_id", F.when(n < 9, "supported").when(n < 13, "unsupported").otherwise("uncertain").alias("verdict"))
    strict = L.reduced_status(s, ["doc_id"], "verdict", ["unsupported", "uncertain", "supported"]).withColumnRenamed("status", "strict_first")
    return strict.join(L.reduced_status(s, ["doc_id"], "verdict", ["uncertain", "unsupported", "supported"]).withColumnRenamed("status", "doubt_first"), "doc_id")


@R.query(
    """
select doc_id, case when (case when doc_id % 4 = 0 then md5(text || '!') when doc_id % 9 = 0 then null else md5(text) end) is not distinct from md5(text) and lang is not distinct from lang then 'current' else 'pending' end as state from documents"""
)
def review_bindings(spark: SparkSession, d: str) -> DataFrame:
    """Every fourth review was made from another text, every ninth recorded none."""
    recorded = F.when(F.col("doc_id") % 4 == 0, F.md5(F.concat("text", F.lit("!")))).when(F.col("doc_id") % 9 == 0, None).otherwise(F.md5("text"))
    return table(spark, d, "documents").select("doc_id", L.binding_state([(recorded, F.md5("text")), (F.col("lang"), F.col("lang"))]).alias("state"))


@R.query(
    f"""
with r as (select doc_id, {sql_digit("'m'", 'doc_id', 'a')} < 5 as malformed, {sql_digit("'g'", 'doc_id', 'a')} < 6 as gap from labels, (select unnest(range(0, 2)) as a)),
k as (select doc_id, bool_and(gap) as gaps from r where not malformed group by doc_id)
select doc_id, case when k.gaps is null then 'do' else 'archive_and_redo' end as action from documents left join k using (doc_id) where k.gaps is null or k.gaps"""
)
def review_redo(spark: SparkSession, d: str) -> DataFrame:
    attempts = table(spark, d, "labels").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("a"))
    reports = attempts.select("doc_id", (digit(F.lit("m"), "doc_id", "a") < 5).alias("malformed"), (digit(F.lit("g"), "doc_id", "a") < 6).alias("gap"))
    return L.redo_plan(table(spark, d, "documents"), reports, "doc_id")


@R.query(
    f"""
with {JUDGED}, t as (select doc_id, judge, a as attempt, {sql_verdict(sql_digit("'retry'", 'doc_id', 'judge', 'a'))} as verdict from v, (select unnest(range(1, 4)) as a)),
g as (select doc_id, judge, arg_min(verdict, attempt) as again from t where verdict is not null group by all)
select doc_id, judge, coalesce(ab, again) as verdict from v left join g using (doc_id, judge)"""
)
def repaired_verdicts(spark: SparkSession, d: str) -> DataFrame:
    own = judged(spark, d).select("doc_id", "judge", F.col("ab").alias("verdict"))
    retries = own.select("doc_id", "judge", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("attempt")).withColumn("verdict", verdict(digit(F.lit("retry"), "doc_id", "judge", "attempt")))
    return L.repaired(own, retries, ["doc_id", "judge"], "verdict", ["A", "B", "T"])


@R.query(f"with {JUDGED} select doc_id, judge, case when ab = 'B' and ba = 'A' then 'B' else 'A' end as pick from v")
def self_select(spark: SparkSession, d: str) -> DataFrame:
    return judged(spark, d).select("doc_id", "judge", L.self_selected(F.col("ab"), F.col("ba")).alias("pick"))


CANDIDATES = f"c as (select source as question, doc_id, {sql_digit("'score'", 'doc_id')} / 15.0 as score from documents)"


def candidates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("source").alias("question"), "doc_id", (digit(F.lit("score"), "doc_id") / 15.0).alias("score"))


@R.query(
    f"""
with {CANDIDATES} select question, arg_max(doc_id, (score, -doc_id)) as chosen, arg_min(doc_id, (score, doc_id)) as rejected from c group by question having max(score) > min(score) and max(score) >= 0.8"""
)
def preference_pairs(spark: SparkSession, d: str) -> DataFrame:
    return L.preference_pairs(candidates(spark, d), "question", "doc_id", "score", 0.8)


@R.query(f"with {CANDIDATES} select question, arg_max(doc_id, (score, -doc_id)) as doc_id, max(score) as score from c group by question having max(score) >= 0.9")
def best_candidates(spark: SparkSession, d: str) -> DataFrame:
    best = F.max_by("doc_id", F.struct("score", -F.col("doc_id"))).alias("doc_id")
    return candidates(spark, d).groupBy("question").agg(best, F.max("score").alias("score")).where("score >= 0.9")


@R.query(f"with {CANDIDATES} select question, min(doc_id) as doc_id from c where score >= 0.6 group by question")
def first_passing_sample(spark: SparkSession, d: str) -> DataFrame:
    return L.first_passing(candidates(spark, d), "question", "doc_id", F.col("score") >= 0.6)


@R.query(f"with {CANDIDATES} select question, doc_id, row_number() over (partition by question order by md5(concat_ws('|', 'p', question, doc_id)), doc_id) - 1 as place from c")
def candidate_order(spark: SparkSession, d: str) -> DataFrame:
    return L.permuted(candidates(spark, d), "question", "doc_id", "p").select("question", "doc_id", "place")


@R.query(
    f"""
with a as (select doc_id, source, {sql_digit("'rule'", 'doc_id')} / 10.0 as share, {sql_digit("'ran'", 'doc_id')} < 11 as ran from documents),
r as (select source, case when share >= 1 and ran then 'correct' when share >= 0.5 then 'partly' else 'wrong' end as rating from a)
select source, count(*) as n, round(avg((rating = 'correct')::int), 9) as strict, round(avg(case rating when 'correct' then 1.0 when 'partly' then 0.5 else 0.0 end), 9) as lenient from r group by source"""
)
def rating_ladder(spark: SparkSession, d: str) -> DataFrame:
    grade = L.rating(digit(F.lit("rule"), "doc_id") / 10.0, digit(F.lit("ran"), "doc_id") < 11)
    rated = table(spark, d, "documents").select("source", grade.alias("rating"))
    lenient = F.when(F.col("rating") == "correct", 1.0).when(F.col("rating") == "partly", 0.5).otherwise(0.0)
    return rated.groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg((F.col("rating") == "correct").cast("int")), 9).alias("strict"), F.round(F.avg(lenient), 9).alias("lenient"))


@R.query(
    f"""
with {JUDGED} select judge, count(*) as expected, count(*) filter (where ab is null or ba is null) as invalid, count(*) filter (where ab is not null and ba is not null) as complete,
  case when count(*) filter (where ab is null or ba is null) > 0 then 'incomplete' else 'complete' end as status from v group by judge"""
)
def comparison_status(spark: SparkSession, d: str) -> DataFrame:
    bad = F.col("ab").isNull() | F.col("ba").isNull()
    return judged(spark, d).groupBy("judge").agg(F.count("*").alias("expected"), F.count_if(bad).alias("invalid"), F.count_if(~bad).alias("complete"), F.when(F.count_if(bad) > 0, "incomplete").otherwise("complete").alias("status"))


@R.query(
    f"""
with {JUDGED}, w as (select source, judge, case ab when 'A' then 1.0 when 'T' then 0.5 when 'B' then 0.0 end as x from v where ab is not null)
select source, round(max(x) filter (where judge = 0), 9) as best, round(avg(x) filter (where judge = 0), 9) as first_arm, round(avg(x) filter (where judge = 1), 9) as second_arm,
  round(avg(x) filter (where judge = 0) - avg(x) filter (where judge = 1), 9) as difference from w group by source"""
)
def arm_by_topic(spark: SparkSession, d: str) -> DataFrame:
    x = F.when(F.col("ab") == "A", 1.0).when(F.col("ab") == "T", 0.5).when(F.col("ab") == "B", 0.0)
    arm = lambda j, f=F.avg: f(F.when(F.col("judge") == j, F.col("x")))
    rows = judged(spark, d).where("ab is not null").withColumn("x", x)
    return rows.groupBy("source").agg(F.round(arm(0, F.max), 9).alias("best"), F.round(arm(0), 9).alias("first_arm"), F.round(arm(1), 9).alias("second_arm"), F.round(arm(0) - arm(1), 9).alias("difference"))
