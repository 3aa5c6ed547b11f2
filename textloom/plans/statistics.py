"""Judge statistics over a verdict table that is derived from labels by hash: 3 judges, both orders, some invalid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import stats as H
from textloom.plans.registry import Registry
from textloom.session import table

R = Registry()
QUERIES, SQL = R.queries, R.sql

VERDICTS = """
base as (select doc_id as id, quality, toxic, judge, ord from labels, (select unnest(['j1', 'j2', 'j3']) as judge), (select unnest([1, 2]) as ord)),
v as (select *, case cast('0x' || substr(md5(id::varchar || judge || ord::varchar), 1, 2) as bigint) % 11 when 0 then null when 1 then 'T' when 2 then 'T' when 3 then 'B' when 4 then 'B' when 5 then 'B' else 'A' end as verdict from base)
"""


def verdicts(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, "labels").withColumnRenamed("doc_id", "id").withColumn("judge", F.explode(F.array(*map(F.lit, ("j1", "j2", "j3"))))).withColumn("ord", F.explode(F.array(F.lit(1), F.lit(2))))
    x = F.conv(F.substring(F.md5(F.concat(F.col("id").cast("string"), "judge", F.col("ord").cast("string"))), 1, 2), 16, 10).cast("int") % 11
    return base.withColumn("x", x).withColumn("verdict", F.when(F.col("x") == 0, None).when(F.col("x") <= 2, "T").when(F.col("x") <= 5, "B").otherwise("A")).drop("x")


@R.query(
    f"""
with {VERDICTS}
select judge, quality, count(*) as n, case when count(*) filter (where verdict is null) = 0 then avg(case verdict when 'T' then 0.5 when 'A' then (ord = 1)::int when 'B' then (ord = 2)::int end) end as rate from v group by all"""
)
def judge_win_rate(spark: SparkSession, d: str) -> DataFrame:
    rate, n = H.win_rate(F.col("verdict"), F.col("ord") == 2)
    return verdicts(spark, d).groupBy("judge", "quality").agg(n.alias("n"), rate.alias("rate"))


@R.query(
    f"""
with {VERDICTS}, c as (select id, ord, verdict, count(*) as n from v where verdict is not null group by all),
t as (select id, ord, max(n) as top from c group by all),
w as (select c.id, c.ord, count(*) as leaders, min(verdict) as v from c join t on c.id = t.id and c.ord = t.ord and c.n = t.top group by all)
select b.id, b.ord, case when w.id is null then null when leaders > 1 then 'T' else w.v end as majority from (select distinct id, ord from v) b left join w using (id, ord)"""
)
def judge_majority(spark: SparkSession, d: str) -> DataFrame:
    return H.majority(verdicts(spark, d), ["id", "ord"])


@R.query(
    f"""
with {VERDICTS}, p as (select judge, id, quality, max(verdict) filter (where ord = 1) as a, max(verdict) filter (where ord = 2) as b from v group by all)
select judge, quality, count(*) as n, avg((coalesce(a, '') = case quality when 1 then 'A' else 'B' end)::int) as accuracy,
  avg((a is not null and b is not null and ((a = 'T' and b = 'T') or (a = 'A' and b = 'B') or (a = 'B' and b = 'A')))::int) as consistency from p group by all"""
)
def judge_calibration(spark: SparkSession, d: str) -> DataFrame:
    p = verdicts(spark, d).groupBy("judge", "id", "quality").agg(F.max(F.when(F.col("ord") == 1, F.col("verdict"))).alias("a"), F.max(F.when(F.col("ord") == 2, F.col("verdict"))).alias("b"))
    right = F.coalesce("a", F.lit("")) == F.when(F.col("quality") == 1, "A").otherwise("B")
    same = F.coalesce(F.concat("a", "b").isin("TT", "AB", "BA"), F.lit(False))
    return p.groupBy("judge", "quality").agg(F.count("*").alias("n"), F.avg(right.cast("int")).alias("accuracy"), F.avg(same.cast("int")).alias("consistency"))


@R.query(
    f"""
with {VERDICTS}
select a.judge as judge_a, b.judge as judge_b, count(*) as n, avg((a.verdict = b.verdict)::int) as agreement from v a join v b on a.id = b.id and a.ord = b.ord and a.judge < b.judge where a.verdict is not null and b.verdict is not null group by all"""
)
def judge_agreement(spark: SparkSession, d: str) -> DataFrame:
    v = verdicts(spark, d).where("verdict is not null").select("id", "ord", "judge", "verdict")
    b = v.select("id", "ord", F.col("judge").alias("judge_b"), F.col("verdict").alias("w"))
    return v.withColumnRenamed("judge", "judge_a").join(b, ["id", "ord"]).where("judge_a < judge_b").groupBy("judge_a", "judge_b").agg(F.count("*").alias("n"), F.avg((F.col("verdict") == F.col("w")).cast("int")).alias("agreement"))


@R.query(
    f"""
with {VERDICTS}, c as (select judge, count(*) filter (where verdict = 'A') as hits, count(*) as n from v group by judge)
select judge, hits, n, round(greatest(0, (hits / n::double + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) - 1.96 * sqrt(hits / n::double * (1 - hits / n::double) / n + 1.96 * 1.96 / (4.0 * n * n)) / (1 + 1.96 * 1.96 / n)), 9) as low,
  round(least(1, (hits / n::double + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) + 1.96 * sqrt(hits / n::double * (1 - hits / n::double) / n + 1.96 * 1.96 / (4.0 * n * n)) / (1 + 1.96 * 1.96 / n)), 9) as high from c"""
)
def wilson_ci(spark: SparkSession, d: str) -> DataFrame:
    c = verdicts(spark, d).groupBy("judge").agg(F.count_if(F.col("verdict") == "A").alias("hits"), F.count("*").alias("n"))
    low, high = H.wilson(F.col("hits"), F.col("n"))
    return c.select("judge", "hits", "n", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@R.query(
    """
with m as (select source, doc_id % 4 as seed, avg(n_chars) as x from documents group by all)
select source, round(avg(x), 6) as mean, round(coalesce(stddev_samp(x), case when count(x) = 1 then 0.0 end), 6) as std, round(min(x), 6) as least, round(max(x), 6) as most, count(x) as n,
  case when count(distinct seed) < 4 or count(*) filter (where x is null) > 0 then 'incomplete' else 'complete' end as status from m group by source"""
)
def seed_stats(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "documents").groupBy("source", (F.col("doc_id") % 4).alias("seed")).agg(F.avg("n_chars").alias("x"))
    s = H.seed_summary(m, ["source"], "seed", "x", 4)
    return s.select("source", *[F.round(c, 6).alias(c) for c in ("mean", "std", "least", "most")], "n", "status")


@R.query(
    """
select lang, n_chars as upper_median from (select lang, n_chars, row_number() over (partition by lang order by n_chars) - 1 as i, count(*) over (partition by lang) as n from documents where n_chars is not null) where i = n // 2"""
)
def upper_median(spark: SparkSession, d: str) -> DataFrame:
    return H.upper_median(table(spark, d, "documents"), ["lang"], "n_chars")


BOOT = """
q as (select item_id, row_number() over (order by item_id) - 1 as k, (item_id * 7 % 5 - 1.5)::double as x from benchmark),
d as (select r, i, cast('0x' || substr(md5('b:' || r::varchar || ':' || i::varchar), 1, 15) as bigint) % (select count(*) from q) as k from range(0, 1000) a(r), range(0, (select count(*) from q)) b(i)),
m as (select r, avg(x) as mean from d join q using (k) group by r),
o as (select *, row_number() over (order by mean, r) - 1 as i from m)
"""


@R.query(f"with {BOOT} select max(mean) filter (where i = 25) as low, max(mean) filter (where i = 974) as high, avg((mean <= 0)::int) as p_le_0 from o")
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "benchmark").select("item_id", (F.col("item_id") * 7 % 5 - 1.5).cast("double").alias("x"))
    return H.bootstrap_interval(H.bootstrap_means(q, "x", "item_id", 1000), 25, 974)


@R.query("select lang, source, n, rank from (select lang, source, count(*) as n, row_number() over (partition by lang order by count(*) desc, source) as rank from documents group by lang, source) where rank <= 3")
def top_sources(spark: SparkSession, d: str) -> DataFrame:
    return H.top_values(table(spark, d, "documents"), ["lang"], "source", 3).select("lang", "source", "n", F.col("rank").cast("long").alias("rank"))


@R.query(
    """
with s as (select doc_id, n_chars / 5000.0 as a, (doc_id * 31 % 100) / 100.0 as b from documents), t as (select unnest([0.25::double, 0.5::double, 0.75::double]) as t)
select t, avg(case when a >= t then a else b end) as gated, avg(greatest(a, b)) as oracle from s, t group by t"""
)
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "documents").select((F.col("n_chars") / 5000.0).alias("a"), (F.col("doc_id") * 31 % 100 / 100.0).alias("b"), F.explode(F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("t"))
    return s.groupBy("t").agg(F.avg(F.when(F.col("a") >= F.col("t"), F.col("a")).otherwise(F.col("b"))).alias("gated"), F.avg(F.greatest("a", "b")).alias("oracle"))


@R.query(
    """
select lang, count(*) filter (where n_chars < 1000) as short, count(*) filter (where n_chars >= 1000) as long, case when count(*) < 110 then 'THIN' else 'OK' end as status from documents group by lang"""
)
def coverage_table(spark: SparkSession, d: str) -> DataFrame:
    size = table(spark, d, "documents").select("lang", F.when(F.col("n_chars") < 1000, "short").otherwise("long").alias("size"))
    p = size.groupBy("lang").pivot("size", ["short", "long"]).count().fillna(0)
    return p.withColumn("status", F.when(F.col("short") + F.col("long") < 110, "THIN").otherwise("OK"))
