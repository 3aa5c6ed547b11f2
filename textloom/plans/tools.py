"""Tool traces and cluster lookups, over events: a user's events are a conversation's calls, or a queue's jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions import cluster as C
from textloom.operators import lookups as S
from textloom.operators import toolcalls as K
from textloom.plans.registry import Registry
from textloom.session import table

R = Registry()
QUERIES, SQL = R.queries, R.sql

CALLS = "c as (select event_id, user_id as conv, ts, event_type as tool, value, cast(json_extract_string(props, '$.k') as bigint) as k from events)"
NAMES = ["click", "view", "purchase", "signup", "error"]


def calls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.col("user_id").alias("conv"), "ts", F.col("event_type").alias("tool"), "value", F.get_json_object("props", "$.k").cast("long").alias("k"))


MATCHED = f"""
{CALLS}, m as (select *, k % 2 = 0 as expected, k % 5 <> 0 as called, k % 11 = 0 as malformed, 1 + (k % 13 = 0)::int as n_calls,
  ((tool = 'view' and k % 10 in (1, 2, 3, 4)) or (tool = 'click' and value < 30) or (tool = 'click' and k % 10 = 7 and value < 60)) as matched from c)
"""


def matched(spark: SparkSession, d: str) -> DataFrame:
    """Calls with arguments level and note, held against three alternatives; some other properties of the turn by k."""
    note = F.when(F.col("value") < 30, "Low").when(F.col("value") < 60, "Mid").otherwise("High")
    arguments = F.create_map(F.lit("level"), (F.col("k") % 10).cast("string"), F.lit("note"), note)
    some = lambda *v: F.array(*map(F.lit, v))
    allowed = lambda level, note: F.create_map(F.lit("level"), level, F.lit("note"), note, F.lit("extra"), some("", "x"))
    alternatives = F.array(
        F.struct(F.lit("view").alias("name"), allowed(some("1", "2", "3", "4"), some("*")).alias("allowed")),
        F.struct(F.lit("click").alias("name"), allowed(some("*"), some("LOW")).alias("allowed")),
        F.struct(F.lit("click").alias("name"), allowed(some("7"), some("low", "mid")).alias("allowed")),
    )
    k = F.col("k")
    return calls(spark, d).withColumn("matched", K.any_alternative(F.col("tool"), arguments, alternatives)).withColumn("expected", k % 2 == 0).withColumn("called", k % 5 != 0).withColumn("malformed", k % 11 == 0).withColumn("n_calls", 1 + (k % 13 == 0).cast("int"))


@R.query(f"with {MATCHED} select event_id, matched from m")
def call_match(spark: SparkSession, d: str) -> DataFrame:
    return matched(spark, d).select("event_id", "matched")


SCORED = f"{MATCHED}, s as (select *, case when (case when expected then called and matched and n_calls = 1 else not called end) and not malformed then 1.0 else 0.0 end as score from m)"


def scored(spark: SparkSession, d: str) -> DataFrame:
    return matched(spark, d).withColumn("score", K.item_score(F.col("expected"), F.col("called"), F.col("matched"), F.col("malformed"), F.col("n_calls")))


@R.query(f"with {SCORED} select event_id, score::double as score from s")
def tool_item_score(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).select("event_id", "score")


@R.query(
    f"""
with {SCORED} select tool, count(*) as n, round(avg(score), 9) as score, round(count(*) filter (where expected and called) / nullif(count(*) filter (where expected), 0)::double, 9) as call_recall,
  round(count(*) filter (where malformed) / count(*)::double, 9) as malformed_rate from s group by tool"""
)
def tool_summary(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("expected")
    return scored(spark, d).groupBy("tool").agg(
        F.count("*").alias("n"), F.round(F.avg("score"), 9).alias("score"), F.round(F.try_divide(F.count_if(e & F.col("called")), F.count_if(e)), 9).alias("call_recall"), F.round(F.count_if("malformed") / F.count("*"), 9).alias("malformed_rate")
    )


@R.query(f"with {MATCHED} select case when expected then case when called then 'call' else 'missed_call' end else case when called then 'needless_call' else 'no_call' end end as decision, count(*) as n from m group by 1")
def call_confusion(spark: SparkSession, d: str) -> DataFrame:
    return matched(spark, d).groupBy(K.decision(F.col("expected"), F.col("called")).alias("decision")).agg(F.count("*").alias("n"))


@R.query(
    f"""
with {CALLS}, u as (select distinct conv, tool from c where k < 50), e as (select distinct conv, tool from c where k >= 80),
b as (select coalesce(u.conv, e.conv) as conv, u.tool as used, e.tool as wanted from u full join e on u.conv = e.conv and u.tool = e.tool),
n as (select conv, count(used) as n_tools, count(*) filter (where used is not null and wanted is not null) / nullif(count(wanted), 0)::double as recall from b group by conv)
select conv, n_tools, round(recall, 9) as recall, n_tools >= 2 and coalesce(recall, 0) >= 0.5 as covered from n"""
)
def tool_coverage(spark: SparkSession, d: str) -> DataFrame:
    c = calls(spark, d)
    return K.coverage(c.where("k < 50"), c.where("k >= 80"), "conv", "tool").withColumn("recall", F.round("recall", 9))


@R.query(
    f"""
with {CALLS} select conv, count(*) filter (where k < 50) as n_calls, arg_min(tool, (ts, event_id)) as first_tool, bool_or(k = 42) as any_exact, max(value) as most, count(*) filter (where tool = 'error') as errors,
  arg_max(tool, (ts, event_id)) = 'error' as ended_early from c group by conv"""
)
def session_metrics(spark: SparkSession, d: str) -> DataFrame:
    at = F.struct("ts", "event_id")
    return calls(spark, d).groupBy("conv").agg(
        F.count_if(F.col("k") < 50).alias("n_calls"), F.min_by("tool", at).alias("first_tool"), F.bool_or(F.col("k") == 42).alias("any_exact"), F.max("value").alias("most"), F.count_if(F.col("tool") == "error").alias("errors"),
        (F.max_by("tool", at) == "error").alias("ended_early"),
    )


@R.query(
    f"""
with {CALLS}, f as (select conv, tool, arg_min(k, (ts, event_id)) as first_k, bool_or(k >= 50) as any_ok, avg((k % 3 = 0)::int) as args_ok from c group by conv, tool)
select coalesce(tool, 'ALL') as tool, count(*) as n, round(avg((first_k >= 50)::int), 9) as first_ok, round(avg(any_ok::int), 9) as any_ok, round(avg(args_ok), 9) as args_ok from f group by rollup (tool)"""
)
def tool_run_scores(spark: SparkSession, d: str) -> DataFrame:
    runs = calls(spark, d).groupBy("conv", "tool").agg(F.min_by("k", F.struct("ts", "event_id")).alias("first_k"), F.bool_or(F.col("k") >= 50).alias("any"), F.avg((F.col("k") % 3 == 0).cast("int")).alias("args"))
    rate = lambda c: F.round(F.avg(c), 9)
    return runs.rollup("tool").agg(F.count("*").alias("n"), rate((F.col("first_k") >= 50).cast("int")).alias("first_ok"), rate(F.col("any").cast("int")).alias("any_ok"), rate("args").alias("args_ok")).withColumn("tool", F.coalesce("tool", F.lit("ALL")))


@R.query(f"with {CALLS}, n as (select *, case when k < 50 then 'call' else 'result' end as kind from c) select event_id, kind, 'call_' || row_number() over (partition by conv, kind order by ts, event_id) as call_id from n")
def call_numbers(spark: SparkSession, d: str) -> DataFrame:
    kinds = calls(spark, d).withColumn("kind", F.when(F.col("k") < 50, "call").otherwise("result"))
    return K.numbered_calls(kinds, "conv", ["ts", "event_id"]).select("event_id", "kind", "call_id")


@R.query(
    f"""
with {CALLS}, n as (select *, case when k < 50 then 'call' else 'result' end as kind from c), r as (select *, row_number() over (partition by conv, kind order by ts, event_id) as n from n),
a as (select * from r where kind = 'call'), b as (select * from r where kind = 'result')
select coalesce(a.conv, b.conv) as conv_id, coalesce(a.n, b.n) as n, a.event_id as call, b.event_id as result from a full join b on a.conv = b.conv and a.n = b.n"""
)
def call_results(spark: SparkSession, d: str) -> DataFrame:
    from textloom.operators.traces import paired_calls

    events = calls(spark, d).select(F.col("conv").alias("conv_id"), F.col("ts").alias("turn"), F.col("event_id").alias("pos"), F.when(F.col("k") < 50, "call").otherwise("result").alias("kind"), F.col("event_id").alias("body"))
    return paired_calls(events).withColumn("n", F.col("n").cast("long"))


@R.query(f"with {CALLS} select event_id, bool_or(k > 95) over (partition by conv, date_trunc('hour', ts)) as blocked from c")
def batch_guard(spark: SparkSession, d: str) -> DataFrame:
    return K.whole_batches(calls(spark, d).withColumn("hour", F.date_trunc("hour", "ts")), ["conv", "hour"], F.col("k") > 95).select("event_id", "blocked")


@R.query(
    f"""
with {CALLS}, w as (select *, case tool when 'signup' then 'running' when 'error' then 'cancelled' end as sets from c),
s as (select *, coalesce(last_value(sets ignore nulls) over (partition by conv order by ts, event_id rows between unbounded preceding and 1 preceding), 'none') as state from w)
select event_id, state, state = case k % 3 when 0 then 'running' when 1 then 'cancelled' else 'none' end as agrees from s where tool = 'view'"""
)
def replay_states(spark: SparkSession, d: str) -> DataFrame:
    """A signup submits, an error cancels, a view asks; what was stored with the view must equal the replayed state."""
    sets = F.when(F.col("tool") == "signup", "running").when(F.col("tool") == "error", "cancelled")
    stored = F.when(F.col("k") % 3 == 0, "running").when(F.col("k") % 3 == 1, "cancelled").otherwise("none")
    return K.replayed(calls(spark, d), "conv", ["ts", "event_id"], sets, "none").where("tool = 'view'").select("event_id", "state", (F.col("state") == stored).alias("agrees"))


REPLIES = """t as (select event_id, tool, case k % 4 when 0 then 'Looking. <tool_call>{"name": "' || tool || '", "arguments": {"k": ' || k || '}}</tool_call>' when 1 then 'I use ' || tool || ' now <tool_call>{"name": "' || tool || '"}</tool_call>'
  when 2 then 'So: {"name": "' || tool || '", "arguments": {"k": ' || k || '}}' else '```\n' || tool || '\n```' end as text from c)""".replace("\\n", "' || chr(10) || '")


def replies(spark: SparkSession, d: str) -> DataFrame:
    """Texts with marked, leaking, unmarked and fenced calls, by k."""
    name, k = F.col("tool"), F.col("k").cast("string")
    text = (
        F.when(F.col("k") % 4 == 0, F.concat(F.lit('Looking. <tool_call>{"name": "'), name, F.lit('", "arguments": {"k": '), k, F.lit("}}</tool_call>")))
        .when(F.col("k") % 4 == 1, F.concat(F.lit("I use "), name, F.lit(' now <tool_call>{"name": "'), name, F.lit('"}</tool_call>')))
        .when(F.col("k") % 4 == 2, F.concat(F.lit('So: {"name": "'), name, F.lit('", "arguments": {"k": '), k, F.lit("}}")))
        .otherwise(F.concat(F.lit("```\n"), name, F.lit("\n```")))
    )
    return calls(spark, d).select("event_id", "tool", "k", text.alias("text"))


@R.query(
    rf"""
with {CALLS}, {REPLIES} select event_id, case when not regexp_matches(regexp_replace(text, '(?s)<tool_call>.*?</tool_call>', '', 'g'), '(?:^|[^A-Za-z0-9_])(?:click|view|purchase|signup|error)(?:[^A-Za-z0-9_]|$)')
  then regexp_replace(text, '("name"\s*:\s*")(click|view|purchase|signup|error)"', '\1hpc_\2"', 'g') end as renamed from t"""
)
def renamed_tools(spark: SparkSession, d: str) -> DataFrame:
    return replies(spark, d).select("event_id", K.renamed_calls(F.col("text"), NAMES, "hpc_").alias("renamed"))


@R.query(
    f"""
with {CALLS}, {REPLIES} select event_id, case when position('<tool_call>' in text) > 0 then null when left(text, 4) = 'So: ' then substr(text, 5) else '{{"name": "' || tool || '", "arguments": {{}}}}' end as body from t"""
)
def rescued_calls(spark: SparkSession, d: str) -> DataFrame:
    return replies(spark, d).select("event_id", K.rescued_call(F.col("text"), NAMES).alias("body"))


@R.query(f"with {CALLS}, {REPLIES} select event_id, regexp_matches(text, '</?tool_call>|(?:^|[^A-Za-z0-9_])(?:click|view|purchase|signup|error)\\s*\\(') as leaks from t")
def tool_leaks(spark: SparkSession, d: str) -> DataFrame:
    from textloom.operators.traces import leaks_tools

    return replies(spark, d).select("event_id", leaks_tools(F.col("text"), NAMES).alias("leaks"))


@R.query(
    r"""
with p as (select a.conv_id, a.turn, regexp_extract_all(a.text, '[A-Za-z]{8,}') as said, regexp_extract_all(b.text, '[A-Za-z]{8,}') as known from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn - 1 where a.role = 'assistant')
select conv_id, turn, cast(len(list_distinct(list_filter(said, lambda x: not list_contains(known, x)))) as bigint) as n_new from p"""
)
def name_grounding(spark: SparkSession, d: str) -> DataFrame:
    """Long names of each answer that the turn before doesn't have."""
    turns = table(spark, d, "conversations")
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("source"))
    both = turns.where("role = 'assistant'").join(before, ["conv_id", "turn"])
    return both.select("conv_id", "turn", F.size(K.grounded(F.col("text"), F.col("source"), "[A-Za-z]{8,}")).cast("long").alias("n_new"))


@R.query(
    r"""
with s as (select conv_id, turn, regexp_extract_all(text, '(?is)(.{0,20}(?:thion|was|reaux))', 1) as found from conversations where role = 'assistant'),
a as (select conv_id, min(turn) as first from conversations where role = 'user' and length(text) > 150 group by conv_id)
select conv_id, turn from s left join a using (conv_id) where len(list_filter(found, lambda c: not regexp_matches(c, '(?i)(?:^|[^a-z])(?:not|never|no|cannot|can''t|didn''t|without)[^a-z]'))) > 0 and (first is null or first >= turn)"""
)
def unbacked_claims(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations")
    return K.unbacked_claims(turns.where("role = 'assistant'"), turns.where("role = 'user' and length(text) > 150"), "thion|was|reaux")


# -- lookups ----------------------------------------------------------------------------

JOBS = f"""{CALLS}, j as (select event_id as job, conv as owner, case tool when 'click' then 'RUNNING' when 'view' then 'PENDING' when 'purchase' then 'COMPLETED' when 'signup' then 'FAILED' else 'CANCELLED' end as state,
  'part' || (conv % 5) as part, value, k, ts from c)"""


def jobs(spark: SparkSession, d: str) -> DataFrame:
    state = F.when(F.col("tool") == "click", "RUNNING").when(F.col("tool") == "view", "PENDING").when(F.col("tool") == "purchase", "COMPLETED").when(F.col("tool") == "signup", "FAILED").otherwise("CANCELLED")
    return calls(spark, d).select(F.col("event_id").alias("job"), F.col("conv").alias("owner"), state.alias("state"), F.concat(F.lit("part"), (F.col("conv") % 5).cast("string")).alias("part"), "value", "k", "ts")


@R.query(f"with {JOBS} select job, state, part from j where state in ('PENDING', 'RUNNING') and part = 'part1'")
def queue_listing(spark: SparkSession, d: str) -> DataFrame:
    return S.queue_listing(jobs(spark, d), state=None, part="part1").select("job", "state", "part")


@R.query(
    f"""
with {JOBS}, p as (select part, count(*) as n from j group by part), q as (select * from (values ('part1'), ('part9')) t(part)), known as (select string_agg(part, ', ' order by part) as names from p)
select q.part, n, case when n is null then 'unknown partition; known: ' || names end as error from q left join p using (part), known"""
)
def partition_lookup(spark: SparkSession, d: str) -> DataFrame:
    parts = jobs(spark, d).groupBy("part").agg(F.count("*").alias("n"))
    return S.keyed_lookup(spark.createDataFrame([("part1",), ("part9",)], "part string"), parts, "part", "partition")


@R.query(
    f"""
with {JOBS}, p as (select distinct part from j), q as (select * from (values ('part2'), ('ART3'), ('part'), ('zzz')) t(asked)),
m as (select asked, count(*) filter (where lower(part) like '%' || lower(asked) || '%') as n, min(part) filter (where lower(part) like '%' || lower(asked) || '%') as one, max(part) filter (where part = asked) as exact from q, p group by asked)
select asked, coalesce(exact, case when n = 1 then one end) as part, case when exact is not null or n = 1 then '' when n = 0 then 'unknown' else 'ambiguous' end as error from m"""
)
def fuzzy_lookup(spark: SparkSession, d: str) -> DataFrame:
    asked = spark.createDataFrame([("part2",), ("ART3",), ("part",), ("zzz",)], "asked string")
    return S.fuzzy_lookup(asked, jobs(spark, d).select("part").distinct(), "part")


@R.query(
    f"""
with {JOBS}, q as (select (job * 3) % 14000 as job from j where k < 5 group by 1), live as (select * from j where state in ('RUNNING', 'PENDING')), acc as (select * from j where state not in ('RUNNING', 'PENDING') and k % 2 = 0)
select q.job, coalesce(live.state, acc.state) as state, case when live.job is not null then 'queue' when acc.job is not null then 'accounting' else 'not found' end as origin
from q left join live on live.job = q.job left join acc on acc.job = q.job"""
)
def job_fallback(spark: SparkSession, d: str) -> DataFrame:
    j = jobs(spark, d)
    asked = j.where("k < 5").select(((F.col("job") * 3) % 14000).alias("job")).distinct()
    live = F.col("state").isin("RUNNING", "PENDING")
    return S.first_found(asked, [("queue", j.where(live)), ("accounting", j.where(~live & (F.col("k") % 2 == 0)))], "job", "state")


@R.query(
    f"""
with {JOBS}, r as (select owner % 5 as reservation, min(owner) as owner from j group by 1)
select reservation, coalesce(array_to_string(list_sort(list(job || ':' || state) filter (where job is not null)), ','), '') as jobs from r left join (select * from j where k >= 90) x using (owner) group by reservation"""
)
def reservation_jobs(spark: SparkSession, d: str) -> DataFrame:
    j = jobs(spark, d)
    reservations = j.groupBy((F.col("owner") % 5).alias("reservation")).agg(F.min("owner").alias("owner"))
    nested = S.nested(reservations, j.where("k >= 90"), "owner", "reservation", F.concat(F.col("job").cast("string"), F.lit(":"), "state"))
    return nested.select("reservation", F.array_join("items", ",").alias("jobs"))


@R.query(
    f"""
with {JOBS}, a as (select owner, 'acc' || (k % 4) as account, case when k % 10 = 0 then '' else part || k % 3 end as allowed, 'q' || (k % 3) || ',normal,q' || (k % 5) as qos from j),
q as (select owner, unnest(string_split(qos, ',')) as qos from a)
select owner, (select count(distinct account) from a x where x.owner = a.owner) as n_accounts, case when bool_or(allowed = '') then 'all' else array_to_string(list_sort(list_distinct(list(allowed))), ',') end as partitions,
  (select array_to_string(list_sort(list_distinct(list(qos))), ',') from q where q.owner = a.owner) as qos from a group by owner"""
)
def associations(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    rows = jobs(spark, d).select(
        "owner", F.concat(F.lit("acc"), (k % 4).cast("string")).alias("account"), F.when(k % 10 == 0, "").otherwise(F.concat("part", (k % 3).cast("string"))).alias("allowed"),
        F.concat(F.lit("q"), (k % 3).cast("string"), F.lit(",normal,q"), (k % 5).cast("string")).alias("qos"),
    )
    return S.associations(rows, "owner")


@R.query(
    f"""
with {JOBS}, s as (select job, owner, case when k % 7 = 0 then job || '.extern' else job || '.' || (k % 3) end as step, case when k % 2 = 0 then (k * 512) || 'K' else k || 'M' end as rss from j)
select step, case when right(rss, 1) = 'K' then cast(rtrim(rss, 'K') as double) / 1024.0 else cast(rtrim(rss, 'M') as double) end as mb from s where not contains(step, '.extern')"""
)
def step_usage(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    steps = jobs(spark, d).select(
        F.concat(F.col("job").cast("string"), F.when(k % 7 == 0, F.lit(".extern")).otherwise(F.concat(F.lit("."), (k % 3).cast("string")))).alias("step"),
        F.when(k % 2 == 0, F.concat((k * 512).cast("string"), F.lit("K"))).otherwise(F.concat(k.cast("string"), F.lit("M"))).alias("rss"),
    )
    return steps.where(~F.col("step").contains(".extern")).select("step", C.megabytes(F.col("rss")).alias("mb"))


@R.query(
    f"""
with {JOBS}, s as (select job, owner, value * 60 as elapsed, 1 + k % 8 as cpus, value * 60 * (1 + k % 8) * (k / 100.0) as used, k * 10.0 as rss, 1000.0 as asked from j where state in ('COMPLETED', 'FAILED'))
select owner, round(max(used / nullif(elapsed * cpus, 0)), 9) as cpu_efficiency, round(max(rss / asked), 9) as memory_efficiency, count(*) as n from s group by owner"""
)
def accounting_efficiency(spark: SparkSession, d: str) -> DataFrame:
    steps = jobs(spark, d).where("state in ('COMPLETED', 'FAILED')").select("owner", (F.col("value") * 60).alias("elapsed"), (1 + F.col("k") % 8).alias("cpus"), (F.col("k") * 10.0).alias("rss"), F.lit(1000.0).alias("asked"), "k")
    steps = steps.withColumn("used", F.col("elapsed") * F.col("cpus") * (F.col("k") / 100.0))
    return steps.groupBy("owner").agg(F.round(F.max(F.try_divide("used", F.col("elapsed") * F.col("cpus"))), 9).alias("cpu_efficiency"), F.round(F.max(F.col("rss") / F.col("asked")), 9).alias("memory_efficiency"), F.count("*").alias("n"))


@R.query(
    f"""
with {JOBS}, u as (select owner, part, count(*) filter (where state = 'RUNNING') as used from j group by all), t as (select part, sum(used) as team from u group by part)
select owner, part, used, greatest(0, least(150 - team, 4 - used)) as free from u join t using (part)"""
)
def quota_free(spark: SparkSession, d: str) -> DataFrame:
    used = jobs(spark, d).groupBy("owner", "part").agg(F.count_if(F.col("state") == "RUNNING").alias("used"))
    return S.quota_free(used, "part", "used", team=150, personal=4)


@R.query(f"with {JOBS} select job, state from j order by coalesce(case when state = 'RUNNING' then null else ts end, timestamp '9999-01-01') desc, job desc limit 10")
def newest_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Jobs without an end come first, then the latest ended; ten of them."""
    ended = F.when(F.col("state") != "RUNNING", F.col("ts"))
    return jobs(spark, d).orderBy(F.desc(F.coalesce(ended, F.to_timestamp(F.lit("9999-01-01")))), F.desc("job")).limit(10).select("job", "state")


@R.query(
    f"""
with {JOBS}, b as (select owner, part, state, value from j)
select part, state, count(*) as n, round(avg(value), 6) as mean, round(coalesce(stddev_samp(value), 0), 6) as std from b group by part, state"""
)
def bench_summary(spark: SparkSession, d: str) -> DataFrame:
    return jobs(spark, d).groupBy("part", "state").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("value"), F.lit(0.0)), 6).alias("std"))


@R.query(f"with {CALLS}, g as (select conv, 'arm_' || (conv % 3) || '_s' || (k % 4) as arm, value from c), s as (select regexp_extract(arm, '^(arm_\\d+)_s\\d+$', 1) as name, arm, avg(value) as m from g group by all) select name, count(*) as seeds, round(avg(m), 6) as mean, round(max(m) - min(m), 6) as spread from s group by name")
def seed_spread(spark: SparkSession, d: str) -> DataFrame:
    arm = F.concat(F.lit("arm_"), (F.col("conv") % 3).cast("string"), F.lit("_s"), (F.col("k") % 4).cast("string"))
    means = calls(spark, d).groupBy(arm.alias("arm")).agg(F.avg("value").alias("m"))
    return means.groupBy(F.regexp_extract("arm", r"^(arm_\d+)_s\d+$", 1).alias("name")).agg(F.count("*").alias("seeds"), F.round(F.avg("m"), 6).alias("mean"), F.round(F.max("m") - F.min("m"), 6).alias("spread"))


@R.query("select user_id, max(event_id) as step from events where event_type = 'signup' group by user_id")
def resume_step(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("event_type = 'signup'").groupBy("user_id").agg(F.max("event_id").alias("step"))


@R.query(
    """
with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents where text is not null),
f as (select *, row_number() over (partition by doc_id order by i) as n from l where contains(lower(line), 'the') and not contains(line, '###'))
select doc_id, count(*) filter (where n <= 3) as shown, count(*) as matching, coalesce(string_agg(line, chr(10) order by i) filter (where n <= 3), '') as head from f group by doc_id"""
)
def output_filters(spark: SparkSession, d: str) -> DataFrame:
    """grep -i the | grep -v ### | head -3, and wc -l of what was found."""
    return S.filtered_lines(table(spark, d, "documents"), "doc_id", "text", [("the", True, False), ("###", False, True)], 3)


@R.query(
    """
with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i, len(string_split(text, chr(10))) as n from documents where text is not null)
select doc_id, string_agg(line, chr(10) order by i) as tail from l where i > n - 2 group by doc_id"""
)
def log_tail(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", S.log_tail(F.col("text"), 2).alias("tail"))


@R.query(
    r"""
with c as (select event_id, case cast(json_extract_string(props, '$.k') as bigint) % 5 when 0 then 'squeue -u me' when 1 then 'scancel 12' when 2 then 'sinfo | head -3' when 3 then 'sacct; rm -rf x' else 'scontrol show job 7' end as command from events)
select event_id, regexp_matches(command, '^\s*(squeue|sinfo|sacct|scontrol show)( [A-Za-z0-9 =,._%+:-]*)?( \| (head|tail|grep|wc)( [A-Za-z0-9 .-]*)?)*\s*$') as allowed from c"""
)
def allowed_commands(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long") % 5
    command = F.when(k == 0, "squeue -u me").when(k == 1, "scancel 12").when(k == 2, "sinfo | head -3").when(k == 3, "sacct; rm -rf x").otherwise("scontrol show job 7")
    return table(spark, d, "events").select("event_id", S.read_only(command).alias("allowed"))


@R.query(
    f"""
with {JOBS}, r as (select job, 'JobId=' || job || ' JobState=' || state || ' Partition=' || part || ' Comment= JobState=' || state || 'X' as text from j)
select job, state || 'X' as state, part, '' as comment, part || '-' || job || '.out' as path from j"""
)
def record_fields(spark: SparkSession, d: str) -> DataFrame:
    """KEY=VALUE records (the last of a repeated key holds) and the job's output file by its name pattern."""
    j = jobs(spark, d)
    s = lambda c: F.col(c).cast("string")
    text = F.concat(F.lit("JobId="), s("job"), F.lit(" JobState="), "state", F.lit(" Partition="), "part", F.lit(" Comment= JobState="), "state", F.lit("X"))
    made = j.select("job", C.record(text).alias("r"), C.expand_pattern(F.lit("%x-%j.out"), F.col("job"), F.lit(None), F.lit(None), F.col("part"), F.lit("me")).alias("path"))
    return made.select("job", F.col("r")["JobState"].alias("state"), F.col("r")["Partition"].alias("part"), F.col("r")["Comment"].alias("comment"), "path")
