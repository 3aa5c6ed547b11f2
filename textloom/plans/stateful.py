"""State carried over a conversation: replayed calls and canonical JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.canonical import json_digest
from textloom.operators import replay as P
from textloom.plans.registry import Registry
from textloom.session import arrow_limits, fresh_path, table
from textloom.sources.seen import SeenSet
from textloom.streaming.sessions import rocksdb, session_memory

R = Registry()
QUERIES, SQL = R.queries, R.sql


@R.query(
    """
select doc_id, sha256('{"id":' || doc_id || ',"lang":' || coalesce(to_json(lang)::varchar, 'null') || ',"meta":{"a":[' || n_chars || ',1.5,true],"z":{"source":' || coalesce(to_json(source)::varchar, 'null') || '},"ä":"é/"},"text":' || coalesce(to_json(text)::varchar, 'null') || '}') as digest from documents"""
)
def json_digests(spark: SparkSession, d: str) -> DataFrame:
    """Digests of documents as JSON whose keys stand in another order, with blanks, escapes and nested objects."""
    arrow_limits(spark)
    value = lambda c: F.coalesce(F.substring(F.to_json(F.struct(F.col(c).alias("x"))), F.lit(6), F.length(F.to_json(F.struct(F.col(c).alias("x")))) - 6), F.lit("null"))
    quoted = {c: F.when(F.col(c).isNull(), "null").otherwise(value(c)) for c in ("text", "source", "lang")}
    text = F.concat(
        F.lit('{ "text" : '), quoted["text"], F.lit(', "meta": {"\\u00e4":"\\u00e9\\/", "z": {"source":'), quoted["source"], F.lit('}, "a": ['), F.col("n_chars").cast("string"), F.lit(', 1.50, true ]},\n"id":'), F.col("doc_id").cast("string"), F.lit(', "lang":'), quoted["lang"], F.lit("}")
    )
    return table(spark, d, "documents").select("doc_id", json_digest(text).alias("digest"))


TOOLS = {"signup": "submit_job", "error": "cancel_job", "view": "job_status", "click": "hold_job", "purchase": "requeue_job"}
REPLAY = """
with recursive base as (select k, 4000000 + list_reduce(list_prepend(0::bigint, list_transform(range(1, 65), lambda i: instr('0123456789abcdef', substr(sha256('#!/bin/bash' || chr(10) || 'run ' || k), i, 1))::bigint - 1)), lambda a, b: (a * 16 + b) % 1000000) as job from range(3) t(k)),
e as (select event_id, user_id, event_type, row_number() over (partition by user_id order by ts, event_id) as i, b.job, cast(json_extract_string(props, '$.k') as bigint) as k
  from events join base b on b.k = cast(json_extract_string(props, '$.k') as bigint) % 3),
f as (select user_id, 0::bigint as i, map([]::bigint[], []::varchar[]) as jobs, null::bigint as event_id, null::varchar as result from (select distinct user_id from e)
  union all
  select s.user_id, s.i, case
      when event_type = 'signup' then map_concat(jobs, map([fresh], ['PENDING']))
      when event_type = 'error' and was in ('PENDING', 'HELD') then map_concat(jobs, map([job], ['CANCELLED']))
      when event_type = 'click' and was = 'PENDING' then map_concat(jobs, map([job], ['HELD']))
      when event_type = 'purchase' and was = 'CANCELLED' then map_concat(jobs, map([job], ['PENDING'])) else jobs end,
    s.event_id, case
      when event_type = 'signup' then '{"job_id":"' || fresh || '","submitted":true}'
      when event_type = 'view' and was is null then '{"found":false,"job_id":"' || job || '"}'
      when event_type = 'view' then '{"job_id":"' || job || '","state":"' || was || '"}'
      else '{"done":' || case when event_type = 'error' then coalesce(was in ('PENDING', 'HELD'), false) when event_type = 'click' then coalesce(was = 'PENDING', false) else coalesce(was = 'CANCELLED', false) end || ',"job_id":"' || job || '"}' end
  from (select f.user_id, f.jobs, e.*exclude (user_id), f.jobs[e.job] as was, list_filter(range(e.job, e.job + cardinality(f.jobs)::bigint + 1), lambda x: not list_contains(map_keys(f.jobs), x))[1] as fresh from f join e on e.user_id = f.user_id and e.i = f.i + 1) s)
select f.event_id, result, case when event_type = 'view' then result = case when k % 2 = 0 then '{"job_id":"' || job || '","state":"PENDING"}' else '{"found":false,"job_id":"' || job || '"}' end end as matches
from f join e using (event_id)
"""


@R.query(REPLAY)
def job_replay(spark: SparkSession, d: str) -> DataFrame:
    """Each user's events as calls on jobs: submitted (again under the next free number), held, cancelled, requeued, asked for.

    What is stored with an answer about a job has its keys in another order.
    """
    k = F.get_json_object("props", "$.k").cast("long")
    script = F.concat(F.lit("#!/bin/bash\nrun "), (k % 3).cast("string"))
    digits = F.split(F.sha2(script, 256), "")
    job = (F.lit(P.FIRST_JOB) + F.aggregate(digits, F.lit(0).cast("long"), lambda a, c: (a * 16 + F.conv(c, 16, 10).cast("long")) % P.JOBS)).cast("string")
    tool = F.create_map(*[F.lit(x) for kv in TOOLS.items() for x in kv])[F.col("event_type")]
    given = F.when(F.col("event_type") == "signup", F.to_json(F.struct(script.alias("script")))).otherwise(F.to_json(F.struct(job.alias("job_id"))))
    claim = F.when(k % 2 == 0, F.concat(F.lit('{"state": "PENDING", "job_id": "'), job, F.lit('"}'))).otherwise(F.concat(F.lit('{ "job_id":"'), job, F.lit('", "found" :false}')))
    calls = table(spark, d, "events").select("event_id", "user_id", "ts", tool.alias("tool"), given.alias("arguments"), F.when(F.col("event_type") == "view", claim).alias("stored"))
    return P.replay_calls(calls, ["user_id"], ["ts", "event_id"], ["event_id"]).select("event_id", "result", "matches")


LIMIT = 1500
MEMORY = f"""
with recursive t as (select conv_id, turn, role, coalesce(length(text), 0)::bigint as chars, row_number() over (partition by conv_id order by turn) as i from conversations where role <> 'system'),
a as (select conv_id, list((i, turn, role, chars) order by i) as m from t group by all),
f as (select conv_id, 0::bigint as i, 1::bigint as start from a
  union all
  select conv_id, i + 1, coalesce(list_filter(range(start, i + 2), lambda p: (p = start or m[p][3] = 'user') and list_sum(list_transform(m[p:i + 1], lambda x: x[4])) <= {LIMIT})[1], i + 2)
  from f join a using (conv_id) where i < len(m))
select conv_id, m[i][2] as turn, case when start <= i then m[start][2] end as first_kept, greatest(0, i - start + 1)::bigint as n_kept, coalesce(list_sum(list_transform(m[start:i], lambda x: x[4])), 0)::bigint as chars_kept from f join a using (conv_id) where i > 0
"""


@R.query(MEMORY)
def session_states(spark: SparkSession, d: str) -> DataFrame:
    """What each conversation remembers after each message, streamed in three runs over one checkpoint.

    Each run is a restart: it finds the earlier turns in state only.
    """
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    at = fresh_path(spark, "sessions")
    for where in ("turn < 2", "turn between 2 and 4", "turn > 4"):
        turns.where(where).write.mode("append").parquet(f"{at}/in")
        stream = session_memory(spark.readStream.schema(turns.schema).parquet(f"{at}/in"), LIMIT)
        with rocksdb(spark):
            run = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
            run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


@R.query(
    """
with r as (select doc_id, sha256(coalesce(text, '')) as sha, case when doc_id % 10 = 0 then 0 else 1 + doc_id % 3 end as run from documents),
o as (select *, min((run, doc_id)) over (partition by sha) as f, min(case when run = 0 then 'old:' || doc_id end) over (partition by sha) as old from r)
select doc_id, run, case when old is not null then old when (run, doc_id) <> f then f[2]::varchar end as seen from o where run > 0"""
)
def seen_over_runs(spark: SparkSession, d: str) -> DataFrame:
    """Three runs that admit each text once, after an old archive: which documents are new, and where the others were seen."""
    docs = table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    seen, out = SeenSet(spark, fresh_path(spark, "seen"), 1), None
    seen.absorb(docs.where("doc_id % 10 = 0"), ["sha"], F.col("doc_id"), 0)
    for run in (1, 2, 3):
        own = docs.where(F.col("doc_id") % 10 != 0).where(F.col("doc_id") % 3 == run - 1)
        got = seen.admit(own, F.col("sha"), ["doc_id"], F.col("doc_id"), run).select("doc_id", F.lit(run).alias("run"), "seen")
        out = got if out is None else out.unionByName(got)
    return out
