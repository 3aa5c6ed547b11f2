"""Formats that the sample tables don't hold as such: values in them are made from the tables' own, on both sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import cluster as C
from textloom.functions import text as T
from textloom.operators import distill, provenance, segment, traces
from textloom.plans.checks import joined
from textloom.plans.registry import Registry
from textloom.plans.tools import JOBS, jobs
from textloom.session import table

R = Registry()
QUERIES, SQL = R.queries, R.sql

K = "e as (select event_id as id, user_id, event_type, value, cast(json_extract_string(props, '$.k') as bigint) as k from events)"


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("id"), "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"))


def text_of(value: Column | int | str) -> Column:
    return (F.lit(value) if isinstance(value, int | str) else value).cast("string")


UNITS = f"""{K}, u as (select id, case k % 7 when 0 then k::varchar when 1 then k || ':30' when 2 then (k % 24) || ':' || lpad((k % 60)::varchar, 2, '0') || ':03' when 3 then (k % 9) || '-' || (k % 24) when 4 then (k % 9) || '-' || (k % 24) || ':' || (k % 60)
  when 5 then (k % 9) || '-' || (k % 24) || ':' || (k % 60) || ':04' else 'UNLIMITED' end as duration, case k % 6 when 0 then (k * 512) || 'K' when 1 then k || 'M' when 2 then k || '.5G' when 3 then k || 'T' when 4 then k::varchar else 'x' || k end as size from e)"""
DAY = r"'^(\d+)-(\d+)(?::(\d+))?(?::(\d+))?$'"
HMS, MS = r"'^(\d+):(\d+):(\d+(?:\.\d+)?)$'", r"'^(\d+):(\d+(?:\.\d+)?)$'"


def _part(p: str, i: int) -> str:
    return f"coalesce(try_cast(nullif(regexp_extract(duration, {p}, {i}), '') as double), 0)"


@R.query(
    rf"""
with {UNITS}, m as (select id, case when regexp_matches(duration, {DAY}) then {_part(DAY, 1)} * 86400 + {_part(DAY, 2)} * 3600 + {_part(DAY, 3)} * 60 + {_part(DAY, 4)}
  when regexp_matches(duration, {HMS}) then {_part(HMS, 1)} * 3600 + {_part(HMS, 2)} * 60 + {_part(HMS, 3)} when regexp_matches(duration, {MS}) then {_part(MS, 1)} * 60 + {_part(MS, 2)}
  when regexp_matches(duration, '^\d+$') then cast(duration as double) * 60 end as seconds,
  try_cast(nullif(regexp_extract(size, '^([0-9]+(?:\.[0-9]+)?)([KMGTkmgt]?)[Bb]?$', 1), '') as double) * case upper(regexp_extract(size, '^([0-9]+(?:\.[0-9]+)?)([KMGTkmgt]?)[Bb]?$', 2)) when 'K' then 1 / 1024.0 when 'G' then 1024 when 'T' then 1048576 else 1 end as mb from u)
select id, seconds, mb, case when floor(mb / 1024) >= 1024 then cast(floor(floor(mb / 1024) / 1024) as bigint)::varchar || ' TB' else cast(floor(mb / 1024) as bigint)::varchar || ' GB' end as pretty from m"""
)
def time_and_size(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    t, by, days = text_of, k % 7, joined(text_of(k % 9), "-", text_of(k % 24))
    duration = (
        F.when(by == 0, t(k)).when(by == 1, joined(t(k), ":30")).when(by == 2, joined(t(k % 24), ":", F.lpad(t(k % 60), 2, "0"), ":03")).when(by == 3, days)
        .when(by == 4, joined(days, ":", t(k % 60))).when(by == 5, joined(days, ":", t(k % 60), ":04")).otherwise("UNLIMITED")
    )
    unit = k % 6
    size = F.when(unit == 0, joined(t(k * 512), "K")).when(unit == 1, joined(t(k), "M")).when(unit == 2, joined(t(k), ".5G")).when(unit == 3, joined(t(k), "T")).when(unit == 4, t(k)).otherwise(joined("x", t(k)))
    mb = C.megabytes(size)
    return events(spark, d).select("id", C.seconds(duration).alias("seconds"), mb.alias("mb"), C.pretty_gb(mb).alias("pretty"))


@R.query(
    rf"""
with {K}, t as (select id, 'cpu=' || k || case k % 4 when 0 then ',gres/gpu:a100=' || (k % 5) || ',gres/gpu:h100=1,gres/gpu=9' when 1 then ',gres/gpu=' || (k % 7) when 2 then ',mem=4G' else '' end as tres from e),
x as (select id, regexp_extract_all(tres, 'gres/gpu:[^=,]+=(\d+)', 1) as typed, try_cast(nullif(regexp_extract(tres, '(?:^|,)gres/gpu=(\d+)', 1), '') as bigint) as plain from t)
select id, case when len(typed) > 0 then cast(list_sum(list_transform(typed, lambda n: n::bigint)) as bigint) else coalesce(plain, 0) end as gpus from x"""
)
def tres_gpus(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    own = F.when(k % 4 == 0, joined(",gres/gpu:a100=", text_of(k % 5), ",gres/gpu:h100=1,gres/gpu=9")).when(k % 4 == 1, joined(",gres/gpu=", text_of(k % 7))).when(k % 4 == 2, ",mem=4G").otherwise("")
    return events(spark, d).select("id", C.gpus(joined("cpu=", text_of(k), own)).alias("gpus"))


SCRIPTS = f"""{K}, s as (select id, '#!/bin/bash' || chr(10) || '#SBATCH --nodes=' || (k % 4) || chr(10) || case when k % 2 = 0 then '#SBATCH -t 0' || (k % 9) || ':00:00' || chr(10) else '#SBATCH --mem ' || k || 'G' || chr(10) end || case when k % 5 = 0 then '#SBATCH --nodes=' || k || chr(10) else '' end || 'srun ./a.out' as script,
  '#SBATCH --nodes=' || (k % 3) || chr(10) || '#SBATCH --mem ' || k || 'G' as other from e)"""


def scripts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    t = text_of
    limit = F.when(k % 2 == 0, joined("#SBATCH -t 0", t(k % 9), ":00:00\n")).otherwise(joined("#SBATCH --mem ", t(k), "G\n"))
    again = F.when(k % 5 == 0, joined("#SBATCH --nodes=", t(k), "\n")).otherwise("")
    script = joined("#!/bin/bash\n#SBATCH --nodes=", t(k % 4), "\n", limit, again, "srun ./a.out")
    return events(spark, d).select("id", script.alias("script"), joined("#SBATCH --nodes=", t(k % 3), "\n#SBATCH --mem ", t(k), "G").alias("other"))


@R.query(
    rf"""
with {SCRIPTS}, o as (select id, key, value from s, lateral (select unnest(['nodes', 'time', 'partition', 'mem']) as key, unnest([
  regexp_extract_all(script, '(?m)^#SBATCH\s+(?:--nodes[= ]|-N ?)\s*(\S+)', 1)[-1], regexp_extract_all(script, '(?m)^#SBATCH\s+(?:--time[= ]|-t ?)\s*(\S+)', 1)[-1],
  regexp_extract_all(script, '(?m)^#SBATCH\s+(?:--partition[= ]|-p ?)\s*(\S+)', 1)[-1], regexp_extract_all(script, '(?m)^#SBATCH\s+(?:--mem[= ])\s*(\S+)', 1)[-1]]) as value))
select id, key, value from o where value is not null"""
)
def script_options(spark: SparkSession, d: str) -> DataFrame:
    return scripts(spark, d).select("id", F.explode(C.script_options(F.col("script"))).alias("key", "value"))


@R.query(
    rf"""
with {SCRIPTS}, l as (select id, regexp_extract_all(script, '(?m)^#SBATCH.*$') as a, regexp_extract_all(other, '(?m)^#SBATCH.*$') as b from s), x as (select id, unnest(a) as line, 'removed' as what, b as against from l union all select id, unnest(b), 'added', a from l)
select distinct id, line, what from x where not list_contains(against, line)"""
)
def script_diff(spark: SparkSession, d: str) -> DataFrame:
    lines = lambda c: T.matches(F.col(c), r"(?m)^#SBATCH.*$")
    tagged = lambda x, y, what: F.transform(F.array_except(lines(x), lines(y)), lambda v: F.struct(v.alias("line"), F.lit(what).alias("what")))
    return scripts(spark, d).select("id", F.explode(F.concat(tagged("script", "other", "removed"), tagged("other", "script", "added"))).alias("t")).select("id", "t.*")


FENCE = "repeat(chr(96), 3)"
ANSWERS = f"""a as (select doc_id as id, case doc_id % 6 when 0 then 'Use:' || chr(10) || {FENCE} || 'bash' || chr(10) || substr(text, 1, 30) || chr(10) || {FENCE} || chr(10) || 'then ' || chr(96) || source || chr(96) || '.' when 1 then substr(text, 1, 80)
  when 2 then '<think>' || substr(text, 1, 20) || '</think> Run ' || chr(96) || source || chr(96) || '.' when 3 then source || ' ' || {FENCE} || ' b' when 4 then {FENCE} || 'json' || chr(10) || '{{"a": ' || doc_id || '}}' || chr(10) || {FENCE} else 'Ask Provided input: ' || substr(text, 1, 40) end as text from documents where text is not null)"""


def answers(spark: SparkSession, d: str) -> DataFrame:
    t, s, by = (lambda n: F.substring("text", 1, n)), F.col("source"), F.col("doc_id") % 6
    text = (
        F.when(by == 0, joined("Use:\n```bash\n", t(30), "\n```\nthen `", s, "`.")).when(by == 1, t(80)).when(by == 2, joined("<think>", t(20), "</think> Run `", s, "`.")).when(by == 3, joined(s, " ``` b"))
        .when(by == 4, joined('```json\n{"a": ', text_of(F.col("doc_id")), "}\n```")).otherwise(joined("Ask Provided input: ", t(40)))
    )
    return table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("id"), text.alias("text"))


@R.query(
    r"""
with """
    + ANSWERS
    + r""", x as (select id, text, regexp_extract_all(text, '(?s)```[^\n]*\n(.*?)```', 1) as f, regexp_extract_all(regexp_replace(text, '(?s)```[^\n]*\n.*?```', '', 'g'), '`([^`\n]+)`', 1) as i from a)
select id, case when len(f) + len(i) = 0 then text else array_to_string(list_concat(f, i), chr(10)) end as code, regexp_replace(text, '(?s)<think>.*?</think>\s*', '', 'g') as spoken,
  trim(regexp_replace(text, '(?s)(Provided input|Quoted retrieval results):.*', '')) as question, repeat('`', greatest(3, 1 + coalesce(list_max(list_transform(regexp_extract_all(text, '`+'), lambda r: length(r))), 0))) as fence,
  trim(regexp_replace(regexp_replace(text, '^\s*```(?:json)?\s*', ''), '\s*```\s*$', '')) as reply from x"""
)
def answer_parts(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return answers(spark, d).select("id", T.code_of_answer(t).alias("code"), T.strip_thinking(t).alias("spoken"), T.question_part(t).alias("question"), segment.quoting_fence(t).alias("fence"), T.reply_json(t).alias("reply"))


@R.query(
    r"""
with """
    + ANSWERS
    + r"""
select id, unnest(regexp_extract_all(text, '(?s)```([A-Za-z0-9_+-]*)[^\n]*\n(.*?)```', 1)) as lang, unnest(regexp_extract_all(text, '(?s)```([A-Za-z0-9_+-]*)[^\n]*\n(.*?)```', 2)) as body from a"""
)
def fenced_blocks(spark: SparkSession, d: str) -> DataFrame:
    return answers(spark, d).select("id", F.explode(segment.fenced_blocks(F.col("text"))).alias("b")).select("id", "b.lang", "b.body")


@R.query(
    rf"""
with {K}, c as (select id, case k % 3 when 0 then 'ok <tool_call>{{"name": "' || event_type || '", "arguments": {{"k": ' || k || '}}}}</tool_call> done' when 1 then '<tool_call>not json ' || k || '</tool_call>' else 'plain ' || event_type end as text from e),
b as (select id, trim(regexp_replace(text, '(?s)<tool_call>.*?</tool_call>', '', 'g')) as outside, regexp_extract_all(text, '(?s)<tool_call>\s*(.*?)\s*</tool_call>', 1) as bodies from c)
select id, outside, cast(len(bodies) as bigint) as n, case when len(bodies) > 0 and json_valid(bodies[1]) then json_extract_string(bodies[1], '$.name') end as name from b"""
)
def hermes_calls(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    name = F.col("event_type")
    text = F.when(k % 3 == 0, joined('ok <tool_call>{"name": "', name, '", "arguments": {"k": ', text_of(k), "}}</tool_call> done")).when(k % 3 == 1, joined("<tool_call>not json ", text_of(k), "</tool_call>")).otherwise(joined("plain ", name))
    calls = traces.hermes_calls(F.col("text"))
    return events(spark, d).withColumn("text", text).select("id", traces.outside_calls(F.col("text")).alias("outside"), F.size(calls).cast("long").alias("n"), F.try_element_at(calls, F.lit(1))["name"].alias("name"))


CLOSURE = """
with recursive fam as (select source as family, case n % 7 when 0 then 'development' else 'train' end as split, list_filter([case when n % 3 <> 0 then 'src' || ((n + 1) % 23) end, case when n % 4 = 1 then 'src' || (n * 2) end, case when n % 10 = 5 then 'src' || (n - 1) end], lambda x: x is not null) as parents,
  n % 6 <> 2 as lineage_reviewed from (select distinct source, cast(substr(source, 4) as bigint) as n from documents)),
e as (select family, unnest(parents) as parent from fam),
r as (select family, family as ancestor from fam union select r.family, e.parent from r join e on r.ancestor = e.family)
"""


def families(spark: SparkSession, d: str) -> DataFrame:
    """Sources as families with up to three parents each; some unknown, some in a cycle."""
    n = F.substring("source", 4, 10).cast("long")
    name = lambda x: joined("src", text_of(x))
    parents = F.array_compact(F.array(F.when(n % 3 != 0, name((n + 1) % 23)), F.when(n % 4 == 1, name(n * 2)), F.when(n % 10 == 5, name(n - 1))))
    return table(spark, d, "documents").select("source").distinct().select(F.col("source").alias("family"), F.when(n % 7 == 0, "development").otherwise("train").alias("split"), parents.alias("parents"), (n % 6 != 2).alias("lineage_reviewed"))


@R.query(f"{CLOSURE} select family, ancestor from r")
def family_closure(spark: SparkSession, d: str) -> DataFrame:
    return provenance.ancestors(families(spark, d))


@R.query(
    f"""
{CLOSURE}
select family, 'unknown_parent' as error from e where parent not in (select family from fam)
union select e.family, 'cycle' from e join r on r.family = e.parent and r.ancestor = e.family
union select family, 'unreviewed' from fam where not lineage_reviewed"""
)
def family_errors(spark: SparkSession, d: str) -> DataFrame:
    known = families(spark, d)
    return provenance.family_errors(known, provenance.ancestors(known))


@R.query(
    f"""
{CLOSURE}, held as (select distinct ancestor from r where family in (select family from fam where split <> 'train')),
ok as (select r.family, bool_and(coalesce(f.split = 'train', false)) and not bool_or(r.ancestor in (select ancestor from held)) as clean from r left join fam f on f.family = r.ancestor group by r.family)
select doc_id, source as family, coalesce(clean, false) as admitted from documents left join ok on ok.family = source"""
)
def lineage_admission(spark: SparkSession, d: str) -> DataFrame:
    known = families(spark, d)
    return provenance.admitted(table(spark, d, "documents").select("doc_id", F.col("source").alias("family")), known, provenance.ancestors(known))


HOLDOUT = """r as (select doc_id as id, source as doc_id, source || '#' || (doc_id % 10) as chunk_id, sha256(text) as source_sha256 from documents),
m as (select item_id as entry, case when item_id % 8 = 0 then 'document' else 'chunk' end as kind, 'src' || (item_id % 20) as doc_id, case when item_id % 8 <> 0 then 'src' || (item_id % 20) || '#' || (item_id % 9) end as chunk_id, (select sha256(text) from documents where documents.doc_id = item_id * 3) as source_sha256 from benchmark)"""


@R.query(f"with {HOLDOUT} select id, min(entry) as entry from r join m on r.source_sha256 = m.source_sha256 or (kind = 'document' and r.doc_id = m.doc_id) or r.chunk_id = m.chunk_id group by id")
def source_holdout(spark: SparkSession, d: str) -> DataFrame:
    docs, i = table(spark, d, "documents"), F.col("item_id")
    rows = docs.select(F.col("doc_id").alias("id"), F.col("source").alias("doc_id"), joined(F.col("source"), "#", text_of(F.col("doc_id") % 10)).alias("chunk_id"), F.sha2("text", 256).alias("source_sha256"))
    name = joined("src", text_of(i % 20))
    sha = docs.select((F.col("doc_id") / 3).alias("item_id"), F.sha2("text", 256).alias("source_sha256"))
    entries = table(spark, d, "benchmark").join(sha, "item_id", "left")
    manifest = entries.select(i.alias("entry"), F.when(i % 8 == 0, "document").otherwise("chunk").alias("kind"), name.alias("doc_id"), F.when(i % 8 != 0, joined(name, "#", text_of(i % 9))).alias("chunk_id"), "source_sha256")
    return provenance.source_holdout(rows, manifest).select("id", "entry")


@R.query(
    f"""
with {K}, a as (select id as call_id, case k % 5 when 4 then 'nope' when 3 then 'state' else 'queue' end as tool, case k % 5 when 0 then ['user', 'n'] when 1 then ['n'] when 2 then ['user', 'extra'] else ['s'] end as keys,
  case k % 5 when 0 then ['me', k::varchar] when 1 then ['x' || k] when 2 then ['me', '1'] else [case when k % 2 = 0 then 'ON' else 'BAD' end] end as vals from e),
s(tool, arg, kind, required, allowed) as (values ('queue', 'user', 'string', true, []::varchar[]), ('queue', 'n', 'integer', false, []), ('state', 's', 'string', true, ['ON', 'OFF'])),
g as (select call_id, tool, unnest(keys) as arg, unnest(vals) as value from a where tool in (select tool from s)), j as (select g.*, kind, allowed from g left join s using (tool, arg))
select call_id, 'unknown_tool' as problem from a where tool not in (select tool from s)
union all select call_id, 'missing:' || arg from a join s using (tool) where required and not list_contains(keys, arg)
union all select call_id, problem from (select call_id, case when kind is null then 'extra:' || arg when kind = 'integer' and not regexp_matches(value, '^-?\\d+$') then 'type:' || arg
  when len(allowed) > 0 and not list_contains(allowed, value) then 'enum:' || arg end as problem from j) where problem is not null"""
)
def argument_problems(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    by = k % 5
    one = lambda *pairs: F.create_map(*[F.lit(v) if isinstance(v, str) else v for v in pairs])
    args = F.when(by == 0, one("user", "me", "n", text_of(k))).when(by == 1, one("n", joined("x", text_of(k)))).when(by == 2, one("user", "me", "extra", "1")).otherwise(one("s", F.when(k % 2 == 0, "ON").otherwise("BAD")))
    calls = events(spark, d).select(F.col("id").alias("call_id"), F.when(by == 4, "nope").when(by == 3, "state").otherwise("queue").alias("tool"), args.alias("args"))
    schema = spark.createDataFrame([("queue", "user", "string", True, []), ("queue", "n", "integer", False, []), ("state", "s", "string", True, ["ON", "OFF"])], "tool string, arg string, kind string, required boolean, allowed array<string>")
    return traces.argument_problems(calls, schema)


@R.query(
    """
with l as (select vec_id, list_transform(embedding[1:8], lambda x: x::double) as teacher, list_transform(embedding[9:16], lambda x: x::double) as student, embedding[1]::double as hard from embeddings),
s as (select vec_id, hard, list_transform(teacher, lambda x: exp(x) / list_sum(list_transform(teacher, lambda y: exp(y)))) as t, list_transform(student, lambda x: exp(x) / list_sum(list_transform(student, lambda y: exp(y)))) as u from l)
select vec_id as id, round(0.5 * -hard + 0.5 * list_sum(list_transform(list_zip(t, u), lambda p: -p[1] * ln(p[2]))), 6)::double as loss from s"""
)
def soft_targets(spark: SparkSession, d: str) -> DataFrame:
    """Eight numbers of a vector as the teacher's logits, the next eight as the student's."""
    part = lambda a: F.transform(F.slice("embedding", a, 8), lambda x: x.cast("double"))
    loss = distill.mixed_loss(F.get("embedding", F.lit(0)).cast("double"), part(1), part(9), 0.5)
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.round(loss, 6).alias("loss"))


@R.query(f"with {JOBS}, a as (select job, case when k % 2 = 0 then 'CANCELLED' else 'RUNNING' end as state from j where k < 20) select j.job, coalesce(a.state, j.state) as state, part from j left join a using (job) where coalesce(a.state, j.state) in ('PENDING', 'RUNNING')")
def queue_overlay(spark: SparkSession, d: str) -> DataFrame:
    """Explicit actions override a job's first state."""
    j = jobs(spark, d)
    overlay = j.where("k < 20").select("job", F.when(F.col("k") % 2 == 0, "CANCELLED").otherwise("RUNNING").alias("new"))
    return j.join(overlay, "job", "left").withColumn("state", F.coalesce("new", "state")).where("state in ('PENDING', 'RUNNING')").select("job", "state", "part")


@R.query(
    f"""
with {JOBS}, n as (select distinct 'n' || (job % 40) as node, part, job % 40 % 9 as total, least(job % 40 % 9, job % 40 % 5) as free from j)
select part, cast(sum(total) as bigint) as total, cast(sum(free) as bigint) as free, cast(sum(case when free = total and total > 0 then total else 0 end) as bigint) as idle from n group by part"""
)
def gpu_availability(spark: SparkSession, d: str) -> DataFrame:
    """A node counts once in a partition, however often it is listed."""
    n = F.col("job") % 40
    nodes = jobs(spark, d).select(joined("n", text_of(n)).alias("node"), "part", (n % 9).alias("total"), F.least(n % 9, n % 5).alias("free")).dropDuplicates()
    return nodes.groupBy("part").agg(F.sum("total").alias("total"), F.sum("free").alias("free"), F.sum(F.when((F.col("free") == F.col("total")) & (F.col("total") > 0), F.col("total")).otherwise(0)).alias("idle"))


@R.query(f"with {K} select id, 'GPU_node,' || k || 'x,Booster' || k || ',Leonardo,Use' as names from e")
def name_like(spark: SparkSession, d: str) -> DataFrame:
    n = text_of(F.col("k"))
    text = joined("Try the GPU_node on Leonardo ", n, "x. Then Use Booster", n, ".")
    return events(spark, d).select("id", F.array_join(T.name_like_words(text), ",").alias("names"))


@R.query(f"with {K} select id, case when k % 2 = 0 then '' else (20000 + k)::varchar end as ungrounded from e")
def id_grounding(spark: SparkSession, d: str) -> DataFrame:
    """An id counts as a whole number only: 120042 doesn't ground 20042; an array's task is grounded by its job."""
    k = F.col("k")
    one, two = text_of(10000 + k), text_of(20000 + k)
    source = joined("see ", one, " or 1", two, F.when(k % 2 == 0, joined(" or ", two, "_7")).otherwise(""))
    return events(spark, d).select("id", F.array_join(traces.grounded_ids(joined("Job ", one, " and ", two, "_3 ran"), source), ",").alias("ungrounded"))


@R.query(f"with {K} select id, k % 4 in (1, 3) as open from e")
def open_fences(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    text = F.when(k % 4 == 0, joined("a\n```\n", text_of(k), "\n```\nb")).when(k % 4 == 1, joined("a\n```sh\n", text_of(k))).when(k % 4 == 2, joined("a \\``` ", text_of(k), "\nb ``` c")).otherwise(joined("````\n```\n", text_of(k), "\n```\n"))
    return events(spark, d).select("id", segment.unmatched_fence(text).alias("open"))


@R.query("select doc_id, doc_id % 3 <> 0 and doc_id % 5 <> 0 as bound from documents where length(text) >= 60")
def span_binding(spark: SparkSession, d: str) -> DataFrame:
    """Spans are bound by their digests, and in order: every third document has a wrong digest, every fifth an overlap."""
    second = F.when(F.col("doc_id") % 5 == 0, 10).otherwise(20)
    span = lambda a, b, own: F.struct(a.alias("start"), b.alias("end"), F.when(own, F.sha2(F.substr("text", a + 1, b - a), 256)).otherwise("x").alias("sha256"))
    spans = F.array(span(F.lit(0), F.lit(20), F.lit(True)), span(second, F.lit(60), F.col("doc_id") % 3 != 0))
    return table(spark, d, "documents").where(F.length("text") >= 60).select("doc_id", segment.bound_spans(F.col("text"), spans).alias("bound"))


@R.query(
    """
with v as (select vec_id, list_transform(embedding[1:4], lambda x: round(x::double, 3)) as v from embeddings)
select vec_id as id, '3,2,1,-1,-1' as ids, round(list_sum([v[4], v[3], v[2]]), 3) as total, case vec_id % 4 when 0 then '1000' when 1 then '0100' when 2 then '0010' else '0001' end as hot, round(v[2] + v[3], 3) as middle from v"""
)
def padded_top(spark: SparkSession, d: str) -> DataFrame:
    """Three best of four tokens by rank (the later the better), padded to five; a one-hot row; a slice by offsets."""
    v = F.transform(F.slice("embedding", 1, 4), lambda x: F.round(x.cast("double"), 3))
    tokens = F.transform(v, lambda x, i: F.struct(i.cast("long").alias("id"), (3 - i).alias("rank"), x.alias("lp")))
    top = distill.top_ranked(tokens, 3)
    ids = distill.padded(F.transform(top, lambda t: t["id"]), 5, F.lit(-1).cast("long"))
    total = lambda a: F.round(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), 3)
    hot = F.array_join(F.transform(distill.one_hot(4, F.col("vec_id") % 4), lambda x: x.cast("int").cast("string")), "")
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.array_join(ids, ",").alias("ids"), total(F.transform(top, lambda t: t["lp"])).alias("total"), hot.alias("hot"), total(distill.ragged(v, F.lit(1), F.lit(3))).alias("middle"))
