"""Range joins, paired bootstraps and schema-checked replies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.schemas import checked_reply
from textloom.functions.text import hash_bucket
from textloom.operators import segment, select
from textloom.operators.bootstrap import CUTS, paired_interval, paired_means
from textloom.operators.ranges import count_and_least, first_within
from textloom.operators.similarity import greedy_keep
from textloom.plans.registry import Registry
from textloom.session import table
from textloom.sources import tabular

R = Registry()
QUERIES, SQL = R.queries, R.sql

RUNS = "runs as (select event_id as run, epoch_us(ts) as a, epoch_us(ts) + 60000000 * (cast(json_extract_string(props, '$.k') as bigint) ** 2)::bigint - 1 as b from events where event_type = 'error'), s as (select event_id as session, epoch_us(ts) as t from events where event_type = 'signup')"


def runs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Runs from errors, of no time to a week, and sessions from sign-ups."""
    events, k = table(spark, d, "events"), F.get_json_object("props", "$.k").cast("long")
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    own = events.where("event_type = 'error'").select(F.col("event_id").alias("run"), start.alias("a"), (start + 60_000_000 * k * k - 1).alias("b"))
    return own, events.where("event_type = 'signup'").select(F.col("event_id").alias("session"), start.alias("t"))


@R.query(f"with {RUNS} select run, count(*) as n_sessions, min(session) as least from runs join s on t between a and b group by run")
def run_sessions(spark: SparkSession, d: str) -> DataFrame:
    """How many sessions began within each run, of whichever user."""
    own, s = runs(spark, d)
    return count_and_least(own, "run", F.col("a"), F.col("b"), s, F.col("t"), "session").withColumnRenamed("n", "n_sessions")


@R.query(f"with {RUNS} select run, arg_min(session, (t, session)) as session from runs join s on t between a - 5000000 and b group by run")
def run_session(spark: SparkSession, d: str) -> DataFrame:
    """The first session of each run, from five seconds before it on."""
    own, s = runs(spark, d)
    return first_within(own, "run", F.col("a") - 5_000_000, F.col("b"), s, F.col("t"), "session")


WEIGHT = " + ".join(f"(u >= {c})::int" for c in CUTS)


@R.query(
    f"""
with p as (select doc_id, source, quality - (1 - toxic) as x from labels join documents using (doc_id) where quality is not null and toxic is not null),
h as (select *, unnest(range(4)) as block from p), g as (select *, sha256('pair:' || doc_id || ':' || block) as s, unnest(range(16)) as j from h),
w as (select source, block * 16 + j as r, x, ('0x' || substr(s, 4 * j + 1, 4))::int as u from g), v as (select source, r, x, {WEIGHT} as w from w),
m as (select source, r, sum(w * x)::double / nullif(sum(w), 0) as mean from v group by all), l as (select source, list(mean order by mean) as m, avg((mean <= 0)::int) as p from m where mean is not null group by all)
select source, round(m[floor(len(m) * 0.025)::int + 1], 9) as low, round(m[ceil(len(m) * 0.975)::int], 9) as high, round(p, 9) as p_not_better from l"""
)
def paired_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Quality against being fit to read, by source: the interval of the mean difference over 64 resamples."""
    both = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id").withColumn("fit", 1 - F.col("toxic"))
    found = paired_interval(paired_means(both, "doc_id", "quality", "fit", 64, groups=("source",)), ("source",))
    return found.select("source", *[F.round(c, 9).alias(c) for c in ("low", "high", "p_not_better")])


REPLY = {
    "type": "object",
    "required": ["id", "lang", "meta", "items"],
    "additionalProperties": False,
    "properties": {
        "id": {"type": "integer", "minimum": 0}, "lang": {"enum": ["en", "de", "fr"]}, "meta": {"type": "object", "required": ["size", "origin"], "properties": {"size": {"type": "integer", "maximum": 3000}, "origin": {"type": "string", "minLength": 2}}},
        "items": {"type": "array", "minItems": 1, "items": {"type": "object", "required": ["label"], "properties": {"label": {"type": ["string", "null"]}, "grade": {"type": "number", "maximum": 5}}}},
    },
}


@R.query(
    """
with r as (select *, length(coalesce(text, '')) % 7 as g, n_chars % 11 as f from documents)
select doc_id, f <> 1 and f <> 3 and f <> 5 and coalesce(lang in ('en', 'de', 'fr'), false) and n_chars <= 3000 and length(source) >= 2 and g <= 5 as fits from r"""
)
def schema_checked(spark: SparkSession, d: str) -> DataFrame:
    """Each document as a model's reply, fenced or not, held against a nested schema.

    Lengths decide which are cut off, have a key too many or a number where a name should be.
    """
    fault = F.col("n_chars") % 11
    label = F.when(fault == 5, F.lit("7")).when(F.col("lang").isNull(), F.lit("null")).otherwise(F.concat(F.lit('"'), F.col("lang"), F.lit('"')))
    items = F.concat(F.lit('[{"label": "x"}, {"grade": '), (F.length(F.coalesce("text", F.lit(""))) % 7).cast("string"), F.lit('.0, "label": '), label, F.lit("}]"))
    head = F.to_json(F.struct(F.col("doc_id").alias("id"), "lang", F.struct(F.col("n_chars").alias("size"), F.col("source").alias("origin")).alias("meta"), F.when(fault == 3, 1).alias("more")))
    body = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(', "items": '), items, F.when(fault == 1, "").otherwise("}"))
    text = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```\n"))).otherwise(body)
    return table(spark, d, "documents").select("doc_id", checked_reply(text, REPLY).isNotNull().alias("fits"))


@R.query(
    """
with recursive e as (select doc_id as a, doc_id + s as b from documents, (values (1), (2)) t(s) where doc_id % 8 + s < 8 and ('0x' || substr(sha256('chain' || s || '-' || doc_id), 1, 8))::bigint % 100 < 55),
n as (select e.a, e.b from e join documents d on d.doc_id = e.b), g as (select b, list(a) as near from n group by b),
f as (select distinct doc_id // 8 as block, 0::bigint as i, []::bigint[] as kept from documents
  union all select f.block, f.i + 1, case when d.doc_id is not null and len(list_intersect(f.kept, coalesce(g.near, []))) = 0 then list_append(f.kept, d.doc_id) else f.kept end
  from f left join documents d on d.doc_id = f.block * 8 + f.i left join g on g.b = d.doc_id where f.i < 8)
select d.doc_id, list_contains(f.kept, d.doc_id) as kept from documents d join f on f.block = d.doc_id // 8 and f.i = 8"""
)
def greedy_chains(spark: SparkSession, d: str) -> DataFrame:
    """Which documents stay of chains, forks and triangles of up to eight neighbours, where the one before decides."""
    docs, i = table(spark, d, "documents").select("doc_id"), F.col("doc_id")
    links = docs.where((i % 8 < 7) & (hash_bucket(i, "chain1-") < 55)).select(i.alias("a"), (i + 1).alias("b")).union(docs.where((i % 8 < 6) & (hash_bucket(i, "chain2-") < 55)).select(i.alias("a"), (i + 2).alias("b")))
    pairs = links.join(docs, F.col("b") == i, "left_semi")
    return greedy_keep(docs.select(i.alias("id")), pairs).select(F.col("id").alias("doc_id"), "kept")


@R.query(
    r"""
with b as (select doc_id, string_split_regex(replace(text, chr(10), chr(10) || ' ' || chr(10)), '\n[ \t]*\n\s*') as blocks from documents where text is not null), k as (select doc_id, list_filter(blocks, lambda b: not regexp_matches(b, '(?i)licen[cs]e|copyright|@')) as kept, len(blocks) as n from b)
select doc_id, sha256(array_to_string(kept, chr(10) || chr(10))) as sha, cast(n - len(kept) as bigint) as dropped from k"""
)
def dropped_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Documents, each line a block, without the blocks that a pattern holds back."""
    text = F.replace("text", F.lit("\n"), F.lit("\n \n"))
    kept, gone = segment.drop_blocks(text, "(?i)licen[cs]e|copyright|@")
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2(kept, 256).alias("sha"), gone.cast("long").alias("dropped"))


@R.query("select doc_id, lang from documents order by sha256('eval|' || doc_id), doc_id limit 25")
def shuffled_sample(spark: SparkSession, d: str) -> DataFrame:
    """A reproducible sample of 25 documents."""
    return select.shuffled_head(table(spark, d, "documents"), "doc_id", 25, "eval").select("doc_id", "lang")


@R.query("select doc_id, lang, source, n_chars, sha256(text) as sha from documents")
def json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Documents written as JSON lines and read back, nulls and line ends included."""
    path = tabular.write_json(table(spark, d, "documents"))
    return spark.read.schema(table(spark, d, "documents").schema).json(path).select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("sha"))
