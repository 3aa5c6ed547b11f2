"""Data sets from documents, labels and benchmark: sets, gates, plans, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import builders as N
from textloom.operators import distill, provenance, segment, similarity
from textloom.operators.select import numbers_within
from textloom.plans.documents import SHINGLES, WORDS, shingle_rows
from textloom.plans.registry import Registry
from textloom.session import saved, table

R = Registry()
QUERIES, SQL = R.queries, R.sql


def BUCKET(salt: str, key: str = "doc_id", n: int = 100) -> str:
    return f"cast('0x' || substr(sha256('{salt}' || {key}::varchar), 1, 8) as bigint) % {n}"


@R.query("select coalesce(d.doc_id, l.doc_id) as doc_id, case when l.doc_id is null then 'left' when d.doc_id is null then 'right' else 'both' end as side from (select doc_id from documents where lang = 'en') d full join (select distinct doc_id from labels) l on d.doc_id = l.doc_id")
def id_sets(spark: SparkSession, d: str) -> DataFrame:
    return N.membership(table(spark, d, "documents").where("lang = 'en'"), table(spark, d, "labels"), "doc_id")


@R.query("select doc_id, count(*) as n from (select doc_id from documents where doc_id % 2 = 0 union all select doc_id from documents where doc_id % 3 = 0 union all select doc_id from labels where quality = 0) group by doc_id having count(*) > 1")
def repeated_ids(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return N.repeated_keys([docs.where("doc_id % 2 = 0"), docs.where("doc_id % 3 = 0"), table(spark, d, "labels").where("quality = 0")], "doc_id")


LICENCE = "case when regexp_matches(text, '(?i)apache license|MIT license|BSD license') then 'permissive' when regexp_matches(text, '(?i)CC BY-SA|gnu general public') then 'share_alike' when regexp_matches(text, '(?i)non-?commercial|CC BY-NC') then 'withheld' else 'unknown' end"


@R.query(f"select {LICENCE} as part, count(*) as n, min(doc_id) as first_doc, cast(sum(length(text)) as bigint) as chars from documents group by 1")
def licence_parts(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    part = F.when(t.rlike("(?i)apache license|MIT license|BSD license"), "permissive").when(t.rlike("(?i)CC BY-SA|gnu general public"), "share_alike").when(t.rlike("(?i)non-?commercial|CC BY-NC"), "withheld").otherwise("unknown")
    return table(spark, d, "documents").groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"), F.sum(F.length("text")).alias("chars"))


@R.query(
    """
with b as (select doc_id, substr(text, 1, 500) as new from documents where doc_id % 4 = 0)
select d.doc_id, new is not null and length(new) < length(text) and contains(new, '.') as replaced, length(case when new is not null and length(new) < length(text) and contains(new, '.') then new else text end)::bigint as n
from documents d left join b on b.doc_id = d.doc_id where text is not null"""
)
def gated_replacement(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    better = docs.where("doc_id % 4 = 0").select("doc_id", F.substring("text", 1, 500).alias("new"))
    gate = (F.length("new") < F.length("text")) & F.col("new").contains(".")
    return N.replaced(docs, better, "doc_id", "text", gate).select("doc_id", "replaced", F.length("text").cast("long").alias("n"))


@R.query(f"select doc_id, cast(len({WORDS}) as bigint) as n_words from documents where len({WORDS}) between 1 and 300")
def length_gate(spark: SparkSession, d: str) -> DataFrame:
    n = F.size(T.words(F.coalesce("text", F.lit(""))))
    return table(spark, d, "documents").select("doc_id", n.cast("long").alias("n_words")).where("n_words between 1 and 300")


@R.query(
    """
with p as (select doc_id, length(text) as n, quality from documents join labels using (doc_id) where text is not null)
select 'all' as variant, doc_id from p union all select 'good', doc_id from p where quality = 1 union all select 'short', doc_id from p where n < 1500"""
)
def ablation_sets(spark: SparkSession, d: str) -> DataFrame:
    """Each row once, with the variants it is in exploded: one join and one scan for all of them."""
    pool = table(spark, d, "documents").where("text is not null").join(table(spark, d, "labels"), "doc_id")
    variants = F.array(F.lit("all"), F.when(F.col("quality") == 1, "good"), F.when(F.length("text") < 1500, "short"))
    return pool.select(F.explode(F.array_compact(variants)).alias("variant"), "doc_id")


@R.query(
    """
select conv_id, 1 + count(*) as n_messages, 'system' || string_agg('>' || role, '' order by turn) as roles, cast(sum(length(coalesce(text, ''))) as bigint) + 8 as chars from conversations where role <> 'system' group by conv_id"""
)
def training_examples(spark: SparkSession, d: str) -> DataFrame:
    """A fixed system message of eight characters, then the turns in order."""
    turns = table(spark, d, "conversations").where("role <> 'system'").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text")))).alias("t"))
    system = F.array(F.struct(F.lit(-1).cast("long").alias("turn"), F.lit("system").alias("role"), F.lit("Be brief").alias("text")))
    messages = turns.select("conv_id", F.concat(system, "t").alias("m"))
    return messages.select("conv_id", F.size("m").cast("long").alias("n_messages"), F.array_join(F.transform("m", lambda x: x["role"]), ">").alias("roles"), F.aggregate("m", F.lit(0).cast("long"), lambda a, x: a + F.length(x["text"])).alias("chars"))


HELD = "h as (select doc_id from documents where source in ('src1', 'src2', 'src3'))"


@R.query(
    f"""
with {HELD}, q as (select distinct doc_id from documents d join labels l using (doc_id) where toxic = 1),
f as (select d.doc_id, h.doc_id is not null as s, q.doc_id is not null as t from documents d left join h on h.doc_id = d.doc_id left join q on q.doc_id = d.doc_id)
select count(*) as n, count(*) filter (where s) as source, count(*) filter (where t) as question, count(*) filter (where s or t) as either, count(*) filter (where not (s or t)) as remaining from f"""
)
def exposure_audit(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    return N.exposure(docs, "doc_id", {"source": docs.where("source in ('src1', 'src2', 'src3')"), "question": docs.join(labels.where("toxic = 1"), "doc_id", "left_semi")})


@R.query(
    """
with c as (select row_number() over (order by doc_id) as line, doc_id, text from documents), p as (select line, case when line % 50 = 0 then doc_id + 1 else doc_id end as doc_id from c where line <= 120)
select 'prefix' as problem, (select count(*) from p left join c using (line) where p.doc_id is distinct from c.doc_id) as n
union all select 'repeated_doc_id', (select cast(sum(m - 1) as bigint) from (select count(*) as m from c group by doc_id))
union all select 'repeated_text', (select cast(sum(m - 1) as bigint) from (select count(*) as m from c group by text))"""
)
def release_check(spark: SparkSession, d: str) -> DataFrame:
    from textloom.operators.select import dense_numbers

    current = dense_numbers(table(spark, d, "documents").select("doc_id", "text"), ["doc_id"]).withColumn("line", F.col("number") + 1)
    previous = current.where("line <= 120").select("line", F.when(F.col("line") % 50 == 0, F.col("doc_id") + 1).otherwise(F.col("doc_id")).alias("doc_id"))
    return N.release_problems(previous, current, "line", "doc_id", ["doc_id", "text"])


@R.query(
    f"""
with j as (select source || '-' || lang as chunk from documents where lang is not null group by source, lang),
g as (select chunk, sha256('plan|' || chunk || '|' || p || '/' || t) as h, p as persona, t as task from j, (select unnest(['novice', 'expert', 'admin']) as p), (select unnest(['howto', 'debug']) as t)),
r as (select *, row_number() over (partition by chunk order by h, persona || '/' || task) as n, substr(h, 1, 16) as job_id from g)
select job_id, chunk, persona, task, case when {BUCKET('plan', 'job_id', 1000)} < 600 then 'prose' when {BUCKET('plan', 'job_id', 1000)} < 900 then 'tool' else 'mixed' end as mode from r where n <= 4"""
)
def question_plan(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "documents").where("lang is not null").select(F.concat_ws("-", "source", "lang").alias("chunk")).distinct()
    return N.job_plan(chunks, "chunk", ["novice", "expert", "admin"], ["howto", "debug"], 4, {"prose": 0.6, "tool": 0.3, "mixed": 0.1}, "plan")


PLAN = "p as (select doc_id // 2 as job, doc_id + (doc_id % 40 = 0)::int * 1000000 as doc_id, case when doc_id % 30 = 0 then 'x' else sha256(text) end as sha, case when doc_id % 25 < 2 then 'Same  Brief ' || (doc_id % 2) else 'brief ' || doc_id end as brief from documents where text is not null)"


@R.query(
    rf"""
with {PLAN}, n as (select *, trim(regexp_replace(lower(brief), '\s+', ' ', 'g')) as norm from p), f as (select norm, min(job) as first from n group by norm having count(*) > 1)
select job, 'duplicate_key' as problem from n group by job having count(*) > 1
union select job, 'duplicate_brief' from n join f using (norm) where job > first
union select job, case when d.doc_id is null then 'unknown_chunk' else 'changed_chunk' end from n left join documents d on d.doc_id = n.doc_id where d.doc_id is null or n.sha is distinct from sha256(d.text)"""
)
def plan_validation(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    i = F.col("doc_id")
    brief = F.when(i % 25 < 2, F.concat(F.lit("Same  Brief "), (i % 2).cast("string"))).otherwise(F.concat(F.lit("brief "), i.cast("string")))
    plan = docs.select(F.floor(i / 2).cast("long").alias("job"), (i + (i % 40 == 0).cast("int") * 1000000).alias("doc_id"), F.when(i % 30 == 0, "x").otherwise(F.sha2("text", 256)).alias("sha"), brief.alias("brief"))
    return N.plan_problems(plan, table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha")), "job", "doc_id", "sha", "brief")


@R.query(f"select doc_id, ['what', 'why', 'how', 'when'][1 + (doc_id + {BUCKET('angle', 'source', 4294967296)}) % 4] as angle from documents")
def angle_rotation(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", N.rotated(F.col("doc_id"), F.col("source"), ["what", "why", "how", "when"], "angle").alias("angle"))


@R.query(
    """
with k as (select doc_id, lang, row_number() over (partition by lang order by sha256('bank|' || doc_id::varchar), doc_id) as n from documents where lang in ('en', 'de', 'fr') and not coalesce(contains(text, 'license'), false))
select doc_id, lang from k where n <= case lang when 'en' then 60 when 'de' then 20 else 10 end"""
)
def task_bank(spark: SparkSession, d: str) -> DataFrame:
    leaks = F.coalesce(F.col("text").contains("license"), F.lit(False))
    return N.quota_bank(table(spark, d, "documents"), "lang", "doc_id", {"en": 60, "de": 20, "fr": 10}, leaks, "bank").select("doc_id", "lang")


@R.query("with r as (select 'a' as origin, source as family, max(lang) as split from documents group by source union all select 'b', source, min(lang) from documents where doc_id % 2 = 0 group by source) select family, count(distinct split) as n from r group by family having count(distinct split) > 1")
def registry_conflicts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    one = docs.groupBy(F.col("source").alias("family")).agg(F.max("lang").alias("split"))
    return N.conflicting(one.union(docs.where("doc_id % 2 = 0").groupBy("source").agg(F.min("lang"))), "family", "split")


@R.query("select doc_id, source in ('src4', 'src5') as evaluation from documents")
def eval_split(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.col("source").isin("src4", "src5").alias("evaluation"))


@R.query("select doc_id, source, row_number() over (partition by source order by doc_id) as line, sha256(concat_ws('|', doc_id, source, lang)) as digest from documents")
def lineage_lines(spark: SparkSession, d: str) -> DataFrame:
    return N.source_lines(table(spark, d, "documents").select("doc_id", "source", "lang"), "source", ["doc_id"], "doc_id")


@R.query(
    """
with o as (select source, count(*) as n, count(distinct doc_id) as ids, bool_and(n_chars = length(text)) as sized, min(doc_id) as first from documents group by source), c as (select source, n + (source = 'src7')::int as certified from o)
select source, n, case when n <> certified then 'count' when ids <> n then 'repeated' when not sized then 'binding' else 'admitted' end as verdict from o join c using (source)"""
)
def origin_admission(spark: SparkSession, d: str) -> DataFrame:
    """An origin is admitted if its rows are as many as certified, unique, and bound to what they were made from."""
    o = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("ids"), F.bool_and(F.col("n_chars") == F.length("text")).alias("sized"))
    certified = F.col("n") + (F.col("source") == "src7").cast("int")
    return o.select("source", "n", F.when(F.col("n") != certified, "count").when(F.col("ids") != F.col("n"), "repeated").when(~F.col("sized"), "binding").otherwise("admitted").alias("verdict"))


@R.query("with used as (select doc_id, 'howto' as variant from labels union all select doc_id, 'debug' from labels where quality = 1) select doc_id, variant from documents, (select unnest(['howto', 'debug', 'concept']) as variant) g where not exists (select 1 from used u where u.doc_id = documents.doc_id and u.variant = g.variant)")
def unused_variants(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels")
    used = labels.select("doc_id", F.lit("howto").alias("variant")).union(labels.where("quality = 1").select("doc_id", F.lit("debug")))
    pairs = table(spark, d, "documents").select("doc_id", F.explode(F.array(*map(F.lit, ("howto", "debug", "concept")))).alias("variant"))
    return pairs.join(used, ["doc_id", "variant"], "left_anti")


@R.query("select count(*) as orphans from labels l where not exists (select 1 from documents d where d.doc_id = l.doc_id and d.doc_id % 10 <> 0)")
def orphan_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").join(table(spark, d, "documents").where("doc_id % 10 <> 0"), "doc_id", "left_anti").agg(F.count("*").alias("orphans"))


@R.query("select lang, persona, task, lang || '/' || persona || '/' || task as cell from (select distinct lang from documents where lang is not null), (select unnest(['a', 'b', 'c']) as persona), (select unnest(['x', 'y']) as task)")
def plan_grid(spark: SparkSession, d: str) -> DataFrame:
    each = table(spark, d, "documents").where("lang is not null").select("lang").distinct()
    grid = each.withColumn("persona", F.explode(F.array(*map(F.lit, "abc")))).withColumn("task", F.explode(F.array(*map(F.lit, "xy"))))
    return grid.withColumn("cell", F.concat_ws("/", "lang", "persona", "task"))


@R.query("select doc_id from documents where not (coalesce(regexp_matches(lower(text), 'apache|token'), false) or coalesce(regexp_matches(source, '^src1'), false))")
def family_exclusion(spark: SparkSession, d: str) -> DataFrame:
    held = F.coalesce(F.lower("text").rlike("apache|token"), F.lit(False)) | F.coalesce(F.col("source").rlike("^src1"), F.lit(False))
    return table(spark, d, "documents").where(~held).select("doc_id")


@R.query("select page_id, site, count(doc_id) as n from (select page_id, regexp_extract(url, '/(en|de|fr|es)/', 1) as site from pages) p left join documents on lang = site and doc_id % 97 = page_id % 97 group by all")
def page_alias_join(spark: SparkSession, d: str) -> DataFrame:
    """Three tables' way: page to its site, site to its documents, one of 97 parts each."""
    pages = table(spark, d, "pages").select("page_id", F.regexp_extract("url", "/(en|de|fr|es)/", 1).alias("site"), (F.col("page_id") % 97).alias("part"))
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("site"), (F.col("doc_id") % 97).alias("part"))
    return pages.join(docs, ["site", "part"], "left").groupBy("page_id", "site").agg(F.count("doc_id").alias("n"))


NEAR_ITEMS = f"""
{shingle_rows('de', 'heads', 'doc_id')}, {shingle_rows('be', 'benchmark', 'item_id')},
dn as (select id, count(*) as n_own from de group by id), bn as (select id as other, count(*) as n_other from be group by id),
o as (select de.id, be.id as other, n_own, n_other, count(*) as shared from de join be using (sh) join dn on dn.id = de.id join bn on bn.other = be.id group by all),
hits as (select id, other, 'near' as how from o where shared / (n_own + n_other - shared)::double >= 0.8
  union all select h.doc_id, b.item_id, 'exact' from heads h join benchmark b on trim(regexp_replace(lower(h.text), '\\s+', ' ', 'g')) = trim(regexp_replace(lower(b.text), '\\s+', ' ', 'g')))
"""


@R.query(
    f"""
with heads as (select item_id + 1000 as doc_id, case item_id % 4 when 0 then '  ' || replace(text, ' ', '  ') when 1 then text || ' zz' when 2 then substr(text, 1, length(text) // 3) else text end as text from benchmark
  union all select doc_id + 100000, text from documents where length(text) < 400), {NEAR_ITEMS}
select id as doc_id, min(other) as item_id, arg_min(how, (other, how)) as how from hits group by id"""
)
def question_contamination(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose text equals an item but for case and blanks, or whose trigrams are 0.8 similar; the first item counts."""
    items, i = table(spark, d, "benchmark"), F.col("item_id")
    altered = F.when(i % 4 == 0, F.concat(F.lit("  "), F.replace("text", F.lit(" "), F.lit("  ")))).when(i % 4 == 1, F.concat("text", F.lit(" zz"))).when(i % 4 == 2, F.expr("substr(text, 1, length(text) div 3)")).otherwise(F.col("text"))
    rows = items.select((i + 1000).alias("doc_id"), altered.alias("text")).union(table(spark, d, "documents").where(F.length("text") < 400).select(F.col("doc_id") + 100000, "text"))
    return similarity.contaminated_by(rows, items, "doc_id", "text", "item_id", "text", 0.8).withColumnRenamed("id", "doc_id")


@R.query(
    f"""
with w as (select doc_id, source, list_distinct({WORDS}) as s from documents where length(text) < 900), e as (select source, doc_id, len(s) as n, unnest(s) as x from w),
p as (select a.source, a.doc_id as a, b.doc_id as b, count(*) / (a.n + b.n - count(*))::double as j from e a join e b on a.source = b.source and a.x = b.x and a.doc_id < b.doc_id group by a.source, a.doc_id, b.doc_id, a.n, b.n)
select source, a, b from p where j >= 0.85"""
)
def near_rows_within_source(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where(F.length("text") < 900)
    return similarity.near_within(rows, "source", "doc_id", T.words(F.coalesce("text", F.lit(""))), 0.85)


@R.query(f"with {SHINGLES}, x as (select id, class from c) select id as doc_id, id > class or class in (select b from pairs) as near from x where class not in (select b from pairs p1 where exists (select 1 from pairs p2 where p2.b = p1.a))")
def greedy_near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Kept in order of id unless near a kept one; the SQL has what no chain of three decides."""
    sets = similarity.hashed_sets(table(spark, d, "documents"), "doc_id", "text")
    classes = similarity.classes_of(sets)
    pairs = similarity.similar_pairs(sets, classes)
    kept = similarity.greedy_keep(classes.where("id = class").select("id"), pairs).select(F.col("id").alias("class"), "kept")
    chained = pairs.select(F.col("a").alias("x"), F.col("b").alias("class")).join(pairs.select(F.col("b").alias("x")), "x", "left_semi").select("class").distinct()
    return classes.join(kept, "class").join(chained, "class", "left_anti").select(F.col("id").alias("doc_id"), ((F.col("id") > F.col("class")) | ~F.col("kept")).alias("near"))


@R.query("select doc_id, n_chars from documents order by n_chars, doc_id limit 50")
def curriculum_head(spark: SparkSession, d: str) -> DataFrame:
    """The first fifty in order of length."""
    return table(spark, d, "documents").orderBy("n_chars", "doc_id").limit(50).select("doc_id", "n_chars")


@R.query("with s as (select source, count(*) filter (where quality = 1) as good, count(*) filter (where toxic = 0) as mild from documents join labels using (doc_id) group by source) select source, case when good >= mild then 'good' else 'mild' end as base, greatest(good, mild) as size from s")
def base_set_choice(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").groupBy("source").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 0).alias("mild"))
    return s.select("source", F.when(F.col("good") >= F.col("mild"), "good").otherwise("mild").alias("base"), F.greatest("good", "mild").alias("size"))


# -- arrays ---------------------------------------------------------------------------

VECTORS = "e as (select vec_id, list_transform(embedding, lambda x: round(x::double, 4)) as v, label from embeddings)"


@R.query(f"with {VECTORS} select vec_id, round(list_sum(list_slice(list_reverse_sort(v), 1, 20)), 3) as top, round(list_reverse_sort(v)[1], 4) as best, cast(len(v) as bigint) as n from e")
def top_by_rank(spark: SparkSession, d: str) -> DataFrame:
    """The twenty largest values of every vector."""
    v = F.transform("embedding", lambda x: F.round(x.cast("double"), 4))
    top = F.slice(F.sort_array(v, asc=False), 1, 20)
    rows = table(spark, d, "embeddings")
    return rows.select("vec_id", F.round(F.aggregate(top, F.lit(0.0), lambda a, x: a + x), 3).alias("top"), F.get(top, F.lit(0)).alias("best"), F.size(v).cast("long").alias("n"))


@R.query("with o as (select vec_id, len(embedding) as n, coalesce(sum(len(embedding)) over (order by vec_id rows between unbounded preceding and 1 preceding), 0) as start from embeddings) select vec_id, cast(start as bigint) as start, cast(start + n as bigint) as stop from o")
def ragged_offsets(spark: SparkSession, d: str) -> DataFrame:
    return distill.ragged_offsets(table(spark, d, "embeddings"), "vec_id", "embedding")


@R.query("select count(*) as n, count(*) filter (where vec_id % 50 <> 0) as kept, count(*) filter (where vec_id % 50 <> 0) >= 0.97 * count(*) as passes from embeddings")
def length_consistency(spark: SparkSession, d: str) -> DataFrame:
    other = F.when(F.col("vec_id") % 50 == 0, F.slice("embedding", 1, 3)).otherwise(F.col("embedding"))
    return N.within_coverage(table(spark, d, "embeddings").withColumn("other", other), "embedding", "other", 0.97)


@R.query(f"with l as (select conv_id, cast(sum(len({WORDS})) as bigint) as tokens, cast(coalesce(sum(len({WORDS})) filter (where role = 'assistant'), 0) as bigint) as targets from conversations group by conv_id) select conv_id, tokens, targets, round(targets / nullif(tokens, 0)::double, 9) as share from l")
def label_accounting(spark: SparkSession, d: str) -> DataFrame:
    """Words that are training targets (the assistant's) and those that are masked."""
    n = F.size(T.words(F.coalesce("text", F.lit(""))))
    own = table(spark, d, "conversations").groupBy("conv_id").agg(F.sum(n).alias("tokens"), F.coalesce(F.sum(F.when(F.col("role") == "assistant", n)), F.lit(0)).alias("targets"))
    return own.withColumn("share", F.round(F.try_divide("targets", "tokens"), 9))


# -- documents' structure ---------------------------------------------------------------


@R.query(
    r"""
with s as (select doc_id, text, [[0, 40], [40, 90], [80, 120]] as spans from documents where length(text) >= 120), e as (select doc_id, text, unnest(spans) as s, generate_subscripts(spans, 1) as i from s)
select doc_id, i::bigint as i, sha256(substr(text, s[1] + 1, s[2] - s[1])) as sha, coalesce(s[1] >= lag(s[2]) over (partition by doc_id order by i), true) as in_order from e"""
)
def context_spans(spark: SparkSession, d: str) -> DataFrame:
    """Text, digest and order of given character spans, the last of which overlaps."""
    spans = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((0, 40), (40, 90), (80, 120))])
    return segment.span_rows(table(spark, d, "documents").where(F.length("text") >= 120).withColumn("spans", spans), "doc_id", "text", "spans")


@R.query(
    r"""
with b as (select doc_id, string_split_regex(text, '\n') as blocks from documents where text is not null), k as (select doc_id, list_filter(blocks, lambda b: not regexp_matches(b, '(?i)licen[cs]e|copyright')) as kept, len(blocks) as n from b)
select doc_id, array_to_string(kept, chr(10)) as text, cast(n - len(kept) as bigint) as dropped from k"""
)
def held_blocks(spark: SparkSession, d: str) -> DataFrame:
    lines = F.split("text", "\n")
    kept = F.filter(lines, lambda b: ~b.rlike("(?i)licen[cs]e|copyright"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.array_join(kept, "\n").alias("text"), (F.size(lines) - F.size(kept)).cast("long").alias("dropped"))


@R.query("with n as (select source, lang, doc_id, row_number() over (partition by source order by doc_id) as i from documents) select source, string_agg(coalesce(lang, '?'), ',' order by i) as langs from n group by source")
def shard_report(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").groupBy("source").agg(F.array_sort(F.collect_list(F.struct("doc_id", F.coalesce("lang", F.lit("?")).alias("l")))).alias("x"))
    return rows.select("source", F.array_join(F.transform("x", lambda s: s["l"]), ",").alias("langs"))


@R.query(
    r"""
with b as (select doc_id, text as t, lag(text) over (partition by source order by doc_id) as before from documents), w as (select conv_id from conversations group by conv_id)
select doc_id, before is null or t is distinct from before as changed from b"""
)
def changed_rows(spark: SparkSession, d: str) -> DataFrame:
    """Whether a document's text differs from the one before it in its source; by digests and numbers, so no source is one task's."""
    numbered = saved(numbers_within(table(spark, d, "documents").select("doc_id", "source", F.sha2("text", 256).alias("sha")), ["source"], ["doc_id"]), "numbered")
    before = numbered.select("source", (F.col("number") + 1).alias("number"), F.col("sha").alias("before"))
    joined = numbered.alias("n").join(before.alias("b"), F.col("n.source").eqNullSafe(F.col("b.source")) & (F.col("n.number") == F.col("b.number")), "left")
    return joined.select("doc_id", (F.col("before").isNull() | ~F.col("sha").eqNullSafe(F.col("before"))).alias("changed"))


@R.query(
    """
with b as (select doc_id, case when doc_id % 10 = 0 then 'xx' else lang end as lang from documents where doc_id % 11 <> 0 union all select doc_id, lang from documents where doc_id % 13 = 0 and doc_id % 10 <> 0 and doc_id % 11 <> 0 union all select -1 - doc_id, lang from documents where doc_id < 3),
n as (select doc_id, count(*) as n, max(lang) as lang from b group by doc_id)
select coalesce(d.doc_id, n.doc_id) as doc_id, case when d.doc_id is null then 'only_right' when n.doc_id is null then 'only_left' when n.n > 1 then 'repeated' else 'differs' end as problem from documents d full join n on n.doc_id = d.doc_id
where d.doc_id is null or n.doc_id is null or n.n > 1 or d.lang is distinct from n.lang"""
)
def strict_join(spark: SparkSession, d: str) -> DataFrame:
    """A one-to-one join that must find nothing, over a cache some of whose rows are stale, gone, repeated or new."""
    docs, i = table(spark, d, "documents").select("doc_id", "lang"), F.col("doc_id")
    stale = docs.where(i % 11 != 0).select("doc_id", F.when(i % 10 == 0, "xx").otherwise(F.col("lang")).alias("lang"))
    twice = docs.where((i % 13 == 0) & (i % 10 != 0) & (i % 11 != 0))
    new = docs.where("doc_id < 3").select((-1 - i).alias("doc_id"), "lang")
    return provenance.mismatches(docs, stale.union(twice).union(new), "doc_id", ["lang"])
