"""Cleaning documents: keys, duplicates, contamination, quality routing, splits, selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import provenance, segment, select, similarity
from textloom.plans.registry import Registry
from textloom.session import table

R = Registry()
QUERIES, SQL = R.queries, R.sql

WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')"


def shingle_rows(name: str, table_name: str, key: str) -> str:
    """CTE with the different 3-word windows of every row, a shorter text being one window."""
    return f"""
{name}_w as (select {key} as id, {WORDS} as w from {table_name}),
{name}_t as (select id, unnest(w) as x, generate_subscripts(w, 1) as i from {name}_w where len(w) >= 3),
{name} as (select distinct id, sh from (select id, x || ' ' || lead(x, 1) over (partition by id order by i) || ' ' || lead(x, 2) over (partition by id order by i) as sh from {name}_t) where sh is not null
  union all select id, array_to_string(w, ' ') from {name}_w where len(w) < 3)"""


SHINGLES = f"""
{shingle_rows('se', 'documents', 'doc_id')},
sig as (select id, count(*) as n, md5(string_agg(sh, '|' order by sh)) as g from se group by id),
c as (select id, min(id) over (partition by g) as class, n from sig),
e as (select id, n, sh from se join c using (id) where id = class),
pairs as (select a.id as a, b.id as b, count(*) / (a.n + b.n - count(*))::double as similarity
          from e a join e b on a.sh = b.sh and a.id < b.id group by a.id, b.id, a.n, b.n having count(*) / (a.n + b.n - count(*))::double >= 0.8)
"""


@R.query(
    rf"""
select doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) as ascii_norm,
       array_to_string({WORDS}, ' ') as word_norm, substr(regexp_replace(lower(text), '\s+', ' ', 'g'), 1, 1500) as text_key,
       sha256(text) as sha, cast(len({WORDS}) as bigint) as n_words, cast(length(text) as bigint) as n_chars,
       cast(ceil(length(text) / 1500.0) as bigint) as est_chunks
from documents"""
)
def doc_text_keys(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id", T.ascii_norm(t).alias("ascii_norm"), T.word_norm(t).alias("word_norm"), T.text_key(t).alias("text_key"), F.sha2(t, 256).alias("sha"),
        F.size(T.words(t)).cast("long").alias("n_words"), F.length(t).cast("long").alias("n_chars"), F.ceil(F.length(t) / 1500.0).cast("long").alias("est_chunks"),
    )


@R.query(
    """
select doc_id, duplicate_of from (
  select doc_id, case when length(text) > 200 and min(doc_id) over (partition by sha256(text)) < doc_id then min(doc_id) over (partition by sha256(text)) end as duplicate_of
  from documents)"""
)
def doc_exact_dups(spark: SparkSession, d: str) -> DataFrame:
    return similarity.duplicate_of(table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


@R.query(f"with {SHINGLES} select a, b, round(similarity, 9) as similarity from pairs")
def doc_near_dup_pairs(spark: SparkSession, d: str) -> DataFrame:
    return similarity.near_duplicate_pairs(table(spark, d, "documents"), "doc_id", "text").withColumn("similarity", F.round("similarity", 9))


@R.query(f"with {SHINGLES} select id as doc_id, class from c")
def doc_shingle_classes(spark: SparkSession, d: str) -> DataFrame:
    return similarity.classes_of(similarity.hashed_sets(table(spark, d, "documents"), "doc_id", "text")).withColumnRenamed("id", "doc_id")


@R.query(f"with {SHINGLES} select id as doc_id, id > class or class in (select b from pairs) as duplicate from c")
def doc_symmetric_dups(spark: SparkSession, d: str) -> DataFrame:
    return similarity.symmetric_drop(table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


OVERLAP = f"""
{shingle_rows('de', 'documents', 'doc_id')}, {shingle_rows('be', 'benchmark', 'item_id')},
dn as (select id, count(*) as n_own from de group by id), bn as (select id as other, count(*) as n_other from be group by id),
o as (select de.id, be.id as other, n_own, n_other, count(*) as shared from de join be using (sh) join dn on dn.id = de.id join bn on bn.other = be.id group by all)
"""


@R.query(f"with {OVERLAP} select id as doc_id, round(max(shared / n_other::double), 9) as contained, arg_min(other, (-shared / n_other::double, other)) as item_id from o group by id")
def bench_containment(spark: SparkSession, d: str) -> DataFrame:
    o = similarity.overlap_with(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "text", "item_id", "text")
    share = F.col("shared") / F.col("n_other")
    return o.groupBy(F.col("id").alias("doc_id")).agg(F.round(F.max(share), 9).alias("contained"), F.min_by("other", F.struct(-share, "other")).alias("item_id"))


@R.query(f"with {OVERLAP} select id as doc_id, min(other) as first_item from o where shared / (n_own + n_other - shared)::double >= 0.05 group by id")
def bench_near_questions(spark: SparkSession, d: str) -> DataFrame:
    o = similarity.overlap_with(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "text", "item_id", "text")
    return o.where(F.col("shared") / (F.col("n_own") + F.col("n_other") - F.col("shared")) >= 0.05).groupBy(F.col("id").alias("doc_id")).agg(F.min("other").alias("first_item"))


@R.query("select doc_id, item_id from documents d join benchmark b on length(b.text) >= 40 and contains(d.text, b.text)")
def bench_substring_hits(spark: SparkSession, d: str) -> DataFrame:
    return similarity.contained_items(table(spark, d, "documents"), table(spark, d, "benchmark").where(F.length("text") >= 40), "doc_id", "text", "item_id", "text")


CLEAN = f"""
with {SHINGLES}, {OVERLAP},
near as (select distinct id from o where shared / n_other::double >= 0.8)
select doc_id, case when coalesce(text, '') = '' then 'empty' when length(text) > 12000 then 'too_long'
  when c.id > c.class then 'duplicate' when c.class in (select b from pairs) then 'near_duplicate'
  when near.id is not null then 'contaminated' when quality = 0 then 'low_quality' when toxic = 1 then 'toxic' else 'clean' end as reason
from documents join c on c.id = doc_id left join near on near.id = doc_id left join labels using (doc_id)
"""


def clean_reasons(spark: SparkSession, d: str) -> DataFrame:
    """First failing rule of every document, in one case expression over the joined checks."""
    docs = table(spark, d, "documents")
    sets = similarity.hashed_sets(docs, "doc_id", "text")
    classes = similarity.classes_of(sets)
    low = similarity.similar_pairs(sets, classes).select(F.col("b").alias("class")).distinct().withColumn("near", F.lit(True))
    o = similarity.overlap_with(docs, table(spark, d, "benchmark"), "doc_id", "text", "item_id", "text", own=sets)
    hit = o.where(F.col("shared") / F.col("n_other") >= 0.8).select("id").distinct().withColumn("hit", F.lit(True))
    copies = classes.join(low, "class", "left").join(hit, "id", "left").withColumnRenamed("id", "doc_id")
    sizes = docs.select("doc_id", (F.coalesce("text", F.lit("")) == "").alias("empty"), F.length("text").alias("chars"))  # texts stay where they are read
    every = sizes.join(copies, "doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    reason = (
        F.when(F.col("empty"), "empty").when(F.col("chars") > 12000, "too_long").when(F.col("doc_id") > F.col("class"), "duplicate").when(F.col("near"), "near_duplicate")
        .when(F.col("hit"), "contaminated").when(F.col("quality") == 0, "low_quality").when(F.col("toxic") == 1, "toxic").otherwise("clean")
    )
    return every.select("doc_id", reason.alias("reason"))


@R.query(CLEAN)
def doc_reject_reasons(spark: SparkSession, d: str) -> DataFrame:
    return clean_reasons(spark, d)


@R.query(f"select reason, count(*) as n from ({CLEAN}) group by reason")
def doc_clean_report(spark: SparkSession, d: str) -> DataFrame:
    return clean_reasons(spark, d).groupBy("reason").agg(F.count("*").alias("n"))


@R.query(
    """
select coalesce(lang, 'ALL') as lang, coalesce(source, 'ALL') as source, count(*) as n_docs, cast(sum(n_chars) as bigint) as chars,
       cast(count(*) filter (where quality = 1 and toxic = 0) as bigint) as n_good
from documents left join labels using (doc_id) group by rollup (lang, source)"""
)
def lang_source_rollup(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return rows.rollup("lang", "source").agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("chars"), F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("n_good")).select(F.coalesce("lang", F.lit("ALL")).alias("lang"), F.coalesce("source", F.lit("ALL")).alias("source"), "n_docs", "chars", "n_good")


@R.query(
    """
select doc_id, case when quality is null then 'pending' when quality = 1 and toxic = 0 then 'verified' when toxic = 1 then 'rejected:toxic' else 'rejected:quality' end as route
from documents left join labels using (doc_id)"""
)
def doc_label_gate(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    route = F.when(F.col("quality").isNull(), "pending").when((F.col("quality") == 1) & (F.col("toxic") == 0), "verified").when(F.col("toxic") == 1, "rejected:toxic").otherwise("rejected:quality")
    return rows.select("doc_id", route.alias("route"))


BUCKET = "cast('0x' || substr(sha256('{salt}' || doc_id::varchar), 1, 8) as bigint) % 100"


@R.query(f"select doc_id, {BUCKET.format(salt='split-')} as bucket, {BUCKET.format(salt='split-')} < 15 as validation from documents")
def hash_split(spark: SparkSession, d: str) -> DataFrame:
    bucket = T.hash_bucket(F.col("doc_id"), "split-")
    return table(spark, d, "documents").select("doc_id", bucket.alias("bucket"), (bucket < 15).alias("validation"))


@R.query(f"select doc_id, {BUCKET.format(salt='ctx-')} < 80 as with_context, case when {BUCKET.format(salt='ctx-')} < 80 then 'Source: ' || source || chr(10) || text else text end as prompt from documents")
def bucket_sample_80(spark: SparkSession, d: str) -> DataFrame:
    attach = T.hash_bucket(F.col("doc_id"), "ctx-") < 80
    return table(spark, d, "documents").select("doc_id", attach.alias("with_context"), F.when(attach, F.concat(F.lit("Source: "), "source", F.lit("\n"), "text")).otherwise(F.col("text")).alias("prompt"))


@R.query(
    """
with g as (select source as doc, count(*) as n_rows, sha256('s1' || '|' || source) as h from documents group by source),
r as (select *, coalesce(sum(n_rows) over (order by h, doc rows between unbounded preceding and 1 preceding), 0) as before, sum(n_rows) over () as total from g)
select doc, n_rows, before < 0.2 * total as validation from r"""
)
def doc_split_by_source(spark: SparkSession, d: str) -> DataFrame:
    return provenance.split_documents(table(spark, d, "documents"), "source", 0.2, "s1")


@R.query(
    """
select doc_id, source, lang from (
  select *, row_number() over (partition by source, lang order by sha256('q|' || doc_id::varchar), doc_id) as rn from documents) where rn <= 3"""
)
def quota_select(spark: SparkSession, d: str) -> DataFrame:
    return select.hash_sample(table(spark, d, "documents"), ["source", "lang"], "doc_id", 3, "q").select("doc_id", "source", "lang")


@R.query(
    """
with n as (select source, count(*) as avail from documents where lang = 'en' group by source),
l as (select max(x) as level from range(0, (select coalesce(max(avail), 0) + 1 from n)) t(x) where (select sum(least(avail, x)) from n) <= 300)
select coalesce(level, 0) as level from l"""
)
def water_fill_sources(spark: SparkSession, d: str) -> DataFrame:
    available = table(spark, d, "documents").where("lang = 'en'").groupBy("source").agg(F.count("*").alias("avail"))
    return select.water_level(available, "avail", 300)


@R.query(
    """
with n as (select source, least(count(*), 40) as c from documents group by source)
select source, cast(greatest(0, least(c, 500 - coalesce(sum(c) over (order by source rows between unbounded preceding and 1 preceding), 0))) as bigint) as take from n"""
)
def capped_sources(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("c"))
    return select.capped_allocation(counts, "source", "c", 40, 500)


@R.query("select doc_id, row_number() over (order by doc_id) - 1 as number, cast(floor((row_number() over (order by doc_id) - 1) / 25) as bigint) as unit, (row_number() over (order by doc_id) - 1) % 7 as shard from documents")
def pack_units(spark: SparkSession, d: str) -> DataFrame:
    n = select.dense_numbers(table(spark, d, "documents").select("doc_id"), ["doc_id"])
    return n.select("doc_id", "number", select.units(F.col("number"), 25).alias("unit"), select.round_robin(F.col("number"), 7).alias("shard"))


@R.query(
    """
with kind as (select doc_id, case when n_chars < 1500 then 'short' else 'long' end as kind from documents),
k as (select least((select count(*) from kind where kind = 'short') // 7, (select count(*) from kind where kind = 'long') // 3) as k)
select doc_id, kind from (select *, row_number() over (partition by kind order by sha256('mix|' || doc_id::varchar), doc_id) as rn from kind), k where rn <= case when kind = 'short' then 7 * k else 3 * k end"""
)
def prose_tool_balance(spark: SparkSession, d: str) -> DataFrame:
    kind = table(spark, d, "documents").select("doc_id", F.when(F.col("n_chars") < 1500, "short").otherwise("long").alias("kind"))
    k = kind.agg(F.floor(F.least(F.count_if(F.col("kind") == "short") / 7, F.count_if(F.col("kind") == "long") / 3)).alias("k"))
    quota = k.select(F.explode(F.array(F.struct(F.lit("short").alias("kind"), (7 * F.col("k")).alias("quota")), F.struct(F.lit("long").alias("kind"), (3 * F.col("k")).alias("quota")))).alias("q")).select("q.*")
    numbered = select.dense_numbers(kind.withColumn("order", T.hash_order(F.col("doc_id"), salt="mix")), ["kind", "order", "doc_id"])
    first = numbered.groupBy("kind").agg(F.min("number").alias("first")).join(quota, "kind")  # two rows
    return numbered.join(F.broadcast(first), "kind").where(F.col("number") - F.col("first") < F.col("quota")).select("doc_id", "kind")


@R.query(
    """
with new as (select doc_id, text from documents where doc_id % 5 = 0), old as (select doc_id, text from documents where doc_id % 5 <> 0 and sha256(text) not in (select sha256(text) from new)),
r as (select *, row_number() over (order by sha256('replay|' || doc_id::varchar), doc_id) as rn from old)
select doc_id, 'new' as origin from new union all select doc_id, 'replay' from r where rn <= (select count(*) from new) * 0.5"""
)
def replay_mix(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    new, rest = docs.where("doc_id % 5 = 0"), docs.where("doc_id % 5 <> 0")
    old = rest.join(new, "sha", "left_anti").withColumn("order", T.hash_order(F.col("doc_id"), salt="replay"))
    n = new.agg((F.count("*") * 0.5).alias("n"))
    ranked = select.dense_numbers(old, ["order", "doc_id"])
    return new.select("doc_id", F.lit("new").alias("origin")).union(ranked.join(F.broadcast(n), F.col("number") + 1 <= F.col("n")).select("doc_id", F.lit("replay").alias("origin")))


@R.query("select doc_id, 'doc' as origin, length(text) as chars from documents union all select item_id, 'bench', length(text) from benchmark")
def union_origin(spark: SparkSession, d: str) -> DataFrame:
    one = table(spark, d, "documents").select("doc_id", F.lit("doc").alias("origin"), F.length("text").cast("long").alias("chars"))
    return one.unionByName(table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit("bench").alias("origin"), F.length("text").cast("long").alias("chars")))


@R.query("select doc_id from documents where not exists (select 1 from labels l where l.doc_id = documents.doc_id)")
def anti_resume(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id")


@R.query("select doc_id from documents where doc_id in (select doc_id from labels where quality = 1)")
def semi_scored(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").join(table(spark, d, "labels").where("quality = 1"), "doc_id", "left_semi").select("doc_id")


@R.query(
    r"""
select doc_id, case when length(text) <= 900 then text else substr(text, 1, 300) || chr(10) || '[... ' || (length(text) - 900)::varchar || ' characters left out ...]' || chr(10) || right(text, 600) end as excerpt,
       cast(greatest(8000, least(40000, 48000 - 3 * length(text))) as bigint) as budget,
       length(list_filter(range(20, 401), lambda p: length(text) >= 6 * p and right(text, 6 * p) = repeat(right(text, p), 6))) > 0 as looping
from documents"""
)
def doc_excerpts(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", T.head_and_tail(t, 300, 600).alias("excerpt"), T.excerpt_budget(3 * F.length(t)).cast("long").alias("budget"), T.ends_in_loop(t).alias("looping"))


@R.query(
    r"""
select doc_id, cast(len(list_intersect(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+'), ['the', 'token', 'apache', 'license', 'und', 'que'])) as bigint) as relevance, regexp_matches(text, '(?i)licensed? under|all rights reserved') as boilerplate,
  case when regexp_matches(text, '(?i)apache license|MIT license|BSD license') then 'permissive' when regexp_matches(text, '(?i)gnu general public|copyleft') then 'copyleft' when regexp_matches(text, '(?i)non-?commercial|CC BY-NC') then 'non_commercial' when regexp_matches(text, '(?i)licen[cs]e') then 'other' else 'unspecified' end as licence
from documents"""
)
def doc_licences(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    licence = F.when(t.rlike(r"(?i)apache license|MIT license|BSD license"), "permissive").when(t.rlike(r"(?i)gnu general public|copyleft"), "copyleft").when(t.rlike(r"(?i)non-?commercial|CC BY-NC"), "non_commercial").when(t.rlike(r"(?i)licen[cs]e"), "other").otherwise("unspecified")
    return table(spark, d, "documents").select("doc_id", F.size(F.array_intersect(T.words(t), F.array(*map(F.lit, ("the", "token", "apache", "license", "und", "que"))))).cast("long").alias("relevance"), t.rlike("(?i)licensed? under|all rights reserved").alias("boilerplate"), licence.alias("licence"))


def chunk_sql(limit: int, kept: str) -> str:
    """Blank-line blocks (none of the texts has a fence) cut at limit and packed up to it; `kept` says which chunks stay."""
    return rf"""
with b as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '\n(?:[\t-\r ]*\n)+'), lambda x: trim(x, chr(10)) <> '') as bs from documents), p as (select doc_id, flatten(list_transform(bs, lambda b: list_transform(range(0, greatest(1, (length(b) + {limit - 1}) // {limit})), lambda i: substr(b, (1 + {limit} * i)::bigint, {limit})))) as ps from b),
c as (select doc_id, list_reduce(list_transform(ps, lambda x: [x]), lambda a, x: case when length(a[-1]) + 2 + length(x[1]) <= {limit} then list_concat(a[1:-2], [a[-1] || chr(10) || chr(10) || x[1]]) else list_concat(a, x) end) as found from p where len(ps) > 0), k as (select doc_id, {kept} as cs from c)
select doc_id, doc_id || '#' || (i - 1) as chunk_id, text from (select doc_id, unnest(cs) as text, generate_subscripts(cs, 1) as i from k)"""


@R.query(chunk_sql(1500, "found"))
def doc_chunks(spark: SparkSession, d: str) -> DataFrame:
    return segment.chunks(table(spark, d, "documents"), "doc_id", "text", 1500, cut_long=True)


@R.query(chunk_sql(2200, "list_filter(found, lambda x: length(x) >= 200)"))
def index_chunks(spark: SparkSession, d: str) -> DataFrame:
    """For an index: longer chunks, none under 200 characters."""
    return segment.chunks(table(spark, d, "documents"), "doc_id", "text", 2200, cut_long=True, least=200)


@R.query(chunk_sql(2200, "case when len(found) = 1 and length(found[1]) between 20 and 79 then found else list_filter(found, lambda x: length(x) >= 80) end"))
def note_chunks(spark: SparkSession, d: str) -> DataFrame:
    """For users' notes: a single short one stays."""
    return segment.chunks(table(spark, d, "documents"), "doc_id", "text", 2200, cut_long=True, least=80, single=20)


@R.query(
    """
with l as (select doc_id, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {'n': 0, 'open': length(x), 'longest': 0}) as l from documents),
f as (select doc_id, list_reduce(l, lambda a, x: case when a.n > 0 and a.open + 1 + x.open <= 600 then {'n': a.n, 'open': a.open + 1 + x.open, 'longest': greatest(a.longest, a.open + 1 + x.open)} else {'n': a.n + 1, 'open': x.open, 'longest': greatest(a.longest, x.open)} end, {'n': 0, 'open': 0, 'longest': 0}) as f from l)
select doc_id, cast(f.n as bigint) as n_chunks, cast(f.longest as bigint) as longest from f"""
)
def doc_line_chunks(spark: SparkSession, d: str) -> DataFrame:
    return segment.line_chunks(table(spark, d, "documents"), "doc_id", "text")


ABBREVIATED = r"(?:^|[^\p{L}\p{N}_])(?:e\.g|i\.e|etc|cf|vs|Dr|Mr|Mrs|Fig|No|[A-Z])\.\s|`|\n\n|\n\s*(?:[-*#]|[0-9]+[.)])\s"


@R.query(
    rf"""
with m as (select doc_id, text, case when regexp_matches(text, '{ABBREVIATED}') then null else string_split(regexp_replace(text, '([.!?]\s+)([A-ZÀ-Ý"(])', '\1' || chr(1) || '\2', 'g'), chr(1)) end as s from documents where coalesce(text, '') <> '')
select doc_id, sha256(text) as whole, case when s is not null then array_to_string(list_transform(s, lambda x: length(x)), ',') end as sizes from m"""
)
def doc_span_cover(spark: SparkSession, d: str) -> DataFrame:
    """The spans' texts, joined, are the text; their lengths, but for texts with abbreviations, code or lists, which SQL can't cut."""
    spans = table(spark, d, "documents").where(F.coalesce("text", F.lit("")) != "").select("doc_id", "text", segment.exact_cover(F.col("text")).alias("s"))
    whole = F.array_join(F.transform("s", lambda s: F.substr("text", s["start"] + 1, s["end"] - s["start"])), "")
    sizes = F.array_join(F.transform("s", lambda s: (s["end"] - s["start"]).cast("string")), ",")
    return spans.select("doc_id", F.sha2(whole, 256).alias("whole"), F.when(~F.col("text").rlike(ABBREVIATED), sizes).alias("sizes"))


DIGITS = ", ".join(f"cast(sum(cast('0x' || substr(sha, {1 + 8 * i}, 8) as bigint)) as varchar)" for i in range(4))


@R.query(f"with s as (select sha256(concat_ws(chr(1), coalesce(doc_id::varchar, chr(2)), coalesce(text, chr(2)))) as sha from documents) select count(*) as n_rows, sha256(concat_ws(',', {DIGITS})) as fingerprint from s")
def doc_fingerprint_rows(spark: SparkSession, d: str) -> DataFrame:
    return provenance.fingerprint(table(spark, d, "documents"), "doc_id", "text")
