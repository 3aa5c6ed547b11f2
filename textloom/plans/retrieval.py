"""BM25 over documents, with benchmark items as questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import retrieval as J
from textloom.operators.similarity import contained_items
from textloom.plans.registry import Registry
from textloom.session import table

R = Registry()
QUERIES, SQL = R.queries, R.sql

STOP = ", ".join(f"'{w}'" for w in J.STOP_WORDS)
BM25 = f"""
tok as (select doc_id as chunk, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) as term from documents),
post as (select term, chunk, count(*) * 1.0 as tf from tok group by all),
dl as (select chunk, sum(tf) as dl from post group by chunk),
tot as (select avg(dl) as avgdl, count(*)::double as n from dl),
qt as (select distinct item_id as q, term from (select item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) as term from benchmark) where length(term) > 2 and term not in ({STOP})),
df as (select term, count(*) as df from post group by term),
sc as (select q, chunk, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) as score
       from qt join post using (term) join df using (term) join dl using (chunk), tot group by q, chunk),
rk as (select *, row_number() over (partition by q order by round(score, 9) desc, chunk) as rank from sc)
"""


def _hits(spark: SparkSession, d: str, k: int) -> DataFrame:
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("q"), J.query_terms(F.col("text")).alias("terms"))
    return J.ranked(J.search(table(spark, d, "documents"), "doc_id", "text", queries), k)


@R.query(f"with {BM25} select q, chunk, rank, round(score, 6) as score from rk where rank <= 8")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d, 8).select("q", "chunk", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@R.query(
    f"""
with tok as (select page_id as chunk, unnest(regexp_extract_all(lower(html), '[a-z0-9_]+')) as term, 1.0 as w from pages
  union all select page_id, unnest(regexp_extract_all(lower(url), '[a-z0-9_]+')), 2.0 from pages),
post as (select term, chunk, sum(w) as tf from tok group by all), dl as (select chunk, sum(tf) as dl from post group by chunk),
tot as (select avg(dl) as avgdl, count(*)::double as n from dl), df as (select term, count(*) as df from post group by term),
qt as (select distinct item_id as q, term from (select item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) as term from benchmark) where length(term) > 2 and term not in ({STOP})),
sc as (select q, chunk, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) as score from qt join post using (term) join df using (term) join dl using (chunk), tot group by q, chunk)
select q, chunk, rank from (select *, row_number() over (partition by q order by round(score, 9) desc, chunk) as rank from sc) where rank <= 5"""
)
def bm25_weighted(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages")
    post = J.weighted_postings([J.postings(pages, "page_id", "html"), J.postings(pages, "page_id", "url", 2.0)])
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("q"), J.query_terms(F.col("text")).alias("terms"))
    return J.ranked(J.bm25(post, queries), 5).select("q", "chunk", F.col("rank").cast("long").alias("rank"))


@R.query("with t as (select distinct doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) as term from documents) select term, count(*) as df from t group by term having count(*) > 1")
def term_df(spark: SparkSession, d: str) -> DataFrame:
    post = J.postings(table(spark, d, "documents"), "doc_id", "text")
    return post.groupBy("term").agg(F.count("*").alias("df")).where("df > 1")


@R.query(
    f"""
with {BM25}, g as (select item_id as q, doc_id as chunk from benchmark b join documents d on contains(d.text, b.text)),
b as (select g.q, min(rank) as best from g left join rk on rk.q = g.q and rk.chunk = g.chunk and rank <= 50 group by g.q)
select count(*) as n, avg((coalesce(best, 999) <= 3)::int) as hit_at_3, avg((coalesce(best, 999) <= 8)::int) as hit_at_8, avg((coalesce(best, 999) <= 50)::int) as hit_at_50 from b"""
)
def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    held = contained_items(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "text", "item_id", "text")
    gold = held.select(F.col("item_id").alias("q"), F.col("doc_id").alias("chunk"))
    return J.recall_at(_hits(spark, d, 50), gold, (3, 8, 50))


@R.query(f"with {BM25} select q, string_agg('Source: ' || source || chr(10) || substr(text, 1, 400), chr(10) || chr(10) order by rank) as context from rk join documents on chunk = doc_id where rank <= 3 group by q")
def context_blocks(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "documents").select("doc_id", "source", F.substring("text", 1, 400).alias("text"))
    return J.context(_hits(spark, d, 3), chunks, "doc_id", "text", "source")


FACETS = "f as (select rk.q, rk.chunk, rk.rank, list_distinct(list_filter([lang, source], lambda x: x is not null)) as fs from rk join documents on doc_id = chunk where rank <= 32)"


@R.query(
    f"""
with {BM25}, {FACETS}, p1 as (select q, arg_min(chunk, (-len(fs), rank, chunk)) as chunk from f group by q), c1 as (select p1.q, [p1.chunk] as gone, fs as covered from p1 join f using (q, chunk)),
p2 as (select f.q, arg_min(chunk, (-len(list_filter(fs, lambda x: not list_contains(covered, x))), rank, chunk)) as chunk from f join c1 on c1.q = f.q and not list_contains(gone, chunk) group by f.q),
c2 as (select p2.q, list_append(gone, p2.chunk) as gone, list_concat(covered, fs) as covered from p2 join f using (q, chunk) join c1 on c1.q = p2.q),
p3 as (select f.q, arg_min(chunk, (-len(list_filter(fs, lambda x: not list_contains(covered, x))), rank, chunk)) as chunk from f join c2 on c2.q = f.q and not list_contains(gone, chunk) group by f.q)
select q, chunk, 1 as pick from p1 union all select q, chunk, 2 from p2 union all select q, chunk, 3 from p3"""
)
def facet_cover(spark: SparkSession, d: str) -> DataFrame:
    facets = table(spark, d, "documents").select(F.col("doc_id").alias("chunk"), F.explode(F.array("lang", "source")).alias("facet"))
    return J.facet_cover(_hits(spark, d, 32), facets)


@R.query(
    f"""
with recursive {BM25}, s as (select q, rank, length(text)::bigint as chars from rk join documents on doc_id = chunk where rank <= 32),
g as (select q, 0::bigint as i, 0::bigint as used, []::bigint[] as taken from (select distinct q from s) union all
  select g.q, i + 1, case when chars is not null and used + chars <= 12000 then used + chars else used end, case when chars is not null and used + chars <= 12000 then list_append(taken, s.rank) else taken end from g left join s on s.q = g.q and s.rank = g.i + 1 where i < 32)
select g.q, s.rank, s.chars from g join s on s.q = g.q and list_contains(g.taken, s.rank) where i = 32"""
)
def budget_pick(spark: SparkSession, d: str) -> DataFrame:
    from textloom.operators.select import skip_not_stop

    sized = _hits(spark, d, 32).join(table(spark, d, "documents").select(F.col("doc_id").alias("chunk"), F.length("text").alias("chars")), "chunk")
    return skip_not_stop(sized, "q", "rank", "chars", 12000)
