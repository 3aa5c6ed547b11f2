"""Searches on an index kept in files, with benchmark items as questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import retrieval as J
from textloom.plans.registry import Registry
from textloom.plans.retrieval import STOP
from textloom.session import fresh_path, table
from textloom.sources.postings import StoredIndex

R = Registry()
QUERIES, SQL = R.queries, R.sql

TEXT = r"regexp_replace(regexp_replace(html, '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')"
QUESTIONS = f"qt as (select distinct item_id as q, term from (select item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) as term from benchmark) where length(term) > 2 and term not in ({STOP}))"
#: Ranks over a CTE c(chunk, text).
RANKS = """
tok as (select chunk, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) as term from c), post as (select term, chunk, count(*)::double as tf from tok group by all), dl as (select chunk, sum(tf) as dl from post group by all),
tot as (select avg(dl) as avgdl, count(*)::double as n from dl), df as (select term, count(*) as df from post group by term),
sc as (select q, chunk, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) as score from qt join post using (term) join df using (term) join dl using (chunk), tot group by q, chunk)
select q, chunk, round(score, 6) as score, row_number() over (partition by q order by round(score, 9) desc, chunk) as rank from sc qualify rank <= 10
"""


def pages(spark: SparkSession, d: str) -> DataFrame:
    plain = F.regexp_replace(F.regexp_replace("html", r"(?s)<[^>]*>", " "), r"\s+", " ")
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), plain.alias("text"))


def questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("q"), J.query_terms(F.col("text")).alias("terms"))


def found(index: StoredIndex, queries: DataFrame) -> DataFrame:
    return index.search(queries, 10).select("q", "chunk", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@R.query(f"with {QUESTIONS}, c as (select page_id as chunk, {TEXT} as text from pages), {RANKS}")
def index_search(spark: SparkSession, d: str) -> DataFrame:
    """The ten best pages of each question from a stored index of all pages."""
    index = StoredIndex(spark, fresh_path(spark, "index"), 8).write(pages(spark, d), "page_id", "text", "host")
    return found(index, questions(spark, d))


def versions(host_of: str) -> str:
    return f"(ascii(substr({host_of}, 1, 1)) % 5)"


def version(host: Column) -> Column:
    return F.ascii(F.substring(host, 1, 1)) % 5


UPSERTS = f"""
with {QUESTIONS}, p as (select page_id, {TEXT} as text, {versions("regexp_extract(url, '^https?://([^/]+)', 1)")} as v from pages),
c as (select page_id as chunk, text from p where v not in (1, 2) union all select page_id + 1000000, 'revised ' || substr(text, 1, 400) from p where v = 1 union all select page_id, text || ' ' || reverse(text) from p where v = 2), {RANKS}
"""


def upserted(spark: SparkSession, d: str) -> StoredIndex:
    """An index of all pages, then three upserts of whole hosts: shortened, replaced again, and lengthened under the same keys."""
    p = pages(spark, d)
    index = StoredIndex(spark, fresh_path(spark, "index"), 8).write(p, "page_id", "text", "host")
    one, two = p.where(version(F.col("host")) == 1), p.where(version(F.col("host")) == 2)
    index.upsert(one.withColumn("page_id", F.col("page_id") + 500_000).withColumn("text", F.upper("text")), "page_id", "text", "host")
    index.upsert(one.withColumn("page_id", F.col("page_id") + 1_000_000).withColumn("text", F.concat(F.lit("revised "), F.substring("text", 1, 400))), "page_id", "text", "host")
    return index.upsert(two.withColumn("text", F.concat("text", F.lit(" "), F.reverse("text"))), "page_id", "text", "host")


@R.query(UPSERTS)
def index_after_upserts(spark: SparkSession, d: str) -> DataFrame:
    """Ranks after three upserts are those of an index built afresh."""
    return found(upserted(spark, d), questions(spark, d))


@R.query(UPSERTS)
def index_merged(spark: SparkSession, d: str) -> DataFrame:
    """The same from one segment that all segments were merged into."""
    return found(upserted(spark, d).merged(fresh_path(spark, "merged")), questions(spark, d))
