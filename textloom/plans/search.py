"""Search plans over pages, with benchmark items as questions: routing, slots, merging, budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import plans as P
from textloom.operators import retrieval as J
from textloom.plans.registry import Registry
from textloom.plans.retrieval import STOP
from textloom.session import saved, table

R = Registry()
QUERIES, SQL = R.queries, R.sql

TEXT = r"regexp_replace(regexp_replace(html, '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')"
SITE = "regexp_extract(url, '/(en|de|fr|es)/', 1)"


def index(name: str, where: str) -> str:
    """CTEs of one index over the pages that meet a condition; <name>_rk has its scored and ranked hits."""
    n = name
    return f"""
{n}_tok as (select page_id as chunk, unnest(regexp_extract_all(lower({TEXT}), '[a-z0-9_]+')) as term from pages where {where}),
{n}_post as (select term, chunk, count(*) * 1.0 as tf from {n}_tok group by all), {n}_dl as (select chunk, sum(tf) as dl from {n}_post group by chunk),
{n}_tot as (select avg(dl) as avgdl, count(*)::double as n from {n}_dl), {n}_df as (select term, count(*) as df from {n}_post group by term),
{n}_sc as (select q, chunk, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) as score from qt join {n}_post using (term) join {n}_df using (term) join {n}_dl using (chunk), {n}_tot group by q, chunk),
{n}_rk as (select *, row_number() over (partition by q order by round(score, 9) desc, chunk) as rank from {n}_sc)"""


QUESTIONS = f"qt as (select distinct item_id as q, term from (select item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) as term from benchmark) where length(term) > 2 and term not in ({STOP}))"


def pages(spark: SparkSession, d: str) -> DataFrame:
    plain = F.regexp_replace(F.regexp_replace("html", r"(?s)<[^>]*>", " "), r"\s+", " ")
    return table(spark, d, "pages").select(F.col("page_id").alias("chunk"), "url", plain.alias("text"), F.regexp_extract("url", "/(en|de|fr|es)/", 1).alias("site"))


def scores(spark: SparkSession, d: str, chunks: DataFrame) -> DataFrame:
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("q"), J.query_terms(F.col("text")).alias("terms"))
    return J.search(chunks, "chunk", "text", queries)


def hits(spark: SparkSession, d: str, chunks: DataFrame, k: int) -> DataFrame:
    return saved(J.ranked(scores(spark, d, chunks), k), "hits")


@R.query(f"with {QUESTIONS}, {index('r', SITE + " in ('en', 'de')")}, s as (select r_rk.*, {SITE} as site from r_rk join pages on page_id = chunk), w as (select *, case when q % 2 = 0 then 'en' else 'de' end as wanted from s) select q, chunk, row_number() over (partition by q order by rank) as place from w where site = wanted qualify row_number() over (partition by q order by rank) <= 5")
def site_search(spark: SparkSession, d: str) -> DataFrame:
    """The five best pages of the site that a question is routed to: even ones to one, odd ones to another."""
    own = pages(spark, d).where("site in ('en', 'de')")
    wanted = F.when(F.col("q") % 2 == 0, "en").otherwise("de")
    routed = scores(spark, d, own).join(own.select("chunk", "site"), "chunk").where(F.col("site") == wanted)
    return J.ranked(routed, 5).select("q", "chunk", F.col("rank").cast("long").alias("place"))


REPEATS = rf"""
{index('a', 'true')}, top as (select q, chunk, rank, {TEXT} as text from a_rk join pages on page_id = chunk where rank <= 32),
tw as (select q, rank, chunk, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') as w from top),
ts as (select q, rank, chunk, list_distinct(list_transform(range(1, greatest(1, len(w) - 4) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) as s from tw),
te as (select q, rank, len(s) as n, unnest(s) as x from ts),
nr as (select a.q, b.rank, a.rank as earlier from te a join te b on a.q = b.q and a.x = b.x and a.rank < b.rank group by a.q, b.rank, a.rank, a.n, b.n having count(*) / (a.n + b.n - count(*))::double >= 0.6),
nl as (select q, rank, list(earlier) as near from nr group by all),
ord as (select ts.q, ts.rank, ts.chunk, coalesce(near, []) as near from ts left join nl on nl.q = ts.q and nl.rank = ts.rank),
fold as (select q, 0::bigint as i, []::bigint[] as kept from (select distinct q from ord) union all
  select f.q, f.i + 1, case when o.rank is not null and len(f.kept) < 8 and len(list_intersect(f.kept, o.near)) = 0 then list_append(f.kept, o.rank) else f.kept end from fold f left join ord o on o.q = f.q and o.rank = f.i + 1 where f.i < 32),
dedup as (select o.q, o.chunk, o.rank from fold f join ord o on o.q = f.q and list_contains(f.kept, o.rank) where f.i = 32)
"""


def deduplicated(spark: SparkSession, d: str, wide: DataFrame, take: int = 8) -> DataFrame:
    return P.without_repeats(wide.select("q", "chunk", "rank"), pages(spark, d).select("chunk", "text"), take)


@R.query(f"with recursive {QUESTIONS}, {REPEATS} select q, chunk, rank from dedup")
def search_without_repeats(spark: SparkSession, d: str) -> DataFrame:
    return deduplicated(spark, d, hits(spark, d, pages(spark, d), 32))


MANUAL = "manual as (select q, chunk, rank from (select q, chunk, row_number() over (partition by q order by round(score, 9) desc, chunk) as rank from a_sc join pages on page_id = chunk where contains(url, '.org')) where rank <= 2)"


@R.query(
    f"""
with recursive {QUESTIONS}, {REPEATS}, {MANUAL}, u as (select q, chunk, 0 as part, rank from dedup where true qualify row_number() over (partition by q order by rank, chunk) <= 2 union all select q, chunk, 1, rank from manual where rank <= 1
  union all select q, chunk, 2, rank from dedup), o as (select q, chunk, min((part, rank)) as o from u group by all)
select q, chunk, row_number() over (partition by q order by o, chunk) as place from o qualify row_number() over (partition by q order by o, chunk) <= 5"""
)
def search_variant(spark: SparkSession, d: str) -> DataFrame:
    """Wide, without repeats: two hits, one manual page, then the other hits, five in all."""
    all_scores = saved(scores(spark, d, pages(spark, d)), "scores")
    best = saved(deduplicated(spark, d, J.ranked(all_scores, 32)), "deduplicated")
    manual = J.ranked(all_scores.join(pages(spark, d).where(F.col("url").contains(".org")).select("chunk"), "chunk"), 2)
    return P.in_slots([(best, 2), (manual, 1), (best, None)], 5)


@R.query(
    f"""
with {QUESTIONS}, {index('x', 'page_id % 2 = 0')}, {index('y', 'page_id % 2 = 1')}, u as (select q, 'even' as origin, chunk, score from x_rk union all select q, 'odd', chunk, score from y_rk)
select q, origin, chunk, row_number() over (partition by q order by round(score, 9) desc, origin, chunk) as rank from u qualify row_number() over (partition by q order by round(score, 9) desc, origin, chunk) <= 6"""
)
def search_merged(spark: SparkSession, d: str) -> DataFrame:
    """Two indexes, each with statistics of its own, by score."""
    p = pages(spark, d)
    return P.merged([("even", scores(spark, d, p.where("chunk % 2 = 0"))), ("odd", scores(spark, d, p.where("chunk % 2 = 1")))], 6)


@R.query(
    f"""
with recursive {QUESTIONS}, {index('x', 'page_id % 5 = 0')}, {index('y', 'page_id % 5 <> 0')},
u as (select q, chunk, 0 as part, rank from x_rk where rank <= 4 union all select q, chunk, 1, rank from y_rk where rank <= 8), p as (select q, chunk, row_number() over (partition by q order by part, rank, chunk) as place from u),
s as (select q, place, length({TEXT})::bigint as size from p join pages on page_id = chunk),
f as (select q, 0::bigint as i, 0::bigint as used, []::bigint[] as taken from (select distinct q from s) union all
  select f.q, i + 1, case when s.size is not null and used + s.size <= 9000 then used + s.size else used end, case when s.size is not null and used + s.size <= 9000 then list_append(taken, s.place) else taken end from f left join s on s.q = f.q and s.place = f.i + 1 where i < 12)
select f.q, s.place, s.size from f join s on s.q = f.q and list_contains(f.taken, s.place) where i = 12"""
)
def own_documents_first(spark: SparkSession, d: str) -> DataFrame:
    p = pages(spark, d)
    own, general = hits(spark, d, p.where("chunk % 5 = 0"), 4), hits(spark, d, p.where("chunk % 5 <> 0"), 8)
    return P.own_first(own, general, p.select("chunk", F.length("text").cast("long").alias("size")), 9000)


@R.query(
    f"""
with {QUESTIONS}, {index('a', 'true')}, c as (select *, case when q % 3 = 0 then 2 else 1 end as slots from a_rk join pages on page_id = chunk),
m as (select q, chunk, rank, slots, row_number() over (partition by q order by rank) as n from c where {SITE} = 'en'), u as (select q, chunk, 0 as part, rank from m where n <= slots union all select q, chunk, 1, rank from a_rk where rank <= 6), o as (select q, chunk, min((part, rank)) as o from u group by all)
select q, chunk, row_number() over (partition by q order by o, chunk) as place from o qualify row_number() over (partition by q order by o, chunk) <= 4"""
)
def command_slots(spark: SparkSession, d: str) -> DataFrame:
    """One or two slots for the command's own pages (of one site), then the best of all."""
    all_scores = saved(scores(spark, d, pages(spark, d)), "scores")
    wide = J.ranked(all_scores, 6)
    own = J.ranked(all_scores.join(pages(spark, d).where("site = 'en'").select("chunk"), "chunk"), 2).where(F.col("rank") <= F.when(F.col("q") % 3 == 0, 2).otherwise(1))
    # the ranks of the own pages are among themselves, which keeps their order
    return P.in_slots([(own, None), (wide, None)], 4)


TITLE = r"trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1))"


@R.query(
    rf"""
with m as (select item_id, page_id, list_distinct(regexp_extract_all(lower({TITLE}), '[a-z0-9_]+')) as w, regexp_extract_all(lower({TITLE}), '[a-z0-9_]+') as t, regexp_extract_all(lower(text), '[a-z0-9_]+') as a from benchmark join pages on page_id = item_id % 50),
s as (select item_id, page_id, len(list_intersect(w, a)) / nullif(len(w), 0)::double as share, len(list_filter(t[1:1], lambda x: not list_contains(a, x))) as missing from m)
select item_id, page_id, round(share, 9) as share, coalesce(share >= 0.5, false) and missing = 0 as matched, (select count(*) from documents where contains(text, 'th ' || (item_id % 10)::varchar)) > 0 as phrase from s"""
)
def manual_matches(spark: SparkSession, d: str) -> DataFrame:
    """A question against one manual's title, whose first word is its name; and whether any document has a phrase."""
    page = table(spark, d, "pages").select("page_id", F.trim(F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"))
    both = table(spark, d, "benchmark").withColumn("page_id", F.col("item_id") % 50).join(page, "page_id")
    names = F.slice(F.array_distinct(T.matches(F.lower("title"), "[a-z0-9_]+")), 1, 1)
    share, matched = P.manual_match(F.col("text"), F.col("title"), names)
    # ten phrases at most: one pass over the documents counts them all
    probe = table(spark, d, "documents").agg(*[F.count_if(F.col("text").contains(f"th {i}")).alias(str(i)) for i in range(10)])
    counts = probe.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(str(i)).alias("n")) for i in range(10)])).alias("p")).select("p.*")
    return both.select("item_id", "page_id", F.round(share, 9).alias("share"), matched.alias("matched")).withColumn("i", F.col("item_id") % 10).join(F.broadcast(counts), "i").select("item_id", "page_id", "share", "matched", (F.col("n") > 0).alias("phrase"))


@R.query(
    r"""
with t as (select doc_id, source, 'Ask about ' || coalesce(lang, '?') || case when doc_id % 7 = 0 then ' as above' else '' end || chr(10) || 'EXCERPT: ' || substr(text, 1, 50) as text, cast('0x' || substr(sha256('closed-' || doc_id::varchar), 1, 8) as bigint) % 100 < 35 as chosen from documents where text is not null),
q as (select *, trim(regexp_replace(text, '(?s)EXCERPT:.*', '')) as question from t)
select doc_id, case when chosen and regexp_matches(question, 'en|de') and not regexp_matches(lower(question), 'excerpt|above|below') then question else text end as prompt from q"""
)
def closed_book_rows(spark: SparkSession, d: str) -> DataFrame:
    above = F.when(F.col("doc_id") % 7 == 0, " as above").otherwise("")
    text = F.concat(F.lit("Ask about "), F.coalesce("lang", F.lit("?")), above, F.lit("\nEXCERPT: "), F.substring("text", 1, 50))
    chosen = T.hash_bucket(F.col("doc_id"), "closed-") < 35
    return table(spark, d, "documents").where("text is not null").select("doc_id", P.closed_book(text, "EXCERPT:", "en|de", chosen).alias("prompt"))


@R.query("select q, array_to_string(list_slice(rest, 1, 2) || manual || list_slice(rest, 3, 100), ',') as mixed from (select item_id as q, ['a' || item_id, 'b', 'c', 'd'] as rest, ['m', 'n'] as manual from benchmark)")
def interleaved_lists(spark: SparkSession, d: str) -> DataFrame:
    rest = F.array(F.concat(F.lit("a"), F.col("item_id").cast("string")), *map(F.lit, "bcd"))
    return table(spark, d, "benchmark").select(F.col("item_id").alias("q"), F.array_join(J.interleaved(rest, F.array(F.lit("m"), F.lit("n"))), ",").alias("mixed"))


@R.query(r"select doc_id, array_to_string(regexp_extract_all(text, '[A-Za-z0-9]*[0-9_][A-Za-z0-9_]*'), ',') as odd, text is not null as asked from documents where regexp_matches(coalesce(text, ''), '[0-9]') and length(text) < 600")
def name_words(spark: SparkSession, d: str) -> DataFrame:
    """Words with a digit or underscore, of short texts with digits."""
    odd = F.array_join(T.matches(F.col("text"), r"[A-Za-z0-9]*[0-9_][A-Za-z0-9_]*"), ",")
    return table(spark, d, "documents").where(F.coalesce("text", F.lit("")).rlike("[0-9]") & (F.length("text") < 600)).select("doc_id", odd.alias("odd"), F.col("text").isNotNull().alias("asked"))
