"""Crawled pages: keys, admission, titles, text, links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import html as H
from textloom.functions import urls as U
from textloom.plans.registry import Registry
from textloom.session import table

R = Registry()
QUERIES, SQL = R.queries, R.sql

HOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"
PATH = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


@R.query(
    rf"""
select page_id,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(url, '[?#].*$', '')), '^https?://', ''), '^www\.', ''), '/index\.html$', ''), '/+$', '') as key_page,
  {HOST} || regexp_replace(regexp_replace({PATH}, '/index\.(?:html|php)$', ''), '/+$', '') as key_host_path,
  regexp_replace({HOST}, '^www\.', '') || regexp_replace({PATH}, '/+$', '') || case when regexp_extract(url, '\?([^#]*)', 1) = '' then '' else '?' || regexp_extract(url, '\?([^#]*)', 1) end as key_query,
  lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || {HOST} || case when regexp_replace({PATH}, ';.*$', '') = '' then '/' else regexp_replace({PATH}, ';.*$', '') end as clean
from pages"""
)
def url_keys(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", U.key_page(u).alias("key_page"), U.key_host_path(u).alias("key_host_path"), U.key_with_query(u).alias("key_query"), U.clean(u).alias("clean"))


@R.query(
    r"""
with p as (select page_id, url, html, lower(regexp_extract(html, '(?is)<html[^>]*\slang=["'']?([A-Za-z]+)', 1)) as lang from pages)
select page_id, reason, count(*) over (partition by reason) as n_alike from (
  select page_id, case when not regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:www|m|th)') then 'scope' when regexp_matches(url, '(?i)\.(?:png|jpe?g|gif|svg|css|js|zip|gz|mp4)$|/(?:login|search|tag|feed)(?:/|$)') then 'path' when lang not in ('', 'en') then 'language'
    when length(html) < 400 then 'short' else 'admitted' end as reason from p)"""
)
def page_admission(spark: SparkSession, d: str) -> DataFrame:
    lang = H.language(F.col("html"))
    u = F.col("url")
    outside = F.when(U.in_scope(u, ["www", "m", "th"], exclude="$^"), None).otherwise("scope")
    excluded = F.when(~U.in_scope(u, [""]), "path")
    reason = F.when(outside.isNotNull(), outside).when(excluded.isNotNull(), excluded).when(~lang.isin("", "en"), "language").when(F.length("html") < 400, "short").otherwise("admitted")
    reasons = table(spark, d, "pages").select("page_id", reason.alias("reason"))
    return reasons.join(reasons.groupBy("reason").agg(F.count("*").alias("n_alike")), "reason").select("page_id", "reason", "n_alike")


@R.query(
    r"""
select page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) as title,
  lower(regexp_extract(html, '(?is)<html[^>]*\slang=["'']?([A-Za-z]+)', 1)) as lang,
  regexp_extract(html, '(?i)href=["'']?([^"''> ]*(?:creativecommons\.org|/licen[cs]e)[^"''> ]*)', 1) as licence
from pages"""
)
def page_title_lang(spark: SparkSession, d: str) -> DataFrame:
    h = F.col("html")
    return table(spark, d, "pages").select("page_id", H.title(h).alias("title"), H.language(h).alias("lang"), H.licence_link(h).alias("licence"))


STRIP = r"html"
for _p, _to in ((r"(?is)<(?:script|style)\b.*?</(?:script|style)\s*>", " "), (r"(?s)<!--.*?-->", " "), (r"(?s)<[^>]*>", " "), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&"), (r"\s+", " ")):
    STRIP = f"regexp_replace({STRIP}, '{_p}', '{_to}', 'g')"


@R.query(f"select page_id, trim({STRIP}) as text, cast(length(trim({STRIP})) as bigint) as n from pages")
def html_text_lengths(spark: SparkSession, d: str) -> DataFrame:
    t = H.plain_text(F.col("html"))
    return table(spark, d, "pages").select("page_id", t.alias("text"), F.length(t).cast("long").alias("n"))


@R.query(
    r"""
with l as (select page_id, unnest(regexp_extract_all(html, '(?i)\bhref\s*=\s*("[^"]*"|''[^'']*''|[^\s>"'']+)', 1)) as u from pages),
c as (select page_id, regexp_replace(u, '["'']', '', 'g') as link from l)
select page_id, link, count(*) as n from c where link <> '' and not regexp_matches(link, '(?i)^(?:mailto|javascript|tel):|^#') group by all"""
)
def page_links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.explode(H.links(F.col("html"))).alias("link")).groupBy("page_id", "link").agg(F.count("*").alias("n"))


@R.query()
def page_markdown(spark: SparkSession, d: str) -> DataFrame:
    return H.markdown(table(spark, d, "pages"))


@R.query(
    rf"""
with k as (select page_id, url, regexp_replace({HOST}, '^(?:www|m)\.', '') as site, sha256({STRIP}) as sha from pages)
select sha, count(*) as n_pages, min(page_id) as first_page, array_to_string(list_sort(list_distinct(list(site))), ',') as sites from k group by sha"""
)
def page_aliases(spark: SparkSession, d: str) -> DataFrame:
    """All sites that hold the same content (text with untrimmed ends)."""
    site = F.regexp_replace(U.host(F.col("url")), r"^(?:www|m)\.", "")
    text = F.col("html")
    for p, to in ((r"(?is)<(?:script|style)\b.*?</(?:script|style)\s*>", " "), (r"(?s)<!--.*?-->", " "), (r"(?s)<[^>]*>", " "), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&"), (r"\s+", " ")):
        text = F.regexp_replace(text, p, to)
    return table(spark, d, "pages").groupBy(F.sha2(text, 256).alias("sha")).agg(F.count("*").alias("n_pages"), F.min("page_id").alias("first_page"), F.array_join(F.array_sort(F.collect_set(site)), ",").alias("sites"))


@R.query(
    rf"""
with k as (select *, regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(url, '[?#].*$', '')), '^https?://', ''), '^www\.', ''), '/+$', '') as k from pages)
select page_id, url from (select *, row_number() over (partition by k order by length(url), page_id) as rn from k) where rn = 1"""
)
def page_first_by_key(spark: SparkSession, d: str) -> DataFrame:
    from textloom.operators.similarity import first_by

    key = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace("url", "[?#].*$", "")), "^https?://", ""), r"^www\.", ""), "/+$", "")
    return first_by(table(spark, d, "pages").withColumn("k", key), ["k"], [F.length("url"), F.col("page_id")]).select("page_id", "url")


@R.query(
    r"""
with p as (select page_id, html, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) as root, regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '[^/]*$', '') as own from pages),
b as (select *, case when own = '' then '/' else own end as folder from p), f as (select *, case when page_id % 3 = 0 then case when folder = '/' then '/' else regexp_replace(folder, '[^/]+/$', '') end || 'v/' else folder end as base from b),
l as (select page_id, root, base, list_filter(list_transform(regexp_extract_all(html, '(?i)\bhref\s*=\s*("[^"]*"|''[^'']*''|[^\s>"'']+)', 1), lambda u: regexp_replace(u, '["'']', '', 'g')), lambda u: u <> '' and not regexp_matches(u, '(?i)^(?:mailto|javascript|tel):|^#')) as u from f)
select page_id, array_to_string(list_transform(u, lambda x: regexp_replace(case when regexp_matches(x, '^[a-z]+:') then x when starts_with(x, '/') then root || x else root || base || x end, '#.*$', '')) || [root || base || 'end?p=1'], ' ') as targets from l"""
)
def page_targets(spark: SparkSession, d: str) -> DataFrame:
    """Where pages lead: links, relative to a base element on every third page, and a forward with dot segments."""
    own = F.when(F.col("page_id") % 3 == 0, '<base href="../v/./">').otherwise("")
    html = F.concat(own, "html", F.lit("<meta http-equiv='Refresh' content='0; url=./next/../end?p=1#x'>"))
    return table(spark, d, "pages").select("page_id", F.array_join(H.links_of(html, F.col("url")), " ").alias("targets"))
