"""Sources, sinks and streams: the sample tables written to the shared folder in a format, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom import streaming
from textloom.functions import text as T
from textloom.operators import provenance
from textloom.plans.registry import Registry
from textloom.session import cached, fresh_path, table
from textloom.sources import index, jsonl

R = Registry()
QUERIES, SQL = R.queries, R.sql


@R.query("select doc_id, lang, source, text from documents")
def jsonl_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "jsonl")
    jsonl.write_jsonl(table(spark, d, "documents").select("doc_id", "lang", "source", "text"), path, compressed=True)
    return jsonl.read_jsonl(spark, path, "doc_id long, lang string, source string, text string")


LOGS = "l as (select doc_id % 16 as log, doc_id, row_number() over (partition by doc_id % 16 order by doc_id) - 1 as line_no, doc_id % 90 = 89 as broken from documents)"


def logs(spark: SparkSession, d: str) -> DataFrame:
    """The numbered lines of sixteen files, one object a line but for broken ones."""
    line = F.when(F.col("doc_id") % 90 == 89, F.lit('{"id": ')).otherwise(F.to_json(F.struct(F.col("doc_id").alias("id"), F.col("source"))))
    path = fresh_path(spark, "logs")
    rows = table(spark, d, "documents").select((F.col("doc_id") % 16).alias("log"), "doc_id", line.alias("value"))
    rows.repartition("log").sortWithinPartitions("log", "doc_id").select("log", "value").write.partitionBy("log").text(path)
    lines = jsonl.numbered_lines(spark, path)
    return lines.withColumn("log", F.regexp_extract("file", "log=([0-9]+)", 1).cast("long"))


@R.query(f"with {LOGS}, b as (select log, min(line_no) as bad from l where broken group by log) select log, line_no, doc_id as id from l left join b using (log) where bad is null or line_no < bad")
def jsonl_valid_prefix(spark: SparkSession, d: str) -> DataFrame:
    rows = jsonl.valid_prefix(logs(spark, d), "id long, source string")
    return rows.select(F.regexp_extract("file", "log=([0-9]+)", 1).cast("long").alias("log"), "line_no", "id")


@R.query(f"with {LOGS} select log, line_no, doc_id as id from l where not broken")
def jsonl_snapshot(spark: SparkSession, d: str) -> DataFrame:
    rows = jsonl.complete_lines(logs(spark, d), "id long, source string")
    return rows.select(F.regexp_extract("file", "log=([0-9]+)", 1).cast("long").alias("log"), "line_no", "id")


@R.query(f"with {LOGS} select log, line_no, 'not JSON' as problem from l where broken")
def jsonl_strict(spark: SparkSession, d: str) -> DataFrame:
    found = jsonl.strict_problems(logs(spark, d))
    return found.select(F.regexp_extract("file", "log=([0-9]+)", 1).cast("long").alias("log"), "line_no", "problem")


@R.query("select case when doc_id % 3 = 0 then 'changed' else 'not_listed' end as problem, count(*) as n from (select distinct doc_id % 16 as doc_id from documents) where doc_id % 3 = 0 or doc_id % 3 = 1 group by 1")
def manifest_scan(spark: SparkSession, d: str) -> DataFrame:
    """Digests of sixteen files against a manifest that has a third of them wrong and a third not at all."""
    path = fresh_path(spark, "files")
    rows = table(spark, d, "documents").select((F.col("doc_id") % 16).alias("log"), "source")
    rows.repartition("log").sortWithinPartitions("log").write.partitionBy("log").text(path)
    found = index.file_digests(spark, f"{path}/log=*")
    log = F.regexp_extract("path", "log=([0-9]+)", 1)
    manifest = found.where(log % 3 != 1).select(log.alias("name"), F.when(log % 3 == 0, "x").otherwise(F.col("sha256")).alias("sha256"))
    return index.unbound_files(found, manifest, "log=([0-9]+)").groupBy("problem").agg(F.count("*").alias("n"))


@R.query(
    r"""
with p as (select page_id, regexp_extract(url, '/(en|de|fr|es)/', 1) as site, unnest(regexp_extract_all(lower(url), '[a-z0-9_]+')) as term from pages)
select page_id as chunk, term, count(*) * 1.0 as tf from p where site = 'en' group by all"""
)
def index_of_site(spark: SparkSession, d: str) -> DataFrame:
    """Postings of one site, from an index partitioned by site."""
    path = fresh_path(spark, "index")
    chunks = table(spark, d, "pages").select(F.col("page_id").alias("chunk_id"), F.col("url").alias("text"), F.regexp_extract("url", "/(en|de|fr|es)/", 1).alias("site"))
    index.write_index(chunks, path)
    return index.read_index(spark, path, "en")[1].select("chunk", "term", "tf")


@R.query("select page_id, page_id % 10 as file, case when page_id % 10 < 3 then 'new ' || page_id else url end as text from pages where page_id % 10 >= 3 or page_id % 20 < 3")
def index_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Three of ten files come anew, with half of their chunks."""
    old = table(spark, d, "pages").select("page_id", (F.col("page_id") % 10).alias("file"), F.col("url").alias("text"))
    new = old.where("file < 3 and page_id % 20 < 3").withColumn("text", F.concat(F.lit("new "), F.col("page_id").cast("string")))
    return index.upserted(old, new)


@R.query("select source, count(*) as n, cast(sum(length(text)) as bigint) as chars from documents group by source")
def cached_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Built under the digest of its input, and read from there the second time."""
    docs = table(spark, d, "documents")
    signature = provenance.fingerprint(docs, "doc_id", "text").first()
    rollup = lambda: docs.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    cached(rollup, spark, "rollup", signature.fingerprint)
    return cached(rollup, spark, "rollup", signature.fingerprint)


@R.query("select doc_id, case when doc_id % 4 = 0 then 400 end::bigint as stopped from documents where length(text) >= 400")
def stream_stop(spark: SparkSession, d: str) -> DataFrame:
    """Streams that fall into a loop after 220 characters are stopped at 400."""
    text = F.when(F.col("doc_id") % 4 == 0, F.concat(F.md5("text"), F.md5(F.reverse("text")), F.substring(F.sha2("text", 512), 1, 96), F.repeat(F.lit("abcdefghij klmnopqrst"), F.lit(20)))).otherwise(F.sha2("text", 512))
    return table(spark, d, "documents").where(F.length("text") >= 400).select("doc_id", streaming.stop_at_loop(text).alias("stopped"))


def events_stream(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


@R.query("select user_id, count(*) as n from events where event_type = 'signup' group by user_id")
def stream_append(spark: SparkSession, d: str) -> DataFrame:
    """Appended exactly once by a stream, run a second time without effect."""
    out, checkpoint = fresh_path(spark, "stream"), fresh_path(spark, "stream-state")
    for _ in range(2):
        streaming.start_append(events_stream(spark, d).where("event_type = 'signup'"), out, checkpoint).awaitTermination()
    return spark.read.parquet(out).groupBy("user_id").agg(F.count("*").alias("n"))


@R.query("select event_type, count(*) as n from events group by event_type")
def stream_units(spark: SparkSession, d: str) -> DataFrame:
    out = fresh_path(spark, "units")
    streaming.start_units(events_stream(spark, d), out, fresh_path(spark, "units-state")).awaitTermination()
    return spark.read.parquet(out).groupBy("event_type").agg(F.count("*").alias("n"))


@R.query("select distinct user_id from events")
def stream_first_seen(spark: SparkSession, d: str) -> DataFrame:
    out = fresh_path(spark, "seen")
    streaming.start_append(streaming.first_seen(events_stream(spark, d), "user_id", "ts", "1000 days"), out, fresh_path(spark, "seen-state")).awaitTermination()
    return spark.read.parquet(out).select("user_id")


@R.query("with w as (select date_trunc('hour', ts) as start, event_type, count(*) as n from events group by all) select start, event_type, n from w where start + interval 1 hour <= (select max(ts) - interval 10 minute from events)")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Hourly counts (an extra): a stream gives the hours that its watermark has passed."""
    out = fresh_path(spark, "windows")
    streaming.start_append(streaming.windowed_counts(events_stream(spark, d), "ts", "event_type", "1 hour"), out, fresh_path(spark, "windows-state")).awaitTermination()
    return spark.read.parquet(out).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@R.query(r"select doc_id, array_to_string(regexp_extract_all(lower(coalesce(text, '')), '[a-zß-öø-ÿ]{2,}'), ' ') as norm from documents where regexp_full_match(coalesce(text, ''), '[A-Za-zä-öø-ü .,\n]*')")
def unicode_norms(spark: SparkSession, d: str) -> DataFrame:
    """NFKC and casefold of texts of plain letters, whose words SQL can fold too."""
    plain = table(spark, d, "documents").where(F.coalesce("text", F.lit("")).rlike(r"^[A-Za-zä-öø-ü .,\n]*$"))
    return plain.select("doc_id", F.array_join(T.matches(T.unicode_norm(F.coalesce("text", F.lit(""))), "[a-zß-öø-ÿ]{2,}"), " ").alias("norm"))
