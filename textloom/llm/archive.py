"""A content-addressed web archive: payloads once by digest, WARC record headers apart.

    <path>/payloads   digest (SHA-256, binary), payload       one row for each different payload
    <path>/headers    head (binary), block_digest             one row for each record

head is the exact start of a WARC/1.1 record: its header, the blank line and
the HTTP header of its block.  A response record is head + payload + two line
ends; a revisit record, of a payload that another record's response already
has, is head + two line ends.  Both tables are bucketed by digest alike, so
payloads meet their heads without a shuffle; a digest that very many records
share is put in their place by broadcast, of which the sizes are bounded.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_limits, fresh_path, materialize

#: A value that more than one row in HOT has is hot: there are fewer than HOT of them.
HOT = 1000
END = "\r\n"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Archive:
    path: str
    buckets: int


def met(left: DataFrame, right: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """left join of right, whose keys are unique, on `key`; `hot`: right's rows of hot keys, fewer than HOT, which are broadcast.

    Rows of hot keys stay out of the shuffled join: their key there is null.
    """
    values = [c for c in right.columns if c != key]
    quick = hot.select(F.col(key).alias("hot_key"), *[F.col(c).alias(f"hot_{c}") for c in values])
    first = left.join(F.broadcast(quick), F.col(key) == F.col("hot_key"), "left").withColumn("cold_key", F.when(F.col("hot_key").isNull(), F.col(key)))
    second = first.join(right.withColumnRenamed(key, "own_key"), F.col("cold_key") == F.col("own_key"), "left")
    return second.select(*left.columns, *[F.coalesce(f"hot_{c}", c).alias(c) for c in values])


def field(name: str, value: Column) -> Column:
    """A header line, or nothing for a null; control characters and blanks at the ends can't break out of the line."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.trim(F.regexp_replace(value, r"[\x00-\x1f\x7f]", "")), F.lit(END)), F.lit(""))


def urn(*of: Column) -> Column:
    h = F.sha2(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("null")) for c in of]), 256)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def record_heads(rows: DataFrame, date: str) -> Column:
    """The head of a record from row, page_id, url, length, sha1, revisit, first_page and first_row."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), field("Content-Length", F.col("length").cast("string")), F.lit(END))
    size = F.octet_length(http) + F.when(F.col("revisit"), 0).otherwise(F.col("length"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        field("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        field("WARC-Record-ID", urn(F.col("page_id"), F.col("row"))),
        field("WARC-Date", F.lit(date)),
        field("WARC-Target-URI", F.col("url")),
        field("X-Page-ID", F.col("page_id").cast("string")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.upper("sha1"))),
        field("WARC-Profile", F.when(F.col("revisit"), IDENTICAL)),
        field("WARC-Refers-To", F.when(F.col("revisit"), urn(F.col("first_page"), F.col("first_row")))),
        field("Content-Type", F.lit("application/http; msgtype=response")),
        field("Content-Length", size.cast("string")),
        F.lit(END),
        http,
    )
    return head.cast("binary")


def write_archive(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 1000, date: str = "1970-01-01T00:00:00Z") -> Archive:
    """One record for each row of pages; the payload is the html in UTF-8, empty for a null.

    Of records with equal payloads of `least` bytes or more, that of the largest id (nulls are smallest; of equal ids
    one of them) is a response, the others are revisits of it; shorter payloads are responses all.  Payloads are
    hashed twice, for the records and for the store, and never compared; reading checks them against their digests.
    Url and null ids may be missing: so is their header line.  An empty table gives an archive without records.
    """
    spark = pages.sparkSession
    path = path or fresh_path(spark, "archive")
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    digest = F.unhex(F.sha2("payload", 256)).alias("digest")
    rows, _ = materialize(own.select(F.monotonically_increasing_id().alias("row"), "page_id", "url", digest, F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("length")), "records")
    equal = rows.where(F.col("length") >= least).groupBy("digest").agg(F.count("*").alias("n"), F.max(F.struct("page_id", "row")).alias("first"))
    firsts, _ = materialize(equal.where("n > 1").select("digest", "n", F.col("first.page_id").alias("first_page"), F.col("first.row").alias("first_row")), "firsts")
    total = rows.count()
    hot = F.col("n") * HOT > total
    seen = met(rows, firsts.where(~hot).drop("n"), "digest", firsts.where(hot).drop("n"))
    typed = seen.withColumn("revisit", F.col("first_row").isNotNull() & (F.col("first_row") != F.col("row")))
    heads = typed.select("digest", record_heads(typed, date).alias("head"), "revisit", "length")

    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    small, _ = materialize(rows.where(F.col("length") < least).groupBy("digest").agg(F.count("*").alias("n")).where(hot).select("digest"), "small")
    # responses of hot small payloads and revisits don't look for their payload in its bucket
    apart = heads.join(F.broadcast(small.withColumnRenamed("digest", "shared")), F.col("digest") == F.col("shared"), "left")
    placed = apart.select("head", F.col("digest").alias("block_digest"), F.when(~F.col("revisit") & F.col("shared").isNull(), F.col("digest")).otherwise(F.unhex(F.sha2("head", 256))).alias("place"))
    once = own.select(digest, "payload").groupBy("digest").agg(F.first("payload").alias("payload"))
    archive = Archive(path, buckets)
    for df, name, key in ((placed, "headers", "place"), (once, "payloads", "digest")):
        at = f"archive_{uuid.uuid4().hex}"
        df.repartition(buckets, key).write.bucketBy(buckets, key).format("parquet").option("path", f"{path}/{name}").option("compression", "zstd").saveAsTable(at)
        spark.sql(f"DROP TABLE {at}")  # of an outer path: the files stay
    return archive


def stored(spark: SparkSession, archive: Archive, name: str, columns: str, key: str) -> DataFrame:
    """A bucketed table of the archive."""
    at = f"archive_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {at} ({columns}) USING parquet CLUSTERED BY ({key}) INTO {archive.buckets} BUCKETS LOCATION '{archive.path}/{name}'")
    return spark.table(at)


def header(name: str) -> Column:
    """A field of head's WARC header, null if it has none."""
    found = F.regexp_extract(F.col("text"), rf"^WARC/1\.1\r\n(?:[^\r\n]+\r\n)*?{name}: ([^\r\n]*)\r\n", 1)
    return F.when(found != "", found)


def checked(ok: Column, value: Column, message: str) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)))


def read_archive(spark: SparkSession, archive: Archive) -> DataFrame:
    """(page_id, url, record_id, record_type, refers_to_id, payload_digest, block_length, head, payload): the records as they were written.

    payload is null for revisits.  It is an error if a payload doesn't have the digests that it is stored and recorded
    under, if a response has none, or if Content-Length is not the length of the block.
    """
    heads = stored(spark, archive, "headers", "head BINARY, block_digest BINARY, place BINARY", "place")
    payloads = stored(spark, archive, "payloads", "digest BINARY, payload BINARY", "digest")
    parsed = heads.withColumn("text", F.decode("head", "UTF-8"))
    parsed = parsed.select(
        header("X-Page-ID").alias("page_id"), header("WARC-Target-URI").alias("url"), header("WARC-Record-ID").alias("record_id"), header("WARC-Type").alias("record_type"), header("WARC-Refers-To").alias("refers_to_id"),
        F.lower(F.substring_index(header("WARC-Payload-Digest"), ":", -1)).alias("payload_digest"), header("Content-Length").cast("long").alias("block_length"),
        F.octet_length(F.substring_index("text", END * 2, -2)).cast("long").alias("http_length"), "head", "block_digest", "place",
    )
    # small payloads that very many records share, fewer than HOT of under `least` bytes each, come by broadcast
    shared, _ = materialize(parsed.where((F.col("record_type") == "response") & (F.col("place") != F.col("block_digest"))).select("block_digest").distinct(), "shared")
    few = payloads.join(F.broadcast(shared), F.col("digest") == F.col("block_digest"), "left_semi").select(F.col("digest").alias("few_digest"), F.col("payload").alias("few_payload"))
    joined = parsed.join(payloads, F.col("place") == F.col("digest"), "left").join(F.broadcast(few), (F.col("block_digest") == F.col("few_digest")) & (F.col("record_type") == "response"), "left")
    payload = F.coalesce("payload", "few_payload")
    sound = (F.unhex(F.sha2(payload, 256)) == F.col("block_digest")) & (F.sha1(payload) == F.col("payload_digest")) & (F.col("block_length") == F.col("http_length") + F.octet_length(payload))
    whole = checked(F.coalesce(F.when(F.col("record_type") == "revisit", F.col("block_length") == F.col("http_length")).otherwise(sound), F.lit(False)), payload, "a record and its payload differ")
    return joined.select("page_id", "url", "record_id", "record_type", "refers_to_id", "payload_digest", "block_length", "head", whole.alias("payload"))


def captures(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of records as read; revisits take what they don't hold from their response.

    It is an error if a revisit's response is not there or has another digest.
    """
    slim, _ = materialize(records.select("page_id", "record_id", "record_type", "refers_to_id", "payload_digest", F.octet_length("payload").cast("long").alias("payload_bytes")), "captures")
    asked, _ = materialize(slim.where(F.col("refers_to_id").isNotNull()).groupBy("refers_to_id").agg(F.count("*").alias("n")), "asked")
    hot = F.col("n") * HOT > asked.agg(F.sum("n")).first()[0] if not asked.isEmpty() else F.lit(False)
    answers, _ = materialize(slim.join(asked.withColumnRenamed("refers_to_id", "asked"), F.col("record_id") == F.col("asked")).select(F.col("record_id").alias("refers_to_id"), "n", F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("first_bytes"), F.col("payload_digest").alias("first_digest")), "answers")
    out = met(slim, answers.where(~hot).drop("n"), "refers_to_id", answers.where(hot).drop("n"))
    revisit = F.col("record_type") == "revisit"
    size = F.when(revisit, checked(F.coalesce(F.col("first_digest") == F.col("payload_digest"), F.lit(False)), F.col("first_bytes"), "a revisit without its response")).otherwise(F.col("payload_bytes"))
    return out.select("page_id", size.alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def export_warc(records: DataFrame, out_dir: str, level: int = 6) -> list:
    """Writes each partition's records as a .warc.gz, a gzip member a record; returns (path, n_records, n_bytes) of the files."""
    arrow_limits(records.sparkSession, 256, 16)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, n, out = TaskContext.get(), 0, None
        files, folder = fs.FileSystem.from_uri(out_dir)
        name = f"{folder}/part-{context.partitionId():06d}"
        part = f"{name}.attempt-{context.taskAttemptId()}"
        for batch in batches:
            if batch.num_rows and out is None:
                files.create_dir(folder, recursive=True)
                out = files.open_output_stream(part, compression=None)
            for head, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                out.write(packer.compress(head + (payload or b"") + b"\r\n\r\n") + packer.flush())
                n += 1
        if out:
            size = out.tell()
            out.close()
            files.move(part, f"{name}.warc.gz")
            yield pa.RecordBatch.from_pydict({"path": [f"{out_dir}/part-{context.partitionId():06d}.warc.gz"], "n_records": [n], "n_bytes": [size]})

    return records.select("head", "payload").mapInArrow(write, "path string, n_records long, n_bytes long").collect()


def import_warc(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(record_type, record_id, head, payload) of .warc.gz files, whose records are read one after the other, a file a task.

    head and payload as read_archive() gives them; a revisit's payload is empty.
    """
    arrow_limits(spark, 256, 16)
    files_of = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                files, path = fs.FileSystem.from_uri(uri)
                with files.open_input_stream(path, compression=None) as raw:
                    for record in members(raw):
                        fields, _, block = record.partition(b"\r\n\r\n")
                        named = dict(line.split(": ", 1) for line in fields.decode().split(END)[1:])
                        block = block[: int(named["Content-Length"])]
                        http, _, payload = block.partition(b"\r\n\r\n")
                        yield pa.RecordBatch.from_pydict({"record_type": [named["WARC-Type"]], "record_id": [named["WARC-Record-ID"]], "head": [fields + b"\r\n\r\n" + http + b"\r\n\r\n"], "payload": [payload]})

    return files_of.mapInArrow(read, "record_type string, record_id string, head binary, payload binary")


def members(raw) -> Iterator[bytes]:
    """The contents of a stream's gzip members, one at a time."""
    unpacker, parts = zlib.decompressobj(31), []
    while chunk := raw.read(1 << 20):
        while chunk:
            parts.append(unpacker.decompress(chunk))
            chunk = b""
            if unpacker.eof:
                chunk = unpacker.unused_data
                yield b"".join(parts)
                unpacker, parts = zlib.decompressobj(31), []
    if parts:
        raise ValueError("a record without its end")
