"""The web archive: exact round trips, equal payloads, damage."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from textloom.llm import archive
from textloom.llm.common import fresh_path


@pytest.fixture(scope="module")
def pages(spark):
    big, other = "<html>" + "ä" * 900, "x" * 1000
    rows = [(1, "http://a/1", big), (7, "http://a/7", big), (3, None, big), (None, "http://a/n", big), (2, "http://a/2\r\nX: y", other), (2, "http://a/2", other), (9, "u", "x" * 999), (10, "u", "x" * 999)]
    rows += [(4, "u", None), (5, "u", ""), (6, "u", "\r\n\r\nWARC/1.1\r\n\r\n"), (8, "u", "z" * 300_000), (8, "u", "z" * 300_000)]
    rows += [(100 + i, f"http://hot/{i}", "h" * 2000) for i in range(1500)] + [(5000 + i, f"http://small/{i}", "small") for i in range(1500)]
    return spark.createDataFrame([(*r, b"1", "t") for r in rows], "page_id long, url string, html string, digest binary, row string")


def expected(rows):
    groups = defaultdict(list)
    for i, html in rows:
        groups[html or ""].append(-1 if i is None else i)
    out = []
    for html, ids in groups.items():
        raw = html.encode()
        first = max(ids)
        answered = False
        for i in sorted(ids):
            own = len(raw) < 1000 or i == first and not answered
            answered |= own and len(raw) >= 1000
            out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "response" if own else "revisit", -2 if own else first))
    return sorted(out)


def seen(records):
    rows = archive.captures(records).collect()
    return sorted((-1 if r.page_id is None else int(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, -2 if r.refers_to is None else int(r.refers_to)) for r in rows)


@pytest.mark.parametrize("hot", [archive.HOT, 1])
def test_records_come_back(spark, pages, hot, monkeypatch):
    """HOT = 1: nothing counts as hot, so every row goes through the shuffled joins."""
    monkeypatch.setattr(archive, "HOT", hot)
    written = archive.write_archive(pages)
    records = archive.read_archive(spark, written)
    want = expected([(r.page_id, r.html) for r in pages.collect()])
    assert seen(records) == want
    stored = spark.read.parquet(f"{written.path}/payloads").collect()
    assert len(stored) == len({x[2] for x in want})
    assert all(hashlib.sha256(r.payload).digest() == bytes(r.digest) for r in stored)
    ids = [r.record_id for r in records.select("record_id").collect()]
    assert len(set(ids)) == len(ids) == len(want)


def test_exported_files_hold_the_records(spark, pages):
    records = archive.read_archive(spark, archive.write_archive(pages))
    files = archive.export_warc(records, fresh_path(spark, "warc"))
    assert sum(f.n_records for f in files) == records.count()
    back = archive.import_warc(spark, [f.path for f in files])
    want = sorted((r.record_type, r.record_id, bytes(r.head), bytes(r.payload or b"")) for r in records.collect())
    assert sorted((r.record_type, r.record_id, bytes(r.head), bytes(r.payload)) for r in back.collect()) == want
    head = next(x[2] for x in want if x[0] == "revisit")
    assert head.startswith(b"WARC/1.1\r\n") and head.count(b"\r\n\r\n") == 2


def test_damage_is_an_error(spark, pages):
    written = archive.write_archive(pages.where("page_id < 10"))
    changed = spark.read.parquet(f"{written.path}/payloads").withColumn("payload", F.when(F.length("payload") == 999, F.lit("y" * 999).cast("binary")).otherwise(F.col("payload")))
    at = "damaged"
    spark.sql(f"drop table if exists {at}")
    path = fresh_path(spark, "damaged")
    changed.repartition(written.buckets, "digest").write.bucketBy(written.buckets, "digest").format("parquet").option("path", f"{path}/payloads").saveAsTable(at)
    heads = spark.read.parquet(f"{written.path}/headers")
    heads.repartition(written.buckets, "place").write.bucketBy(written.buckets, "place").format("parquet").option("path", f"{path}/headers").saveAsTable("heads")
    with pytest.raises(Exception, match="a record and its payload differ"):
        archive.captures(archive.read_archive(spark, archive.Archive(path, written.buckets))).collect()


def test_payloads_meet_their_heads_without_a_shuffle(spark, pages):
    records = archive.read_archive(spark, archive.write_archive(pages))
    plan = records._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan


def test_empty_table(spark, pages):
    assert archive.captures(archive.read_archive(spark, archive.write_archive(pages.where("false")))).count() == 0
