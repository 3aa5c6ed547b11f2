"""The stored index: pruning, upserts, reads of asked terms only."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import retrieval as J
from textloom.session import fresh_path
from textloom.sources import postings
from textloom.sources.postings import StoredIndex


@pytest.fixture(scope="module")
def chunks(spark):
    r = random.Random(4)
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(r.choices(words, [1 / (j + 1) for j in range(200)], k=r.randint(0, 40))), f"f{i % 30}") for i in range(600)]
    rows += [(1000 + i, "rare " * (i + 1) + "w1 w2", "rare") for i in range(12)] + [(2000, None, "none"), (2001, "", "none")]
    return spark.createDataFrame(rows, "id long, text string, file string")


def plain(chunks, queries, k):
    hits = J.ranked(J.bm25(J.postings(chunks, "id", "text"), queries), k)
    return sorted((r.q, r["rank"], r.chunk, round(r.score, 9)) for r in hits.collect())


def indexed(index, queries, k, **options):
    return sorted((r.q, r["rank"], r.chunk, round(r.score, 9)) for r in index.search(queries, k, **options).collect())


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(1, ["rare", "w1"]), (2, ["w150", "w3"]), (3, ["unknown"]), (4, ["w199"]), (5, ["w0", "w1", "w2"])], "q long, terms array<string>")


def test_ranks_equal_those_of_all_postings(spark, chunks, queries, monkeypatch):
    monkeypatch.setattr(postings, "WINDOW", 16)
    index = StoredIndex(spark, fresh_path(spark, "index"), 4).write(chunks, "id", "text", "file")
    want = plain(chunks, queries, 5)
    for lead in (1, 4):
        assert indexed(index, queries, 5, lead=lead) == want
    # of the windows with an asked term, few are scored
    only = queries.where("q = 1")
    assert indexed(index, only, 5, lead=1) == [x for x in want if x[0] == 1]
    assert index.later.count() < 3 and index.asked(only)[1].select("window").distinct().count() > 20


def test_a_search_opens_the_folders_of_its_terms(spark, chunks, queries):
    index = StoredIndex(spark, fresh_path(spark, "index"), 32).write(chunks, "id", "text", "file")
    _, blocks = index.asked(queries.where("q = 4"))
    assert {r.term for r in blocks.collect()} == {"w199"}
    want = indexed(index, queries.where("q = 4"), 5)
    own = blocks.first().bucket
    broken = 0
    for path in glob.glob(f"{index.path.removeprefix('file://')}/blocks/segment=0/bucket=*/*.parquet"):
        if f"/bucket={own}/" not in path:
            os.remove(os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.crc"))
            with open(path, "wb") as f:
                f.write(b"no block")
            broken += 1
    assert broken > 20
    assert indexed(index, queries.where("q = 4"), 5) == want


def test_upserts_give_the_ranks_of_a_fresh_index(spark, chunks, queries):
    index, state = StoredIndex(spark, fresh_path(spark, "index"), 4).write(chunks, "id", "text", "file"), chunks
    steps = [("f1", 5000, "w1 w1 rare"), ("f1", 6000, "w2 w199"), ("rare", 1000, "rare w3"), ("new", 7000, "w150 rare rare")]
    for file, base, text in steps:
        new = spark.createDataFrame([(base + i, f"{text} " * (i + 1), file) for i in range(3)], "id long, text string, file string")
        index.upsert(new, "id", "text", "file")
        state = state.where(F.col("file") != file).unionByName(new)
        assert indexed(index, queries, 7) == plain(state, queries, 7)
    assert indexed(index.merged(fresh_path(spark, "merged")), queries, 7) == plain(state, queries, 7)
    assert index.totals().first() == index.merged(fresh_path(spark, "merged")).totals().first()


def test_empty_index_and_no_queries(spark, chunks, queries):
    index = StoredIndex(spark, fresh_path(spark, "index"), 4).write(chunks.where("false"), "id", "text", "file")
    assert indexed(index, queries, 5) == []
    full = StoredIndex(spark, fresh_path(spark, "index"), 4).write(chunks, "id", "text", "file")
    assert indexed(full, queries.where("false"), 5) == []


def test_folders_are_written_by_as_many_tasks_as_there_are_spans(spark, chunks, queries, monkeypatch):
    """Not by one task a folder, whatever the input."""
    monkeypatch.setattr(postings, "WINDOW", 8)
    monkeypatch.setattr(postings, "SPAN", 2)
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(coalesce)
    spark.conf.set(coalesce, "false")
    try:
        index = StoredIndex(spark, fresh_path(spark, "index"), 2).write(chunks, "id", "text", "file")
        merged = index.merged(fresh_path(spark, "merged"))
    finally:
        spark.conf.set(coalesce, before)
    for made in (index, merged):
        files = glob.glob(f"{made.path.removeprefix('file://')}/blocks/segment=0/bucket=*/*.parquet")
        assert len(files) > 2
        assert indexed(made, queries, 5) == plain(chunks, queries, 5)


def test_merged_windows_stay_bounded(spark, chunks, queries, monkeypatch):
    """Small windows are put together, replaced keys that came again stay, and numbers are those of one chunk."""
    monkeypatch.setattr(postings, "WINDOW", 16)
    index, state = StoredIndex(spark, fresh_path(spark, "index"), 4).write(chunks, "id", "text", "file"), chunks
    for text in ("w1 rare", "w150 w2", "w199 w3 w3"):  # the same keys each time
        new = spark.createDataFrame([(i, f"{text} " * (i % 3 + 1), "rare") for i in range(1000, 1005)], "id long, text string, file string")
        index.upsert(new, "id", "text", "file")
        state = state.where("file <> 'rare'").unionByName(new)
    for _ in range(2):
        index = index.merged(fresh_path(spark, "merged"))
        sizes = index.table("docs").groupBy("window").agg(F.count("*").alias("n"), F.count_distinct("no").alias("d")).collect()
        assert max(r.n for r in sizes) < 32 and all(r.n == r.d for r in sizes) and sum(r.n for r in sizes) == state.count()
        assert len(sizes) < 2 * state.count() / 16 + 2
        assert indexed(index, queries, 7) == plain(state, queries, 7)
