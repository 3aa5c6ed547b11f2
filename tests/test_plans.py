"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import math
import os

import duckdb
import pytest

from textloom import plans

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no sample tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, (int, str)):
        return v
    if hasattr(v, "isoformat"):
        return v.isoformat().replace("+00:00", "")
    v = float(v)
    return None if math.isnan(v) else round(v, 6)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_same_rows(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = duck.execute(plans.SQL[name])
    names = [d[0] for d in found.description]
    theirs = sorted((tuple(plain(dict(zip(names, r, strict=True))[c]) for c in columns) for r in found.fetchall()), key=repr)
    assert sorted(names) == columns
    assert ours == theirs


def test_page_words_of_cut_references(spark, tmp_path):
    pages = ["<p>and&amp</p>", "<h1>&amp;amp; &copy; 1&#65;2</h1>&quo", "x&lt;b&gt;y&nbsp;z &amp;lt; &AMP; &amp"]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").write.parquet(f"file://{tmp_path}/pages.parquet")
    ours = sorted(tuple(r) for r in plans.QUERIES["page_markdown_words"](spark, f"file://{tmp_path}").collect())
    c = duckdb.connect()
    c.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert ours == sorted(c.execute(plans.SQL["page_markdown_words"]).fetchall()) and ours[0] == (0, "and amp")


def test_calls_are_not_dealt_by_tool(spark):
    """Held against a schema of a few tools, all calls would be a few tasks'."""
    plan = plans.QUERIES["argument_problems"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("name", ["page_markdown", "page_markdown_words", "json_digests", "note_chunks", "doc_chunks", "index_chunks"])
def test_batches_to_python_are_bounded(spark, name):
    """Spark's default of 10,000 rows a batch holds as many whole texts in every worker."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "10000")
    try:
        plans.QUERIES[name](spark, SF)
        assert int(spark.conf.get(setting)) <= 256
    finally:
        spark.conf.set(setting, before)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_runs(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["doc_reject_reasons", "doc_clean_report", "doc_symmetric_dups", "greedy_near_duplicates"])
def test_near_duplicate_queries_write_sets_once(spark, monkeypatch, name):
    """Words are not written, members of sets once, and neither they nor texts are shuffled for what is joined by id."""
    from textloom.operators import similarity

    tags, saved = [], similarity.saved
    monkeypatch.setattr(similarity, "saved", lambda df, tag: tags.append((tag, "members" in df.columns)) or saved(df, tag))
    plan = plans.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert [tag for tag, members in tags if members and tag != "shingles"] == [] and "words" not in dict(tags)
    assert "length(text" not in plan or plan.index("length(text") > plan.index("Join")
