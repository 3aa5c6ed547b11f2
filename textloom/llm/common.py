"""Helpers shared by the corpus operators."""

from __future__ import annotations

import posixpath
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.session import ARROW_ROWS, arrow_limits, spread  # noqa: F401  (arrow_limits: for the operators)

#: Words as the contracts state them: runs of anything but ASCII blanks.
BLANK_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: The same on UTF-8 bytes; the bytes of other characters are all above 0x7F.
BLANK_WORD_BYTES = re.compile(rb"[^\x20\x09-\x0D]+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """So many rows a batch for the jobs run inside, whose rows are short."""
    before = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, before)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where that is unset and Spark runs in one process (tests)."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = "file://" + tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured


def fresh_path(spark: SparkSession, tag: str) -> str:
    return posixpath.join(shared_dir(spark), f"{tag}-{uuid.uuid4().hex}")


def materialize(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Write df to the shared folder and read it back: cuts its lineage, and any executor can be lost afterwards."""
    path = fresh_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete tables written by materialize() that nothing reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def crc_mod(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def with_text(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """The id and text columns alone, so that other columns can't clash; null text becomes empty.

    A small table, which Spark may read in a single task, is dealt to all cores.
    """
    own = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        *more,
    )
    return spread(own)


def labelled_sample(docs: DataFrame, labels: DataFrame, train: Column, id_col: str, text_col: str, label_col: str, sizes: dict[int, int]) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, label, text) of at most sizes[label] documents of each label, and how many rows of each label there are.

    Of the label rows for which `train` holds, those of smallest id hash are drawn; an id of several labels has the
    largest.  Only the drawn ids, whose number is bounded, are broadcast, and the documents are read once.  An id of
    several texts stands for one of them, the one of smallest hash, so a frequent id is no more than one row.
    """
    known, _ = materialize(labels.where(train & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(F.col(label_col).cast("int")).alias("label")), "labels")
    counts = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    drawn = [known.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for label, n in sizes.items()]
    ids = reduce(DataFrame.unionByName, drawn)
    texts = with_text(docs, id_col, text_col).join(F.broadcast(ids), "doc_id")
    one = texts.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    return one.select("doc_id", "label", F.col("t.text").alias("text")), counts
