"""Session and table loading."""

from __future__ import annotations

import hashlib
import posixpath
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def session(name: str = "textloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, skew joins and Arrow on, in UTC; conf keys may use __ for dots."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The table dealt evenly to as many partitions as the session's textloom.partitions says; unset, it stays as read.

    For a table in few row groups, which few tasks would read, before work on its texts that takes far longer than a
    shuffle of them.  Tables of many files need none.
    """
    parts = df.sparkSession.conf.get("textloom.partitions", None)
    return df.repartition(int(parts)) if parts else df


def arrow_limits(spark: SparkSession, rows: int = 256, mb: int = 24) -> None:
    """Bound what one Arrow batch brings into a Python worker: rows and bytes.

    Documents may be very long, so Spark's default of 10,000 rows a batch is no bound on memory.  A DataFrame takes the
    session's setting when it runs, after its operator has returned, so the bound has to stay; a lower one of the
    caller's is left alone.
    """
    if not 0 < int(spark.conf.get(ARROW_ROWS)) <= rows:
        spark.conf.set(ARROW_ROWS, str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{mb}m")


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A new name in the folder that all executors share, spark.checkpoint.dir.

    A temporary folder is set where the setting is unset and Spark runs in one process (tests).
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return posixpath.join(folder, f"{tag}-{uuid.uuid4().hex}")


def saved(df: DataFrame, tag: str) -> DataFrame:
    """df written once to the shared folder and read back, for what a plan reads several times.

    It cuts the lineage and outlives lost executors.
    """
    spark, path = df.sparkSession, fresh_path(df.sparkSession, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cached(build: Callable[[], DataFrame], spark: SparkSession, *signature: object) -> DataFrame:
    """build()'s result under a name made from the signature of its inputs; built once, then read, by later runs too."""
    name = hashlib.sha256("|".join(map(str, signature)).encode()).hexdigest()[:32]
    path = posixpath.join(posixpath.dirname(fresh_path(spark, "cache")), f"cache-{name}")
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
