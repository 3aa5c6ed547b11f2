"""What earlier runs and old archives hold, by digest: kept in files for ever, not in a stream's state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class SeenSet:
    """Digests in <path>/run=<n>/bucket=<first hex digits>, sorted within a bucket, so a file's row groups tell which digests they may hold.

    A run is given by its number and looks at lower ones only: run again, after it died or not, it admits the same rows.
    """

    SCHEMA = "digest string, origin string, run int, bucket string"

    def __init__(self, spark: SparkSession, path: str, digits: int = 2):
        self.spark, self.path, self.digits = spark, path, digits

    def before(self, run: int) -> DataFrame:
        """(digest, origin) of the runs below `run`; empty before anything was written."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], "digest string, origin string")
        return self.spark.read.schema(self.SCHEMA).parquet(self.path).where(F.col("run") < run).select("digest", "origin")

    def _write(self, rows: DataFrame, run: int) -> None:
        placed = rows.withColumn("bucket", F.substring("digest", 1, self.digits)).repartition("bucket").sortWithinPartitions("bucket", "digest")
        placed.write.mode("overwrite").option("parquet.bloom.filter.enabled#digest", "true").partitionBy("bucket").parquet(f"{self.path}/run={run}")

    def absorb(self, archive: DataFrame, digests: list[str], origin: Column, run: int) -> None:
        """An old archive as a run of its own: each digest column of its rows, without admitting anything."""
        each = archive.select(F.explode(F.array(*digests)).alias("digest"), F.concat(F.lit("old:"), origin.cast("string")).alias("origin"))
        self._write(each.where("coalesce(digest, '') <> ''").groupBy("digest").agg(F.min("origin").alias("origin")), run)

    def admit(self, rows: DataFrame, digest: Column, order: list[str], origin: Column, run: int) -> DataFrame:
        """rows plus `seen`: null for the first row, in order, of a digest that no earlier run has, else where it was seen.

        Rows without a digest are admitted all.  Of what was seen before only what this run asks for is shuffled: the
        asked digests reach the scan as a Bloom filter where that pays (Spark decides).  Of a digest that many rows
        share each task sends one.
        """
        own = rows.withColumn("_digest", F.nullif(digest, F.lit(""))).withColumn("_origin", origin.cast("string"))
        first = own.where("_digest is not null").groupBy(F.col("_digest").alias("digest")).agg(F.min(F.struct(*order, F.col("_origin").alias("_o"))).alias("first"))
        known = self.before(run).join(first.select("digest"), "digest", "left_semi").groupBy("digest").agg(F.min("origin").alias("old"))
        asked = first.join(known, "digest", "left")
        self._write(asked.where("old is null").select("digest", F.col("first._o").alias("origin")), run)
        joined = own.join(asked, F.col("_digest") == F.col("digest"), "left")
        is_first = F.struct(*order, F.col("_origin").alias("_o")) == F.col("first")
        seen = F.when(F.col("old").isNotNull(), F.col("old")).when(F.col("digest").isNotNull() & ~is_first, F.col("first._o"))
        return joined.withColumn("seen", seen).select(*rows.columns, "seen")
