"""Search index tables and file manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators.retrieval import postings


def write_index(chunks: DataFrame, out: str, key: str = "chunk_id", text: str = "text", site: str = "site") -> None:
    """chunks/ and postings/ as Parquet, partitioned by site so that a routed search reads its sites only."""
    chunks.write.mode("errorifexists").partitionBy(site).parquet(f"{out}/chunks")
    sites = chunks.select(F.col(key).alias("chunk"), site)
    postings(chunks, key, text).join(sites, "chunk").write.mode("errorifexists").partitionBy(site).parquet(f"{out}/postings")


def read_index(spark: SparkSession, out: str, site: str | None = None, column: str = "site") -> tuple[DataFrame, DataFrame]:
    both = spark.read.parquet(f"{out}/chunks"), spark.read.parquet(f"{out}/postings")
    return both if site is None else (both[0].where(F.col(column) == site), both[1].where(F.col(column) == site))


def upserted(chunks: DataFrame, new: DataFrame, file: str = "file") -> DataFrame:
    """The chunks with those of each file in `new` replaced by the new ones."""
    return chunks.join(new.select(file).distinct(), file, "left_anti").unionByName(new)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files, read as binary."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def unbound_files(found: DataFrame, manifest: DataFrame, name: str = "([^/]+)$") -> DataFrame:
    """(name, problem) for files that are missing, not listed, or of another digest than the manifest's (name, sha256).

    A file's name is the part of its path that the pattern catches.
    """
    have = found.select(F.regexp_extract("path", name, 1).alias("name"), F.col("sha256").alias("own"))
    problem = F.when(F.col("own").isNull(), "missing").when(F.col("sha256").isNull(), "not_listed").when(F.col("own") != F.col("sha256"), "changed")
    return have.join(manifest, "name", "full").select("name", problem.alias("problem")).where("problem is not null")
