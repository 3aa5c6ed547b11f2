"""CSV, Markdown tables and ragged arrays as files in the shared folder."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators.distill import ragged_offsets
from textloom.session import fresh_path


def write_csv(df: DataFrame, path: str | None = None) -> str:
    path = path or fresh_path(df.sparkSession, "csv")
    df.write.option("header", True).csv(path)
    return path


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """With a header, UTF-8 with or without a byte order mark; a value of the wrong type is an error."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def write_json(df: DataFrame, path: str | None = None) -> str:
    path = path or fresh_path(df.sparkSession, "json")
    df.write.option("ignoreNullFields", False).json(path)
    return path


def markdown_table(df: DataFrame, order: list[str]) -> DataFrame:
    """One row (table): a small summary as a Markdown table in order of its keys."""
    cell = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in df.columns]), F.lit(" |"))
    head = f"| {' | '.join(df.columns)} |\n|{'-|' * len(df.columns)}"
    lines = F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("_line")))), lambda r: r["_line"])
    return df.agg(F.array_join(F.concat(F.array(F.lit(head)), lines), "\n").alias("table"))


def write_ragged(rows: DataFrame, key: str, values: str, path: str | None = None) -> str:
    """One row a value (at, value) in value/, one a key with its offsets (start, stop) in offsets/."""
    path = path or fresh_path(rows.sparkSession, "ragged")
    placed = ragged_offsets(rows, key, values)
    placed.write.parquet(f"{path}/offsets")
    flat = placed.join(rows.select(key, F.posexplode(values).alias("i", "value")), key).select((F.col("start") + F.col("i")).alias("at"), F.col(key), F.col("value").cast("double").alias("value"))
    flat.write.parquet(f"{path}/values")
    return path


def read_ragged(spark: SparkSession, path: str) -> DataFrame:
    """(key, values): every key's values in order; without any, an empty array."""
    offsets, flat = spark.read.parquet(f"{path}/offsets"), spark.read.parquet(f"{path}/values")
    key = reduce(lambda a, b: a, [c for c in offsets.columns if c not in ("start", "stop")])
    own = flat.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]).alias("values"))
    return offsets.join(own, key, "left").select(key, F.coalesce("values", F.array().cast("array<double>")).alias("values"))
