"""Incremental runs: append, resume, seen-sets and event windows as Structured Streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import ends_in_loop


def first_seen(rows: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """Each key's first row; state is kept for the delay only."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def first_by_digest(rows: DataFrame, text: str, time: str, delay: str) -> DataFrame:
    """Each text's first row, by its digest."""
    return first_seen(rows.withColumn("sha", F.sha2(F.col(text), 256)), "sha", time, delay)


def windowed_counts(rows: DataFrame, time: str, group: str, size: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Tumbling or sliding counts; rows later than the delay don't count (an extra)."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return rows.withWatermark(time, delay).groupBy(w.alias("w"), group).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), group, "n")


def session_counts(rows: DataFrame, time: str, group: str, gap: str, delay: str = "10 minutes") -> DataFrame:
    """Sessions that end after a gap (an extra)."""
    return rows.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("w"), group).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), group, "n")


def stop_at_loop(text: Column, every: int = 200) -> Column:
    """Characters after which a token stream is stopped: the first of every so many at which it ends in a loop; null if none."""
    marks = F.filter(F.sequence(F.lit(every), F.greatest(F.lit(every), F.length(text)), F.lit(every)), lambda n: n <= F.length(text))
    return F.get(F.filter(marks, lambda n: ends_in_loop(F.substr(text, F.lit(1), n))), F.lit(0)).cast("long")


def start_append(rows: DataFrame, out: str, checkpoint: str):
    """Append to Parquet exactly once; a run that was killed goes on where its checkpoint says."""
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def start_units(rows: DataFrame, out: str, checkpoint: str):
    """Each micro-batch is one folder, written over if the batch is run again: the same rows, never twice."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/unit={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
