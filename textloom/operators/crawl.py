"""Expanding a crawl's frontier over links that are known already (nothing is fetched)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.session import saved


def breadth_first(start: DataFrame, links: DataFrame, per_host: int, depth: int) -> DataFrame:
    """(host, page, level): pages reached from start (host, page) over links (host, page, to) within depth steps.

    Level by level, each written: new pages of a host are taken in order of name until it has per_host of them.
    """
    seen = saved(start.select("host", "page", F.lit(0).alias("level")).dropDuplicates(["host", "page"]), "frontier")
    order = Window.partitionBy("host").orderBy("page")
    for level in range(1, depth + 1):
        reached = seen.where(F.col("level") == level - 1).join(links, ["host", "page"]).select("host", F.col("to").alias("page")).distinct()
        new = reached.join(seen, ["host", "page"], "left_anti").withColumn("n", F.row_number().over(order))
        had = seen.groupBy("host").agg(F.count("*").alias("had"))
        taken = new.join(had, "host").where(F.col("n") + F.col("had") <= per_host).select("host", "page", F.lit(level).alias("level"))
        before = seen.count()
        seen = saved(seen.unionByName(taken), "frontier")
        if seen.count() == before:
            break
    return seen
