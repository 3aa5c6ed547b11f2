"""Composing search results: near-duplicate removal, slots, merged indexes, budgets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions.text import matches
from textloom.operators.similarity import hashed_sets, jaccard


def without_repeats(hits: DataFrame, texts: DataFrame, take: int, t: float = 0.6, n: int = 5) -> DataFrame:
    """(q, chunk, rank): hits in order of rank, but none that is t-similar (n-grams) to one taken before, `take` at most.

    hits: (q, chunk, rank), a bounded list a query; texts: (chunk, text).  Each list is folded in rank order.
    """
    sets = hashed_sets(texts.join(hits.select("chunk").distinct(), "chunk", "left_semi"), "chunk", "text", n)
    own = hits.join(sets, F.col("chunk") == F.col("id")).select("q", F.struct(F.col("rank").cast("long").alias("rank"), F.col("chunk").cast("long").alias("chunk"), F.col("members").alias("s")).alias("hit"))
    lists = own.groupBy("q").agg(F.array_sort(F.collect_list("hit")).alias("hits"))
    none = F.array().cast("array<struct<rank:bigint,chunk:bigint,s:array<bigint>>>")

    def step(kept: Column, hit: Column) -> Column:
        fresh = (F.size(kept) < take) & ~F.exists(kept, lambda k: jaccard(k["s"], hit["s"]) >= t)
        return F.when(fresh, F.concat(kept, F.array(hit))).otherwise(kept)

    taken = lists.select("q", F.explode(F.aggregate("hits", none, step)).alias("hit"))
    return taken.select("q", F.col("hit.chunk").alias("chunk"), F.col("hit.rank").alias("rank"))


def in_slots(parts: list[tuple[DataFrame, int | None]], k: int) -> DataFrame:
    """(q, chunk, place): from each part (q, chunk, rank) in turn its first so many, each chunk once, k at most for a query."""
    tagged = []
    for i, (hits, most) in enumerate(parts):
        own = hits if most is None else hits.withColumn("_n", F.row_number().over(Window.partitionBy("q").orderBy("rank", "chunk"))).where(F.col("_n") <= most)
        tagged.append(own.select("q", "chunk", F.struct(F.lit(i).alias("part"), F.col("rank").cast("long").alias("rank")).alias("order")))
    once = reduce(DataFrame.unionByName, tagged).groupBy("q", "chunk").agg(F.min("order").alias("order"))
    place = F.row_number().over(Window.partitionBy("q").orderBy("order", "chunk"))
    return once.withColumn("place", place.cast("long")).where(F.col("place") <= k).select("q", "chunk", "place")


def merged(indexes: list[tuple[str, DataFrame]], k: int, digits: int = 9) -> DataFrame:
    """(q, origin, chunk, rank): the k best of several indexes' hits (q, chunk, score), by score, then origin and chunk."""
    every = reduce(DataFrame.unionByName, [hits.select("q", F.lit(name).alias("origin"), "chunk", "score") for name, hits in indexes])
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc(F.round("score", digits)), "origin", "chunk"))
    return every.withColumn("rank", place.cast("long")).where(F.col("rank") <= k).select("q", "origin", "chunk", "rank")


def own_first(own: DataFrame, general: DataFrame, sizes: DataFrame, budget: int) -> DataFrame:
    """(q, place, size): the user's own hits before the general ones, each that still fits the budget."""
    from textloom.operators.select import skip_not_stop

    placed = in_slots([(own, None), (general, None)], 1 << 30)
    return skip_not_stop(placed.join(sizes, "chunk"), "q", "place", "size", budget)


def manual_match(question: Column, title: Column, names: Column) -> tuple[Column, Column]:
    """(share, matches): share of the title's words in the question; a match has half of them, and all of the names."""
    asked = matches(F.lower(question), "[a-z0-9_]+")
    words = F.array_distinct(matches(F.lower(title), "[a-z0-9_]+"))
    share = F.try_divide(F.size(F.array_intersect(words, asked)), F.size(words))
    return share, F.coalesce(share >= 0.5, F.lit(False)) & (F.size(F.array_except(names, asked)) == 0)


def closed_book(text: Column, excerpt_mark: str, sites: str, chosen: Column) -> Column:
    """The question part alone where the row is chosen, names a site and doesn't refer to its excerpt; else the text."""
    question = F.trim(F.regexp_replace(text, f"(?s){excerpt_mark}.*", ""))
    return F.when(chosen & question.rlike(sites) & ~F.lower(question).rlike("excerpt|above|below"), question).otherwise(text)
