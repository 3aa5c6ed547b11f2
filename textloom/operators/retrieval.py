"""BM25 retrieval over a postings table: k1 = 1.2, b = 0.75, idf = ln(1 + (N - df + 0.5) / (df + 0.5)); higher is better."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions.text import matches
from textloom.session import saved, spread

K1, B = 1.2, 0.75
#: Words that queries leave out. Fixed values.
STOP_WORDS = (
    "the", "and", "for", "this", "that", "with", "from", "does", "what", "how", "can", "are", "you", "your",
    "want", "have", "has", "job", "slurm", "when", "which", "would", "should",
)


def query_terms(question: Column) -> Column:
    """Different terms of more than two characters that aren't stop words, in order of appearance."""
    return F.filter(F.array_distinct(matches(F.lower(question), "[a-z0-9_]+")), lambda t: (F.length(t) > 2) & ~t.isin(*STOP_WORDS))


def postings(chunks: DataFrame, key: str, text: str, weight: float = 1.0) -> DataFrame:
    """(term, chunk, tf): tf is the number of occurrences times the field's weight."""
    texts = spread(chunks.select(F.col(key).alias("chunk"), F.coalesce(F.col(text), F.lit("")).alias("t")))
    each = texts.select("chunk", F.explode(matches(F.lower("t"), "[a-z0-9_]+")).alias("term"))
    return each.groupBy("term", "chunk").agg((F.count("*") * F.lit(weight)).alias("tf"))


def weighted_postings(fields: list[DataFrame]) -> DataFrame:
    """Sum of the fields' postings: weights apply before saturation."""
    out = fields[0]
    for f in fields[1:]:
        out = out.unionByName(f)
    return out.groupBy("term", "chunk").agg(F.sum("tf").alias("tf"))


def bm25(post: DataFrame, queries: DataFrame, n_chunks: int | None = None) -> DataFrame:
    """(q, chunk, score) for chunks that share a term with the query; queries: (q, terms array).

    Only postings of asked terms are scored; chunk lengths and document frequencies are one aggregation each.
    n_chunks counts chunks without terms too, if the caller knows of them.
    """
    length = post.groupBy("chunk").agg(F.sum("tf").alias("dl"))
    totals = length.agg(F.avg("dl").alias("avgdl"), (F.lit(n_chunks) if n_chunks is not None else F.count("*")).cast("double").alias("n"))
    asked = queries.select("q", F.explode("terms").alias("term"))
    found = post.join(asked.select("term").distinct(), "term", "left_semi").join(length, "chunk")
    return scored(found, totals, asked)


def scored(found: DataFrame, totals: DataFrame, asked: DataFrame) -> DataFrame:
    """(q, chunk, score) from the asked terms' postings (term, chunk, tf, dl), one row (avgdl, n) and (q, term)."""
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    parts = found.join(df, "term").crossJoin(F.broadcast(totals)).select("term", "chunk", part.alias("part"))
    return asked.join(parts, "term").groupBy("q", "chunk").agg(F.sum("part").alias("score"))


def search(chunks: DataFrame, key: str, text: str, queries: DataFrame) -> DataFrame:
    """bm25 of chunks that no index has been made of: only what the queries ask for is counted and shuffled.

    Texts are cut into terms once; their number is a chunk's length, and of the terms themselves those leave their
    task that a query has.
    """
    texts = spread(chunks.select(F.col(key).alias("chunk"), F.coalesce(F.col(text), F.lit("")).alias("t")))
    cut = texts.select("chunk", matches(F.lower("t"), "[a-z0-9_]+").alias("w"))
    tokens = saved(cut.where(F.size("w") > 0), "tokens")
    totals = tokens.agg(F.avg(F.size("w")).alias("avgdl"), F.count("*").cast("double").alias("n"))
    asked = queries.select("q", F.explode("terms").alias("term"))
    each = tokens.select("chunk", F.size("w").alias("dl"), F.explode("w").alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    return scored(saved(each.groupBy("term", "chunk", "dl").agg(F.count("*").cast("double").alias("tf")), "found"), totals, asked)


def ranked(scores: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """The k best chunks of each query with ranks; equal scores (to `digits` places) by chunk."""
    w = Window.partitionBy("q").orderBy(F.desc(F.round("score", digits)), "chunk")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def recall_at(hits: DataFrame, gold: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """One row: share of the gold (q, chunk) queries whose chunk is among the first k hits."""
    found = gold.join(hits.select("q", "chunk", "rank"), ["q", "chunk"], "left").groupBy("q").agg(F.min("rank").alias("best"))
    return found.agg(F.count("*").alias("n"), *[F.avg((F.coalesce("best", F.lit(1 << 30)) <= k).cast("int")).alias(f"hit_at_{k}") for k in ks])


def context(hits: DataFrame, chunks: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """(q, context): the hits' chunks as headed blocks, in order of rank."""
    block = F.concat(F.lit("Source: "), F.col(source).cast("string"), F.lit("\n"), F.col(text))
    each = hits.join(chunks.select(F.col(key).alias("chunk"), block.alias("block")), "chunk")
    ordered = F.array_sort(F.collect_list(F.struct("rank", "block")))
    return each.groupBy("q").agg(F.array_join(F.transform(ordered, lambda b: b["block"]), "\n\n").alias("context"))


def interleaved(rest: Column, manual: Column, lead: int = 2) -> Column:
    """The first hits, then manual pages, then the other hits; each once."""
    return F.array_distinct(F.concat(F.slice(rest, 1, lead), manual, F.slice(rest, lead + 1, F.greatest(F.size(rest), F.lit(1)))))


def facet_cover(hits: DataFrame, facets: DataFrame, picks: int = 3) -> DataFrame:
    """(q, chunk, pick): greedily the chunk with most facets not covered yet, ties by rank; picks rounds, all in joins."""
    hits = saved(hits, "hits")  # read in every round
    offered = hits.join(facets, "chunk").select("q", "chunk", "rank", "facet").distinct()
    base = hits.select("q", "chunk", "rank")
    out = None
    for pick in range(1, picks + 1):
        gain = base.join(offered.groupBy("q", "chunk").agg(F.count_distinct("facet").alias("new")), ["q", "chunk"], "left").fillna(0, ["new"])
        w = Window.partitionBy("q").orderBy(F.desc("new"), "rank", "chunk")
        best = gain.withColumn("n", F.row_number().over(w)).where("n = 1").select("q", "chunk", F.lit(pick).alias("pick"))
        out = best if out is None else out.union(best)
        covered = best.join(offered, ["q", "chunk"]).select("q", "facet")
        offered = offered.join(covered, ["q", "facet"], "left_anti").join(best.select("q", "chunk"), ["q", "chunk"], "left_anti")
        base = base.join(best.select("q", "chunk"), ["q", "chunk"], "left_anti")
    return out
