"""A search index kept in files: block postings in segments, upserts with tombstones, and a top-k that skips blocks.

    <path>/docs      segment, no, window, chunk, file, dl       a row a chunk
    <path>/blocks    segment, bucket, term, window, n, max_tf, min_dl, chunks, tfs, dls
    <path>/dead      segment, chunk, dl        chunks of earlier segments that the segment replaces
    <path>/gone      segment, term, n          how many postings of a term they had

A window is a run of chunk numbers of a segment; a block holds a term's postings in one window, with their number, the
largest count and the shortest length.  From these follows the most that the window's chunks can score, whatever the
averages are by then, so a later segment leaves blocks as they are.  blocks is partitioned by segment and by a hash of
the term: a search opens the folders of its terms only.  A folder has a file for every span of windows, so that as many
tasks write as there are spans and folders.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions.text import matches
from textloom.operators.retrieval import K1, B, ranked
from textloom.operators.select import prefix_sums
from textloom.session import arrow_limits, saved

WINDOW = 256
#: Windows in one file of a bucket.
SPAN = 64
SCHEMA = {
    "docs": "no long, window long, chunk long, file string, dl long, segment int",
    "blocks": "term string, window long, n long, max_tf long, min_dl long, chunks array<long>, tfs array<long>, dls array<long>, segment int, bucket int",
    "dead": "chunk long, dl long, segment int",
    "gone": "term string, n long, segment int",
}
KEEP = ["segment", "chunk"]
BLOCKS = "term string, window long, n long, max_tf long, min_dl long, chunks array<long>, tfs array<long>, dls array<long>"


class StoredIndex:
    """The segments in a folder; each of write() and upsert() adds one, merged() makes one of all in a new folder."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        """buckets: folders that a segment's terms are dealt to; the same number whenever the index is used."""
        self.spark, self.path, self.buckets = spark, path, buckets

    def bucket(self, term: str) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int").alias("bucket")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMA[name]).parquet(f"{self.path}/{name}")

    def segments(self) -> int:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/docs")
        files = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sum(s.getPath().getName().startswith("segment=") for s in files.listStatus(at)) if files.exists(at) else 0

    def _add(self, name: str, rows: DataFrame, number: int, *more: str) -> None:
        """A segment's part is written over, if a run that died left some of it."""
        out = f"{self.path}/{name}/segment={number}"
        (rows.write.partitionBy(*more) if more else rows.write).mode("overwrite").parquet(out)

    def _add_blocks(self, blocks: DataFrame, number: int) -> None:
        """A segment's blocks; those of one bucket and span of windows come to one task and file."""
        spans = blocks.withColumn("bucket", self.bucket("term")).repartition("bucket", F.floor(F.col("window") / SPAN))
        self._add("blocks", spans.sortWithinPartitions("bucket", "term", "window"), number, "bucket")

    def write(self, chunks: DataFrame, key: str, text: str, file: str) -> StoredIndex:
        """The chunks as a new segment: lower-cased words of a-z, digits and _; null texts are empty; keys are longs."""
        number = self.segments()
        own = chunks.select(F.col(key).cast("long").alias("chunk"), F.col(file).cast("string").alias("file"), matches(F.lower(F.coalesce(F.col(text), F.lit(""))), "[a-z0-9_]+").alias("words"))
        placed = numbered(saved(own.withColumn("dl", F.size("words").cast("long")).withColumn("id", F.monotonically_increasing_id()), "cut")).withColumn("window", F.floor(F.col("no") / WINDOW))
        # words travel once, to the task that has their window
        arrow_limits(self.spark, WINDOW)
        self._add_blocks(placed.select("window", "chunk", "dl", "words").groupBy("window").applyInArrow(counted, BLOCKS), number)
        empty = self.spark.createDataFrame([], "chunk long, dl long")
        if number == 0:
            self._add("dead", empty, 0)
            self._add("gone", self.spark.createDataFrame([], "term string, n long"), 0)
        self._add("docs", placed.select("no", "window", "chunk", "file", "dl"), number)  # the last: a segment is there when this is
        return self

    def upsert(self, chunks: DataFrame, key: str, text: str, file: str) -> StoredIndex:
        """Replaces all chunks of the files in `chunks` by these; keys of replaced chunks may come again."""
        number = self.segments()
        files = chunks.select(F.col(file).cast("string").alias("file")).distinct()
        old = saved(self.live().join(files, "file", "left_semi"), "old")
        self._add("dead", old.select("chunk", "dl"), number)
        windows = old.select("segment", "window").distinct()
        held = self.table("blocks").join(windows, ["segment", "window"], "left_semi").select("segment", "term", F.explode("chunks").alias("chunk"))
        self._add("gone", held.join(old.select(*KEEP), KEEP, "left_semi").groupBy("term").agg(F.count("*").alias("n")), number)
        return self.write(chunks, key, text, file)

    def dead(self) -> DataFrame:
        """(chunk, until): a chunk of a segment below `until` isn't there any more."""
        return self.table("dead").groupBy("chunk").agg(F.max("segment").alias("until"))

    def live(self) -> DataFrame:
        both = self.table("docs").join(self.dead(), "chunk", "left")
        return both.where(F.col("until").isNull() | (F.col("segment") >= F.col("until"))).drop("until")

    def totals(self) -> DataFrame:
        """One row (n, avgdl) of the chunks that have a word, from added less replaced ones."""
        added = self.table("docs").where("dl > 0").agg(F.count("*").alias("n"), F.sum("dl").alias("s"))
        lost = self.table("dead").where("dl > 0").agg(F.count("*").alias("less"), F.coalesce(F.sum("dl"), F.lit(0)).alias("t"))
        return added.crossJoin(lost).select((F.col("n") - F.col("less")).cast("double").alias("n"), F.try_divide(F.col("s") - F.col("t"), F.col("n") - F.col("less")).alias("avgdl"))

    def merged(self, path: str) -> StoredIndex:
        """All live postings as the one segment of a new index, without reading texts.

        Windows stay together: those with fewer live chunks than WINDOW are put together, the others stand alone, so
        none has 2 * WINDOW of them, however often an index is merged.
        """
        out = StoredIndex(self.spark, path, self.buckets)
        docs = saved(self.table("docs").join(self.dead(), "chunk", "left").withColumn("gone", F.coalesce(F.col("segment") < F.col("until"), F.lit(False))), "merged")
        sizes = docs.where("not gone").groupBy("segment", "window").agg(F.count("*").alias("live"))
        to = saved(packed(sizes), "packed")
        kept = docs.where("not gone").join(to, ["segment", "window"]).select(F.col("to").alias("window"), "chunk", "file", "dl")
        place = F.row_number().over(Window.partitionBy("window").orderBy("chunk")) - 1
        numbers = kept.withColumn("no", F.col("window") * (2 * WINDOW) + place)
        at = to.select("segment", "window", "to")
        held = self.table("blocks").drop("bucket").join(at, ["segment", "window"]).select("to", "segment", "term", "chunks", "tfs", "dls")
        gone = docs.where("gone").join(at, ["segment", "window"]).select(F.col("to").alias("into"), "segment", "chunk")
        out._add_blocks(held.groupBy("to").cogroup(gone.groupBy("into")).applyInArrow(joined, BLOCKS), 0)
        out._add("dead", self.spark.createDataFrame([], "chunk long, dl long"), 0)
        out._add("gone", self.spark.createDataFrame([], "term string, n long"), 0)
        out._add("docs", numbers.select("no", "window", "chunk", "file", "dl"), 0)
        return out

    def asked(self, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(q, term, idf, avgdl) of (q, terms), and the blocks of these terms."""
        terms = saved(queries.select("q", F.explode("terms").alias("term")).distinct().withColumn("bucket", self.bucket("term")), "terms")
        folders = [r.bucket for r in terms.select("bucket").distinct().collect()]  # at most self.buckets numbers
        blocks = self.table("blocks").where(F.col("bucket").isin(folders)).join(terms.select("bucket", "term").distinct(), ["bucket", "term"], "left_semi")
        held = blocks.groupBy("term").agg(F.sum("n").alias("n"))
        gone = self.table("gone").groupBy("term").agg(F.sum("n").alias("less"))
        df = held.join(gone, "term", "left").select("term", (F.col("n") - F.coalesce("less", F.lit(0))).alias("df"))
        counted = terms.join(df, "term").crossJoin(F.broadcast(self.totals()))  # one row
        return saved(counted.select("q", "term", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), "avgdl"), "asked"), blocks

    def scored(self, wanted: DataFrame, asked: DataFrame, blocks: DataFrame) -> DataFrame:
        """(q, chunk, score) of all live chunks in the wanted (q, segment, window)."""
        parts = wanted.join(asked, "q").join(blocks, ["term", "segment", "window"])
        each = parts.select("q", "segment", "idf", "avgdl", F.explode(F.arrays_zip("chunks", "tfs", "dls")).alias("p")).select("q", "segment", F.col("p.chunks").alias("chunk"), part(F.col("idf"), F.col("p.tfs"), F.col("p.dls"), F.col("avgdl")).alias("part"))
        dead = self.dead()
        whole = each.groupBy("q", "segment", "chunk").agg(F.sum("part").alias("score")).join(dead, "chunk", "left")
        return whole.where(F.col("until").isNull() | (F.col("segment") >= F.col("until"))).select("q", "chunk", "score")

    def search(self, queries: DataFrame, k: int, lead: int = 4) -> DataFrame:
        """(q, chunk, score, rank): the k best chunks of each query (q, terms), equal scores by chunk; all of them, exactly.

        The `lead` windows that could score most are scored first.  Of the others only those come after that could
        reach the k-th score found so far.
        """
        asked, blocks = self.asked(queries)
        # blocks without their lists: a row for each term and window
        most = asked.join(blocks.select("term", "segment", "window", "max_tf", "min_dl"), "term").groupBy("q", "segment", "window").agg(F.sum(part(F.col("idf"), F.col("max_tf"), F.col("min_dl"), F.col("avgdl"))).alias("bound"))
        order = Window.partitionBy("q").orderBy(F.desc("bound"), "segment", "window")
        bounds = saved(most.withColumn("place", F.row_number().over(order)), "bounds")
        first = saved(self.scored(bounds.where(F.col("place") <= lead).select("q", "segment", "window"), asked, blocks), "first")
        floor = ranked(first, k).where(F.col("rank") == k).select("q", F.col("score").alias("floor"))
        self.later = saved(bounds.where(F.col("place") > lead).join(floor, "q", "left").where(F.col("floor").isNull() | (F.col("bound") >= F.col("floor") - 1e-8)).select("q", "segment", "window"), "later")
        return ranked(first.unionByName(self.scored(self.later, asked, blocks)), k)


def part(idf: Column, tf: Column, dl: Column, avgdl: Column) -> Column:
    """A term's part of a chunk's score; grows with tf and falls with dl."""
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def numbered(cut: DataFrame) -> DataFrame:
    """Rows numbered from 0 as no, in the order of their id: Spark's increasing id, which has the row within its task below bit 33.

    What is broadcast is a row a task.
    """
    task = F.shiftright("id", 33)
    sizes = cut.groupBy(task.alias("task")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = sizes.select("task", before.alias("base"))
    return cut.withColumn("task", task).join(F.broadcast(base), "task").withColumn("no", F.col("base") + F.col("id").bitwiseAND((1 << 33) - 1)).drop("id", "task", "base")


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of one window, of rows (window, chunk, dl, words): each batch is counted, only its postings are kept."""
    parts = []
    for b in batches:
        coded = b["words"].flatten().dictionary_encode()
        row = pc.list_parent_indices(b["words"]).to_numpy().astype(np.int64)
        key, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * len(b) + row, return_counts=True)
        row = key % len(b)
        parts.append((pa.DictionaryArray.from_arrays(pa.array(key // len(b), pa.int32()), coded.dictionary), b["chunk"].to_numpy()[row], tf, b["dl"].to_numpy()[row]))
        window = b["window"][0].as_py()
    terms, *numbers = zip(*parts, strict=True)
    yield from grouped(window, pa.chunked_array(terms), *[np.concatenate(x) for x in numbers]).to_batches()


def joined(blocks: pa.Table, gone: pa.Table) -> pa.Table:
    """The blocks of a new window of those (to, segment, term, chunks, tfs, dls) of old ones, without chunks that are gone (into, segment, chunk)."""
    if not len(blocks):
        return grouped(0, pa.chunked_array([], pa.dictionary(pa.int32(), pa.string())), *[np.empty(0, np.int64)] * 3)
    blocks = blocks.combine_chunks()
    block = pc.list_parent_indices(blocks["chunks"]).to_numpy()
    chunk, tf, dl = (pc.list_flatten(blocks[c]).to_numpy() for c in ("chunks", "tfs", "dls"))
    segment, of, which = blocks["segment"].to_numpy()[block], gone["segment"].to_numpy(), gone["chunk"].to_numpy()
    live = np.ones(len(chunk), bool)
    for s in np.unique(of):
        live &= (segment != s) | ~np.isin(chunk, which[of == s])
    terms = blocks["term"].dictionary_encode().unify_dictionaries().combine_chunks()
    kept = pa.DictionaryArray.from_arrays(terms.indices.take(pa.array(block[live])), terms.dictionary)
    return grouped(blocks["to"][0].as_py(), pa.chunked_array([kept]), chunk[live], tf[live], dl[live])


def grouped(window: int, terms: pa.ChunkedArray, chunk: np.ndarray, tf: np.ndarray, dl: np.ndarray) -> pa.Table:
    """Postings of a window as its blocks, by term and chunk."""
    coded = terms.unify_dictionaries().combine_chunks()
    order = pc.array_sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    code = rank[coded.indices.to_numpy()]
    by = np.lexsort((chunk, code))
    code, chunk, tf, dl = code[by], chunk[by], tf[by], dl[by]
    starts = np.flatnonzero(np.diff(code, prepend=-1))
    ends = np.append(starts, len(code)).astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x, pa.int64())) for x in (chunk, tf, dl)]
    most, least = (np.maximum.reduceat(tf, starts), np.minimum.reduceat(dl, starts)) if len(starts) else (tf, dl)
    term = coded.dictionary.take(pa.array(order[code[starts]]))
    return pa.table([term, *[pa.array(x, pa.int64()) for x in (np.full(len(starts), window), np.diff(ends), most, least)], *lists], [c.split()[0] for c in BLOCKS.split(", ")])


def packed(sizes: DataFrame) -> DataFrame:
    """(segment, window, to) of windows with their live chunks: even numbers for windows put together, odd ones for those alone."""
    small = F.when(F.col("live") < WINDOW, F.col("live")).otherwise(0)
    large = F.when(F.col("live") < WINDOW, 0).otherwise(1)
    each = prefix_sums(prefix_sums(sizes, ["segment", "window"], small, "chunks"), ["segment", "window"], large, "before")
    return each.select("segment", "window", F.when(F.col("live") < WINDOW, 2 * F.floor(F.col("chunks") / WINDOW)).otherwise(2 * F.col("before") + 1).alias("to"))
