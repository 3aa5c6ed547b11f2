"""Benchmark decontamination by a prefix-filtered set join.

Every benchmark item is cut into windows of `window` words, and windows and
documents into shingles of SHINGLE words (a shorter window is one shingle).
For a window to lie in a document, each of its shingles must; so with the
shingles ordered by how rare they are in the corpus, joining on the rarest,
the prefix of one that exact containment needs, finds every window.  The
shingle's place in the window gives the one place where the window can lie
(positional bound), which must leave room for all of it (length bound); then
the window is compared word by word.

The documents are read once.  That pass keeps, of the stretches around
shingles which a Bloom filter of the benchmark's lets through, the words and
the shingles' places; counts, prefix, join and verification work on these.
The filter spares work and decides nothing, so its size is bounded.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, materialize, with_text

#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z, on UTF-8 bytes.
ITEM_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHINGLE = 5


def words_of(text: str) -> list[bytes]:
    return ITEM_WORD.findall(text.encode().lower())  # bytes.lower() touches A-Z alone


def item_windows(items: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """(words, items): each different window once, its words joined by blanks, with the items that hold it."""
    words = F.regexp_extract_all(F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER), F.lit(WORD_PATTERN), F.lit(0))
    cut = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), words.alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - F.lit(window - 1)))
    each = cut.select("item", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, window), " "))).alias("words"))
    return each.groupBy("words").agg(F.array_sort(F.collect_set("item")).alias("items"))


class WordHashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of `width` words, one a place, from the words' hashes."""
    n = max(0, len(words) - width + 1)
    h = np.full(n, width, np.uint64)
    for i in range(width):
        h = (h ^ words[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return h


def window_shingles(windows: DataFrame) -> DataFrame:
    """(words, items, size, width, h, place): a row for each shingle of each window."""
    cut = windows.select("words", "items", F.size(F.split("words", " ")).alias("size")).withColumn("width", F.least("size", F.lit(SHINGLE)))

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [shingle_hashes(WordHashes().of(w.encode().split(b" ")), n).view(np.int64) for w, n in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            which = pa.array(np.repeat(np.arange(len(hashes)), [len(h) for h in hashes]), pa.int64())
            places = np.concatenate([np.arange(0), *(np.arange(len(h)) for h in hashes)])
            all_hashes = np.concatenate([np.empty(0, np.int64), *hashes])
            yield pa.RecordBatch.from_arrays([*(c.take(which) for c in batch.columns), pa.array(all_hashes), pa.array(places, pa.int32())], names=[*batch.schema.names, "h", "place"])

    return cut.mapInArrow(shingled, "words string, items array<string>, size int, width int, h long, place int")


def slots(h: Column, bits: int) -> tuple[Column, Column]:
    """Two slots of a hash in a filter of 2**bits, as may_hold() has them."""
    return h.bitwiseAND(F.lit((1 << bits) - 1)), F.shiftrightunsigned(h, 64 - bits)


def bloom_filter(hashes: DataFrame, most_bits: int = 27) -> np.ndarray:
    """Bits, as uint64, of a Bloom filter of column h: 16 or more for each hash, but 2**most_bits at most."""
    bits = min(most_bits, max(10, (16 * hashes.count()).bit_length()))
    slot = hashes.select(F.explode(F.array(*slots(F.col("h"), bits))).alias("slot"))
    one = F.expr("shiftleft(1L, cast(slot & 63 as int))")
    words = slot.groupBy(F.shiftright("slot", 6).alias("at")).agg(F.bit_or(one).alias("word")).toArrow()
    out = np.zeros(1 << bits - 6, np.uint64)
    out[words.column("at").to_numpy()] = words.column("word").to_numpy().view(np.uint64)
    return out


def may_hold(bloom: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places of the hashes that the filter lets through."""
    bits = np.uint64(len(bloom).bit_length() + 5)
    first = h & (np.uint64(1) << bits) - np.uint64(1)
    found = np.flatnonzero(bloom[first >> np.uint64(6)] >> (first & np.uint64(63)) & np.uint64(1))
    second = h[found] >> np.uint64(64) - bits
    return found[(bloom[second >> np.uint64(6)] >> (second & np.uint64(63)) & np.uint64(1)).astype(bool)]


#: A stretch of a document: place of its first word, its words, the shingles found in it and their places.
PARTS = pa.list_(pa.struct([("at", pa.int32()), ("words", pa.list_(pa.string())), ("found", pa.list_(pa.struct([("h", pa.int64()), ("place", pa.int32())])))]))


def stretches(words: list[bytes], found: list[tuple[int, int]], window: int) -> list[dict]:
    """The parts of a document in which windows around the found (place, hash) can lie."""
    out: list[dict] = []
    end = 0
    for place, h in sorted(found):
        low = max(0, place - window + 1)
        if not out or low > end:
            out.append({"at": low, "words": [], "found": []})
        end = min(len(words), place + window)
        out[-1]["words"] += [w.decode() for w in words[out[-1]["at"] + len(out[-1]["words"]) : end]]
        out[-1]["found"].append({"h": h, "place": place})
    return out


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, min_percent: int = 5, filter_bits: int = 27) -> DataFrame:
    """For every document: words, words inside benchmark windows, the items they are of, and a verdict.

    contaminated: some word is hit, and at least min_percent of all words are.  Writes the benchmark's shingles and
    what one pass over the documents keeps to the shared folder; all else is joins and grouping of these, so a large
    benchmark grows neither a broadcast (2**filter_bits bits at most) nor what the driver holds.  Null and empty
    texts have no words and are clean; an item without words has no windows; an empty benchmark leaves all clean.
    Repeated rows give repeated rows; other columns are ignored.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    rows = with_text(docs, id_col, text_col)
    id_kind = rows.schema["doc_id"].dataType.simpleString()
    shingles, _ = materialize(window_shingles(item_windows(items, item_col, item_text_col, window)), "shingles")
    widths = sorted(r.width for r in shingles.select("width").distinct().collect())
    bloom = spark.sparkContext.broadcast(bloom_filter(shingles.select("h").distinct(), filter_bits))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, row = WordHashes(), TaskContext.get().partitionId() << 40
        for batch in batches:
            words = [words_of(text) for text in batch.column(1).to_pylist()]
            n_words = np.array([len(w) for w in words], np.int64)
            ends = np.cumsum(n_words)
            hashes = known.of(list(chain.from_iterable(words))) if widths else np.empty(0, np.uint64)
            found: list[list[tuple[int, int]]] = [[] for _ in words]
            for width in widths:
                h = shingle_hashes(hashes, width)
                at = may_hold(bloom.value, h)
                doc = np.searchsorted(ends, at, "right")
                inside = at + width <= ends[doc]
                at, doc = at[inside], doc[inside]
                for d, place, x in zip(doc.tolist(), (at - ends[doc] + n_words[doc]).tolist(), h[at].view(np.int64).tolist(), strict=True):
                    found[d].append((place, x))
            parts = [stretches(w, f, window) if f else [] for w, f in zip(words, found, strict=True)]
            number = pa.array(np.arange(row, row + batch.num_rows), pa.int64())
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), number, pa.array(n_words), pa.array(parts, PARTS)], names=["doc_id", "row", "n_words", "parts"])

    scanned, _ = materialize(rows.mapInArrow(scan, f"doc_id {id_kind}, row long, n_words long, parts array<struct<at int, words array<string>, found array<struct<h long, place int>>>>"), "scanned")
    part = scanned.select("row", "n_words", F.explode("parts").alias("part"))
    seen = part.select("row", "n_words", "part.at", F.explode("part.found").alias("x")).select("row", "n_words", "at", "x.h", F.col("x.place").alias("own_place"))
    counts = part.select(F.explode("part.found.h").alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    ranked = shingles.join(counts, "h", "left").withColumn("rarity", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h", "place"))
    prefix = ranked.groupBy("words", "size").agg(F.min("rarity").alias("rare"), F.first("items").alias("items")).where(F.col("rare.n") > 0)
    rarest, _ = materialize(prefix.select("rare.h", "rare.place", "words", "size", "items"), "prefix")

    start = F.col("own_place") - F.col("place")
    bounded = seen.join(rarest, "h").where((start >= 0) & (start + F.col("size") <= F.col("n_words")))
    # a stretch's words meet what was found in it once, not once for each find
    found_in = bounded.groupBy("row", "at").agg(F.collect_list(F.struct(start.alias("start"), "size", "words", "items")).alias("finds"))
    stretch = found_in.join(part.select("row", "part.at", F.col("part.words").alias("own")), ["row", "at"])
    same = F.filter("finds", lambda x: F.array_join(F.slice("own", x["start"] - F.col("at") + 1, x["size"]), " ") == x["words"])
    exact = stretch.select("row", F.explode(same).alias("x")).select("row", "x.start", "x.size", "x.items")
    start = F.col("start")
    hits = exact.groupBy("row").agg(F.array_sort(F.collect_set(F.struct(start.alias("a"), (start + F.col("size")).alias("b")))).alias("places"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    nothing = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate("places", nothing, lambda x, p: F.struct(F.greatest(x["end"], p["b"]).alias("end"), (x["n"] + F.greatest(F.lit(0), p["b"] - F.greatest(x["end"], p["a"]))).alias("n")))
    counted = hits.select("row", covered["n"].alias("n_hit"), "items")
    whole = scanned.select("doc_id", "row", "n_words").join(counted, "row", "left")
    n_hit, found = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("items", F.array().cast("array<string>"))
    return whole.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(found).cast("long").alias("n_items"), found.alias("items"), ((n_hit > 0) & (100 * n_hit >= min_percent * F.col("n_words"))).alias("contaminated"))
