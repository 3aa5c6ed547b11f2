"""Drawing documents whose words are like those of a target collection.

Words and runs of words are hashed into buckets.  The counts of all documents
are kept as a sparse matrix in blocks of rows (CSR: row bounds, buckets,
counts), written once.  Its column sums and those of the target's matrix give
each bucket a gain; the product of matrix and gains is each document's weight.
Gumbel noise from a hash of the id turns the highest scores into a draw without
replacement.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_limits, materialize, with_text

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BREAK = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
#: Bytes of a text cut into words at a time; cells counted at a time.
SLICE, CELLS = 1 << 20, 1 << 22
#: Cells after which a new block begins.
BLOCK = 2048


def feature_buckets(raw: bytes, buckets: int, longest: int = 3) -> Iterator[tuple[int, np.ndarray]]:
    """(number of words, buckets of the features that end in them), slice by slice.

    crc32 goes on where it stopped, so a run's checksum is made from that of the run without its last word.
    """
    raw, at, before = raw.lower(), 0, [None] * (longest - 1)  # checksums of the runs that end in the word before
    while at < len(raw):
        end = BREAK.search(raw, at + SLICE) if at + SLICE < len(raw) else None
        end = end.start() if end else len(raw)
        words = WORD.findall(raw, at, end)
        at = end
        if not words:
            continue
        spaced = [b" " + w for w in words]
        runs = [list(map(crc32, words))]
        for k in range(1, longest):
            earlier = [before[k - 1], *runs[k - 1][:-1]]
            skip = next((i for i, x in enumerate(earlier) if x is not None), len(earlier))
            runs.append([None] * skip + list(map(crc32, spaced[skip:], earlier[skip:])))
        before = [r[-1] for r in runs[:-1]]
        found = runs[0] + [x for r in runs[1:] for x in r if x is not None]
        yield len(words), np.fromiter(found, np.uint32, len(found)) % np.uint32(buckets)


CSR = "bounds array<int>, buckets binary, counts binary"
BUCKET, COUNT = np.dtype("<u2"), np.dtype("<u4")


def packed(values: np.ndarray, ends: np.ndarray, kind: np.dtype) -> pa.BinaryArray:
    """The values between the ends as little-endian bytes: a reader holds thousands of blocks, and lists take it six times as much."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * kind.itemsize).astype(np.int32)), pa.py_buffer(values.astype(kind))])


def unpacked(column: pa.BinaryArray, kind: np.dtype) -> np.ndarray:
    """All values of a column's blocks in a row."""
    _, offsets, data = column.buffers()
    first, last = np.frombuffer(offsets, np.int32, len(column) + 1, 4 * column.offset)[[0, -1]].tolist()
    return np.frombuffer(data, kind, (last - first) // kind.itemsize, first) if last > first else np.zeros(0, kind)


def count_matrix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = 10_000, longest: int = 3) -> DataFrame:
    """(ids, n_words, n_features, bounds, buckets, counts): the bucket counts of all documents, a block of them a row.

    Row i of a block has buckets[bounds[i]:bounds[i + 1]], ascending, each as often as counts says; both are
    little-endian integers of 2 and 4 bytes, so there are 65,536 buckets at most.  A block begins
    where BLOCK further cells are full, so that it has BLOCK and a row's cells at most: readers hold thousands of
    blocks.  A-Z are lower-cased; words are runs of digits, a-z and characters beyond ASCII; features all runs of 1 to
    `longest` words, repeats included, in the bucket of their crc32.  Null and empty texts are empty rows; repeated
    rows are rows each; an empty table gives no block.  Ids may be of any type.
    """
    if buckets > 1 << 16:
        raise ValueError("at most 65,536 buckets")
    arrow_limits(docs.sparkSession, 256, 4)
    rows = with_text(docs, id_col, text_col)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, CELLS // buckets)
        for batch in batches:
            if not batch.num_rows:
                continue
            n_words, parts, sizes = [], [], []
            for first in range(0, batch.num_rows, step):
                some = batch.column(1).slice(first, step).to_pylist()
                cells = np.zeros(len(some) * buckets, np.int64)
                for i, text in enumerate(some):
                    n_words.append(0)
                    own = cells[i * buckets : (i + 1) * buckets]
                    for n, found in feature_buckets(text.encode(), buckets, longest):
                        n_words[-1] += n
                        own += np.bincount(found, minlength=buckets)
                at = np.flatnonzero(cells)
                sizes.append(np.diff(np.searchsorted(at, np.arange(len(some) + 1) * buckets)))
                parts.append((at % buckets, cells[at]))
            ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
            where, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
            n_features = np.diff(np.concatenate([[0], np.cumsum(counts)])[ends])
            # the rows at which a block begins, and the end
            begins = np.concatenate([[0], np.flatnonzero(np.diff(ends[:-1] // BLOCK)) + 1, [len(ends) - 1]])
            relative = np.concatenate([ends[a : b + 1] - ends[a] for a, b in zip(begins, begins[1:], strict=False)])

            def lists(offsets: np.ndarray, values: pa.Array) -> pa.ListArray:
                return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)

            yield pa.RecordBatch.from_arrays(
                [
                    lists(begins, batch.column(0)), lists(begins, pa.array(n_words, pa.int64())), lists(begins, pa.array(n_features, pa.int64())),
                    lists(begins + np.arange(len(begins)), pa.array(relative, pa.int32())), packed(where, ends[begins], BUCKET), packed(counts, ends[begins], COUNT),
                ],
                names=["ids", "n_words", "n_features", "bounds", "buckets", "counts"],
            )

    return rows.mapInArrow(count, f"ids array<{rows.schema['doc_id'].dataType.simpleString()}>, n_words array<long>, n_features array<long>, {CSR}")


def column_sums(matrix: DataFrame, buckets: int) -> np.ndarray:
    """Total count of each bucket: a row of `buckets` sums a task, added up by bucket; `buckets` numbers come back."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            # float64 sums of whole numbers are exact up to 2**53 and are cast for each batch
            total += np.bincount(unpacked(batch.column(0), BUCKET), unpacked(batch.column(1), COUNT), buckets).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int32()), "n": pa.array(total[at], pa.int64())})

    out = np.zeros(buckets, np.int64)
    for r in matrix.select("buckets", "counts").mapInArrow(add, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the target's share over the source's), each count raised by one."""
    k, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + k) / ((s + 1) * (t_all + k)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weights(matrix: DataFrame, gains: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the matrix times the gains, block by block where the blocks are."""
    shared = matrix.sparkSession.sparkContext.broadcast(gains)
    kind = matrix.schema["ids"].dataType.elementType.simpleString()

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            ids, n_words, n_features, bounds = (c.flatten() for c in batch.columns[:4])
            buckets, counts = unpacked(batch.column(4), BUCKET), unpacked(batch.column(5), COUNT)
            n_bounds = batch.column(3).value_lengths().to_numpy().astype(np.int64)
            n_cells = np.diff(np.frombuffer(batch.column(4).buffers()[1], np.int32, batch.num_rows + 1, 4 * batch.column(4).offset)) // BUCKET.itemsize
            places = bounds.to_numpy() + np.repeat(np.cumsum(n_cells) - n_cells, n_bounds)  # in the batch
            products = np.concatenate([[0], np.cumsum(gain[buckets] * counts.astype(np.int64))])
            weight = np.delete(np.diff(products[places]), np.cumsum(n_bounds)[:-1] - 1)  # not from block to block
            yield pa.RecordBatch.from_arrays([ids, n_words, n_features, pa.array(weight, pa.int64())], names=["doc_id", "n_words", "n_features", "weight"])

    return matrix.select("ids", "n_words", "n_features", "bounds", "buckets", "counts").mapInArrow(multiply, f"doc_id {kind}, n_words long, n_features long, weight long")


def gumbel(key: Column, seed: int) -> Column:
    """floor(-1000 * ln(-ln u)), u from the first 32 bits of sha256 of `seed:key`; a null key counts as the empty text."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def draw(scored: DataFrame, eligible: Column, per_cent: int) -> DataFrame:
    """scored (doc_id, score) plus rank: 1, 2, ... for the floor(per_cent * N / 100) highest scores of the N eligible rows.

    Equal scores by smaller id, null ids last, equal rows in any order.  Rows are dealt by ranges of the score, so that
    no task numbers them all: a range's ranks begin after the sizes of the ranges before it.
    """
    rows, _ = materialize(scored.withColumn("eligible", F.coalesce(eligible, F.lit(False))), "scored")
    order = [F.desc("eligible"), F.desc("score"), F.asc_nulls_last("doc_id"), F.col("tie")]
    dealt = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    ranged, _ = materialize(dealt, "ranges")
    sizes = ranged.groupBy("part").agg(F.count_if("eligible").alias("n"))  # a row a task
    base = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"), F.sum("n").over(Window.partitionBy(F.lit(0))).alias("all"))
    number = F.col("base") + F.row_number().over(Window.partitionBy("part").orderBy(*order))
    drawn = F.col("eligible") & (number <= F.floor(F.col("all") * per_cent / 100))
    return ranged.join(F.broadcast(base), "part").withColumn("rank", F.when(drawn, number).cast("long")).select(*scored.columns, "rank")


def resample(docs: DataFrame, target: DataFrame, per_cent: int = 5, min_words: int = 20, buckets: int = 10_000, longest: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", target_id: str = "item_id", target_text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank): every document, with a rank where it is drawn.

    The source distribution is that of all documents, the target's that of all its texts.  Null and empty texts have
    no feature and weight 0; only documents of min_words words at least can be drawn.  Repeated rows are documents
    each; an empty table gives an empty one, an empty target gains of the source alone.
    """
    matrix, _ = materialize(count_matrix(docs, id_col, text_col, buckets, longest), "matrix")
    aim, _ = materialize(count_matrix(target, target_id, target_text, buckets, longest), "matrix")
    gains = bucket_gains(column_sums(matrix, buckets), column_sums(aim, buckets))
    scored = weights(matrix, gains).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    return draw(scored, F.col("n_words") >= min_words, per_cent)
