"""Packing documents into training sequences by best-fit decreasing.

A document of n token ids gives n // size full windows, each a sequence of its
own, and a remainder.  The remainders are dealt into groups by hash; within a
group the largest go first, each into the open sequence it fits most tightly,
or a new one.  A segment tree over the remaining capacities 1..size, counting
the open sequences of each, finds the tightest in log2(size) steps.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, with_text
from .tokens import encoder


class CapacityTree:
    """Open sequences by remaining capacity; finds the smallest capacity of at least so much."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def put(self, capacity: int, sequence: int) -> None:
        self.open[capacity].append(sequence)
        i = self.leaves + capacity
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Removes and returns (capacity, sequence) of the tightest that has room for need."""
        count, i = self.count, self.leaves + need
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i *= 2
                if not count[i]:
                    i += 1
        capacity = i - self.leaves
        while i:
            count[i] -= 1
            i >>= 1
        return capacity, self.open[capacity].pop()


def best_fit_decreasing(lengths: list[int], size: int) -> list[tuple[int, int]]:
    """(sequence, offset) of each length, none over size; sequences are numbered from 0."""
    tree, placed, n = CapacityTree(size), [(0, 0)] * len(lengths), 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        length = lengths[i]
        found = tree.take(length)
        if found:
            capacity, sequence = found
        else:
            capacity, sequence = size, n
            n += 1
        placed[i] = (sequence, size - capacity)
        if capacity > length:
            tree.put(capacity - length, sequence)
    return placed


PIECE = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long"


def cut_documents(docs: DataFrame, tokenizer: str, size: int = 4096, id_col: str = "doc_id", text_col: str = "text", split: str = "words", end_id: int = 2) -> DataFrame:
    """Pieces of every document's token ids (end_id appended): full windows of size, then the remainder."""
    arrow_limits(docs.sparkSession, 1024)
    rows = with_text(docs, id_col, text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer, split), np.array([end_id], "<u4").tobytes()
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        for batch in batches:
            which, out = [], []
            for i, ids in enumerate(encode(batch.column(1).to_pylist())):
                raw = ids + end
                for at in range(0, len(raw), 4 * size):
                    piece = raw[at : at + 4 * size]
                    which.append(i)
                    out.append((at // 4, len(piece) // 4, zlib.crc32(piece), len(raw) // 4))
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which, pa.int64())), *(pa.array(c, pa.int64()) for c in columns)], names=names)

    return rows.mapInArrow(cut, PIECE.format(id=rows.schema["doc_id"].dataType.simpleString()))


def pack(docs: DataFrame, tokenizer: str, size: int = 4096, id_col: str = "doc_id", text_col: str = "text", split: str = "words", end_id: int = 2, group_pieces: int = 40_000) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Counts the documents first, for the number of groups: about group_pieces remainders each, so a group is bounded
    and its one or two badly filled last sequences are few in thousands.  Only piece rows (no ids) are shuffled, by a
    hash of the whole row.  A group is packed in runs of at most 4 * group_pieces, should equal rows crowd it.
    sequence_id is (group number + 1) << 40 plus a count within the group.  Null text is the empty document: end_id
    alone.  Every id lies in exactly one piece, equal rows and null ids included; an empty table gives no row.  Document ids
    may be of any type that Spark can sort.
    """
    groups = max(1, -(-docs.count() // group_pieces))
    pieces = cut_documents(docs, tokenizer, size, id_col, text_col, split, end_id)
    dealt = pieces.repartition(groups, F.xxhash64("doc_id", "start", "length", "ids_crc32", "doc_tokens")).sortWithinPartitions("doc_id", "start", "ids_crc32", "doc_tokens")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (TaskContext.get().partitionId() + 1) << 40
        held: list[pa.RecordBatch] = []

        def packed() -> pa.RecordBatch:
            nonlocal number
            table = pa.Table.from_batches(held).combine_chunks()
            placed = best_fit_decreasing(table.column("length").to_pylist(), size)
            ids = pa.array([number + s for s, _ in placed], pa.int64())
            number += max(s for s, _ in placed) + 1
            return table.append_column("sequence_id", ids).append_column("offset", pa.array([o for _, o in placed], pa.int64())).combine_chunks().to_batches()[0]

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= 4 * group_pieces:
                yield packed()
                held = []
        if held:
            yield packed()

    return dealt.mapInArrow(place, f"{dealt.schema.simpleString()[7:-1].replace(':', ' ').replace(',', ', ')}, sequence_id long, offset long")
