"""Token ids in sorted-string-table shards.

A shard is one file, written once, in key order:

    data blocks | index block | Bloom filter | footer

Data block: entries (varint shared key bytes, varint further key bytes, varint
value bytes, key suffix, value), then the places of the restart entries (which
share nothing; one in RESTART entries) as uint32 and their number as uint32;
the whole block is one zstandard frame.
Index block: for each data block its last key (uint16 length, bytes), its
place (uint64) and size (uint32).  Bloom filter: uint32 number of hashes, then
the bits.  Footer: eight little-endian uint64: place and size of the index and
of the filter, documents, token ids, crc32 of index and filter, magic.

A key is 0 for a null id, or 1 and the id plus 2**63 as 8 big-endian bytes;
then a uint32 that numbers documents of equal id within the shard.  A value
is the document's token ids as little-endian uint32.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_limits, fresh_path, with_text
from .tokens import encoder

RESTART = 16
FOOTER = struct.Struct("<8Q")
MAGIC = 0x31424154534D4F4C
BITS_PER_KEY, HASHES = 10, 7


def key_of(doc_id: int | None, ordinal: int = 0) -> bytes:
    head = b"\0" if doc_id is None else b"\1" + (doc_id + (1 << 63)).to_bytes(8, "big")
    return head + ordinal.to_bytes(4, "big")


def id_of(key: bytes) -> int | None:
    return None if key[0] == 0 else int.from_bytes(key[1:9], "big") - (1 << 63)


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(raw: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = raw[at]
        n |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return n, at


def bloom_places(hashes: np.ndarray, n_bits: int, k: int) -> np.ndarray:
    """k bit places for each 64-bit hash, by double hashing."""
    h = hashes.astype(np.uint64)
    a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return (a[:, None] + np.arange(k, dtype=np.uint64)[None, :] * b[:, None]) % np.uint64(n_bits)


class ShardWriter:
    """Writes entries given in key order; holds one block, the index and 8 bytes a document."""

    def __init__(self, out, block_bytes: int = 65_536):
        self.out, self.block_bytes = out, block_bytes
        self.packer = zstandard.ZstdCompressor(level=1)
        self.block, self.restarts, self.last, self.entries = bytearray(), [], b"", 0
        self.index, self.hashes, self.at = bytearray(), [], 0
        self.n_docs = self.n_ids = 0

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.entries % RESTART == 0:
            self.restarts.append(len(self.block))
        else:
            while shared < len(key) and shared < len(self.last) and key[shared] == self.last[shared]:
                shared += 1
        self.block += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        self.last, self.entries = key, self.entries + 1
        self.hashes.append(xxhash.xxh64_intdigest(key[:-4]))
        self.n_docs += 1
        self.n_ids += len(value) // 4
        if len(self.block) >= self.block_bytes:
            self.flush()

    def flush(self) -> None:
        if not self.entries:
            return
        self.block += struct.pack(f"<{len(self.restarts) + 1}I", *self.restarts, len(self.restarts))
        packed = self.packer.compress(self.block)
        self.index += struct.pack("<H", len(self.last)) + self.last + struct.pack("<QI", self.at, len(packed))
        self.out.write(packed)
        self.at += len(packed)
        self.block, self.restarts, self.entries = bytearray(), [], 0

    def close(self) -> None:
        self.flush()
        n_bits = max(64, -(-self.n_docs * BITS_PER_KEY // 8) * 8)
        bits = np.zeros(n_bits, bool)
        if self.hashes:
            bits[bloom_places(np.array(self.hashes, np.uint64), n_bits, HASHES).ravel().astype(np.int64)] = True
        bloom = struct.pack("<I", HASHES) + np.packbits(bits, bitorder="little").tobytes()
        index = bytes(self.index)
        self.out.write(index + bloom + FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), self.n_docs, self.n_ids, zlib.crc32(index + bloom), MAGIC))
        self.out.close()


class Shard:
    """Reads a shard: lookup by id through filter, index and restarts, or a scan in key order."""

    def __init__(self, uri: str):
        files, path = fs.FileSystem.from_uri(uri)
        self.file = files.open_input_file(path)
        size = self.file.size()
        self.file.seek(size - FOOTER.size)
        at, n, bloom_at, bloom_n, self.n_docs, self.n_ids, crc, magic = FOOTER.unpack(self.file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is not a shard")
        self.file.seek(at)
        raw = self.file.read(n + bloom_n)
        if zlib.crc32(raw) != crc:
            raise ValueError(f"{uri}: index or filter is damaged")
        self.k = struct.unpack_from("<I", raw, n)[0]
        self.bits = np.frombuffer(raw, np.uint8, offset=n + 4)
        self.last_keys, self.blocks, i = [], [], 0
        while i < n:
            length = struct.unpack_from("<H", raw, i)[0]
            self.last_keys.append(raw[i + 2 : i + 2 + length])
            self.blocks.append(struct.unpack_from("<QI", raw, i + 2 + length))
            i += 14 + length

    def may_hold(self, doc_id: int | None) -> bool:
        h = np.array([xxhash.xxh64_intdigest(key_of(doc_id)[:-4])], np.uint64)
        places = bloom_places(h, len(self.bits) * 8, self.k)[0].astype(np.int64)
        return bool(np.all(self.bits[places >> 3] >> (places & 7).astype(np.uint8) & 1))

    def _block(self, i: int) -> tuple[bytes, int, list[int]]:
        at, size = self.blocks[i]
        self.file.seek(at)
        raw = zstandard.decompress(self.file.read(size))
        n = struct.unpack_from("<I", raw, len(raw) - 4)[0]
        end = len(raw) - 4 - 4 * n
        return raw, end, list(struct.unpack_from(f"<{n}I", raw, end))

    @staticmethod
    def _entries(raw: bytes, at: int, end: int) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < end:
            shared, at = read_varint(raw, at)
            more, at = read_varint(raw, at)
            size, at = read_varint(raw, at)
            key = key[:shared] + raw[at : at + more]
            at += more
            yield key, raw[at : at + size]
            at += size

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.blocks)):
            raw, end, _ = self._block(i)
            yield from self._entries(raw, 0, end)

    def get(self, doc_id: int | None) -> list[bytes]:
        """The values of all documents with this id; an empty list if there are none."""
        if not self.may_hold(doc_id):
            return []
        first, head, found = key_of(doc_id), key_of(doc_id)[:-4], []
        for i in range(bisect_left(self.last_keys, first), len(self.blocks)):
            raw, end, restarts = self._block(i)
            low, high = 0, len(restarts)
            while low < high:  # first restart whose key is not below the wanted
                mid = (low + high) // 2
                if next(self._entries(raw, restarts[mid], end))[0] < first:
                    low = mid + 1
                else:
                    high = mid
            for key, value in self._entries(raw, restarts[max(0, low - 1)], end):
                if key >= first:
                    if key[:-4] != head:
                        return found
                    found.append(value)
        return found


def stored_bytes(docs: DataFrame) -> int:
    """What Spark's statistics say of the table's size (that of its files, without reading them); counted where they say nothing."""
    size = docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if int(size) < 1 << 60:
        return int(size)
    return docs.agg(F.sum(F.octet_length(F.concat_ws("", *[F.col(f"`{c}`").cast("string") for c in docs.columns])))).first()[0] or 0


def write_shards(docs: DataFrame, tokenizer: str, out_dir: str, id_col: str = "doc_id", text_col: str = "text", split: str = "byte_level", end_id: int = 2, shard_bytes: int = 256 << 20) -> list:
    """Encode every text, append end_id, write shards in ascending id order; returns the manifest rows, in that order.

    Rows are dealt by ranges of the id (and of a hash of the text, so that one id with very many rows is split too),
    sorted, and each partition streams into one file: a temporary name, then a rename, so a task that is run again or
    twice leaves the same file.  There are as many ranges as Spark has shuffle partitions, and more where a range
    would hold over shard_bytes as stored: a shard, with its index and key hashes, doesn't grow with the corpus.  The
    manifest has a row a shard (shard, path, n_docs, n_ids).  Ids are integers (a long can hold them).  Null ids sort
    first; null text is the empty document (end_id alone); equal rows are kept; an empty table gives no shard.
    """
    arrow_limits(docs.sparkSession, 1024)
    rows = with_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("h", F.xxhash64("text"))
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-stored_bytes(docs) // shard_bytes))
    dealt = rows.repartitionByRange(shards, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, context = encoder(tokenizer, split), TaskContext.get()
        files, folder = fs.FileSystem.from_uri(out_dir)
        end, writer, before, ordinal = np.array([end_id], "<u4").tobytes(), None, None, 0
        name = f"{folder}/shard-{context.partitionId():06d}"
        for batch in batches:
            if batch.num_rows and writer is None:
                files.create_dir(folder, recursive=True)
                part = f"{name}.attempt-{context.taskAttemptId()}"
                writer = ShardWriter(files.open_output_stream(part))
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist()), strict=True):
                ordinal = ordinal + 1 if writer.n_docs and doc_id == before else 0
                writer.add(key_of(doc_id, ordinal), ids + end)
                before = doc_id
        if writer:
            writer.close()
            files.move(part, f"{name}.sst")
            yield pa.RecordBatch.from_pydict({"shard": [context.partitionId()], "path": [f"{out_dir}/shard-{context.partitionId():06d}.sst"], "n_docs": [writer.n_docs], "n_ids": [writer.n_ids]})

    return sorted(dealt.mapInArrow(write, "shard long, path string, n_docs long, n_ids long").collect())


def read_shards(spark: SparkSession, manifest: list) -> DataFrame:
    """(doc_id, start, ids) of all shards: token ids as binary, and the ids of all documents before."""
    at, bases = 0, []
    for row in manifest:
        bases.append((row["path"], at))
        at += row["n_ids"]
    paths = spark.createDataFrame(bases, "path string, base long").repartition(max(1, len(bases)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, starts, values, size, start = [], [], [], 0, base
                for key, value in Shard(path).scan():
                    ids.append(id_of(key))
                    starts.append(start)
                    values.append(value)
                    start, size = start + len(value) // 4, size + len(value)
                    if size > 8_000_000:
                        yield made(ids, starts, values)
                        ids, starts, values, size = [], [], [], 0
                yield made(ids, starts, values)

    def made(ids: list, starts: list, values: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(values, pa.binary())], names=["doc_id", "start", "ids"])

    return paths.mapInArrow(read, "doc_id long, start long, ids binary")


def token_table(docs: DataFrame, tokenizer: str, out_dir: str | None = None, **options) -> DataFrame:
    """write_shards() into out_dir (a new one in the shared folder by default), then read_shards()."""
    spark = docs.sparkSession
    return read_shards(spark, write_shards(docs, tokenizer, out_dir or fresh_path(spark, "sstable"), **options))
