"""Aligning the tokens that two tokenizers cut from the same texts.

The texts of an Arrow batch stand in one row of bytes, each with a blank before
it.  The ends of either tokenizer's tokens are counted at their byte offsets in
that row, once for the batch; where both have an end, all texts are cut into
groups at once.  What belongs to one document comes back from prefix sums at
its first and last byte.  A link is the pair of tokens that end a group.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, materialize, with_text
from .tokens import CachedEncoder, strings_of

#: Stands for a blank in the pieces of the second tokenizer.
BLANK_MARK = "▁"
#: Pieces encoded in one call: the libraries' results for a piece are far larger than its ids.
CHUNKS = 2000


def spans(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places first[i], first[i] + 1, ... of sizes[i] items each, in a row."""
    ends = np.cumsum(sizes)
    return np.repeat(first - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of the values from each bound to the next, by prefix sums."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


@dataclass(frozen=True)
class TokenBytes:
    """The bytes of every id of a vocabulary, in a row, with their places; digits: the id in decimal as eight bytes, zeros at the end."""

    data: np.ndarray
    first: np.ndarray
    size: np.ndarray
    digits: np.ndarray
    n_digits: np.ndarray

    @classmethod
    def of(cls, entries: dict[int, bytes]) -> TokenBytes:
        n = max(entries) + 1
        if n > 9_999_999 or not all(entries.values()):
            raise ValueError("a vocabulary of over 9,999,999 ids, or an entry without bytes")
        rows = [entries.get(i, b"") for i in range(n)]
        size = np.fromiter(map(len, rows), np.int64, n)
        written = [str(i).encode() for i in range(n)]
        digits = np.frombuffer(b"".join(x.ljust(8, b"\0") for x in written), "<u8")
        return cls(np.frombuffer(b"".join(rows), np.uint8), np.cumsum(size) - size, size, digits, np.fromiter(map(len, written), np.uint64, n))

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.data[spans(self.first[ids], self.size[ids])]


def byte_level_chars() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it is printable, else one from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevelEncoder(CachedEncoder):
    """Ids of byte-level BPE in which the names of special tokens are ordinary text."""

    def __init__(self, path: str, limit: int = 250_000):
        super().__init__(path, "byte_level", limit)
        self.tokenizer.encode_special_tokens = True
        self.added, self.names, self.known = {}, None, {}
        byte = byte_level_chars()
        self.bytes = TokenBytes.of({i: bytes(byte[c] for c in t) for t, i in self.tokenizer.get_vocab().items()})

    def batch(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and each text's number of them."""
        found = self([r.decode() for r in raws])
        return np.frombuffer(b"".join(found), "<u4").astype(np.int64), np.fromiter(map(len, found), np.int64, len(found)) >> 2


    def _each(self, pieces: list[str]) -> Iterator[tuple[str, bytes]]:
        for i in range(0, len(pieces), CHUNKS):
            yield from super()._each(pieces[i : i + CHUNKS])


class PieceEncoder:
    """Ids of a sentence-piece model, remembering those of short chunks.

    A piece has blanks at its start only and no line end, so no merge goes over the place before a run of blanks, nor
    over a line end: the ids of chunks cut there are the ids of the text.  Models for which this does not hold encode
    whole texts.  The model puts a blank before a text; texts given to batch() have it already.
    """

    def __init__(self, path: str, limit: int = 250_000):
        import sentencepiece

        self.model, self.limit = sentencepiece.SentencePieceProcessor(model_file=path), limit
        pieces = [self.model.id_to_piece(i) for i in range(len(self.model))]
        self.bytes = TokenBytes.of({i: bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(BLANK_MARK, " ").encode() for i, p in enumerate(pieces)})
        probe = "ﬁ  x \n Å \n\ty "
        self.cuts = not any("\n" in p or BLANK_MARK in p.lstrip(BLANK_MARK) for p in pieces) and "".join(self.model.encode(probe, out_type=str)).replace("<0x0A>", "\n").replace("<0x09>", "\t").replace(BLANK_MARK, " ") == f" {probe}"
        self.blank = np.array([self.model.piece_to_id(BLANK_MARK)], "<u4").tobytes()
        self.known: dict[bytes, bytes] = {}

    def batch(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, raws), np.int64, len(raws))
        if not self.cuts:
            found = self.model.encode([r[1:].decode() for r in raws], num_threads=1)
            return np.fromiter((i for ids in found for i in ids), np.int64), np.fromiter(map(len, found), np.int64, len(found))
        buffer = np.frombuffer(b"".join(raws), np.uint8)
        if not len(buffer):
            return np.zeros(0, np.int64), np.zeros(len(raws), np.int64)
        blank, line = buffer == 32, buffer == 10
        starts = line.copy()
        starts[1:] |= (blank[1:] & ~blank[:-1]) | line[:-1]
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        starts[bounds[:-1][sizes > 0]] = True
        where = np.flatnonzero(starts)
        offsets = np.append(where, len(buffer)).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(where), [None, pa.py_buffer(offsets), pa.py_buffer(buffer)]).dictionary_encode()
        values = self.ids_of(strings_of(coded.dictionary))
        n = np.fromiter(map(len, values), np.int64, len(values)) >> 2
        ids, codes = np.frombuffer(b"".join(values), "<u4"), coded.indices.to_numpy()
        return ids[spans((np.cumsum(n) - n)[codes], n[codes])].astype(np.int64), sums(n[codes], np.searchsorted(where, bounds))

    def ids_of(self, chunks: list[bytes]) -> list[bytes]:
        known = self.known
        if len(known) > self.limit:
            known.clear()
        found = list(map(known.get, chunks))
        new = [c for c, ids in zip(chunks, found, strict=True) if ids is None]
        fresh = {b" ": self.blank} if b" " in new else {}
        for i in range(0, len(new), CHUNKS):
            some = [c for c in new[i : i + CHUNKS] if c != b" "]
            # the model's own blank is the chunk's first, or goes with a line end, which merges with nothing
            asked = [c[1:].decode() if c[0] == 32 else "\n" + c.decode() for c in some]
            for c, ids in zip(some, self.model.encode(asked, num_threads=1), strict=True):
                fresh[c] = np.array(ids if c[0] == 32 else ids[2:], "<u4").tobytes()
        known.update((c, ids) for c, ids in fresh.items() if len(c) <= 48)
        return [fresh[c] if ids is None else ids for c, ids in zip(chunks, found, strict=True)]


_encoders: dict[str, ByteLevelEncoder | PieceEncoder] = {}


def encoder(path: str) -> ByteLevelEncoder | PieceEncoder:
    """One a tokenizer in a Python worker, kept from task to task; .model files are sentence-piece models."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _encoders:
        _encoders[path] = (PieceEncoder if path.endswith(".model") else ByteLevelEncoder)(path)
    return _encoders[path]


@dataclass(frozen=True)
class Aligned:
    """What a batch of texts gives, an entry a text; pairs and counts: its different links (first id * width + second id) and how often it has them."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    groups: pa.StringArray
    pairs: pa.ListArray
    counts: pa.ListArray


def align_batch(texts: list[str | None], a: ByteLevelEncoder | PieceEncoder, b: ByteLevelEncoder | PieceEncoder) -> Aligned:
    """The groups of each text, as `a1,a2|b1;a3|b2,b3`.

    A text has no tokens where it is null or empty, or where the bytes of either tokenizer's tokens are not a blank and
    the text.
    """
    raws = [b" " + t.encode() if t else b"" for t in texts]
    own = []
    size = np.fromiter(map(len, raws), np.int64, len(raws))
    for e in (a, b):
        ids, n = e.batch(raws)
        own.append((ids, n, sums(e.bytes.size[ids], np.concatenate([[0], np.cumsum(n)]))))
    kept = (size > 0) & (own[0][2] == size) & (own[1][2] == size)
    bounds = np.concatenate([[0], np.cumsum(size * kept)])
    text = np.frombuffer(b"".join(r for r, k in zip(raws, kept.tolist(), strict=True) if k), np.uint8)
    tokens = [ids[np.repeat(kept, n)] for ids, n, _ in own]
    same = np.ones(len(raws), bool)
    for e, ids in zip((a, b), tokens, strict=True):
        same &= sums(e.bytes.joined(ids) != text, bounds) == 0
    if not same.all():
        return align_batch([t if s else None for t, s in zip(texts, same.tolist(), strict=True)], a, b)
    n_a, n_b = own[0][1] * kept, own[1][1] * kept

    ends = [np.cumsum(e.bytes.size[ids]) for e, ids in zip((a, b), tokens, strict=True)]
    at_a, at_b = (np.bincount(x, minlength=len(text) + 1) for x in ends)
    cut = (at_a > 0) & (at_b > 0)
    before = np.cumsum(cut) - cut  # cuts before an offset: the group of a token that ends there
    closes = [cut[x] for x in ends]
    last_a, last_b = (np.concatenate([[0], np.flatnonzero(c) + 1]) for c in closes)  # tokens up to each group
    group_at = np.searchsorted(np.flatnonzero(cut), bounds, side="right")
    n_groups = np.diff(group_at)

    a_ids, b_ids = tokens
    final = np.zeros(len(last_b) - 1, bool)  # a text's last group
    final[group_at[1:][n_groups > 0] - 1] = True
    signs_a = np.where(closes[0], ord("|"), ord(",")).astype(np.uint64)
    signs_b = np.where(closes[1], ord(";"), ord(",")).astype(np.uint64)
    signs_b[last_b[1:][final] - 1] = 0
    written = np.zeros(len(a_ids) + len(b_ids), "<u8")
    eight = np.uint64(8)
    written[np.arange(len(a_ids)) + last_b[before[ends[0]]]] = a.bytes.digits[a_ids] | signs_a << eight * a.bytes.n_digits[a_ids]
    written[np.arange(len(b_ids)) + last_a[before[ends[1]] + 1]] = b.bytes.digits[b_ids] | signs_b << eight * b.bytes.n_digits[b_ids]
    chars = written.view(np.uint8)
    solid = chars != 0
    token_at = np.concatenate([[0], np.cumsum(n_a + n_b)])
    offsets = np.concatenate([[0], np.cumsum(sums(solid, 8 * token_at))]).astype(np.int32)
    groups = pa.Array.from_buffers(pa.string(), len(raws), [None, pa.py_buffer(offsets), pa.py_buffer(chars[solid])])

    width = len(b.bytes.size)
    doc = np.repeat(np.arange(len(raws)), n_groups)
    space = len(a.bytes.size) * width
    codes, counts = np.unique(doc * space + a_ids[closes[0]] * width + b_ids[closes[1]], return_counts=True)
    places = pa.array(np.searchsorted(codes, np.arange(len(raws) + 1) * space), pa.int32())
    lists = [pa.ListArray.from_arrays(places, pa.array(x)) for x in (codes % space, counts.astype(np.int32))]
    return Aligned(n_a, n_b, n_groups, groups, *lists)


def align(docs: DataFrame, first: str, second: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, groups, pairs, counts), a row a document; no shuffle.

    first and second name tokenizer files: byte-level BPE, or a sentence-piece model (.model).  groups lists the ids of
    both between the places where both end a token, `a1,a2|b1;a3|b2,b3`; pairs and counts list the links, as
    pair_of() reads them.  row is a number of its own for each row of this run: write the result before joining on it.
    Null and empty texts, and those that a tokenizer doesn't give back byte for byte, have no tokens and empty lists.
    Repeated rows and null ids are rows like others; ids may be of any type; an empty table gives an empty one.
    """
    arrow_limits(docs.sparkSession, 1024, 1)  # a byte of text takes about 60 of the arrays
    rows = with_text(docs, id_col, text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, n = encoder(first), encoder(second), TaskContext.get().partitionId() << 40
        names = ["row", "doc_id", "n_a", "n_b", "n_groups", "groups", "pairs", "counts"]
        for batch in batches:
            got = align_batch(batch.column(1).to_pylist(), a, b)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, n + batch.num_rows)), batch.column(0), *(pa.array(x, pa.int64()) for x in (got.n_a, got.n_b, got.n_groups)), got.groups, got.pairs, got.counts], names=names)
            n += batch.num_rows

    return rows.mapInArrow(cut, f"row long, doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_a long, n_b long, n_groups long, groups string, pairs array<long>, counts array<int>")


def pair_of(code: int, second: str) -> tuple[int, int]:
    """The ids of a pair in align()'s lists."""
    return divmod(code, len(encoder(second).bytes.size))


def pair_counts(links: DataFrame, width: int, held: int = 2_000_000) -> DataFrame:
    """(pair, n, best): how many links hold each pair in all documents, and whether no pair of its second id has more.

    Each task adds up its own lists, at most about `held` different pairs at a time, before the shuffle, so a pair that
    every document has is a row a task.  There is one row for each of `width` second ids at most in what is broadcast.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts, size = [], [], 0

        def folded() -> tuple[np.ndarray, np.ndarray]:
            codes, at = np.unique(np.concatenate(pairs), return_inverse=True)
            return codes, np.bincount(at, np.concatenate(counts), len(codes)).astype(np.int64)

        for batch in batches:
            pairs.append(batch.column(0).flatten().to_numpy())
            counts.append(batch.column(1).flatten().to_numpy())
            size += len(pairs[-1])
            if size > 2 * held:
                codes, n = folded()
                if len(codes) > held:
                    yield pa.RecordBatch.from_pydict({"pair": codes, "n": n})
                    codes, n = codes[:0], n[:0]
                pairs, counts, size = [codes], [n], len(codes)
        if size:
            codes, n = folded()
            yield pa.RecordBatch.from_pydict({"pair": codes, "n": n})

    added = links.select("pairs", "counts").mapInArrow(add, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    table, _ = materialize(added, "pairs")
    most = table.groupBy((F.col("pair") % width).alias("second")).agg(F.max("n").alias("most"))
    return table.join(F.broadcast(most), F.col("pair") % width == F.col("second")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def score_links(links: DataFrame, counts: DataFrame, head: int = 500_000) -> DataFrame:
    """links (with row, pairs, counts) plus n_links, n_best (those whose pair is best) and count_sum (of n over the links).

    The `head` most frequent pairs are broadcast, at most 17 bytes each, and looked up where the documents are; links
    of the others, each rarer than all of those, meet their counts in a join.  Nothing is left out either way.
    """
    spark = links.sparkSession
    kept, _ = materialize(counts, "counts")
    top = kept.orderBy(F.desc("n"), "pair").limit(head).toPandas().sort_values("pair")
    rest = kept.count() > len(top)
    shared = spark.sparkContext.broadcast((top["pair"].to_numpy(np.int64), top["n"].to_numpy(np.int64), top["best"].to_numpy(bool)))
    columns = [c for c in links.columns if c not in ("pairs", "counts")]
    at = [links.columns.index(c) for c in columns]
    pairs_at, counts_at = links.columns.index("pairs"), links.columns.index("counts")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, n, best = shared.value
        for batch in batches:
            bounds = np.concatenate([[0], np.cumsum(batch.column(pairs_at).value_lengths().to_numpy())])
            pair, times = (batch.column(i).flatten().to_numpy() for i in (pairs_at, counts_at))
            found = np.searchsorted(codes, pair)
            found[found == len(codes)] = 0
            known = codes[found] == pair if len(codes) else np.zeros(len(pair), bool)
            values = [sums(times, bounds)] + ([sums(x, bounds) for x in (times * best[found] * known, times * n[found] * known)] if len(codes) else [np.zeros(len(bounds) - 1, np.int64)] * 2)
            left = pa.array(np.searchsorted(np.flatnonzero(~known), bounds), pa.int32())
            lists = [pa.ListArray.from_arrays(left, pa.array(x[~known])) for x in (pair, times)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in at), *(pa.array(v, pa.int64()) for v in values), *lists], names=[*columns, "n_links", "n_best", "count_sum", "left_pairs", "left_counts"])

    schema = ", ".join(f"{c} {links.schema[c].dataType.simpleString()}" for c in columns)
    scored = links.mapInArrow(score, f"{schema}, n_links long, n_best long, count_sum long, left_pairs array<long>, left_counts array<int>")
    if not rest:
        return scored.drop("left_pairs", "left_counts")
    scored, _ = materialize(scored, "scored")
    each = scored.select("row", F.explode(F.arrays_zip("left_pairs", "left_counts")).alias("x")).select("row", F.col("x.left_pairs").alias("pair"), F.col("x.left_counts").alias("times"))
    more = each.join(kept, "pair").groupBy("row").agg(F.sum(F.col("times") * F.col("best").cast("long")).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    out = scored.drop("left_pairs", "left_counts").join(more, "row", "left")
    return out.select(*columns, "n_links", *[(F.col(c) + F.coalesce(m, F.lit(0))).alias(c) for c, m in (("n_best", "more_best"), ("count_sum", "more_sum"))])
