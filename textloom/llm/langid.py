"""Language identification with language-bitmask n-gram filters.

One Bloom filter for each language, bit-sliced: slot i holds bit i of all the
filters, one language a bit, so that the AND of an n-gram's few slots is the
mask of all languages that contain it.  A text's n-grams give one popcount a
language; each is corrected for the filter's false positives, and the largest
decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, with_text

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters; made once in each worker."""
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _letters[0]


def grams(text: str, n: int = 4) -> tuple[np.ndarray, bool]:
    """Hashes of the n-grams, one a place, of the lower-cased text with a blank for all that is no letter; any letter?

    An n-gram counts if all but one of its characters are letters; a text of a single short word has at least one.
    """
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), "<u4")
    letter = letters()[points]
    if not letter.any():
        return np.empty(0, np.uint64), False
    chars = np.where(letter, points, 32).astype(np.uint64)
    if len(chars) < n:
        chars, letter = np.pad(chars, (0, n - len(chars)), constant_values=32), np.pad(letter, (0, n - len(letter)))
    size = len(chars) - n + 1
    h = np.full(size, 0x9E3779B97F4A7C15, np.uint64)
    inside = np.zeros(size, np.int8)
    for i in range(n):
        h = (h ^ chars[i : i + size]) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        inside += letter[i : i + size]
    kept = h[inside >= n - 1]
    return (kept if len(kept) else h[inside >= 1]), True


def slots_of(hashes: np.ndarray, n_slots: int, k: int) -> list[np.ndarray]:
    """k slot numbers for each hash; n_slots is a power of two."""
    low, high = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(32)) | np.uint64(1)
    return [((low + np.uint64(i) * high) & np.uint64(n_slots - 1)).astype(np.int64) for i in range(k)]


@dataclass(frozen=True)
class LanguageFilters:
    languages: list[str]
    slots: np.ndarray  # (n_slots, words) of uint64
    false_rate: np.ndarray  # of each language
    fallback: int  # the most frequent language, for texts without a known n-gram
    n: int
    k: int

    def shares(self, hashes: np.ndarray) -> np.ndarray:
        """For each language: the share of the n-grams it contains, corrected for false positives."""
        mask = None
        for at in slots_of(hashes, len(self.slots), self.k):
            mask = self.slots[at] if mask is None else mask & self.slots[at]
        found = np.array([np.count_nonzero(mask[:, i >> 6] >> np.uint64(i & 63) & np.uint64(1)) for i in range(len(self.languages))])
        return np.clip((found / len(hashes) - self.false_rate) / (1 - self.false_rate), 0, 1)

    def predict(self, text: str) -> tuple[str, float, float]:
        """Language, its share among all languages' shares, its share of the n-grams; ("und", 0, 0) without a letter."""
        hashes, any_letter = grams(text, self.n)
        if not any_letter or not self.languages:
            return "und", 0.0, 0.0
        shares = self.shares(hashes)
        if not shares.any():
            return self.languages[self.fallback], 0.0, 0.0
        best = int(shares.argmax())  # ties: the first by name
        return self.languages[best], float(shares[best] / shares.sum()), float(shares[best])


def build_filters(found: dict[str, np.ndarray], docs_of: dict[str, int], n: int, k: int, most_bytes: int = 1 << 30) -> LanguageFilters:
    """Filters of the n-grams found; an error if they took over most_bytes, as they are broadcast."""
    languages = sorted(docs_of)
    most = max([1, *(len(found[x]) for x in languages if x in found)])
    n_slots = 1 << max(10, (16 * most - 1).bit_length())  # at most k / 16 of the slots are taken
    if n_slots * 8 * -(-len(languages) // 64) > most_bytes:
        raise ValueError(f"language filters of over {most_bytes} bytes: {most} n-grams of a language, {len(languages)} languages; raise min_share or lower sample")
    slots = np.zeros((n_slots, max(1, -(-len(languages) // 64))), np.uint64)
    false_rate = np.zeros(len(languages))
    for i, language in enumerate(languages):
        for at in slots_of(found.get(language, np.empty(0, np.uint64)), n_slots, k):
            slots[at, i >> 6] |= np.uint64(1 << (i & 63))
        fill = np.count_nonzero(slots[:, i >> 6] >> np.uint64(i & 63) & np.uint64(1)) / n_slots
        false_rate[i] = fill**k
    return LanguageFilters(languages, slots, false_rate, max(range(len(languages)), key=lambda i: (docs_of[languages[i]], -i), default=0), n, k)


def learn_filters(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", n: int = 4, k: int = 3, sample: int = 3000, min_share: float = 0.004, thin: int = 0) -> LanguageFilters:
    """Filters of all languages of the rows where `train` holds and the language isn't null.

    The fit is on a bounded sample: of each language about `sample` documents, those of small id hash.  An n-gram is
    the language's if at least max(2, min_share * documents) of its sampled documents hold it, which keeps the words
    of other languages, names and noise out, and bounds a filter: no more than (n-grams a document) / min_share.  Of a
    language with fewer than `thin` documents every n-gram counts, as there is nothing to tell noise by.  An empty
    table gives filters without a language.
    """
    labelled = docs.where(train & F.col(lang_col).isNotNull())
    counts = {r[0]: r[1] for r in labelled.groupBy(F.col(lang_col).cast("string").alias("lang")).count().collect()}
    share = F.element_at(F.create_map(*[F.lit(v) for x, c in counts.items() for v in (x, min(1.0, sample / c))]), F.col(lang_col).cast("string")) if counts else F.lit(0.0)
    draw = F.pmod(F.xxhash64(F.lit("language"), F.col(id_col)), F.lit(1 << 30)) < share * (1 << 30)
    chosen = with_text(labelled.where(draw), id_col, text_col, F.col(lang_col).cast("string").alias("lang"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        size = 0

        def summed() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                gram, seen = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram.view(np.int64), pa.int64()), pa.array(seen, pa.int64())], names=["lang", "gram", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hashes = np.unique(grams(text, n)[0])
                held.setdefault(lang, []).append(hashes)
                size += len(hashes)
            if size > 4_000_000:
                yield from summed()
                held, size = {}, 0
        yield from summed()

    sums = chosen.mapInArrow(gather, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    least = F.element_at(F.create_map(*[F.lit(v) for x, c in counts.items() for v in (x, 1.0 if c < thin else max(2.0, min_share * min(c, sample)))]), F.col("lang")) if counts else F.lit(2.0)
    kept = sums.where(F.col("n") >= least).select("lang", "gram").toArrow() if counts else None
    found = {}
    if kept is not None:
        lang = kept.column("lang").to_pandas().to_numpy()
        gram = kept.column("gram").to_numpy().view(np.uint64)
        found = {x: gram[lang == x] for x in counts}
    return build_filters(found, counts, n, k)


def identify(docs: DataFrame, filters: LanguageFilters, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """(doc_id, ..., lang_pred, score, known): score is the language's part of all shares, known its share of the n-grams.

    Null text and text without a letter: "und", 0.  A text none of whose n-grams is known: the most frequent learned
    language, with score 0; without any learned language all are "und".  Equal rows are kept; no shuffle.
    """
    arrow_limits(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(filters)  # build_filters() checks its size
    rows = with_text(docs, id_col, text_col, *more)
    rows = rows.select("text", *[c for c in rows.columns if c != "text"])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = sent.value
        for batch in batches:
            lang, score, known = zip(*[filters.predict(t) for t in batch.column(0).to_pylist()], strict=True) if batch.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(known, pa.float64())], names=[*batch.schema.names[1:], "lang_pred", "score", "known"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[1:])
    return rows.mapInArrow(predict, f"{kept}, lang_pred string, score double, known double")
