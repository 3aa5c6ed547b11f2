"""Quality rules by compression bands.

zstandard ratios of the whole document and of fixed chunks are held against
limits that depend on the length: text that compresses far better than prose
of its length repeats itself, text that hardly compresses is noise (encoded
data, random characters).  Word and line counts go along for rule filters.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import BLANK_WORD, arrow_limits, with_text

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class BandLimits:
    """UTF-8 length from which a band holds, and the lowest and highest ratio (bytes over compressed bytes) allowed.

    Set from the ratios of prose (level 3): about 1.1 to 1.7 at 100 to 400 bytes, 1.4 to 2.1 at 1 KB, 1.8 to 2.4
    at 5 KB, 2.2 to 3.2 from 20 KB on; the limits leave room on both sides.  Under 128 bytes nothing is judged.
    """

    whole: tuple[tuple[int, float, float], ...] = (
        (0, 0.0, float("inf")), (128, 0.75, 3.0), (512, 1.15, 4.0), (2048, 1.38, 5.0), (8192, 1.45, 6.0), (32768, 1.5, 8.0),
    )
    chunk_bytes: int = 2048
    #: For each chunk.
    chunk_low: float = 1.2
    chunk_high: float = 6.0
    #: Rejected if more than this share of the chunks is outside of the chunk band.
    chunk_share: float = 0.4
    level: int = 3


def band_verdict(raw: bytes, limits: BandLimits, packer: zstandard.ZstdCompressor) -> tuple[float, float, bool]:
    """Ratio of the whole, share of chunks outside the chunk band, verdict.

    The last chunk is as long as the others and ends with the text, so every byte is in a chunk; a text shorter than
    one chunk is judged by the band of its length alone.
    """
    if not raw:
        return 1.0, 0.0, True
    ratio = len(raw) / len(packer.compress(raw))
    low, high = next((a, b) for at, a, b in reversed(limits.whole) if len(raw) >= at)
    size = limits.chunk_bytes
    starts = [min(at, len(raw) - size) for at in range(0, len(raw), size)] if len(raw) >= size else []
    out = sum(not limits.chunk_low <= size / len(packer.compress(raw[at : at + size])) <= limits.chunk_high for at in starts)
    share = out / len(starts) if starts else 0.0
    return ratio, share, low <= ratio <= high and share <= limits.chunk_share


def repeated_window_words(words: list[str], width: int = 3) -> int:
    """Words that lie in a window of so many words which the list holds twice or more."""
    windows = list(zip(*(words[i:] for i in range(width)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen = Counter(windows)
    total, covered = 0, 0  # covered: end of the last hit window
    for i, w in enumerate(windows):
        if seen[w] > 1:
            total += i + width - max(i, covered)
            covered = i + width
    return total


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if BLANK_WORD.search(x)]
    return len(lines) - len(set(lines))


SCHEMA = "doc_id {id}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, bad_chunk_share double"


def compression_bands(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: BandLimits = BandLimits(), min_words: int = 50, max_repeat: float = 0.5) -> DataFrame:
    """Word and line counts, compression ratios and a verdict for every document; one row each, no shuffle.

    base_failed: fewer than min_words words, or more than max_repeat of the words lie in repeated 3-word windows.
    kept: not base_failed, and the ratios are inside their bands.  Null and empty texts have no words: base_failed.
    Repeated rows give repeated rows, an empty table an empty one; other columns are ignored.
    """
    arrow_limits(docs.sparkSession)
    rows = with_text(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=limits.level)
        for batch in batches:
            out: list[list] = [[] for _ in range(9)]
            for text in batch.column(1).to_pylist():
                words = BLANK_WORD.findall(text)
                n, again = len(words), repeated_window_words(words)
                failed = n < min_words or again > max_repeat * n
                ratio, share, fits = band_verdict(text.encode(), limits, packer)
                values = (n, sum(map(len, words)), sum(map(text.count, SYMBOLS)), duplicate_lines(text), again, failed, fits and not failed, ratio, share)
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
            names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "bad_chunk_share"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=names)

    return rows.mapInArrow(measure, SCHEMA.format(id=kind.simpleString()))
