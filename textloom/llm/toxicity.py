"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary text and one on the
passages that set toxic text apart, and both kinds share the ordinary part, so
that ordinary windows compress to the same length with either.  A window that
gets shorter with the toxic dictionary has something in common with toxic
text; how much shorter, for the document's best windows and over all, is held
against thresholds calibrated by a logistic regression on the training rows.

A window is one word: what toxic texts have in common are short insults, and
in a window of several words the few bytes that a match saves are lost among
those by which the two dictionaries happen to match the neighbours (the README
has the figures).
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK_WORD_BYTES, arrow_limits, labelled_sample, with_text

WINDOW_WORDS = 1
N_FEATURES = 7
#: Windows whose gain a worker remembers at a time.
MEMORY = 400_000
#: Ends both dictionaries, starts and ends every window: so much is saved by it that zstandard never stores a window
#: raw, and the last bytes, where it looks for no matches, are never the window's own.
MARK = bytes(33 + (i * i * 7 + i * 13) % 94 for i in range(48))


def windows_of(text: str) -> list[bytes]:
    """The whole lower-cased text in windows of WINDOW_WORDS words, over-long ones in parts; none for a text without words."""
    words = BLANK_WORD_BYTES.findall(text.lower().encode())
    out = [b" %s " % b" ".join(words[i : i + WINDOW_WORDS]) for i in range(0, len(words), WINDOW_WORDS)]
    if any(len(w) > 4096 for w in out):
        out = [w[i : i + 4096] for w in out for i in range(0, len(w), 4096)]
    return out


def trained(samples: list[bytes], size: int) -> bytes:
    """A zstandard dictionary's bytes; the samples themselves where there are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[:size]


def byte_grams(text: bytes, width: int) -> np.ndarray:
    """The byte n-grams of the text, one a place, as numbers; width is 8 at most."""
    raw = np.frombuffer(text, np.uint8).astype(np.uint64)
    n = len(raw) - width + 1
    if n < 1:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out = out << np.uint64(8) | raw[i : i + n]
    return out


def telling_grams(toxic: list[np.ndarray], ordinary: list[np.ndarray], least: float = 0.01, lift: float = 12.0) -> np.ndarray:
    """N-grams that far more of the toxic than of the ordinary documents hold, given each document's different n-grams.

    An n-gram counts from 4 toxic documents, and the share `least` of them, on.
    """
    none = [np.empty(0, np.uint64)]
    bad, n_bad = np.unique(np.concatenate(none + toxic), return_counts=True)
    good, n_good = np.unique(np.concatenate(none + ordinary), return_counts=True)
    bad, n_bad = (x[n_bad >= max(4, least * len(toxic))] for x in (bad, n_bad))
    at = np.searchsorted(good, bad)
    at[at == len(good)] = 0
    in_good = np.where(good[at] == bad, n_good[at], 0) if len(good) else np.zeros(len(bad))
    return bad[n_bad >= lift * len(toxic) / max(1, len(ordinary)) * (in_good + 0.5)]


def passages(text: bytes, marks: np.ndarray, width: int) -> list[bytes]:
    """The parts of the text that are made of these n-grams."""
    hit = np.flatnonzero(np.isin(byte_grams(text, width), marks))
    runs = np.split(hit, np.flatnonzero(np.diff(hit) > 1) + 1) if len(hit) else []
    return [text[r[0] : r[-1] + width] for r in runs]


@dataclass
class CompressionModel:
    ordinary: bytes
    toxic: bytes
    weights: list[float]
    mean: list[float]
    scale: list[float]
    _packers: tuple = field(default=(), repr=False)
    _known: dict[bytes, int] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_packers": (), "_known": {}}

    def packers(self) -> tuple:
        if not self._packers:
            # the same length and the same explicit parameters for both, or their hash tables would differ by chance
            settings = zstandard.ZstdCompressionParameters(window_log=17, hash_log=16, chain_log=16, search_log=4, min_match=4, target_length=32, strategy=zstandard.STRATEGY_LAZY2, write_content_size=False, write_dict_id=False)
            made = []
            for own in (b"\0" * len(self.toxic), self.toxic):
                d = zstandard.ZstdCompressionDict(self.ordinary + own + MARK, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(compression_params=settings)
                made.append(zstandard.ZstdCompressor(dict_data=d, compression_params=settings))
            self._packers = tuple(made)
        return self._packers

    def gains(self, windows: list[bytes]) -> np.ndarray:
        """Bytes saved by the toxic dictionary, for each different window; those of short windows are remembered."""
        if len(self._known) > MEMORY:
            self._known.clear()
        known, (plain, toxic) = self._known, (p.compress for p in self.packers())
        out = []
        for w in dict.fromkeys(windows):
            gain = known.get(w)
            if gain is None:
                marked = MARK + w + MARK
                gain = len(plain(marked)) - len(toxic(marked))
                if len(w) <= 40:
                    known[w] = gain
            out.append(gain)
        return np.array(out, float)

    def features(self, windows: list[bytes]) -> list[float]:
        g = np.sort(self.gains(windows))[::-1]
        if not len(g):
            return [0.0] * N_FEATURES
        top = np.pad(g[:3], (0, max(0, 3 - len(g))))
        total = g[g > 0].sum()
        return [top[0], top[1], top[2], np.log1p(total), 10 * total / (len(g) + 10), np.log1p(np.count_nonzero(g >= 4)), np.log1p(len(g))]

    def scores(self, features: np.ndarray) -> np.ndarray:
        z = (features - np.array(self.mean)) / np.array(self.scale)
        return 1 / (1 + np.exp(-np.clip(np.hstack([z, np.ones((len(z), 1))]) @ np.array(self.weights), -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, pull: float = 1.0, steps: int = 40) -> np.ndarray:
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    damp = pull * np.eye(len(w))
    damp[-1, -1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w - np.linalg.solve((x.T * (p * (1 - p))) @ x + damp, x.T @ (p - y) + damp @ w)
    return w


def train_compression(cut: list[list[bytes]], labels: list[int], dict_bytes: int = 32_768, toxic_bytes: int = 8_192, folds: int = 4, width: int = 6, dict_windows: int = 200_000) -> CompressionModel:
    """Dictionaries and thresholds from each document's different windows.

    The ordinary dictionary is trained on about dict_windows windows at most, drawn over the whole of all texts by
    their hash.  The thresholds are fitted on documents in folds, each scored with a toxic dictionary that has seen
    the others only.  width and dict_windows were chosen by those folds' scores, on training documents alone: 6 is
    better than 5 for each of five sizes of sample.
    """
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return CompressionModel(b"", b"", [0.0] * N_FEATURES + [float(np.log(share / (1 - share)))], [0.0] * N_FEATURES, [1.0] * N_FEATURES)
    plain = [c for c, label in zip(cut, labels, strict=True) if not label]
    share = dict_windows / max(dict_windows, sum(map(len, plain)))
    ordinary = trained([w for i, c in enumerate(plain) for w in c if share == 1 or zlib.crc32(w, i) < share * (1 << 32)], dict_bytes)
    whole = [b"".join(c) for c in cut]
    grams = [np.unique(byte_grams(t, width)) for t in whole]

    def toxic_part(chosen: list[int]) -> bytes:
        marks = telling_grams(*([grams[i] for i in chosen if labels[i] == label] for label in (1, 0)))
        return trained([p for i in chosen if labels[i] for p in passages(whole[i], marks, width)], toxic_bytes)

    x = np.zeros((len(cut), N_FEATURES))
    for fold in range(folds):
        part = CompressionModel(ordinary, toxic_part([i for i in range(len(cut)) if i % folds != fold]), [], [], [])
        for i in range(fold, len(cut), folds):
            x[i] = part.features(cut[i])
    mean, scale = x.mean(0), np.maximum(x.std(0), 0.3)
    weights = logistic((x - mean) / scale, y)
    return CompressionModel(ordinary, toxic_part(list(range(len(cut)))), weights.tolist(), mean.tolist(), scale.tolist())


def learn_toxicity(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 1500, ordinary_sample: int = 3000) -> CompressionModel:
    """Model from at most `sample` toxic and `ordinary_sample` ordinary documents, of the label rows for which `train` holds.

    The fit alone is on a bounded sample of rows, those of smallest id hash, and on their whole texts: tasks send the
    driver each one's different windows.  The odds of the sample are put back to those of all training labels.
    Without labels of both kinds every document gets the share of toxic ones (with one of each added), so 1/2 for
    empty tables.
    """
    texts, counts = labelled_sample(docs, labels, train, id_col, text_col, label_col, {0: ordinary_sample, 1: sample})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            windows = [b"\n".join(dict.fromkeys(windows_of(t))) for t in batch.column(1).to_pylist()]  # no window has a \n
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(windows, pa.binary())], names=["label", "windows"])

    arrow_limits(docs.sparkSession)
    drawn_rows = texts.select("label", "text").mapInArrow(cut, "label int, windows binary").toArrow()
    ordered = sorted(zip(drawn_rows.column("label").to_pylist(), drawn_rows.column("windows").to_pylist(), strict=True), key=lambda r: (r[0], zlib.crc32(r[1]), r[1]))
    seen: dict[bytes, bytes] = {}  # one object for all occurrences of a window
    rows = [(label, [seen.setdefault(w, w) for w in raw.split(b"\n") if w]) for label, raw in ordered]
    del drawn_rows, ordered, seen
    model = train_compression([windows for _, windows in rows], [label for label, _ in rows])
    drawn = Counter(label for label, _ in rows)
    if drawn[0] and drawn[1]:
        model.weights[-1] += float(np.log(counts[1] / drawn[1]) - np.log(counts[0] / drawn[0]))
    return model


def toxicity(docs: DataFrame, model: CompressionModel, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """(doc_id, ..., score, best_gain): the probability that the document is toxic, the bytes saved in its best window.

    Null, empty and wordless texts have no window and get the score of no gain.  Equal rows are kept and score alike,
    an empty table gives an empty one; no shuffle.
    """
    arrow_limits(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of bounded size
    rows = with_text(docs, id_col, text_col, *more)
    rows = rows.select("text", *[c for c in rows.columns if c != "text"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([sent.value.features(windows_of(t)) for t in batch.column(0).to_pylist()]).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(sent.value.scores(x), pa.float64()), pa.array(x[:, 0], pa.float64())], names=[*batch.schema.names[1:], "score", "best_gain"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[1:])
    return rows.mapInArrow(score, f"{kept}, score double, best_gain double")
