"""Quality by a linear-chain conditional random field over lines.

Every line is good or bad; its features are its own and its two neighbours'.
Trained in numpy on the lines of labelled documents, each line taking its
document's label.  The forward-backward marginals of a document's lines,
weighted by their lengths, are its raw quality; a logistic curve fitted to the
training documents turns that into a probability.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, labelled_sample, with_text

_UPPER, _LOWER, _DIGIT = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789"
_SYMBOL, _STOP = b"#*$%&|<>{}[]=_~^\\/@+", b".,;:?\"'()-"
N_LINE = 16


def line_features(line: str, seen_before: bool) -> list[float]:
    raw = line.encode()
    n = len(raw) or 1
    upper, lower, digit, symbol, stop, bang = (n - len(raw.translate(None, c)) if raw else 0 for c in (_UPPER, _LOWER, _DIGIT, _SYMBOL, _STOP, b"!"))
    words = raw.split()
    m = len(words) or 1
    again = sum(map(bytes.__eq__, words, words[1:]))
    different = len(set(words))
    pairs = len(set(zip(words, words[1:], strict=False)))
    return [
        np.log1p(len(raw)) / 8, upper / n, upper / max(1, upper + lower), digit / n, symbol / n, stop / n, bang / n, raw.count(b"|") / m,
        different / m, again / m, 1 - pairs / max(1, len(words) - 1) if len(words) > 1 else 0.0, min(n / m, 40) / 10, float(seen_before), float(not words), min(1.0, symbol / m), min(1.0, bang / m),
    ]


def document_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(lines, 3 * N_LINE + 1) features, own, before and after, and a 1; lengths of the lines.  A text has one line at least."""
    lines = text.split("\n")
    seen: set[str] = set()
    own = np.empty((len(lines), N_LINE))
    for i, line in enumerate(lines):
        own[i] = line_features(line, line in seen and bool(line))
        seen.add(line)
    edge = np.zeros((1, N_LINE))
    x = np.hstack([own, np.vstack([edge, own[:-1]]), np.vstack([own[1:], edge]), np.ones((len(lines), 1))])
    return x, np.array([len(line) + 1.0 for line in lines])


def forward_backward(scores: list[np.ndarray], moves: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """For each chain: every line's probability of being good; the expected numbers of moves, summed over all chains.

    scores: how much more good than bad a line looks by itself.  moves: scores of [label, next label].  Chains of
    about equal length are done together, step by step.
    """
    out: list[np.ndarray] = [np.empty(0)] * len(scores)
    expected = np.zeros((2, 2))
    e_moves = np.exp(moves - moves.max())
    order = sorted(range(len(scores)), key=lambda i: len(scores[i]))
    at = 0
    while at < len(order):
        longest = 2 * len(scores[order[at]])
        group = [i for i in order[at : at + 512] if len(scores[i]) <= longest]
        at += len(group)
        sizes = np.array([len(scores[i]) for i in group])
        steps = sizes.max()
        e = np.zeros((len(group), steps))
        for row, i in enumerate(group):
            e[row, : sizes[row]] = scores[i]
        good = 1 / (1 + np.exp(-np.clip(e, -30, 30)))
        unary = np.stack([1 - good, good], 2)
        alive = np.arange(steps)[None, :] < sizes[:, None]
        forward = np.empty((steps, len(group), 2))
        forward[0] = unary[:, 0] / unary[:, 0].sum(1, keepdims=True)
        for t in range(1, steps):
            f = (forward[t - 1] @ e_moves) * unary[:, t]
            forward[t] = np.where(alive[:, t, None], f / f.sum(1, keepdims=True), forward[t - 1])
        back = np.ones((len(group), 2))
        marginal = np.empty((len(group), steps))
        for t in range(steps - 1, -1, -1):
            m = forward[t] * back
            m /= m.sum(1, keepdims=True)
            marginal[:, t] = m[:, 1]
            if t:
                b = unary[:, t] * back
                pair = forward[t - 1][:, :, None] * e_moves[None] * b[:, None, :]
                pair /= pair.sum((1, 2), keepdims=True)
                expected += pair[alive[:, t]].sum(0)
                b = b @ e_moves.T
                back = np.where(alive[:, t, None], b / b.sum(1, keepdims=True), back)
        for row, i in enumerate(group):
            out[i] = marginal[row, : sizes[row]]
    return out, expected


@dataclass(frozen=True)
class LineModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    moves: np.ndarray
    curve: tuple[float, float]  # of the logistic curve over the raw quality's logit

    def raw(self, documents: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not documents:
            return np.empty(0)
        marginals, _ = forward_backward([((x - self.mean) / self.scale) @ self.weights for x, _ in documents], self.moves)
        return np.array([float(m @ size / size.sum()) for m, (_, size) in zip(marginals, documents, strict=True)])

    def score(self, documents: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        raw = np.clip(self.raw(documents), 1e-4, 1 - 1e-4)
        a, b = self.curve
        return 1 / (1 + np.exp(-(a * np.log(raw / (1 - raw)) + b)))


def logistic_curve(z: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """a, b of sigmoid(a * z + b) by Newton's method with a slight pull towards a = 1, b = 0."""
    x, w = np.stack([z, np.ones_like(z)], 1), np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + (w - [1.0, 0.0])
        w = w - np.linalg.solve((x.T * (p * (1 - p))) @ x + np.eye(2), gradient)
    return float(w[0]), float(w[1])


def train_line_model(texts: list[str], labels: list[int], steps: int = 120, rate: float = 0.1, decay: float = 1e-3) -> LineModel:
    """Maximum likelihood by Adam over all given documents; without both labels, a model that always says so."""
    width = 3 * N_LINE + 1
    y = np.array(labels, float)
    plain = LineModel(np.zeros(width), np.ones(width), np.zeros(width), np.zeros((2, 2)), (0.0, 0.0))
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return LineModel(plain.mean, plain.scale, plain.weights, plain.moves, (0.0, float(np.log(share / (1 - share)))))
    documents = [document_features(t) for t in texts]
    stacked = np.vstack([x for x, _ in documents])
    mean, scale = stacked.mean(0), stacked.std(0) + 1e-3
    mean[-1], scale[-1] = 0, 1
    xs = [(x - mean) / scale for x, _ in documents]
    stacked = np.vstack(xs)
    sizes = [len(x) for x in xs]
    # a long document counts as much as a short one of a few lines
    doc_weight = np.array([min(1.0, 8 / n) for n in sizes])
    line_weight, line_y = np.repeat(doc_weight, sizes), np.repeat(y, sizes)
    moved = np.zeros((2, 2))
    for label, n in zip(labels, sizes, strict=True):
        moved[label, label] += n - 1
    w, moves = np.zeros(width), np.zeros((2, 2))
    theta = np.concatenate([w, moves.ravel()])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, moves = theta[:width], theta[width:].reshape(2, 2)
        scores = np.split(stacked @ w, np.cumsum(sizes)[:-1])
        marginals, expected = forward_backward(scores, moves)
        g_w = stacked.T @ (line_weight * (np.concatenate(marginals) - line_y)) / len(xs) + decay * w
        g_m = (expected - moved) / max(1.0, moved.sum()) + decay * moves
        g = np.concatenate([g_w, g_m.ravel()])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    model = LineModel(mean, scale, theta[:width], theta[width:].reshape(2, 2), (1.0, 0.0))
    raw = np.clip(model.raw(documents), 1e-4, 1 - 1e-4)
    return LineModel(model.mean, model.scale, model.weights, model.moves, logistic_curve(np.log(raw / (1 - raw)), y))


def learn_quality(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 2000) -> LineModel:
    """Model from at most `sample` labelled documents of each label for which `train` holds (of the labels' rows).

    The fit alone is on a bounded sample of rows, those of smallest id hash, with their whole texts.  The odds of the
    sample are put back to those of all training labels, so the score doesn't drift to even odds where the bound
    binds.  Without labels of both kinds every document gets the share of good ones (with one of each added).
    """
    texts, counts = labelled_sample(docs, labels, train, id_col, text_col, label_col, {0: sample, 1: sample})
    rows = sorted(texts.collect(), key=lambda r: (r.label, zlib.crc32(r.text.encode()), r.text))
    model = train_line_model([r.text for r in rows], [r.label for r in rows])
    drawn = Counter(r.label for r in rows)
    if drawn[0] and drawn[1]:
        a, b = model.curve
        model = replace(model, curve=(a, b + float(np.log(counts[1] / drawn[1]) - np.log(counts[0] / drawn[0]))))
    return model


def line_quality(docs: DataFrame, model: LineModel, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """(doc_id, ..., score): the probability that the document is good; one row each, no shuffle.

    Null and empty texts are one empty line and get that line's score.  Equal rows are kept and score alike; an empty
    table gives an empty one.
    """
    arrow_limits(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = with_text(docs, id_col, text_col, *more)
    rows = rows.select("text", *[c for c in rows.columns if c != "text"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = sent.value.score([document_features(t) for t in batch.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(scores, pa.float64())], names=[*batch.schema.names[1:], "score"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[1:])
    return rows.mapInArrow(score, f"{kept}, score double")
