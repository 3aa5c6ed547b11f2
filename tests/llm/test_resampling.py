"""Importance resampling against counts of single features."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np

from textloom.llm import queries, resampling

from . import brute
from .conftest import SF

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, longest=3):
    words = WORD.findall(brute.lower(text))
    return len(words), [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def expected(docs, target, per_cent=5, least=20, buckets=10_000):
    own = [(i, *features(text)) for i, text in docs]

    def bucket(f):
        return zlib.crc32(f.encode()) % buckets

    source = Counter(bucket(f) for _, _, fs in own for f in fs)
    aim = Counter(bucket(f) for text in target for f in features(text)[1])
    s_all, t_all = sum(source.values()), sum(aim.values())
    rows = []
    for i, n, fs in own:
        weight = sum(math.floor(1000 * math.log((aim[b] + 1) * (s_all + buckets) / ((source[b] + 1) * (t_all + buckets)))) for b in map(bucket, fs))
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    eligible = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    for rank, r in enumerate(eligible[: per_cent * len(eligible) // 100], 1):
        r[4] = rank
    return rows


def test_op12_against_single_features(spark, texts):
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = sorted(r[:5] for r in expected(sorted(texts.items()), items))
    got = sorted(list(r) for r in queries.op12_importance_resampling(spark, SF).select("doc_id", "n_features", "weight", "score", "rank").collect())
    assert got == want and sum(r[4] is not None for r in got) >= 5


def test_awkward_rows(spark, edge, empty):
    target = spark.createDataFrame([(1, "same words AGAIN", "x"), (2, None, None), (None, "Wälder 你好 mail 1.2.3.4", "y")], "item_id long, text string, doc_id string")
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    for least, per_cent in ((20, 5), (1, 50), (0, 100)):
        want = expected(rows, [r.text for r in target.collect()], per_cent, least)
        got = resampling.resample(edge, target, per_cent, least).collect()
        key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2], r[3])
        plain = sorted(((r.doc_id, r.n_features, r.weight, r.score) for r in got), key=key)
        assert plain == sorted((tuple(r[:4]) for r in want), key=key)
        # of rows equal in score and id, which is drawn is open
        assert sorted((r.rank, r.score) for r in got if r.rank) == sorted((r[4], r[3]) for r in want if r[4])
    assert resampling.resample(empty, target).count() == 0
    alone = resampling.resample(edge, target.where("false")).collect()
    assert [r.weight for r in alone if r.n_features == 0] == [0] * 4 and len(alone) == len(rows)


def test_blocks_hold_every_count(edge, monkeypatch):
    """Slices of a text cut between words, and blocks of few rows, change nothing."""
    text = " ".join(f"w{i % 97} x{i % 13}" for i in range(5000))
    want = Counter(zlib.crc32(f.encode()) % 1000 for f in features(text)[1])
    monkeypatch.setattr(resampling, "SLICE", 50)
    found = Counter()
    for _, b in resampling.feature_buckets(text.encode(), 1000):
        found.update(b.tolist())
    assert found == want
    matrix = resampling.count_matrix(edge, buckets=50).collect()
    assert sum(len(r.ids) for r in matrix) == edge.count()
    for r in matrix:
        buckets, counts = np.frombuffer(r.buckets, resampling.BUCKET), np.frombuffer(r.counts, resampling.COUNT)
        assert r.bounds[0] == 0 and r.bounds[-1] == len(buckets) == len(counts)
        assert [sum(counts[a:b]) for a, b in zip(r.bounds, r.bounds[1:], strict=False)] == r.n_features
