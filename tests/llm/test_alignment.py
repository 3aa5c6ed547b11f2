"""Token alignment against the plain tokenizers and a walk over each text."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from textloom.llm import alignment, queries
from textloom.llm.common import materialize

from .conftest import SF

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
CHARS = alignment.byte_level_chars()
CHOICES = "abcdABCéßÄñЖ你ªº²½٣İſ \t\n\r\x0b\x0c\x1c\x1f\x85\xa0 　'’.,!#$%&<>|_-0123̸́😀\x00"
BITS = ["<|endoftext|>", "<s>", "</s>", "<unk>", "<0x0A>", "'s", "don't", "  ", "    ", "\n\n", " \n ", "x" * 60, "!" * 70, "hello world ", "▁"]


@pytest.fixture(scope="module")
def plain():
    first = Tokenizer.from_file(A)
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=B)


def walked(plain, text):
    """(n_a, n_b, groups, links) of one text."""
    first, second = plain
    if not text:
        return 0, 0, "", []
    a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
    pieces = [second.id_to_piece(i) for i in b]
    of_a = [bytes(CHARS[c] for c in first.id_to_token(i)) for i in a]
    of_b = [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces, strict=True)]
    if not b"".join(of_a) == b"".join(of_b) == b" " + text.encode():
        return 0, 0, "", []
    groups, links, i, j, at_a, at_b, from_i, from_j = [], [], 0, 0, 0, 0, 0, 0
    while i < len(a) or j < len(b):
        if at_a <= at_b:
            at_a, i = at_a + len(of_a[i]), i + 1
        else:
            at_b, j = at_b + len(of_b[j]), j + 1
        if at_a == at_b:
            groups.append(",".join(map(str, a[from_i:i])) + "|" + ",".join(map(str, b[from_j:j])))
            links.append((a[i - 1], b[j - 1]))
            from_i, from_j = i, j
    return len(a), len(b), ";".join(groups), links


def test_batches_against_a_walk(plain):
    r = random.Random(5)
    texts = ["".join(r.choice(CHOICES) if r.random() < 0.8 else r.choice(BITS) for _ in range(r.randint(0, 60))) for _ in range(1500)] + [None, "", " ", "  ", "\n", "\n ", " \n", "a", "▁"]
    first, second = alignment.ByteLevelEncoder(A), alignment.PieceEncoder(B, limit=500)
    assert second.cuts
    for at in range(0, len(texts), 250):
        some = texts[at : at + 250]
        got = alignment.align_batch(some, first, second)
        for k, text in enumerate(some):
            n_a, n_b, groups, links = walked(plain, text)
            assert (got.n_a[k], got.n_b[k], got.n_groups[k], got.groups[k].as_py()) == (n_a, n_b, len(links), groups), text
            assert dict(zip(got.pairs[k].as_py(), got.counts[k].as_py(), strict=True)) == Counter(a * 32_000 + b for a, b in links)


def expected(plain, rows):
    """The contract's rows for (doc_id, text) rows."""
    found = [(i, *walked(plain, text)) for i, text in rows]
    count = Counter(x for f in found for x in f[4])
    most = {}
    for (_, b), n in count.items():
        most[b] = max(n, most.get(b, 0))
    return [(i, n_a, n_b, len(links), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(groups.encode()).hexdigest() if n_a else "") for i, n_a, n_b, groups, links in found]


def test_op11_against_plain_tokenizers(spark, plain, texts):
    got = queries.op11_token_alignment(spark, SF)
    want = expected(plain, sorted(texts.items()))
    assert sorted(tuple(r) for r in got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()) == want
    assert 0 < sum(w[5] for w in want) < sum(w[4] for w in want)


@pytest.mark.parametrize("head", [500_000, 40, 0])
def test_awkward_rows_and_pairs_beyond_the_broadcast(spark, plain, edge, empty, head):
    """The result is the same whatever part of the pairs is broadcast; equal rows and null ids keep a row each."""
    links, _ = materialize(alignment.align(edge, A, B), "links")
    got = alignment.score_links(links, alignment.pair_counts(links, 32_000, held=50), head)
    rows = [(-1 if r.doc_id is None else r.doc_id, r.text) for r in edge.collect()]
    sha = F.when(F.col("n_groups") == 0, "").otherwise(F.sha2("groups", 256))
    seen = got.select(F.coalesce("doc_id", F.lit(-1)), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", sha).collect()
    assert sorted(tuple(r) for r in seen) == sorted(expected(plain, rows))
    nothing, _ = materialize(alignment.align(empty, A, B), "links")
    assert alignment.score_links(nothing, alignment.pair_counts(nothing, 32_000), head).count() == 0
