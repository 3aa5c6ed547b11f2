"""Every operator against brute force, an exact round trip or held-out accuracy, and on awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from textloom.llm import bands, ctw, decontam, langid, linecrf, packing, pii, queries, simhash, sstable, tokens, toxicity
from textloom.llm.common import crc_mod, fresh_path

from . import brute
from .conftest import SF

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def plain(path):
    return Tokenizer.from_file(path)


def held_out(doc_id, n, r):
    return zlib.crc32(str(doc_id).encode()) % n == r


def auc(rows, label_of):
    good = [r.score for r in rows if label_of[r.doc_id] == 1]
    bad = [r.score for r in rows if label_of[r.doc_id] == 0]
    return float(np.mean([(g > b) + (g == b) / 2 for g in good for b in bad]))


# -- tokens -------------------------------------------------------------------


@pytest.mark.parametrize(("path", "split"), [(BYTE, "byte_level"), (WORD, "words")])
def test_pieces_join_to_the_tokenizers_ids(path, split):
    r = random.Random(3)
    chars = "abcdABCéßÄñЖ你ªº²½٣İſ \t\n\r\x0b\x0c\x1c\x1f\x85\xa0 　'’.,!#$%&<>|_-0123̸́😀"
    bits = ["<|endoftext|>", "<|startoftext|>", "<|endoftext|><|endoftext|>", "<|endoftext", "'s", "'LL", "don't", " it's", "</w>", "x" * 60, "!" * 70]
    fuzz = ["".join(r.choice(chars) if r.random() < 0.9 else r.choice(bits) for _ in range(r.randint(0, 50))) for _ in range(3000)]
    e, t = tokens.CachedEncoder(path, split, limit=500), plain(path)
    for i in range(0, len(fuzz), 100):
        some = fuzz[i : i + 100]
        assert e(some) == [np.array(x.ids, "<u4").tobytes() for x in t.encode_batch(some, add_special_tokens=False)]


def test_op1_reads_back_all_ids_in_order(spark, texts):
    t, start, want = plain(BYTE), 0, {}
    for i in sorted(texts):
        ids = brute.token_ids(t, texts[i])
        want[i] = (start, len(ids), brute.ids_crc(ids))
        start += len(ids)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op1_sorted_string_table(spark, SF).collect()}
    assert got == want


def test_sorted_string_table_lookup(spark, edge, empty):
    t = plain(BYTE)
    manifest = sstable.write_shards(edge, BYTE, fresh_path(spark, "test"))
    want = defaultdict(list)
    for r in edge.collect():
        want[r.doc_id].append(np.array(brute.token_ids(t, r.text), "<u4").tobytes())
    shards = [sstable.Shard(m.path) for m in manifest]
    for doc_id in [None, *range(-1, 12)]:
        assert sorted(v for s in shards for v in s.get(doc_id)) == sorted(want.get(doc_id, []))
    assert sum(any(s.may_hold(i) for s in shards) for i in range(1000, 3000)) < 200
    rows = sstable.read_shards(spark, manifest).orderBy("start").collect()
    assert [r.start for r in rows] == [0, *np.cumsum([len(r.ids) // 4 for r in rows])[:-1].tolist()]
    assert sstable.token_table(empty, BYTE).count() == 0


def check_packing(rows, ids_of):
    """ids_of: the ids of each text, listed under its doc_id."""
    left = {k: sorted(map(tuple, v)) for k, v in ids_of.items()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    for k, texts_ids in left.items():
        want = [(at, len(ids[at : at + 4096]), brute.ids_crc(ids[at : at + 4096]), len(ids)) for ids in texts_ids for at in range(0, len(ids), 4096)]
        assert sorted(pieces[k]) == sorted(want)
    assert set(pieces) == set(left)
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 4096
    return len(sequences)


def test_op4_each_id_in_one_piece_with_little_padding(spark, texts, edge, empty):
    t = plain(WORD)
    ids = {k: [brute.token_ids(t, v)] for k, v in texts.items()}
    n = check_packing(queries.op4_packing(spark, SF).collect(), ids)
    assert n <= -(-sum(len(x[0]) for x in ids.values()) // 4096) + 1
    own = defaultdict(list)
    for r in edge.collect():
        own[r.doc_id].append(brute.token_ids(t, r.text))
    check_packing(packing.pack(edge, WORD).collect(), own)
    assert packing.pack(empty, WORD).count() == 0


def test_best_fit_takes_the_tightest_open_window():
    r = random.Random(1)
    lengths = [r.randint(1, 64) for _ in range(400)]
    room, want = [], []
    for n in sorted(lengths, reverse=True):
        fits = [x for x in room if x >= n]
        if fits:
            room.remove(min(fits))
        room.append((min(fits) if fits else 64) - n)
        want.append(sorted(room))
    placed = packing.best_fit_decreasing(lengths, 64)
    used = defaultdict(int)
    for (s, _), n in zip(placed, lengths, strict=True):
        used[s] += n
    assert sorted(64 - u for u in used.values()) == want[-1]


# -- decontamination, near-duplicates -------------------------------------------


def test_op3_against_brute_force(spark, texts):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = queries.op3_decontamination(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        n, hit, found = brute.contamination(texts[r.doc_id], items)
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), hit > 0 and 20 * hit >= n)
    assert any(r.contaminated for r in got)


@pytest.mark.parametrize("filter_bits", [27, 7])
def test_decontamination_of_awkward_rows(spark, edge, empty, filter_bits):
    """A filter of 128 bits lets nearly everything through; the join decides."""
    items = spark.createDataFrame([(1, "same words AGAIN"), (2, None), (None, "word word"), (3, "..."), (4, " ".join(f"w{i}" for i in range(20))), (1, "wälder 你好")], "item_id long, text string")
    extra = spark.createDataFrame([(20, " ".join(f"W{i}" for i in range(3, 18)) + " und Wälder 你好")], "doc_id long, text string")
    docs = edge.select("doc_id", "text").unionByName(extra)
    pairs = [("" if r.item_id is None else r.item_id, r.text) for r in items.collect()]
    got = sorted(tuple(r) for r in decontam.decontaminate(docs, items, filter_bits=filter_bits).select(F.coalesce("doc_id", F.lit(-1)), "n_words", "n_hit", F.array_join("items", ",")).collect())
    want = []
    for r in docs.collect():
        if r.doc_id == 7:
            want.append((7, 60_000, 60_000, ""))
        else:
            n, hit, found = brute.contamination(r.text, pairs)
            want.append((-1 if r.doc_id is None else r.doc_id, n, hit, ",".join(found)))
    assert got == sorted(want)
    assert decontam.decontaminate(empty, items).count() == 0
    clean = decontam.decontaminate(edge, items.where("false")).collect()
    assert len(clean) == edge.count() and not any(r.contaminated for r in clean)


def test_a_long_quoted_passage(spark):
    """20,000 words of an item within a document: every word of it is hit, and no stretch's words are copied for each find."""
    passage = [f"p{i * i % 7919}q{i}" for i in range(20_000)]
    items = spark.createDataFrame([(1, " ".join(passage))], "item_id long, text string")
    docs = spark.createDataFrame([(1, "before " + " ".join(passage) + " after"), (2, "clean words alone"), (3, " ".join(passage[100:112])), (4, " ".join(passage[100:113]))], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontam.decontaminate(docs, items).collect()}
    assert got == {1: (20_002, 20_000, ["1"]), 2: (3, 0, []), 3: (12, 0, []), 4: (13, 13, ["1"])}


def test_op5_against_all_pairs(spark, texts):
    ids = sorted(texts)
    prints = [brute.simhash(texts[i]) for i in ids]
    want = {i: (f"{p:016x}", ids[c]) for i, p, c in zip(ids, prints, brute.components(prints, 4), strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op5_simhash(spark, SF).collect()} == want
    assert len({c for _, c in want.values()}) < len(ids)


@pytest.mark.parametrize("shard_limit", [4096, 8])
def test_hamming_groups_of_clustered_fingerprints(spark, shard_limit):
    r = random.Random(9)
    centres = [r.getrandbits(64) for _ in range(20)]
    prints = {0, (1 << 64) - 1}
    for c in centres:
        for _ in range(15):  # chains, some of whose ends are far apart
            for b in r.sample(range(64), r.randint(1, 6)):
                c ^= 1 << b
            prints.add(c)
    ordered = sorted(prints, key=lambda p: p - (1 << 64) if p >> 63 else p)
    signed = [p - (1 << 64) if p >> 63 else p for p in ordered]
    links = simhash.hamming_links(spark.createDataFrame([(p,) for p in signed], "fp long"), 4, shard_limit)
    got = {x.node: x.root for x in simhash.linked_groups(links).collect()}
    want = {p: signed[c] for p, c in zip(signed, brute.components(ordered, 4), strict=True)}
    assert {p: got.get(p, p) for p in signed} == want


def test_near_duplicates_of_awkward_rows(edge, empty):
    got = simhash.near_duplicates(edge).collect()
    assert len(got) == edge.count()
    wordless = [r for r in got if r.fp == 0]
    assert {r.doc_id for r in wordless} == {None, 1, 2, 3} and {r.component_id for r in wordless} == {1}
    assert simhash.near_duplicates(empty).count() == 0


# -- languages, scores ---------------------------------------------------------------


def test_op6_on_held_out_documents(spark, texts):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op6_language_id(spark, SF).collect()
    assert len(rows) == len(texts)
    assert all(r.held_out == held_out(r.doc_id, 3, 1) and 0 <= r.score <= 1 for r in rows)
    judged = [r for r in rows if r.held_out and lang[r.doc_id] and r.lang_pred != "und"]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in judged]) >= 0.95
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in texts[r.doc_id] or "")) for r in rows)


def test_op6_against_plain_sets_of_grams(spark, texts):
    """Shares of n-grams in exact sets of strings: predictions agree, and scores but for the filters' few false positives."""

    def plain_grams(text):
        chars = "".join(c if c.isalpha() else " " for c in f" {(text or '').lower()} ")
        every = [chars[i : i + 4].ljust(4) for i in range(max(1, len(chars) - 3))]
        inside = [g for g in every if sum(c != " " for c in g) >= 3]
        return inside or [g for g in every if g.strip()]

    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    seen, docs_of = defaultdict(Counter), Counter()
    for i, text in texts.items():
        if lang[i] is not None and not held_out(i, 3, 1):
            docs_of[lang[i]] += 1
            seen[lang[i]].update(set(plain_grams(text)))
    sets = {x: {g for g, n in seen[x].items() if n >= max(2.0, 0.004 * docs_of[x])} for x in docs_of}
    close = 0
    for r in queries.op6_language_id(spark, SF).collect():
        found = plain_grams(texts[r.doc_id])
        if not found:
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        shares = {x: sum(g in own for g in found) / len(found) for x, own in sets.items()}
        first, second = sorted(shares.values(), reverse=True)[:2]
        close += first - second < 0.02
        assert r.lang_pred in [x for x, v in shares.items() if first - v < 0.02] or first == 0
        if first > 0.1:
            assert abs(r.score - shares[r.lang_pred] / sum(shares.values())) < 0.03
    assert close < len(texts) / 20


def test_language_filters_hold_all_they_were_given(edge, empty):
    r = np.random.default_rng(2)
    found = {x: r.integers(0, 1 << 63, 500, dtype=np.uint64) for x in ("aa", "bb", "cc")}
    filters = langid.build_filters(found, {"aa": 1, "bb": 2, "cc": 3}, 4, 3)
    for i, x in enumerate(("aa", "bb", "cc")):
        assert filters.shares(found[x])[i] == 1
        assert np.delete(filters.shares(found[x]), i).max() < 0.05
    learned = langid.learn_filters(edge, F.lit(True))
    assert langid.identify(edge, learned).count() == edge.count()
    assert langid.identify(empty, learned).count() == 0
    nothing = langid.learn_filters(empty, F.lit(True))
    assert {x.lang_pred for x in langid.identify(edge, nothing).collect()} == {"und"}


def test_op7_base_is_exact(spark, texts):
    counts, n = defaultdict(int), 0
    words = {k: [*brute.BLANK.findall(brute.lower(v)), ""] for k, v in texts.items()}
    for k, found in words.items():
        if not held_out(k, 7, 2):
            for w in found:
                counts[w] += 1
                n += 1
    rows = queries.op7_context_tree(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        found = words[r.doc_id]
        base = sum(np.log10((counts.get(w, 0) + 1) / (n + len(counts) + 1)) for w in found)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held_out(r.doc_id, 7, 2), len(found), sum(w in counts for w in found), n)
        assert r.base_score == pytest.approx(base, rel=1e-9)
    # contexts must help: on new texts the tree has to beat the bytes' plain frequencies
    trained = b"".join((v or "").encode() + b"\0" for k, v in texts.items() if not held_out(k, 7, 2))
    share = np.log10((np.bincount(np.frombuffer(trained, np.uint8), minlength=256) + 0.5) / (len(trained) + 128))
    new = [r for r in rows if r.held_out]
    assert sum(r.score for r in new) > 0.8 * sum(share[np.frombuffer((texts[r.doc_id] or "").encode() + b"\0", np.uint8)].sum() for r in new)


def test_base_is_exact_whatever_is_broadcast(edge, empty):
    def bases(**options):
        rows = ctw.score_documents(edge, F.lit(True), **options).collect()
        assert len(rows) == edge.count() and all(r.n_known == r.n_tokens for r in rows)
        return sorted(r.base_score for r in rows)

    assert bases(head_words=1) == pytest.approx(bases(), rel=1e-9)
    assert ctw.score_documents(empty, F.lit(True)).count() == 0
    untrained = ctw.score_documents(edge, F.lit(False)).collect()
    assert len(untrained) == edge.count() and all(r.train_tokens == 0 for r in untrained)


def test_context_tree_against_recursion(spark):
    texts = ["abracadabra", "abra abra cab", "A bad cab, 12!", "é"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    tree = ctw.grow_tree(ctw.gather_counts(docs).where("cell is not null").select("cell", "n"), 24_000)
    for scored in ("abra", "cab 7", "zzz", ""):
        assert tree.log10(scored) == pytest.approx(brute.tree_log10(texts, scored, ctw.CLASS, ctw.DEPTH), rel=1e-4)
    assert np.allclose((10.0**tree.table.astype(float)).sum(1), 1, atol=1e-4)


@pytest.mark.parametrize("options", [{}, {"head_cells": 300}])
def test_every_context_counts_whatever_is_broadcast(spark, options):
    """More than 24,000 contexts, most of them seen once, and texts with unseen ones."""
    r = random.Random(5)
    trained = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz 01é.") for _ in range(2000)) for _ in range(10)]
    new = [trained[3][500:700] + "\x07 never 你", "", trained[0][:90]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(trained + new)], "doc_id long, text string")
    got = {x.doc_id: x.score for x in ctw.score_documents(docs, F.col("doc_id") < len(trained), **options).collect()}
    assert len(got) == len(trained) + len(new)
    counted = ctw.gather_counts(docs.where(F.col("doc_id") < len(trained))).where("cell is not null").select("cell", "n")
    tree = ctw.grow_tree(counted, 1 << 40)  # all of it on the driver, itself tested against recursion
    assert len(tree.table) > 24_000
    for i, text in enumerate(trained + new):
        assert got[i] == pytest.approx(tree.log10(text), rel=1e-5)


# -- classifiers ---------------------------------------------------------------------


@pytest.mark.parametrize(("query", "label", "n", "r", "size"), [("op2_toxicity", "toxic", 4, 2, "0.1"), ("op2_toxicity", "toxic", 4, 2, "0.01"), ("op8_line_crf", "quality", 5, 0, "0.01")])
def test_classifiers_on_held_out_labels(spark, query, label, n, r, size):
    sf = SF.replace("0.001", size)
    known = {x.doc_id: x[label] for x in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.QUERIES[query](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.3) and x.held_out == held_out(x.doc_id, n, r) for x in rows)
    assert auc([x for x in rows if x.held_out and known.get(x.doc_id) is not None], known) >= 0.85


def test_classifiers_of_awkward_rows(spark, edge, empty):
    labels = spark.createDataFrame([(None, 1, 0), (4, 1, 0), (4, 1, 0), (5, 0, 1), (6, 1, None), (7, None, 1), (9, 0, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.where("false")):
        q, t = linecrf.learn_quality(edge, known, F.lit(True)), toxicity.learn_toxicity(edge, known, F.lit(True))
        for scored in (linecrf.line_quality(edge, q), toxicity.toxicity(edge, t)):
            rows = scored.collect()
            assert len(rows) == edge.count() and all(0 <= r.score <= 1 for r in rows)
        assert linecrf.line_quality(empty, q).count() == toxicity.toxicity(empty, t).count() == 0


def test_quality_keeps_the_labels_odds_where_the_sample_is_bounded(spark):
    """600 good and 60 bad documents that can't be told apart by their lines: 10 to 1, whatever is drawn."""
    r = random.Random(12)
    words = "the of a lake river stone under green slow and with many".split()
    docs = [(i, "\n".join(" ".join(r.choice(words) for _ in range(12)) for _ in range(3)), int(i % 11 > 0)) for i in range(660)]
    df = spark.createDataFrame(docs, "doc_id long, text string, quality int")
    for sample in (2000, 60):
        model = linecrf.learn_quality(df, df, F.lit(True), sample=sample)
        scores = np.array([x.score for x in linecrf.line_quality(df, model).collect()])
        assert abs(scores.mean() - 600 / 660) < 0.04 and (scores >= 0.3).mean() > 0.98


def test_line_marginals_against_enumeration():
    r = np.random.default_rng(4)
    chains, moves = [r.normal(size=n) for n in (1, 4, 5, 9)], r.normal(size=(2, 2))
    got, expected = linecrf.forward_backward(chains, moves)
    pairs = np.zeros((2, 2))
    for scores, marginal in zip(chains, got, strict=True):
        n = len(scores)
        labels = np.array([[c >> i & 1 for i in range(n)] for c in range(1 << n)])
        weight = np.exp(labels @ scores + moves[labels[:, :-1], labels[:, 1:]].sum(1))
        weight /= weight.sum()
        assert marginal == pytest.approx(weight @ labels)
        for a, b in np.ndindex(2, 2):
            pairs[a, b] += weight @ ((labels[:, :-1] == a) & (labels[:, 1:] == b)).sum(1)
    assert expected == pytest.approx(pairs)


# -- personal data, compression --------------------------------------------------------


def test_op9_patterns_and_added_spans(spark, texts):
    rows = queries.op9_personal_data(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = brute.personal(texts[r.doc_id])
        listed = [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[1] == k for s in base) for k in range(4)]
        assert set(listed) <= set(r.spans.split(","))


def test_patterns_on_awkward_texts():
    r = random.Random(8)
    chars = "ab.@-+ 0123456789()19_%é\n"
    for _ in range(4000):
        text = "".join(r.choice(chars) for _ in range(r.randint(0, 60)))
        assert pii.base_spans(text) == brute.personal(text), text
    for text in ("a" * 200_000, "a@" * 100_000, "1." * 100_000, "+1" * 100_000, "1" * 100_000, "+1" + " " * 100_000):
        pii.base_spans(text)


def test_tagger_gradient_and_decoding():
    r = np.random.default_rng(6)
    tagger = pii.Tagger.fresh(width=3, size=4)
    tagger.p = {k: v.astype(float) for k, v in tagger.p.items()}
    x, y = r.integers(0, pii.SYMBOLS, (5, 3)), np.array([[0, 1, 3], [1, 2, 4], [2, 2, 0], [0, 0, 5], [7, 0, 6]])
    _, gradient = tagger.gradient(x, y)
    for name, values in tagger.p.items():
        for _ in range(4):
            at = tuple(r.integers(0, n) for n in values.shape)
            if name == "embed":
                at = (int(r.choice(x.ravel())), at[1])
            kept = values[at]
            values[at] = kept + 1e-5
            high, _ = tagger.gradient(x, y)
            values[at] = kept - 1e-5
            low, _ = tagger.gradient(x, y)
            values[at] = kept
            assert gradient[name][at] == pytest.approx((high - low) / 2e-5, abs=2e-4)
    scores, _ = tagger.unary(x[:3, :1])
    moves = tagger.p["moves"] + pii.MOVES
    best = max(np.ndindex(pii.TAGS, pii.TAGS, pii.TAGS), key=lambda t: sum(scores[i, 0, t[i]] for i in range(3)) + moves[0, t[0]] + moves[t[0], t[1]] + moves[t[1], t[2]])
    assert tuple(tagger.decode(x[:3, :1].T)[0]) == best


def test_added_spans_on_planted_forms(spark, documents, texts):
    """Forms that the patterns miss, with numbers and names of their own, in texts without personal data."""
    tagger, r = pii.learn_tagger(documents), random.Random(77)
    clean = [t for t in texts.values() if t and len(t) > 200 and not brute.personal(t)]
    planted, want = [], []
    for i in range(160):
        kind, text = i % 4, clean[i % len(clean)]
        span = pii.rewritten(kind, pii.invented(kind, r), r)
        at = text.find(" ", r.randint(0, len(text) // 2)) + 1
        planted.append(f"{text[:at]}{span} {text[at:]}")
        want.append((at, kind, at + len(span)))
    found = pii.all_spans(planted, tagger)
    assert not any(base for base, _ in found)
    for kind in range(4):
        assert np.mean([w in spans for w, (_, spans) in zip(want, found, strict=True) if w[1] == kind]) >= 0.6
    assert np.mean([w in spans for w, (_, spans) in zip(want, found, strict=True)]) >= 0.8
    assert sum(len(spans) for _, spans in found) - sum(w in spans for w, (_, spans) in zip(want, found, strict=True)) <= 3
    assert not any(spans for _, spans in pii.all_spans(clean, tagger))


@pytest.mark.parametrize("kind", range(4))
def test_training_window_that_cuts_an_earlier_span_of_its_kind(kind):
    """The window is rewritten where its whole span stands, not where one is cut at its start."""
    span = ["ann.lee@mail.example.com", "192.168.10.25", "4111 1111 1111 1111", "+1 (528) 555-3435"][kind]
    text = f"{span[8:]} some words between {span} and some more"
    at = text.index(span)
    window = (text, [(-8, kind, len(span) - 8), (at, kind, at + len(span))])
    for seed in range(20):
        made = [w for w in pii.labelled_windows({kind: [window]}, 1, seed) if w[0].startswith(text[: at - 1])]
        assert len(made) == (5 if kind == 0 else 3) and made[0] == window
        for changed, spans in made[1:]:
            assert spans[0] == window[1][0] and spans[1][:2] == window[1][1][:2] and changed == text[:at] + changed[at : spans[1][2]] + text[at + len(span) :]
            assert changed[at : spans[1][2]] != span


def test_personal_data_of_awkward_rows(edge, empty):
    for tagger in (pii.learn_tagger(edge), pii.learn_tagger(empty)):
        rows = pii.find_personal_data(edge, tagger).collect()
        assert len(rows) == edge.count()
        six = next(r for r in rows if r.doc_id == 6)
        assert (six.n_email, six.n_ip, six.n_card, six.n_phone) == (1, 1, 1, 1) and "[EMAIL]" in six.redacted and "4111" not in six.redacted
        assert pii.find_personal_data(empty, tagger).count() == 0


def test_op10_counts_and_verdicts(spark, texts, edge, empty):
    rows = queries.op10_compression_bands(spark, SF).collect()
    assert len(rows) == len(texts)
    for r, text in [(r, texts[r.doc_id]) for r in rows]:
        counts = brute.text_counts(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts
        assert r.base_failed == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
        assert not (r.kept and r.base_failed)
    assert any(r.kept for r in rows)
    prose = " ".join("".join(random.Random(i).choice("abcdefghij") for _ in range(5)) for i in range(800))
    tails = spark.createDataFrame([(1, prose[:2048]), (2, prose[:2048] + "\n" + "a " * 1000)], "doc_id long, text string")
    assert {r.doc_id: round(r.bad_chunk_share, 2) for r in bands.compression_bands(tails).collect()} == {1: 0.0, 2: 0.5}  # the last chunk counts
    noise = "".join(random.Random(1).choice("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/") for _ in range(6000))
    mixed = spark.createDataFrame([(1, " ".join(noise[i : i + 60] for i in range(0, 6000, 60)))], "doc_id long, text string")
    assert not bands.compression_bands(mixed).first().kept
    assert bands.compression_bands(edge).count() == edge.count() and bands.compression_bands(empty).count() == 0


# -- pipeline --------------------------------------------------------------------------


def test_pipeline_stage_by_stage(spark, documents):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "near_dedup", "decontamination", "personal_data", "packing"]
    rows = {r.doc_id: r for r in documents.collect()}

    def ids(df):
        assert df.columns == documents.columns
        found = [r.doc_id for r in df.select("doc_id").collect()]
        assert len(found) == len(set(found))
        return set(found)

    kept = ids(stages["language"](spark, documents, SF))
    lettered = {i: sum(c.isalpha() for c in r.text or "") for i, r in rows.items()}
    per_lang = Counter(r.lang for r in rows.values() if r.lang)
    # no letter: gone; short, or labelled with a language too rare to judge by: kept
    assert not any(lettered[i] == 0 for i in kept)
    assert all(i in kept for i in rows if 0 < lettered[i] < corpus_pipeline.ENOUGH_LETTERS or lettered[i] and per_lang.get(rows[i].lang, 10**9) < corpus_pipeline.ENOUGH_DOCS)
    assert sum(i not in kept for i in rows if lettered[i]) <= len(rows) / 50

    order = sorted(rows)
    firsts = {order[c] for c in brute.components([brute.simhash(rows[i].text) for i in order], 4)}
    assert ids(stages["near_dedup"](spark, documents, SF)) == firsts

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {i for i, r in rows.items() if not (found := brute.contamination(r.text, items))[1] or 20 * found[1] < found[0]}
    assert ids(stages["decontamination"](spark, documents, SF)) == clean

    redacted = stages["personal_data"](spark, documents, SF)
    assert ids(redacted) == set(rows)
    changed = 0
    for r in redacted.collect():
        assert r.n_chars == len(r.text) and not [s for s in brute.personal(r.text) if s[1] == 0]
        changed += r.text != (rows[r.doc_id].text or "")
        if not brute.personal(rows[r.doc_id].text):  # no document here has personal data that only the network sees
            assert r.text == (rows[r.doc_id].text or "")
        else:  # outside of the patterns' spans nothing changes
            cut = re.split(r"\[(?:EMAIL|IP|CARD|PHONE)\]", r.text)
            at = 0
            for part in cut:
                at = rows[r.doc_id].text.find(part, at)
                assert at >= 0
                at += len(part)
    assert changed


def test_pipeline_runs_whole_and_on_awkward_rows(spark, edge, empty, documents):
    final = corpus_pipeline.run(spark, SF)
    t = plain(WORD)
    assert final.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(final.columns)
    docs = documents
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    check_packing(final.collect(), {r.doc_id: [brute.token_ids(t, r.text)] for r in docs.collect()})
    five = edge.select(*documents.columns)
    wanted = {"language": sum(any(c.isalpha() for c in r.text or "") for r in five.collect()), "personal_data": five.count(), "packing": five.count()}
    for name, stage in corpus_pipeline.STAGES:
        n = stage(spark, five, SF).count()
        assert n >= wanted.get(name, 1)  # packing cuts the long text
        assert stage(spark, empty.select(*documents.columns), SF).count() == 0


def test_pipeline_tells_rows_of_repeated_and_null_ids_apart(spark, documents):
    r = random.Random(21)
    a, b, c, d = (" ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(60)) for _ in range(4))
    item = next(x.text for x in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len(brute.BLANK.findall(x.text)) >= 13)
    own = [(None, a), (None, b), (None, b), (1, c), (1, d), (2, d), (None, item), (1, item), (3, None)]
    rows = spark.createDataFrame([(i, t, "en", f"s{n}", len(t or "")) for n, (i, t) in enumerate(own)], documents.schema)
    stages = dict(corpus_pipeline.STAGES)

    def kept(name):
        return sorted(int(x.source[1:]) for x in stages[name](spark, rows, SF).collect())

    assert kept("near_dedup") == [0, 1, 3, 4, 7, 8]
    assert kept("decontamination") == [0, 1, 2, 3, 4, 5, 8]


def test_pipeline_keeps_clean_documents_of_rare_languages(spark, documents):
    r = random.Random(31)

    def prose(letters, n=80, size=40):
        words = ["".join(r.choice(letters) for _ in range(5)) for _ in range(size)]
        return lambda: " ".join(r.choice(words) for _ in range(n))

    common, one, few = prose("abcdefg"), prose("ñopqrst"), prose("жзийклм")
    own = [(common(), "en") for _ in range(300)] + [(one(), "xx"), *((few(), "yy") for _ in range(9)), (few(), None), ("Wyvxz Zuwyv", "en"), ("Wyvxz Zuwyv", None)]
    junk = [("123 456", "en"), (None, "en"), ("".join(r.choice("αβγδεζηθ ") for _ in range(900)), None)]

    def kept(texts):
        rows = spark.createDataFrame([(i, t, x, "s", 0) for i, (t, x) in enumerate(texts)], documents.schema)
        return sorted(x.doc_id for x in corpus_pipeline.language(spark, rows, SF).collect())

    assert kept(own + junk[:2]) == list(range(len(own)))
    assert kept(own[:300] + junk) == list(range(300))  # every language can be judged
