"""Operators on literal rows: edge cases, nulls, order-dependence, faults."""

import json
import re

import pytest
from pyspark.sql import functions as F

from textloom.config import CleanConfig, configured
from textloom.functions import text as T
from textloom.functions.convert import first_call, numbers_of, roff_to_markdown
from textloom.functions.html import html_to_markdown
from textloom.operators import builders, commands, crawl, distill, lookups, provenance, review, segment, select, similarity, stats, toolcalls, traces
from textloom.sources import index, jsonl


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_unicode_norm(spark):
    df = spark.createDataFrame([("ＳＢＡＴＣＨ  option",), (None,), ("",)], "t string")
    assert [r.x for r in df.select(T.unicode_norm("t").alias("x")).collect()] == ["sbatch option", None, ""]


@pytest.mark.parametrize(("verdicts", "rate"), [(["A", "B"], 1.0), (["B", "A"], 0.0), (["T", "T"], 0.5), (["A", "A"], 0.5), (["A", None], None), (["x", "B"], None), ([], None)])
def test_win_rate(spark, verdicts, rate):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(verdicts)], "i int, v string")
    r, n = stats.win_rate(F.col("v"), F.col("i") % 2 == 1)
    row = df.agg(r.alias("r"), n.alias("n")).first()
    assert (row.r, row.n) == (rate, len(verdicts))


def test_empty_texts_are_alike(spark):
    df = spark.createDataFrame([(1, ""), (2, None), (3, "..."), (4, "one two"), (5, "one two")], "id long, t string")
    assert {(r["id"], r["class"]) for r in similarity.shingle_sets(df, "id", "t").collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)}


def test_greedy_keeps_both_ends_of_a_chain(spark):
    nodes = spark.createDataFrame([(1,), (2,), (3,), (4,)], "id long")
    pairs = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    assert {r.id for r in similarity.greedy_keep(nodes, pairs).where("kept").collect()} == {1, 3, 4}


def test_similar_pairs_against_brute_force(spark):
    rows = [(i, " ".join(f"w{(i // 3) * 40 + j + (17 if j % (9 + i % 3) == 0 else 0)}" for j in range(40))) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, t string")
    cut = lambda t: {" ".join(t.split()[i : i + 3]) for i in range(38)}
    sets = {i: cut(t) for i, t in rows}
    near = {(a, b) for a in sets for b in sets if a < b and sets[a] != sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.3}
    assert {(r.a, r.b) for r in similarity.near_duplicate_pairs(df, "id", "t", 0.3).collect()} == near


def test_chunks_keep_fences_whole():
    text = "intro\n\n```py\na = 1\n\nb = 2\n```\n\nend"
    assert segment.blocks_of(text) == ["intro", "```py\na = 1\n\nb = 2\n```", "end"]
    assert segment.chunks_of(text, 12, False, 1, 0) == ["intro", "```py\na = 1\n\nb = 2\n```", "end"]
    assert segment.chunks_of("short", 100, True, 80, 3) == ["short"]
    assert segment.chunks_of(None, 100, True, 80, 0) == []


def test_spans_cover_and_fences(spark):
    texts = ["Dr. Smith came. He saw e.g. Rome. Then left!\n\n- item\n- two", "", None, "```\nopen", "~~~\n```\n~~~", "x\n````\n```\n````"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    spans = [r.x for r in df.select(segment.exact_cover("t").alias("x")).collect()]
    for t, s in zip(texts, spans, strict=True):
        assert "".join((t or "")[x.start : x.end] for x in s) == (t or "")
    assert [r.x for r in df.select(segment.unmatched_fence("t").alias("x")).collect()] == [False, False, False, True, False, False]


def test_markdown():
    page = '<html><nav>menu</nav><main><h1>Title</h1><p>Some  <b>text</b></p><ul><li>a</li></ul><pre>x  y</pre><script>no</script></main>after</html>'
    out = html_to_markdown(page)
    assert "# Title" in out and "- a" in out and "x  y" in out and "menu" not in out and "no" not in out and "after" not in out
    assert html_to_markdown(None) == ""


@pytest.mark.parametrize("most", [1 << 18, 512])
def test_near_duplicates_travel_once_a_group(spark, monkeypatch, most):
    """A cluster's sets come to their groups, not to each of their pairs; small groups deal the cluster to parts."""
    import random

    r = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(60):
        words = [f"v{i // 40}x{w}" for w in base]
        for _ in range(r.randint(0, 2)):
            words[r.randrange(60)] = f"z{r.randrange(1000)}"
        texts.append((i, " ".join(words)))
    grams = {i: {tuple(w[j : j + 3]) for j in range(len(w) - 2)} for i, t in texts for w in [t.split()]}
    classes = {}
    for i in sorted(grams):
        classes.setdefault(frozenset(grams[i]), i)
    first = sorted(classes.values())
    want = {(a, b): round(s, 12) for a in first for b in first if a < b and (s := len(grams[a] & grams[b]) / len(grams[a] | grams[b])) >= 0.8}
    monkeypatch.setattr(similarity, "GROUP_MEMBERS", most)
    sent, compared = [], similarity.compared
    monkeypatch.setattr(similarity, "compared", lambda one, meet: sent.append(meet.count()) or compared(one, meet))
    df = spark.createDataFrame(texts, "id long, t string")
    assert {(x.a, x.b): round(x.similarity, 12) for x in similarity.near_duplicate_pairs(df, "id", "t").collect()} == want and len(want) > 200
    assert len(want) <= sent[0] <= 2 * len(want)


def near_texts(seed, families=12, copies=6, n=90, most=14):
    """(id, text)s: copies with up to `most` changed words, a line that all share, some exact copies, empty and short texts."""
    import random

    r = random.Random(seed)
    texts = ["", None, "one two", "One, two!", "three"]
    for f in range(families):
        words = [f"v{f}x{i}" for i in range(n)] + [f"shared{i}" for i in range(12)]
        for _ in range(copies):
            own = list(words)
            for _ in range(r.randint(0, most)):
                own[r.randrange(n)] = f"z{r.randrange(5000)}"
            texts.append(" ".join(own))
    return list(enumerate(texts))


def brute_pairs(texts, t):
    grams = {i: {tuple(w[j : j + 3]) for j in range(max(1, len(w) - 2))} for i, x in texts for w in [re.findall(r"\w+", (x or "").lower())]}
    classes = {}
    for i in sorted(grams):
        classes.setdefault(frozenset(grams[i]), i)
    first = sorted(classes.values())
    return {(a, b): round(s, 12) for a in first for b in first if a < b and (s := len(grams[a] & grams[b]) / len(grams[a] | grams[b])) >= t}


@pytest.mark.parametrize(("t", "limits"), [(0.8, {}), (0.5, {"SENT_IDS": 0}), (0.3, {"FREQUENT": 5, "COMMON": 1, "NOTED_BITS": 19})])
def test_similar_pairs_within_limits(spark, monkeypatch, t, limits):
    """Bounds on what is counted, noted and sent to tasks change no result."""
    for name, value in limits.items():
        monkeypatch.setattr(similarity, name, value)
    texts = near_texts(3, most=6)
    got = similarity.near_duplicate_pairs(spark.createDataFrame(texts, "id long, t string"), "id", "t", t).collect()
    want = brute_pairs(texts, t)
    assert {(x.a, x.b): round(x.similarity, 12) for x in got} == want and len(got) == len(want) > 20


def test_only_near_sets_are_compared(spark, monkeypatch):
    """Pairs somewhat below the threshold bring no sets together, and neither words nor sets are written or joined anew."""
    texts = near_texts(5, families=40, copies=4, n=300, most=20)
    want, sent, tags, compared, saved = brute_pairs(texts, 0.8), [], {}, similarity.compared, similarity.saved
    monkeypatch.setattr(similarity, "compared", lambda one, meet: sent.append(meet.count()) or compared(one, meet))
    monkeypatch.setattr(similarity, "saved", lambda df, tag: tags.setdefault(tag, df.columns) and saved(df, tag))
    df = spark.createDataFrame(texts, "id long, t string")
    got = similarity.near_duplicate_pairs(df, "id", "t").collect()
    assert {(x.a, x.b): round(x.similarity, 12) for x in got} == want
    assert len(want) <= sent[0] <= 1.3 * len(want) and len(brute_pairs(texts, 0.65)) > 1.3 * len(want)
    assert [tag for tag, columns in tags.items() if "members" in columns] == ["shingles"] and "words" not in tags


def test_bits_apart_bound_the_members_apart(spark):
    import numpy as np

    r = np.random.default_rng(2)
    sets = [(i, sorted(r.integers(-(2**63), 2**63, n).tolist())) for i, n in enumerate([1, 60, 70, 300, 1000])]
    sets += [(10 + i, sorted([*m[: len(m) // 2], *r.integers(-(2**63), 2**63, 40).tolist()])) for i, m in sets]
    df = spark.createDataFrame(sets, "id long, members array<bigint>").coalesce(1)
    f = similarity.first_members(df, 0.8).select("id", "n", "bits")
    both = f.toDF("x", "nx", "bx").crossJoin(f.toDF("y", "ny", "by")).select("x", "y", similarity.bits_apart(F.col("bx"), F.col("by")).alias("apart"))
    members = {i: set(m) for i, m in sets}
    for row in both.collect():
        apart = len(members[row.x] ^ members[row.y])
        assert row.apart <= apart and (apart - row.apart) % 2 == 0
        assert row.x != row.y or row.apart == 0


def test_markdown_of_references():
    assert html_to_markdown("<p>a &amp;&amp b &quo c &copy; &#65;&#x42; &lt;i&gt; ?x=1&copy=2") == "a &&amp b &quo c © AB <i> ?x=1&copy=2"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<nav><h2>no</h2><ul><li>no</li></ul></nav><p>yes", "yes"),
        ("<h1>out</h1><main><p>in<br>two</main><h2>out</h2>", "in\n\ntwo"),
        ('<div role="main"><img src=x><p>a</p></div><p>b</p>', "a"),
        ("<ul><li><p>one</p></li><li>two</li></ul>after", "- one\n- two\n\nafter"),
        ("<pre>a ``` b</pre>", "````\na ``` b\n````"),
        ("<p>use <code>x &lt; y</code> now</p></div></p>", "use `x < y` now"),
        ("<!-- <p>no --><script>if (a<b) '</p>'</script>text <b>bold", "text bold"),
        ("<head><title>t</title></head><body>x</body>", "x"),
        ("", ""),
    ],
)
def test_markdown_of_awkward_pages(page, want):
    assert html_to_markdown(page) == want


def test_manual_pages():
    assert roff_to_markdown('.\\" c\n.SH NAME\na \\fBb\\fR\n.PP\n.B c\n.nf\n  x\n.fi\n') == "## NAME\n\na **b**\n\n**c**\n\n```\n  x\n```"
    assert roff_to_markdown(None) == "" and roff_to_markdown(".nf\nopen") == "```\nopen\n```"


def test_manual_pages_keep_their_text():
    assert roff_to_markdown('.TH X 1\n.SH "SEE ALSO"\n.BR squeue (1),\n.IR file .txt\nand \\(em \\[aq]x\\(aq\\e \\-\\-all') == "## SEE ALSO\n\n**squeue**(1), *file*.txt and — 'x'\\ --all"
    assert roff_to_markdown(".TP 4\n.BR \\-n , \" --name \" =\\fIx\\fR\nThe name.\n.IP\nMore.\n.PP\nRest") == "**-n, --name =*x***\n\nThe name.\n\nMore.\n\nRest"
    assert roff_to_markdown(".EX\na \\-b\n.B c\n.EE\n.IP \\(bu 2\none\n.IP term\ntwo\n.Dd words kept\n'\\\" gone\n.\nend") == "```\na -b\n.B c\n```\n\none\n\n**term**\n\ntwo words kept end"


def test_json_helpers():
    assert numbers_of({"a": {"b": 1, "c": True, "d": "x"}, "e": 2.5, "f": [1]}) == {"a.b": 1.0, "e": 2.5}
    assert first_call('{"name": "rm", "arguments": {}} {"name": "ls", "arguments": 3} ls()', None, "ls,ps") == '{"name":"ls","arguments":{}}'
    assert first_call("nothing { here", None, "ls") is None and first_call(None, None, "ls") is None


def test_options_stop_at_the_program():
    text = "```sh\n#SBATCH --nodes=2 -p gpu\nsbatch --wrap 'a --b' --time 5 job.sh --mine\nls --long\n```\n`srun --pty bash --login`"
    assert commands.options_of(text) == ["nodes", "pty", "time", "wrap"]
    assert commands.options_of("srun --open 'quote x") == ["open"] and commands.options_of(None) == []


def test_reduced_status_and_binding(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (2, "b"), (3, "odd"), (3, None)], "k long, v string")
    assert {(r.k, r.status) for r in review.reduced_status(df, ["k"], "v", ["a", "b"]).collect()} == {(1, "a"), (2, "b"), (3, None)}
    null = F.lit(None).cast("string")
    assert one(spark, review.binding_state([(null, null), (F.lit("x"), F.lit("x"))])) == "current" and one(spark, review.binding_state([(null, F.lit("x"))])) == "pending"


@pytest.mark.parametrize(("text", "segments", "ok"), [("a b\nc", ["a b", "c"], True), ("a b c", ["a", "c"], False), ("a b", ["b", "a"], False), ("a a", ["a"], False), ("  ", [], True), ("x", [], False)])
def test_segments_cover(spark, text, segments, ok):
    df = spark.createDataFrame([(text, segments)], "t string, s array<string>")
    assert df.select(review.segments_cover(F.col("t"), F.col("s")).alias("x")).first().x is ok


def test_call_matching(spark):
    args = lambda **kw: F.create_map(*[F.lit(v) for p in kw.items() for v in p]) if kw else F.create_map().cast("map<string,string>")
    allowed = F.create_map(F.lit("user"), F.array(F.lit("Me")), F.lit("n"), F.array(F.lit(""), F.lit("*")))
    match = lambda name, **kw: one(spark, toolcalls.call_matches(F.lit(name), args(**kw), F.lit("queue"), allowed))
    assert match("queue", user="ME") and match("queue", user="me", n="77")
    assert not match("queue", n="1") and not match("queue", user="me", other="1") and not match("state", user="me")


def test_lookups_of_unknown_keys(spark):
    rows = spark.createDataFrame([("gpu", 1), ("gpu-debug", 2)], "part string, n long")
    asked = spark.createDataFrame([("gpu",), ("GPU-D",), ("g",), ("z",)], "asked string")
    assert {(r.asked, r.part, r.error) for r in lookups.fuzzy_lookup(asked, rows.select("part"), "part").collect()} == {("gpu", "gpu", ""), ("GPU-D", "gpu-debug", ""), ("g", None, "ambiguous"), ("z", None, "unknown")}
    found = lookups.keyed_lookup(spark.createDataFrame([("cpu",)], "part string"), rows, "part", "partition").first()
    assert found.error == "unknown partition; known: gpu, gpu-debug"


def test_crawl_keeps_to_its_limits(spark):
    links = spark.createDataFrame([("h", "a", "b"), ("h", "a", "c"), ("h", "b", "a"), ("h", "c", "d"), ("h", "d", "e"), ("i", "x", "y")], "host string, page string, to string")
    start = spark.createDataFrame([("h", "a")], "host string, page string")
    assert {(r.page, r.level) for r in crawl.breadth_first(start, links, 3, 9).collect()} == {("a", 0), ("b", 1), ("c", 1)}
    assert {(r.page, r.level) for r in crawl.breadth_first(start, links, 9, 2).collect()} == {("a", 0), ("b", 1), ("c", 1), ("d", 2)}


def test_long_lineages_are_followed_to_their_end(spark):
    n = 200  # longer than any fixed depth
    families = spark.createDataFrame([(f"f{i}", "development" if i == n - 1 else "train", [f"f{i + 1}"] if i < n - 1 else [], True) for i in range(n)], "family string, split string, parents array<string>, lineage_reviewed boolean")
    reach = provenance.ancestors(families)
    assert reach.where("family = 'f0'").count() == n
    docs = spark.createDataFrame([(1, "f0")], "doc_id long, family string")
    assert not provenance.admitted(docs, families, reach).first().admitted


def test_contained_items(spark):
    rows = spark.createDataFrame([(1, "xx the quick brown fox jumps over it"), (2, "the quick brown"), (3, None), (4, "unquick brown fox jumpsuit")], "id long, t string")
    items = spark.createDataFrame([(7, "quick brown fox jumps"), (8, "brown"), (9, "no such words here")], "item long, t string")
    assert {(r.id, r.item) for r in similarity.contained_items(rows, items, "id", "t", "item", "t").collect()} == {(1, 7), (4, 7), (1, 8), (2, 8), (4, 8)}


def test_membership_and_release(spark):
    a, b = spark.createDataFrame([(1,), (2,), (2,)], "k long"), spark.createDataFrame([(2,), (3,)], "k long")
    assert {(r.k, r.side) for r in builders.membership(a, b, "k").collect()} == {(1, "left"), (2, "both"), (3, "right")}
    assert [(r.k, r.n) for r in builders.repeated_keys([a, b], "k").collect()] == [(2, 3)]


def test_budget_skips_what_does_not_fit(spark):
    df = spark.createDataFrame([("q", 1, 5), ("q", 2, 9), ("q", 3, 4), ("r", 1, 20)], "g string, o long, s long")
    assert {(r.g, r.o) for r in select.skip_not_stop(df, "g", "o", "s", 10).collect()} == {("q", 1), ("q", 3)}


def test_water_level(spark):
    df = spark.createDataFrame([(x,) for x in (3, 5, 9, 20)], "n long")
    for want in (0, 3, 12, 22, 30, 37, 100):
        level = max(x for x in range(40) if x <= 20 and sum(min(x, n) for n in (3, 5, 9, 20)) <= want)
        assert select.water_level(df, "n", want).first().level == level


def test_longest_first(spark):
    df = spark.createDataFrame([("a", 9), ("b", 7), ("c", 6), ("d", 5)], "k string, n long")
    assert {r.k: r.shard for r in select.longest_first_shards(df, "k", "n", 2).collect()} == {"a": 0, "b": 1, "c": 1, "d": 0}


def test_top_ranked(spark):
    tokens = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(r).alias("rank"), F.lit(lp).alias("lp")) for i, r, lp in ((9, 2, -3.0), (7, 0, -0.1), (5, 1, -1e9))])
    assert [(t.id, t.lp) for t in one(spark, distill.top_ranked(tokens, 2))] == [(7, -0.1), (5, -1e4)]


def test_mismatches(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y"), (4, "z")], "k long, v string")
    b = spark.createDataFrame([(1, "x"), (2, "y"), (3, "q"), (4, None)], "k long, v string")
    assert {(r.k, r.problem) for r in provenance.mismatches(a, b, "k", ["v"]).collect()} == {(2, "repeated"), (3, "only_right"), (4, "differs")}


def test_fingerprint_ignores_order(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "i long, t string")
    f = lambda d: provenance.fingerprint(d, "i", "t").first().fingerprint
    assert f(df) == f(df.orderBy(F.desc("i")).repartition(3)) != f(df.where("i < 3"))


def test_calls_pair_by_order(spark):
    df = spark.createDataFrame([(1, 1, 0, "call", "c1"), (1, 1, 1, "call", "c2"), (1, 2, 0, "result", "r1")], "conv_id long, turn long, pos long, kind string, body string")
    assert {(r.call, r.result) for r in traces.paired_calls(df).collect()} == {("c1", "r1"), ("c2", None)}


def test_grounded_ids(spark):
    assert one(spark, traces.grounded_ids(F.lit("jobs 12345_7 and 99999"), F.lit("queue 12345"))) == ["99999"]


def test_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "t": "é"}\n{"id": 2}\n{"id": 3, bad\n{"id": 4}\n{"id": 5')
    lines = jsonl.numbered_lines(spark, f"file://{tmp_path}/a.jsonl")
    assert [r.id for r in jsonl.valid_prefix(lines, "id long, t string").orderBy("line_no").collect()] == [1, 2]
    assert {r.id for r in jsonl.complete_lines(lines, "id long, t string").collect()} == {1, 2, 4}
    (tmp_path / "b.jsonl").write_text('{"id": 1}\n\n{"id": 1}\n{"a": 1, "a": 2}\n{"x": NaN}\n[1]\n')
    strict = jsonl.strict_problems(jsonl.numbered_lines(spark, f"file://{tmp_path}/b.jsonl"))
    assert {(r.line_no, r.problem) for r in strict.collect()} == {(1, "empty line"), (2, "repeated id"), (3, "repeated key"), (4, "not finite"), (5, "not an object")}
    df = spark.createDataFrame([(1, "ü")], "id long, t string")
    jsonl.write_jsonl(df, f"file://{tmp_path}/out", compressed=True)
    assert jsonl.read_jsonl(spark, f"file://{tmp_path}/out", "id long, t string").collect() == df.collect()


def test_index_and_manifest(spark, tmp_path):
    chunks = spark.createDataFrame([("a#0", "x", "gpu job", "f1"), ("b#0", "y", "cpu", "f2")], "chunk_id string, site string, text string, file string")
    index.write_index(chunks, f"file://{tmp_path}/ix")
    found, post = index.read_index(spark, f"file://{tmp_path}/ix", "x")
    assert [r.chunk_id for r in found.collect()] == ["a#0"] and {r.term for r in post.collect()} == {"gpu", "job"}
    new = spark.createDataFrame([("a#9", "x", "new", "f1")], chunks.schema)
    assert {r.chunk_id for r in index.upserted(chunks, new).collect()} == {"a#9", "b#0"}
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "one").write_text("1")
    have = index.file_digests(spark, f"file://{tmp_path}/m")
    manifest = spark.createDataFrame([("one", "0"), ("two", "0")], "name string, sha256 string")
    assert {(r.name, r.problem) for r in index.unbound_files(have, manifest).collect()} == {("one", "changed"), ("two", "missing")}


def test_config():
    assert configured(CleanConfig(), ["dedup_threshold=0.5"]).dedup_threshold == 0.5
    for bad in (["nope=1"], ["dedup_threshold=2"], ["chunk_chars"]):
        with pytest.raises(ValueError):
            configured(CleanConfig(), bad)
    assert json.dumps(CleanConfig().__dict__)


def test_streams(spark, tmp_path):
    from textloom import streaming as R

    rows = spark.createDataFrame([(1, "a", "2024-01-01 00:00:00"), (2, "a", "2024-01-01 00:01:00"), (3, "b", "2024-01-01 00:02:00")], "id long, t string, at string").withColumn("at", F.to_timestamp("at"))
    rows.write.parquet(f"file://{tmp_path}/in")
    read = lambda: spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/in")
    R.start_append(R.first_by_digest(read(), "t", "at", "1 hour"), f"file://{tmp_path}/out", f"file://{tmp_path}/ck").awaitTermination()
    R.start_append(R.first_by_digest(read(), "t", "at", "1 hour"), f"file://{tmp_path}/out", f"file://{tmp_path}/ck").awaitTermination()
    assert sorted(r.t for r in spark.read.parquet(f"file://{tmp_path}/out").collect()) == ["a", "b"]
    R.start_units(read(), f"file://{tmp_path}/units", f"file://{tmp_path}/ck2").awaitTermination()
    assert spark.read.parquet(f"file://{tmp_path}/units").count() == 3


def test_numbers_within_groups_over_many_ranges(spark):
    """A group over several ranges, groups within one, null groups and a range that ends with its group."""
    from textloom.operators.select import numbers_within

    rows = [("hot", i) for i in range(400)] + [(f"g{i % 30}", 1000 + i) for i in range(200)] + [(None, 5000 + i) for i in range(50)] + [("last", 9)]
    df = spark.createDataFrame(rows, "g string, i long")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted((r.g or "", r.i, r.number) for r in numbers_within(df, ["g"], ["i"]).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    seen, want = {}, []
    for g, i in sorted((g or "", i) for g, i in rows):
        want.append((g, i, seen.get(g, 0)))
        seen[g] = seen.get(g, 0) + 1
    assert got == want


def test_fuzzy_lookup_against_every_key(spark):
    from textloom.operators.lookups import fuzzy_lookup

    keys = ["boost_usr_prod", "Boost", "dcgp", "dcgp_usr", "ä", "usr", "a" * 50, "ab", "abc", "ABC"]
    asked = ["boost", "Boost", "BOOST_USR", "dcgp", "cgp_", "ä", "", "zzz", "b", "ab", "aaaa", "abc", "ABC", "Abc", "longer than any key there is"]
    want = {}
    for a in asked:
        near = [k for k in keys if a.lower() in k.lower()]
        exact = a if a in keys else None
        want[a] = (exact or (near[0] if len(near) == 1 else None), "" if exact or len(near) == 1 else "ambiguous" if near else "unknown")
    got = fuzzy_lookup(spark.createDataFrame([(a,) for a in asked], "asked string"), spark.createDataFrame([(k,) for k in keys], "k string"), "k")
    assert {r.asked: (r.k, r.error) for r in got.collect()} == want
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
