"""Range joins, bootstraps and schemas."""

import json
import random

import pytest
from pyspark.sql import functions as F

from textloom.functions.schemas import checked_reply, conforms
from textloom.operators.bootstrap import paired_interval, paired_means, weights
from textloom.operators.ranges import count_and_least, first_within, points_in_intervals


def test_points_in_intervals_of_any_length(spark):
    r = random.Random(2)
    intervals = [(i, a := r.randint(-1000, 1000) * 7, a + r.choice([0, 1, 5, 63, 64, 1000, 1 << 40, -1])) for i in range(150)] + [(900, None, 5), (901, 5, None)]
    points = [(i, r.randint(-8000, 8000)) for i in range(300)] + [(i, a) for i, (_, a, b) in enumerate(intervals[:50], 1000)] + [(2000, None)]
    left, right = spark.createDataFrame(points, "p long, t long"), spark.createDataFrame(intervals, "i long, a long, b long")
    found = points_in_intervals(left, F.col("t"), right, F.col("a"), F.col("b"))
    want = sorted((p, i) for p, t in points for i, a, b in intervals if None not in (t, a, b) and a <= t <= b)
    assert sorted((r.p, r.i) for r in found.collect()) == want and len(want) > 1000
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    first = {}
    for p, t in points:
        for i, a, b in intervals:
            if None not in (t, a, b) and a <= t <= b:
                first[i] = min(first.get(i, (t, p)), (t, p))
    assert {r.i: r.p for r in first_within(right, "i", F.col("a"), F.col("b"), left, F.col("t"), "p").collect()} == {i: p for i, (_, p) in first.items()}
    assert points_in_intervals(left, F.col("t"), right.where("false"), F.col("a"), F.col("b")).count() == 0


@pytest.mark.parametrize("top", [1 << 14, 4])
def test_count_and_least_without_pairs(spark, monkeypatch, top):
    from textloom.operators import ranges

    monkeypatch.setattr(ranges, "TOP_NODES", top)
    r = random.Random(4)
    intervals = [(i % 140, a := r.randint(-300, 300), a + r.choice([0, 1, 5, 63, 64, 1000, 1 << 40, -1])) for i in range(150)] + [(900, None, 5), (901, 5, None), (902, 10**6, 10**7)]
    for n in (0, 1, 2, 5, 333):
        points = [(r.randint(0, 10**6), r.randint(-400, 400)) for _ in range(n)] + [(2000, None)]
        left, right = spark.createDataFrame(points, "p long, t long"), spark.createDataFrame(intervals, "i long, a long, b long")
        want, first = {}, {}
        for i, a, b in intervals:
            inside = [(t, p) for p, t in points if None not in (t, a, b) and a <= t <= b]
            if inside:
                known = want.get(i, (0, 10**9))
                want[i] = (known[0] + len(inside), min(known[1], min(p for _, p in inside)))
                first[i] = min(first.get(i, (10**9, 0)), min(inside))
        found = count_and_least(right, "i", F.col("a"), F.col("b"), left, F.col("t"), "p")
        assert {x.i: (x.n, x.least) for x in found.collect()} == want
        assert {x.i: x.p for x in first_within(right, "i", F.col("a"), F.col("b"), left, F.col("t"), "p").collect()} == {i: p for i, (_, p) in first.items()}


def test_ten_thousand_intervals_over_all_of_ten_thousand_points(spark):
    """10**8 pairs, of which no join makes one."""
    rows = spark.range(10_000)
    found = count_and_least(rows, "id", F.lit(0), F.lit(10_000), rows.withColumnRenamed("id", "p"), F.col("p"), "p")
    assert found.groupBy("n", "least").count().collect() == [(10_000, 0, 10_000)]
    assert first_within(rows, "id", F.lit(-1), F.lit(10_000), rows.withColumnRenamed("id", "p"), F.col("p"), "p").groupBy("p").count().collect() == [(0, 10_000)]


def test_paired_bootstrap(spark):
    r = random.Random(3)
    rows = [(f"q{i}", "ab"[i % 2], r.random() + (i % 2), r.random()) for i in range(400)] + [("x", "a", None, 1.0), (None, "a", 1.0, 0.5)]
    df = spark.createDataFrame(rows, "q string, arm string, first double, second double")
    means = paired_means(df, "q", "first", "second", 40, groups=("arm",))
    want = {}
    for q, arm, a, b in rows:
        if a is not None and b is not None:
            for n, w in enumerate(weights(q or "", 40, "pair").tolist()):
                t = want.setdefault((arm, n), [0, 0.0])
                t[0], t[1] = t[0] + w, t[1] + w * (a - b)
    got = {(m.arm, m.r): m["mean"] for m in means.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - s / w) < 1e-9 for k, (w, s) in want.items())
    ends = {x.arm: x for x in paired_interval(means, ("arm",)).collect()}
    of_a = [a - b for _, arm, a, b in rows if arm == "a" and a is not None]
    assert ends["a"].low < sum(of_a) / len(of_a) < ends["a"].high < 0.3 and ends["b"].low > 0.8 and ends["b"].p_not_better == 0
    whole = sum(int(weights(f"k{i}", 200, "s").sum()) for i in range(200)) / 40_000
    assert 0.98 < whole < 1.02
    assert paired_interval(paired_means(df.where("false"), "q", "first", "second", 10)).first()["low"] is None


CASES = [
    ({"type": "string", "minLength": 2, "maxLength": 3, "pattern": "^a"}, ['"ab"', '"abc"'], ['"a"', '"abcd"', '"ba"', "1", "null", "{}"]),
    ({"type": "integer", "minimum": 0, "maximum": 9}, ["0", "9", "9.0"], ["-1", "10", "1.5", '"1"', "true"]),
    ({"type": ["number", "null"]}, ["1", "1.5", "1e3", "null"], ['"x"', "[]"]),
    ({"enum": ["A", "B"]}, ['"A"'], ['"C"', "1", "null"]),
    ({"type": "boolean"}, ["true", "false"], ["0", '"true"']),
    ({"type": "array", "minItems": 1, "maxItems": 2, "items": {"type": "array", "items": {"type": "integer"}}}, ["[[1],[]]"], ["[]", "[[1],[2],[3]]", '[["1"]]', "[1]", "{}"]),
    (
        {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "object", "required": ["b c"], "properties": {"b c": {"enum": ["x"]}}}, "d": {"type": "string"}}},
        ['{"a":{"b c":"x","more":1}}', '{"a":{"b c":"x"},"d":"y"}'],
        ["{}", '{"a":{}}', '{"a":{"b c":"y"}}', '{"a":{"b c":"x"},"d":1}', '{"a":{"b c":"x"},"d":null}', '{"a":{"b c":"x"},"e":1}', "[]"],
    ),
    ({}, ["1", "null", "{}"], []),
]


@pytest.mark.parametrize(("schema", "good", "bad"), CASES)
def test_conforms(spark, schema, good, bad):
    rows = spark.createDataFrame([(t, t in good) for t in good + bad], "t string, want boolean")
    wrong = rows.where(F.coalesce(conforms(F.parse_json("t"), schema), F.lit(False)) != F.col("want")).collect()
    assert wrong == []


def test_checked_replies(spark):
    schema = {"type": "object", "required": ["v"], "properties": {"v": {"enum": ["A", "B", "T"]}}}
    texts = ['```json\n{"v": "A"}\n```', ' {"v":"T"} ', "```\n{\"v\":\"B\"}```", '{"v":"C"}', '{"v":"A"', "", None, '{"v":"A","v":"A"}', 'so: {"v":"A"}']
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(checked_reply(F.col("t"), schema)).collect()]
    assert [None if x is None else json.loads(x)["v"] for x in got] == ["A", "T", "B", *[None] * 6]
    with pytest.raises(ValueError):
        conforms(F.lit(1), {"oneOf": []})
