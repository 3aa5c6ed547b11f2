"""Canonical JSON and replayed calls."""

import hashlib
import json

import pytest

from textloom.functions.canonical import canonical, json_digest
from textloom.operators.replay import JobTable, replay_calls


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('{"b": 1, "a": [1.0, true, null]}', '{"a":[1.0,true,null],"b":1}'), ('{"z":{"y":1,"x":{"b":"\\u00e9\\/","a":2}}}', '{"z":{"x":{"a":2,"b":"é/"},"y":1}}'), (" 1e3 ", "1000.0"), ('"x"', '"x"'), ("[]", "[]"),
        ('{"a":1,"a":1}', None), ('{"a":{"b":1,"b":2}}', None), ("NaN", None), ("[Infinity]", None), ("{", None), ("", None), (None, None), ("[" * 100_000, None),
    ],
)
def test_canonical(text, want):
    assert canonical(text) == want


def test_digests(spark):
    rows = spark.createDataFrame([('{"a":1,"b":2}',), ('{ "b":2, "a":1}',), ('{"a":1.0,"b":2}',), ("{",)], "j string")
    got = [r[0] for r in rows.select(json_digest(rows.j)).collect()]
    assert got[0] == got[1] == hashlib.sha256(b'{"a":1,"b":2}').hexdigest() and got[2] != got[0] and got[3] is None


def number(script):
    return str(4_000_000 + int(hashlib.sha256(script.encode()).hexdigest(), 16) % 1_000_000)


def test_job_table():
    t, s = JobTable(), "#!/bin/sh\nls"
    first = number(s)
    assert t.step("submit_job", {"script": s}) == {"submitted": True, "job_id": first}
    again = t.step("submit_job", {"script": s})["job_id"]
    assert int(again) == int(first) + 1
    steps = [("requeue_job", False), ("hold_job", True), ("hold_job", False), ("cancel_job", True), ("cancel_job", False), ("release_job", False), ("requeue_job", True), ("hold_job", True), ("release_job", True)]
    assert [t.step(tool, {"job_id": first})["done"] for tool, _ in steps] == [done for _, done in steps]
    assert t.step("job_status", {"job_id": first}) == {"job_id": first, "state": "PENDING"} and t.step("job_status", {"job_id": "7"}) == {"job_id": "7", "found": False}
    for tool, arguments in (("submit_job", {"script": "ls"}), ("submit_job", {}), ("job_status", {"job_id": 7}), ("job_status", {"job_id": "x"}), ("fly", {"job_id": "7"})):
        with pytest.raises(ValueError):
            t.step(tool, arguments)


def test_replayed_calls(spark):
    s = "#!/bin/sh\nls"
    job = number(s)
    one = [("submit_job", {"script": s}, f'{{"job_id": "{job}", "submitted": true}}', True), ("job_status", {"job_id": job}, f'{{"state":"PENDING","job_id":"{job}"}}', True), ("cancel_job", {"job_id": job}, None, None), ("job_status", {"job_id": job}, f'{{"state":"PENDING","job_id":"{job}"}}', False)]
    rows = [("a", i, f"a{i}", tool, json.dumps(given), stored) for i, (tool, given, stored, _) in enumerate(one)]
    # another conversation, one without a name, and calls that can't be run
    rows += [("b", 0, "b0", "job_status", json.dumps({"job_id": job}), f'{{"found":false,"job_id":"{job}"}}'), (None, 0, "n0", "submit_job", json.dumps({"script": s}), None), (None, 1, "n1", "job_status", json.dumps({"job_id": job}), "[]")]
    rows += [("c", 0, "c0", "job_status", "{", "{}"), ("c", 1, "c1", None, "{}", None), ("c", 2, "c2", "submit_job", None, None), ("c", 3, "c3", "job_status", "[1]", None)]
    df = spark.createDataFrame(rows, "conv string, i long, key string, tool string, arguments string, stored string")
    got = {r.key: r for r in replay_calls(df, ["conv"], ["i"], ["key"]).collect()}
    assert [got[f"a{i}"].matches for i in range(4)] == [m for *_, m in one]
    assert got["b0"].matches and got["n1"].matches is False and got["n1"].result == f'{{"job_id":"{job}","state":"PENDING"}}'
    assert [got[f"c{i}"].error for i in range(4)] == ["arguments are no JSON", "no job id", "arguments are no JSON", "arguments are no object"] and got["c0"].matches is False
    assert replay_calls(df.where("false"), ["conv"], ["i"], ["key"]).count() == 0
    # a batch may end within a conversation
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        assert {r.key: r for r in replay_calls(df, ["conv"], ["i"], ["key"]).collect()} == got
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
