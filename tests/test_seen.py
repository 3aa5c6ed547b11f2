"""The seen-set over runs, restarts and archives."""

from pyspark.sql import functions as F

from textloom.session import fresh_path
from textloom.sources.seen import SeenSet


def test_runs_archives_and_restarts(spark):
    seen = SeenSet(spark, fresh_path(spark, "seen"), 1)

    def run(number, rows):
        df = spark.createDataFrame(rows, "i long, sha string")
        return {r.i: r.seen for r in seen.admit(df, F.col("sha"), ["i"], F.concat(F.lit("u"), F.col("i")), number).collect()}

    first = [(1, "aa1"), (2, "bb2"), (3, "aa1"), (4, None), (5, ""), (6, None)] + [(100 + i, "hot") for i in range(500)]
    assert run(1, first) == {1: None, 2: None, 3: "u1", 4: None, 5: None, 6: None, 100: None} | {101 + i: "u100" for i in range(499)}
    second = [(7, "aa1"), (8, "cc3"), (9, "old"), (10, "cc3")]
    assert run(2, second) == {7: "u1", 8: None, 9: None, 10: "u8"}
    assert run(2, second) == {7: "u1", 8: None, 9: None, 10: "u8"}  # run again
    archive = spark.createDataFrame([("http://a", "dd4", "ee5"), ("http://b", None, ""), ("http://c", "dd4", "aa1")], "url string, sha256 string, text_sha256 string")
    seen.absorb(archive, ["sha256", "text_sha256"], F.col("url"), 3)
    assert run(4, [(11, "dd4"), (12, "ee5"), (13, "ff6"), (14, "cc3")]) == {11: "old:http://a", 12: "old:http://a", 13: None, 14: "u8"}
    assert run(5, []) == {}
