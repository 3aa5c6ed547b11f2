"""JSON lines: plain, still being written, truncated, strict."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from textloom.session import saved


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line, blank lines skipped, .gz as it is; a line that isn't an object fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str, compressed: bool = False) -> None:
    """One line a row, non-ASCII kept; never over an existing folder."""
    df.write.mode("errorifexists").option("compression", "gzip" if compressed else "none").json(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value, unfinished): a line's number is its order within its file, however many tasks read it.

    Lines are written once with the block of the file they were read from and their order in it; the blocks' counts
    give every block its first number.  unfinished: the file ends without a newline and this is its last line; that
    can't be told of compressed files, whose lines all count as finished.
    """
    read = spark.read.option("lineSep", "\n").text(path)
    meta = [F.col(f"_metadata.{c}").alias(a) for c, a in (("file_path", "file"), ("file_block_start", "block"), ("file_size", "size"))]
    lines = saved(read.select(*meta, F.monotonically_increasing_id().alias("id"), "value"), "lines")
    blocks = lines.groupBy("file", "block", "size").agg(F.count("*").alias("n"), F.sum(F.octet_length("value") + 1).alias("bytes"))
    of_file = Window.partitionBy("file")  # a row a block
    before = F.coalesce(F.sum("n").over(of_file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_end = (F.sum("bytes").over(of_file) > F.col("size")) & ~F.col("file").endswith(".gz")
    placed = blocks.select("file", "block", before.alias("base"), F.sum("n").over(of_file).alias("total"), open_end.alias("open"))
    number = F.col("base") + F.row_number().over(Window.partitionBy("file", "block").orderBy("id")) - 1
    return lines.join(placed, ["file", "block"]).withColumn("line_no", number).select("file", "line_no", "value", (F.col("open") & (F.col("line_no") == F.col("total") - 1)).alias("unfinished"))


def valid_prefix(lines: DataFrame, schema: str) -> DataFrame:
    """Rows before each file's first line that isn't an object; what a writer that was killed had finished."""
    parsed = lines.where(F.trim("value") != "").withColumn("row", F.from_json("value", schema, {"mode": "PERMISSIVE"}))
    bad = F.try_parse_json(F.col("value")).isNull() | F.col("unfinished")
    first_bad = F.min(F.when(bad, F.col("line_no"))).over(Window.partitionBy("file"))
    return parsed.withColumn("bad", first_bad).where(F.col("bad").isNull() | (F.col("line_no") < F.col("bad"))).select("file", "line_no", "row.*")


def complete_lines(lines: DataFrame, schema: str) -> DataFrame:
    """Snapshot of files still being written: finished lines that are objects."""
    good = lines.where(~F.col("unfinished") & F.try_parse_json(F.col("value")).isNotNull())
    return good.select("file", "line_no", F.from_json("value", schema).alias("row")).select("file", "line_no", "row.*")


@F.pandas_udf(StringType())
def _strict_problem(values: pd.Series) -> pd.Series:
    def no_repeats(pairs: list) -> dict:
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError("repeated key")
        return dict(pairs)

    def not_finite(word: str) -> None:
        raise ValueError("not finite")

    def problem(value: str) -> str:
        if not value.strip():
            return "empty line"
        try:
            found = json.loads(value, object_pairs_hook=no_repeats, parse_constant=not_finite)
        except ValueError as e:
            return str(e) if str(e) in ("repeated key", "not finite") else "not JSON"
        return "" if isinstance(found, dict) else "not an object"

    return values.map(problem)


def strict_problems(lines: DataFrame, id_field: str = "id") -> DataFrame:
    """(file, line_no, problem) of what strict inputs forbid: no final newline, empty lines, bad JSON, repeated keys or ids, NaN."""
    each = lines.withColumn("problem", F.when(F.col("unfinished"), "no newline").otherwise(_strict_problem(F.col("value"))))
    ids = lines.withColumn("id", F.get_json_object("value", f"$.{id_field}")).where("id is not null")
    repeated = ids.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("file", "line_no"))).where("n > 1").select("file", "line_no", F.lit("repeated id").alias("problem"))
    return each.where("problem <> ''").select("file", "line_no", "problem").union(repeated)
