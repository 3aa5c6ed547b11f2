"""Building data sets: set operations, gates, replacements, planning of jobs, exposure audits, release checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions.text import hash_order
from textloom.operators.select import numbers_within


def membership(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): both, left or right, for each key of either side."""
    a, b = left.select(key).distinct().withColumn("_l", F.lit(1)), right.select(key).distinct().withColumn("_r", F.lit(1))
    side = F.when(F.col("_r").isNull(), "left").when(F.col("_l").isNull(), "right").otherwise("both")
    return a.join(b, key, "full").select(key, side.alias("side"))


def repeated_keys(parts: list[DataFrame], key: str) -> DataFrame:
    """(key, n) of keys that the union of the parts holds more than once; none if the parts are unique and disjoint."""
    return reduce(DataFrame.unionByName, [p.select(key) for p in parts]).groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def replaced(rows: DataFrame, better: DataFrame, key: str, column: str, gate: Column) -> DataFrame:
    """Rows with the column from `better` (key, new) where there is one and the gate over both holds; `replaced` says where."""
    joined = rows.join(better, key, "left").withColumn("replaced", F.coalesce(F.col("new").isNotNull() & gate, F.lit(False)))
    return joined.withColumn(column, F.when(F.col("replaced"), F.col("new")).otherwise(F.col(column))).drop("new")


def lottery(key: Column, weights: dict[str, float], salt: str) -> Column:
    """One of the names, by the key's hash and in proportion to the weights, in thousandths."""
    point = F.conv(F.substring(F.sha2(F.concat(F.lit(salt), key.cast("string")), 256), 1, 8), 16, 10).cast("long") % 1000
    total, below, out = sum(weights.values()), 0.0, F
    for name, weight in weights.items():
        below += 1000 * weight / total
        out = out.when(point < F.lit(round(below)), name)
    return out


def job_plan(chunks: DataFrame, key: str, personas: list[str], tasks: list[str], per_chunk: int, weights: dict[str, float], salt: str) -> DataFrame:
    """(job_id, key, persona, task, mode): per_chunk cells of the grid of personas and tasks for every chunk, with stable ids."""
    grid = [f"{p}/{t}" for p in personas for t in tasks]
    cells = F.array(*map(F.lit, grid))
    ordered = F.array_sort(F.transform(cells, lambda c: F.struct(F.sha2(F.concat_ws("|", F.lit(salt), F.col(key).cast("string"), c), 256).alias("h"), c.alias("cell"))))
    jobs = chunks.select(key, F.explode(F.slice(ordered, 1, per_chunk)).alias("j")).select(key, F.col("j.cell").alias("cell"), F.substring("j.h", 1, 16).alias("job_id"))
    return jobs.select("job_id", key, F.substring_index("cell", "/", 1).alias("persona"), F.substring_index("cell", "/", -1).alias("task"), lottery(F.col("job_id"), weights, salt).alias("mode"))


def plan_problems(plan: DataFrame, chunks: DataFrame, job: str, key: str, digest: str, brief: str) -> DataFrame:
    """(job, problem): repeated job keys, chunks that don't exist or have changed, briefs that are the same but for case and blanks."""
    norm = F.trim(F.regexp_replace(F.lower(brief), r"\s+", " "))
    each = plan.withColumn("_norm", norm)
    twice = each.groupBy(job).agg(F.count("*").alias("n")).where("n > 1").select(job, F.lit("duplicate_key").alias("problem"))
    same = each.groupBy("_norm").agg(F.min(job).alias("_first"), F.count("*").alias("n")).where("n > 1")
    briefs = each.join(same, "_norm").where(F.col(job) > F.col("_first")).select(job, F.lit("duplicate_brief").alias("problem"))
    bound = each.join(chunks.select(key, F.col(digest).alias("_now")).withColumn("_known", F.lit(True)), key, "left")
    state = F.when(F.col("_known").isNull(), "unknown_chunk").when(~F.col(digest).eqNullSafe(F.col("_now")), "changed_chunk")
    return twice.union(briefs).union(bound.select(job, state.alias("problem")).where("problem is not null")).distinct()


def rotated(number: Column, key: Column, values: list[str], salt: str) -> Column:
    """The value at number + an offset by the key's hash, round and round."""
    offset = F.conv(F.substring(F.sha2(F.concat(F.lit(salt), key.cast("string")), 256), 1, 8), 16, 10).cast("long")
    return F.get(F.array(*map(F.lit, values)), ((number + offset) % len(values)).cast("int"))


def quota_bank(tasks: DataFrame, family: str, key: str, quotas: dict[str, int], excluded: Column, salt: str) -> DataFrame:
    """Tasks of each family up to its quota, in order of hash, without the excluded ones."""
    quota = F.create_map(*[F.lit(v) for item in quotas.items() for v in item])
    kept = tasks.where(~excluded & F.map_contains_key(quota, F.col(family)))
    w = Window.partitionBy(family).orderBy(hash_order(F.col(key), salt=salt), key)
    # the largest quota lets each task cut its families before the shuffle
    return kept.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= max(quotas.values())).where(F.col("_n") <= F.element_at(quota, F.col(family))).drop("_n")


def exposure(rows: DataFrame, key: str, checks: dict[str, DataFrame]) -> DataFrame:
    """One row: rows, for each check how many of them it holds, how many any of them holds, and how many remain."""
    flagged = rows.select(key)
    for name, held in checks.items():
        flagged = flagged.join(held.select(key).distinct().withColumn(f"_{name}", F.lit(True)), key, "left")
    flags = {name: F.coalesce(f"_{name}", F.lit(False)) for name in checks}
    either = reduce(lambda a, b: a | b, flags.values())
    return flagged.agg(F.count("*").alias("n"), *[F.count_if(c).alias(name) for name, c in flags.items()], F.count_if(either).alias("either"), F.count_if(~either).alias("remaining"))


def release_problems(previous: DataFrame, current: DataFrame, line: str, key: str, unique: list[str]) -> DataFrame:
    """(problem, n): lines of the previous release that the current doesn't hold at the same place, and repeated values."""
    was = previous.select(line, F.col(key).alias("_was"))
    moved = was.join(current.select(line, F.col(key).alias("_is")), line, "left").agg(F.count_if(~F.col("_was").eqNullSafe(F.col("_is"))).alias("n")).select(F.lit("prefix").alias("problem"), "n")
    twice = [current.groupBy(c).agg(F.count("*").alias("m")).agg(F.coalesce(F.sum(F.col("m") - 1), F.lit(0)).alias("n")).select(F.lit(f"repeated_{c}").alias("problem"), "n") for c in unique]
    return reduce(DataFrame.union, twice, moved)


def conflicting(registries: DataFrame, name: str, definition: str) -> DataFrame:
    """(name, n): names that different origins define differently."""
    return registries.groupBy(name).agg(F.count_distinct(definition).alias("n")).where("n > 1")


def source_lines(rows: DataFrame, origin: str, order: list[str], key: str) -> DataFrame:
    """(key, origin, line, digest): line number within the origin, in order."""
    own = rows.withColumn("digest", F.sha2(F.concat_ws("|", *rows.columns), 256))
    return numbers_within(own, [origin], order, "line").select(key, origin, (F.col("line") + 1).alias("line"), "digest")


def within_coverage(rows: DataFrame, left: str, right: str, least: float) -> DataFrame:
    """One row (n, kept, passes): rows whose two arrays are of equal length, and whether these are `least` of all."""
    same = F.count_if(F.size(left) == F.size(right))
    return rows.agg(F.count("*").alias("n"), same.alias("kept"), (same >= F.lit(least) * F.count("*")).alias("passes"))
