"""Family graphs, held-out material, splits and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions.text import hash_order
from textloom.session import saved


def ancestors(families: DataFrame) -> DataFrame:
    """(family, ancestor): every family with itself and all its ancestors, over (family, parents[]); unknown parents included.

    Grows by doubling (paths of up to 2**k edges after k joins) until a join finds nothing new, however long a lineage
    is; each step is written.  A cycle ends too, with its members their own ancestors.
    """
    edges = families.select("family", F.explode("parents").alias("ancestor")).distinct()
    reach = saved(families.select("family", F.col("family").alias("ancestor")).union(edges).distinct(), "lineage")
    before, now = -1, reach.count()
    while now > before:
        on = reach.select(F.col("family").alias("ancestor"), F.col("ancestor").alias("further"))
        reach = saved(reach.join(on, "ancestor").select("family", F.col("further").alias("ancestor")).distinct(), "lineage")
        before, now = now, reach.count()
    return reach


def family_errors(families: DataFrame, reach: DataFrame) -> DataFrame:
    """(family, error) for unknown parents, cycles and lineage that nobody reviewed."""
    edges = families.select("family", F.explode("parents").alias("parent"))
    unknown = edges.join(families.select(F.col("family").alias("parent")), "parent", "left_anti").select("family", F.lit("unknown_parent").alias("error"))
    on_cycle = edges.join(reach.select(F.col("family").alias("parent"), F.col("ancestor").alias("back")), "parent").where(F.col("back") == F.col("family")).select("family", F.lit("cycle").alias("error"))
    unreviewed = families.where("not lineage_reviewed").select("family", F.lit("unreviewed").alias("error"))
    return unknown.union(on_cycle).union(unreviewed).distinct()


def admitted(documents: DataFrame, families: DataFrame, reach: DataFrame) -> DataFrame:
    """(doc_id, family, admitted): lineage is train throughout and touches no ancestor of a held family."""
    split = families.select(F.col("family").alias("ancestor"), "split")
    lineage = reach.join(split, "ancestor", "left")
    held = lineage.join(families.where("split <> 'train'").select("family"), "family").select("ancestor").distinct()
    touched = lineage.join(held.withColumn("held", F.lit(True)), "ancestor", "left")
    clean = touched.groupBy("family").agg((F.bool_and(F.coalesce(F.col("split") == "train", F.lit(False))) & ~F.coalesce(F.bool_or("held"), F.lit(False))).alias("clean"))
    return documents.join(clean, "family", "left").select("doc_id", "family", F.coalesce("clean", F.lit(False)).alias("admitted"))


def split_documents(rows: DataFrame, doc: str, fraction: float, seed: str) -> DataFrame:
    """(doc, n_rows, validation): whole documents, shuffled by hash, go to validation until it has the fraction of all rows.

    The running sum is over documents, not rows: summed by leading hash digits first, so that no task sees them all.
    """
    docs = rows.groupBy(F.col(doc).alias("doc")).agg(F.count("*").alias("n_rows")).withColumn("h", hash_order(F.col("doc"), salt=seed))
    docs = docs.withColumn("part", F.substring("h", 1, 2))
    parts = docs.groupBy("part").agg(F.sum("n_rows").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # 256 rows
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.sum("n").over(Window.partitionBy()).alias("total"))
    within = Window.partitionBy("part").orderBy("h", "doc").rowsBetween(Window.unboundedPreceding, -1)
    placed = docs.join(F.broadcast(parts), "part").withColumn("before", F.col("base") + F.coalesce(F.sum("n_rows").over(within), F.lit(0)))
    return placed.select("doc", "n_rows", (F.col("before") < F.lit(fraction) * F.col("total")).alias("validation"))


def fingerprint(df: DataFrame, *columns: str) -> DataFrame:
    """One row: rows, and a digest that any change of a row changes and the order doesn't.

    Row digests are added up in parts of their hex digits, so it takes one partial aggregation.
    """
    sha = F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0002")) for c in columns]), 256)
    part = lambda i: F.sum(F.conv(F.substring("sha", 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).cast("string")
    return df.select(sha.alias("sha")).agg(F.count("*").alias("n_rows"), F.sha2(F.concat_ws(",", *[F.coalesce(part(i), F.lit("0")) for i in range(4)]), 256).alias("fingerprint"))


def source_holdout(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """(id, reason order): rows bound to held-out sources: same digest, same document (document entries) or same chunk.

    Three equi-joins rather than one join on any of three conditions; the first entry in manifest order counts.
    """
    parts = [
        rows.join(manifest, "source_sha256").select("id", "entry", F.lit("source_sha256").alias("reason")),
        rows.join(manifest.where("kind = 'document'"), "doc_id").select("id", "entry", F.lit("document").alias("reason")),
        rows.join(manifest.where("chunk_id is not null"), "chunk_id").select("id", "entry", F.lit("chunk").alias("reason")),
    ]
    every = parts[0].union(parts[1]).union(parts[2])
    return every.groupBy("id").agg(F.min(F.struct("entry", "reason")).alias("m")).select("id", F.col("m.entry").alias("entry"), F.col("m.reason").alias("reason"))


def mismatches(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Strict one-to-one join: (key, problem) for keys on one side only, repeated keys and differing fields; none if all agree."""
    count: Column = F.count("*").alias("n")
    a = left.groupBy(key).agg(count, *[F.first(f).alias(f"l_{f}") for f in fields])
    b = right.groupBy(key).agg(count.alias("m"), *[F.first(f).alias(f"r_{f}") for f in fields])
    differs = F.lit(False)
    for f in fields:
        differs = differs | ~F.col(f"l_{f}").eqNullSafe(F.col(f"r_{f}"))
    problem = F.when(F.col("n").isNull(), "only_right").when(F.col("m").isNull(), "only_left").when((F.col("n") > 1) | (F.col("m") > 1), "repeated").when(differs, "differs")
    return a.join(b, key, "full").select(key, problem.alias("problem")).where("problem is not null")
