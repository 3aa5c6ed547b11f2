"""Small lookups over queue, partition and accounting tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def queue_listing(jobs: DataFrame, state: str | None = None, part: str | None = None) -> DataFrame:
    """Jobs that wait or run, of one state or partition if given."""
    out = jobs.where(F.col("state").isin("PENDING", "RUNNING"))
    for column, wanted in (("state", state), ("part", part)):
        if wanted is not None:
            out = out.where(F.col(column) == wanted)
    return out


def keyed_lookup(asked: DataFrame, rows: DataFrame, key: str, what: str) -> DataFrame:
    """Rows of the asked keys; for an unknown key an error that names the known ones (of a small table)."""
    names = rows.agg(F.array_join(F.array_sort(F.collect_set(key)), ", ").alias("_names"))
    found = asked.join(rows.withColumn("_found", F.lit(True)), key, "left").join(F.broadcast(names))  # one row
    return found.withColumn("error", F.when(F.col("_found").isNull(), F.concat(F.lit(f"unknown {what}; known: "), "_names"))).drop("_found", "_names")


def grams(text: Column, size: int) -> Column:
    """The different substrings of so many characters."""
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substr(text, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def fuzzy_lookup(asked: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """(asked, key, error): the exact key, else the only one that contains what was asked whatever its case.

    Keys meet what is asked by its three characters in a row that fewest keys have, or by all of it if it is shorter;
    only those are searched for the whole.  Neither side is broadcast whole.
    """
    keys = known.select(F.col(key).alias("_key"), F.lower(key).alias("_low")).where("_key is not null")
    parts = keys.select("_key", "_low", F.explode(F.concat(F.array(F.lit("")), *[grams(F.col("_low"), n) for n in (1, 2, 3)])).alias("_gram"))
    want = asked.select("asked").distinct().withColumn("_want", F.lower("asked"))
    offered = want.select("asked", "_want", F.explode_outer(F.when(F.length("_want") < 3, F.array("_want")).otherwise(grams(F.col("_want"), 3))).alias("_gram"))
    counted = offered.join(parts.groupBy("_gram").agg(F.count("*").alias("_keys")), "_gram", "left")
    rarest = counted.groupBy("asked", "_want").agg(F.min(F.struct(F.coalesce("_keys", F.lit(0)).alias("n"), "_gram")).alias("_m")).select("asked", "_want", F.col("_m._gram").alias("_gram"))
    hits = rarest.join(parts, "_gram").where(F.contains("_low", "_want")).groupBy("asked").agg(F.count("*").alias("_n"), F.min("_key").alias("_one"), F.max(F.when(F.col("_key") == F.col("asked"), F.col("_key"))).alias("_exact"))
    near = want.join(hits, "asked", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    return near.select("asked", F.coalesce("_exact", F.when(F.col("_n") == 1, F.col("_one"))).alias(key), F.when(F.col("_exact").isNotNull() | (F.col("_n") == 1), "").when(F.col("_n") == 0, "unknown").otherwise("ambiguous").alias("error"))


def first_found(asked: DataFrame, tables: list[tuple[str, DataFrame]], key: str, value: str) -> DataFrame:
    """(key, value, origin): from the first table, in order, that has the key; origin says which, or "not found"."""
    parts = [rows.select(key, F.lit(i).alias("_i"), F.lit(name).alias("_name"), F.col(value).alias("_value")) for i, (name, rows) in enumerate(tables)]
    best = reduce(DataFrame.unionByName, parts).groupBy(key).agg(F.min_by(F.struct("_value", "_name"), "_i").alias("_b"))
    return asked.join(best, key, "left").select(key, F.col("_b._value").alias(value), F.coalesce("_b._name", F.lit("not found")).alias("origin"))


def nested(parents: DataFrame, children: DataFrame, on: str, key: str, item: Column) -> DataFrame:
    """(key, items): each parent with its children's items, sorted; empty without any."""
    joined = parents.join(children.select(on, item.alias("_item")), on, "left")
    return joined.groupBy(key).agg(F.array_sort(F.collect_list("_item")).alias("items"))


def associations(rows: DataFrame, user: str) -> DataFrame:
    """(user, n_accounts, partitions, qos) from rows (account, allowed, qos); an empty allowed partition means all."""
    qos = rows.select(user, F.explode(F.split("qos", ",")).alias("q")).groupBy(user).agg(F.array_join(F.array_sort(F.collect_set("q")), ",").alias("qos"))
    own = rows.groupBy(user).agg(F.count_distinct("account").alias("n_accounts"), F.when(F.bool_or(F.col("allowed") == ""), "all").otherwise(F.array_join(F.array_sort(F.collect_set("allowed")), ",")).alias("partitions"))
    return own.join(qos, user)


def quota_free(used: DataFrame, group: str, amount: str, team: int, personal: int) -> DataFrame:
    """used with `free`: the smaller of what the team and the user have left, at least 0."""
    totals = used.groupBy(group).agg(F.sum(amount).alias("_team"))
    return used.join(totals, group).withColumn("free", F.greatest(F.lit(0), F.least(F.lit(team) - F.col("_team"), F.lit(personal) - F.col(amount))).cast("long")).drop("_team")


def filtered_lines(texts: DataFrame, key: str, text: str, greps: list[tuple[str, bool, bool]], head: int) -> DataFrame:
    """(key, shown, matching, head): lines that pass all greps (what, ignore case, invert), the first `head` of them; none for texts without any."""

    def passes(line: Column) -> Column:
        out = F.lit(True)
        for what, fold, invert in greps:
            has = (F.lower(line) if fold else line).contains(what.lower() if fold else what)
            out = out & (~has if invert else has)
        return out

    found = texts.where(F.col(text).isNotNull()).select(key, F.filter(F.split(text, "\n"), passes).alias("lines")).where(F.size("lines") > 0)
    first = F.slice("lines", 1, head)
    return found.select(key, F.size(first).cast("long").alias("shown"), F.size("lines").cast("long").alias("matching"), F.array_join(first, "\n").alias("head"))


def log_tail(text: Column, n: int) -> Column:
    """The last n lines, n between 1 and 200."""
    lines, n = F.split(text, "\n"), max(1, min(200, n))
    return F.array_join(F.slice(lines, F.greatest(F.lit(1), F.size(lines) - F.lit(n - 1)), F.lit(n)), "\n")


def read_only(command: Column) -> Column:
    """Whether the command is one that only reads, alone or piped into line filters."""
    return command.rlike(r"^\s*(squeue|sinfo|sacct|scontrol show)( [A-Za-z0-9 =,._%+:-]*)?( \| (head|tail|grep|wc)( [A-Za-z0-9 .-]*)?)*\s*$")
