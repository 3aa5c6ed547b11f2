"""Durations, sizes, records and options in the formats of batch schedulers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds(duration: Column) -> Column:
    """[D-]HH:MM:SS, MM:SS, D-HH[:MM] or MM (minutes) as seconds; null for anything else."""
    day = r"^(\d+)-(\d+)(?::(\d+))?(?::(\d+))?$"
    part = lambda p, i: F.coalesce(F.nullif(F.regexp_extract(duration, p, i), F.lit("")).try_cast("double"), F.lit(0.0))
    hms, ms = r"^(\d+):(\d+):(\d+(?:\.\d+)?)$", r"^(\d+):(\d+(?:\.\d+)?)$"
    return (
        F.when(duration.rlike(day), part(day, 1) * 86400 + part(day, 2) * 3600 + part(day, 3) * 60 + part(day, 4))
        .when(duration.rlike(hms), part(hms, 1) * 3600 + part(hms, 2) * 60 + part(hms, 3))
        .when(duration.rlike(ms), part(ms, 1) * 60 + part(ms, 2))
        .when(duration.rlike(r"^\d+$"), duration.try_cast("double") * 60)
    )


def megabytes(size: Column) -> Column:
    """A number with K, M, G or T (M without) in MB; null for anything else."""
    pattern = r"^([0-9]+(?:\.[0-9]+)?)([KMGTkmgt]?)[Bb]?$"
    n = F.nullif(F.regexp_extract(size, pattern, 1), F.lit("")).try_cast("double")
    unit = F.upper(F.regexp_extract(size, pattern, 2))
    return F.when(unit == "K", n / 1024).when(unit == "G", n * 1024).when(unit == "T", n * 1048576).otherwise(n)


def pretty_gb(mb: Column) -> Column:
    """Whole GB, or TB from 1024 GB on."""
    gb = F.floor(mb / 1024)
    return F.when(gb >= 1024, F.concat(F.floor(gb / 1024).cast("string"), F.lit(" TB"))).otherwise(F.concat(gb.cast("string"), F.lit(" GB")))


def record(text: Column) -> Column:
    """KEY=VALUE words of a record as a map; of a repeated key the last holds."""
    pairs = F.transform(F.regexp_extract_all(text, F.lit(r"(\S+?=\S*)"), F.lit(1)), lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), F.regexp_replace(p, "^[^=]*=", "").alias("value")))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    last = lambda k: F.element_at(F.filter(pairs, lambda p: p["key"] == k), -1)["value"]
    return F.map_from_arrays(keys, F.transform(keys, last))


def gpus(tres: Column) -> Column:
    """GPUs of a resource list: the typed counts' sum if there are any, else the untyped count, else 0."""
    typed = F.transform(F.regexp_extract_all(tres, F.lit(r"gres/gpu:[^=,]+=(\d+)"), F.lit(1)), lambda n: n.cast("long"))
    plain = F.nullif(F.regexp_extract(tres, r"(?:^|,)gres/gpu=(\d+)", 1), F.lit("")).cast("long")
    total = F.aggregate(typed, F.lit(0).cast("long"), lambda a, n: a + n)
    return F.when(F.size(typed) > 0, total).otherwise(F.coalesce(plain, F.lit(0)))


#: Options read from scripts, with the short letter of each where there is one. Fixed values.
OPTIONS = {"nodes": "N", "ntasks": "n", "cpus-per-task": "c", "time": "t", "partition": "p", "account": "A", "mem": None, "gres": None, "array": "a", "output": "o", "job-name": "J"}


def script_options(script: Column) -> Column:
    """Options of the #SBATCH lines as a map; of a repeated option the last holds."""

    def last(long: str, short: str | None) -> Column:
        name = f"--{long}[= ]" + (f"|-{short} ?" if short else "")
        found = F.regexp_extract_all(script, F.lit(rf"(?m)^#SBATCH\s+(?:{name})\s*(\S+)"), F.lit(1))
        return F.when(F.size(found) > 0, F.element_at(found, -1))

    pairs = F.array(*[F.struct(F.lit(k).alias("key"), last(k, s).alias("value")) for k, s in OPTIONS.items()])
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))


def expand_pattern(pattern: Column, job_id: Column, array_job: Column, task: Column, name: Column, user: Column) -> Column:
    """%j %A %a %x %u and %% of output file names."""
    out = F.replace(pattern, F.lit("%%"), F.lit("\u0001"))
    for mark, value in (("%j", job_id), ("%A", array_job), ("%a", task), ("%x", name), ("%u", user)):
        out = F.replace(out, F.lit(mark), F.coalesce(value.cast("string"), F.lit("")))
    return F.replace(out, F.lit("\u0001"), F.lit("%"))
