"""Cutting documents: chunks, blocks, fences, spans."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructType

from textloom.functions.text import matches
from textloom.session import arrow_limits

_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})")


def blocks_of(text: str) -> list[str]:
    """Blank-line blocks; a fenced block is never cut."""
    out: list[list[str]] = [[]]
    fence = ""
    for line in text.split("\n"):
        m = _FENCE.match(line)
        if m and not fence:
            fence = m.group(1)
        elif m and m.group(1)[0] == fence[0] and len(m.group(1)) >= len(fence) and not line.strip().strip(fence[0]):
            fence = ""
        if not line.strip() and not fence:
            out.append([])
        else:
            out[-1].append(line)
    return ["\n".join(b) for b in out if b]


def packed(blocks: list[str], limit: int, cut_long: bool) -> list[str]:
    """Blocks joined by a blank line, greedily, up to limit characters; longer blocks alone, or cut if cut_long."""
    if cut_long:
        blocks = [b[i : i + limit] for b in blocks for i in range(0, len(b), limit)]
    out: list[str] = []
    for b in blocks:
        if out and len(out[-1]) + 2 + len(b) <= limit:
            out[-1] += "\n\n" + b
        else:
            out.append(b)
    return out


def chunks_of(text: str | None, limit: int, cut_long: bool, least: int, single: int) -> list[str]:
    found = [c for c in packed(blocks_of(text or ""), limit, cut_long)]
    kept = [c for c in found if len(c) >= least]
    if not kept and len(found) == 1 and single and len(found[0]) >= single:
        kept = found
    return kept


def chunks(docs: DataFrame, key: str, text: str, limit: int = 1500, cut_long: bool = False, least: int = 1, single: int = 0) -> DataFrame:
    """(key, chunk_id "key#i", text): chunks of at most limit characters where blocks allow it.

    least drops shorter chunks; a document of one short chunk keeps it if it has `single` characters.
    """

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: chunks_of(t, limit, cut_long, least, single))

    arrow_limits(docs.sparkSession)
    each = docs.select(key, F.posexplode(cut(F.col(text))).alias("i", "text"))
    return each.select(key, F.concat(F.col(key).cast("string"), F.lit("#"), F.col("i").cast("string")).alias("chunk_id"), "text")


def line_chunks(docs: DataFrame, key: str, text: str, limit: int = 600) -> DataFrame:
    """(key, n_chunks, longest): lines packed greedily into chunks of at most limit characters, a longer line alone; JVM only."""
    state = F.struct(F.lit(0).alias("n"), F.lit(0).alias("open"), F.lit(0).alias("longest"))

    def step(s: Column, line: Column) -> Column:
        fits = (s["n"] > 0) & (s["open"] + 1 + F.length(line) <= limit)
        size = F.when(fits, s["open"] + 1 + F.length(line)).otherwise(F.length(line))
        return F.struct(F.when(fits, s["n"]).otherwise(s["n"] + 1).alias("n"), size.alias("open"), F.greatest(s["longest"], size).alias("longest"))

    folded = F.aggregate(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), state, step)
    return docs.select(key, folded.alias("f")).select(key, F.col("f.n").cast("long").alias("n_chunks"), F.col("f.longest").cast("long").alias("longest"))


def fenced_blocks(text: Column) -> Column:
    """(lang, body) of the fenced code blocks."""
    pattern = r"(?s)```([A-Za-z0-9_+-]*)[^\n]*\n(.*?)```"
    return F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("lang"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("body"))


def drop_blocks(text: Column, pattern: str) -> tuple[Column, Column]:
    """Text without the blank-line blocks that match, and how many went."""
    blocks = F.split(text, r"\n[ \t]*\n\s*")
    kept = F.filter(blocks, lambda b: ~b.rlike(pattern))
    return F.array_join(kept, "\n\n"), F.size(blocks) - F.size(kept)


def quoting_fence(text: Column) -> Column:
    """Backticks one more than the longest run in the text, three at least."""
    longest = F.coalesce(F.array_max(F.transform(matches(text, "`+"), lambda r: F.length(r))), F.lit(0))
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), longest + 1))


def bound_spans(text: Column, spans: Column) -> Column:
    """Of each {start, end, sha256}: whether the characters have the digest, in order and without overlap."""
    right = F.forall(spans, lambda s: F.sha2(F.substring(text, s["start"] + 1, s["end"] - s["start"]), 256) == s["sha256"])
    ordered = F.forall(F.sequence(F.lit(1), F.size(spans)), lambda i: (i == 1) | (F.element_at(spans, i)["start"] >= F.coalesce(F.try_element_at(spans, i - 1)["end"], F.lit(0))))
    return (F.size(spans) == 0) | (right & ordered)


def span_rows(docs: DataFrame, key: str, text: str, spans: str) -> DataFrame:
    """(key, i, sha, in_order): the digest of each {start, end} span's characters, and whether it starts behind the one before."""
    parts = F.transform(
        F.col(spans),
        lambda s, i: F.struct(
            (i + 1).cast("long").alias("i"),
            F.sha2(F.substr(F.col(text), s["start"] + 1, s["end"] - s["start"]), 256).alias("sha"),
            ((i == 0) | (s["start"] >= F.coalesce(F.get(F.col(spans), i - 1)["end"], F.lit(0)))).alias("in_order"),
        ),
    )
    return docs.select(key, F.explode(parts).alias("p")).select(key, "p.*")


@F.pandas_udf(BooleanType())
def unmatched_fence(texts: pd.Series) -> pd.Series:
    """Whether a code fence is opened and never closed on a line of its own; escaped ones don't count."""

    def open_at_end(text: str | None) -> bool:
        fence = ""
        for line in (text or "").split("\n"):
            m = _FENCE.match(line)
            if not m:
                continue
            mark, rest = m.group(1), line[m.end() :]
            if not fence:
                fence = mark
            elif mark[0] == fence[0] and len(mark) >= len(fence) and not rest.strip():
                fence = ""
        return bool(fence)

    return texts.map(open_at_end)


_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[A-ZÀ-Ý\"(])|\n{2,}|\n(?=\s*(?:[-*#]|\d+[.)])\s)")
_ABBREVIATION = re.compile(r"(?:\b(?:e\.g|i\.e|etc|cf|vs|Dr|Mr|Mrs|Fig|No)|\b[A-Z])\.$")


@F.pandas_udf(ArrayType(StructType().add("start", IntegerType()).add("end", IntegerType())))
def exact_cover(texts: pd.Series) -> pd.Series:
    """Spans of sentences, list items and blocks whose texts, joined, are the text; code fences stay whole."""

    def cover(text: str | None) -> list[dict]:
        text = text or ""
        code = [m.span() for m in re.finditer(r"(?s)```.*?```|`[^`\n]+`", text)]
        cuts = [0]
        for m in _SENTENCE.finditer(text):
            at = m.end()
            if not any(a < at < b for a, b in code) and not _ABBREVIATION.search(text[max(0, m.start() - 8) : m.start()]):
                cuts.append(at)
        cuts.append(len(text))
        return [{"start": a, "end": b} for a, b in zip(cuts, cuts[1:], strict=False) if a < b]

    return texts.map(cover)
