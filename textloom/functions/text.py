"""Scalar text expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words of any script; the same in Java and in RE2, whose \w are ASCII.
WORD = r"[\p{L}\p{N}_]+"
NUMBER = r"[0-9][0-9,]*(?:\.[0-9]+)?"
PLACEHOLDER = r"<[A-Za-z][A-Za-z0-9_ -]*>|\[(?:your|YOUR)[^\]]*\]|\bTODO\b|\bXXX+\b"


def matches(text: Column, pattern: str) -> Column:
    """All whole matches of the pattern, in order; null for null."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def words(text: Column) -> Column:
    return matches(F.lower(text), WORD)


def squeeze(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", " ")


def ascii_norm(text: Column) -> Column:
    """Lower case; every run of anything but a-z and 0-9 becomes one blank."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def word_norm(text: Column) -> Column:
    """Lower-cased words of any script joined by blanks."""
    return F.array_join(words(text), " ")


@F.pandas_udf(StringType())
def unicode_norm(text: pd.Series) -> pd.Series:
    """NFKC, casefold, runs of white space as one blank, trimmed; Spark has no built-in for the first two."""
    return text.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).casefold().split()))


def text_key(text: Column, chars: int = 1500) -> Column:
    """Key of near-identical pages: the first characters, lower case, white space collapsed."""
    return F.substring(squeeze(F.lower(text)), 1, chars)


def hash_bucket(key: Column, salt: str, buckets: int = 100) -> Column:
    """Bucket from the first 32 bits of sha256(salt + key); any engine can reproduce it."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(salt), key.cast("string")), 256), 1, 8), 16, 10).cast("long") % F.lit(buckets)


def hash_order(*keys: Column, salt: str = "") -> Column:
    """Sort key of a reproducible shuffle."""
    return F.sha2(F.concat_ws("|", F.lit(salt), *[k.cast("string") for k in keys]), 256)


def numbers(text: Column) -> Column:
    """All numbers as doubles, thousands commas dropped."""
    return F.transform(matches(text, NUMBER), lambda n: F.regexp_replace(n, ",", "").try_cast("double"))


def head_and_tail(text: Column, head: int = 2000, tail: int = 10000) -> Column:
    """Both ends of a long text with a note of how much was left out between them."""
    left_out = F.length(text) - F.lit(head + tail)
    return F.when(left_out <= 0, text).otherwise(F.concat(F.substring(text, 1, head), F.lit("\n[... "), left_out.cast("string"), F.lit(" characters left out ...]\n"), F.right(text, F.lit(tail))))


def excerpt_budget(question_chars: Column, total: int = 48000, low: int = 8000, high: int = 40000) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), F.lit(total) - question_chars))


def ends_in_loop(text: Column, shortest: int = 20, longest: int = 400, times: int = 6) -> Column:
    """Whether the text ends with one block of shortest to longest characters, so many times over."""
    tail, last = F.right(text, F.lit(longest * times)), F.right(text, F.lit(shortest))
    # the last characters must occur so many times near the end; few texts go on to the check of every block length
    often = F.length(tail) - F.length(F.replace(tail, last, F.lit(""))) >= shortest * times
    return often & F.exists(F.sequence(F.lit(shortest), F.lit(longest)), lambda p: (F.length(text) >= p * times) & (F.right(text, p * times) == F.repeat(F.right(text, p), F.lit(times))))


def strip_thinking(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)<think>.*?</think>\s*", "")


def name_like_words(text: Column) -> Column:
    """Words with an underscore or digit, and capitalised words that don't start a sentence."""
    odd = matches(text, r"\b[A-Za-z0-9]*[0-9_][A-Za-z0-9_]*\b")
    inner = F.flatten(F.transform(F.split(text, r"[.!?]\s+|\n"), lambda s: matches(F.regexp_replace(s, r"^\s*\S+", ""), r"\b[A-Z][A-Za-z0-9]+\b")))
    return F.array_distinct(F.concat(odd, inner))


def question_part(text: Column) -> Column:
    """What stands before quoted input or retrieval results."""
    return F.trim(F.regexp_replace(text, r"(?s)(Provided input|Quoted retrieval results):.*", ""))


def reply_json(text: Column) -> Column:
    """Body of a reply that may be fenced as json."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"^\s*```(?:json)?\s*", ""), r"\s*```\s*$", ""))


def code_of_answer(text: Column) -> Column:
    """Fenced blocks and inline code, one a line; the whole text if there are none."""
    fenced = F.regexp_extract_all(text, F.lit(r"(?s)```[^\n]*\n(.*?)```"), F.lit(1))
    inline = F.regexp_extract_all(F.regexp_replace(text, r"(?s)```[^\n]*\n.*?```", ""), F.lit(r"`([^`\n]+)`"), F.lit(1))
    both = F.concat(fenced, inline)
    return F.when(F.size(both) == 0, text).otherwise(F.array_join(both, "\n"))


def last_sentence(text: Column) -> Column:
    return F.element_at(F.split(F.rtrim(text), r"[.!?]\s+"), -1)
