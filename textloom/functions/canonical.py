"""One form of equal JSON values, and digests of it."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _once(pairs: list[tuple[str, object]]) -> dict:
    if len({k for k, _ in pairs}) < len(pairs):
        raise ValueError("a key twice")
    return dict(pairs)


def _no_constant(name: str) -> None:
    raise ValueError(name)


def loads_strict(text: str) -> object:
    """The JSON value; an error for repeated keys, NaN and infinities too."""
    return json.loads(text, object_pairs_hook=_once, parse_constant=_no_constant)


def dumps_canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def canonical(text: str | None) -> str | None:
    """Keys sorted at every depth, no blanks, characters as themselves; 1, 1.0, true and "1" stay apart.

    Null for null, for what is no JSON, and for an object with a key twice.
    """
    try:
        return None if text is None else dumps_canonical(loads_strict(text))
    except (ValueError, RecursionError):
        return None


@F.pandas_udf(StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    return texts.map(canonical)


def json_digest(text: Column) -> Column:
    """SHA-256 of the canonical form."""
    return F.sha2(canonical_json(text), 256)
