"""Typed settings of the cleaning pipeline: unknown keys and values out of range are errors."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class CleanConfig:
    dedup_threshold: float = 0.8
    decontam_threshold: float = 0.8
    shingle_words: int = 3
    max_answer_chars: int = 4000
    chunk_chars: int = 1500

    def __post_init__(self):
        for name in ("dedup_threshold", "decontam_threshold"):
            if not 0 < getattr(self, name) <= 1:
                raise ValueError(f"{name} must be above 0 and at most 1")
        for name in ("shingle_words", "max_answer_chars", "chunk_chars"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be positive")


def configured(base: CleanConfig, overrides: list[str]) -> CleanConfig:
    """base with KEY=VALUE overrides, values read as JSON."""
    known, given = {f.name for f in fields(base)}, {}
    for item in overrides:
        key, found, value = item.partition("=")
        if not found or key not in known:
            raise ValueError(f"unknown setting: {item}")
        given[key] = json.loads(value)
    return replace(base, **given)
