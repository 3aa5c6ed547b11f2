"""Conversions that take a small state machine for each text, in Arrow batches."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, MapType, StringType

_FONT = re.compile(r"\\f(?:\[([A-Z]*)\]|([BIRP]))")
_MARK = {"B": "**", "I": "*"}
_SIGN = re.compile(r"\\(?:\((..)|\[([^\]]*)\]|(.))")
#: Characters by their names, and those that stand for others after a backslash. Fixed values.
NAMED = {"em": "—", "en": "–", "aq": "'", "dq": '"', "bu": "-", "hy": "-", "lq": "“", "rq": "”", "co": "©", "rs": "\\"}
ESCAPED = {"e": "\\", "&": "", "|": "", "^": "", "~": " ", "0": " "}
#: Requests about the page's look, which carry no text. Fixed values.
SILENT = frozenset(("TH", "RS", "RE", "ad", "na", "hy", "nh", "in", "ti", "ft", "ps", "ne", "de", "so", "ds", "nr", "if", "ie", "el", "ig", "tr", "PD", "UR", "UE", "MT", "ME"))


def _sign(m: re.Match) -> str:
    name = m.group(1) or m.group(2)
    return NAMED.get(name, name) if name else ESCAPED.get(m.group(3), m.group(3))


def _inline(text: str) -> str:
    """Font changes as marks, escaped and named signs as signs."""
    out, open_, at = [], "", 0
    for m in _FONT.finditer(text):
        out.append(text[at : m.start()] + open_)
        open_ = _MARK.get(m.group(1) or m.group(2), "")
        out.append(open_)
        at = m.end()
    return _SIGN.sub(_sign, "".join([*out, text[at:], open_]))


def _arguments(text: str) -> list[str]:
    """A request's arguments; one in quotes may have blanks, and two quotes in it are one."""
    return [q.replace('""', '"') if q or not w else w for q, w in re.findall(r'"((?:[^"]|"")*)"?|(\S+)', text)]


def _in_fonts(fonts: str, rest: str) -> str:
    """Arguments in one font with blanks between them, or in two fonts by turns without."""
    arguments = [_inline(a) for a in _arguments(rest)]
    if len(fonts) == 1:
        return _MARK.get(fonts, "") + " ".join(arguments) + _MARK.get(fonts, "") if arguments else ""
    return "".join(_MARK.get(fonts[i % 2], "") + a + _MARK.get(fonts[i % 2], "") for i, a in enumerate(arguments) if a)


def roff_to_markdown(text: str | None) -> str:
    """A manual page's sections, fonts, paragraphs, terms and literal blocks; comments and requests about its look go.

    A term (.TP, or .IP's argument) is a block of its own in bold.  What another request carries is text.  A literal
    block ends with the text at the latest.
    """
    blocks: list[str] = []
    words: list[str] = []
    literal: list[str] | None = None
    term = False  # the next line is one

    def close() -> None:
        if words:
            blocks.append(" ".join(words))
            words.clear()

    def say(line: str) -> None:
        nonlocal term
        if line and term:
            blocks.append(f"**{line.replace('**', '')}**")
        elif line:
            words.append(line)
        term = term and not line

    for line in (text or "").split("\n"):
        if line.startswith((".\\\"", "'\\\"")):
            continue
        m = re.match(r"[.'][ \t]*([A-Za-z]+)[ \t]*(.*)$", line)
        request, rest = m.groups() if m else ("", line)
        if literal is not None:
            if request in ("fi", "EE"):
                blocks.append("\n".join(["```", *literal, "```"]))
                literal = None
            else:
                literal.append(_inline(line))
        elif request in ("SH", "SS"):
            close()
            blocks.append(("## " if request == "SH" else "### ") + _inline(" ".join(_arguments(rest))))
        elif re.fullmatch("[BIR]{1,2}|SM|SB", request):
            say(_in_fonts(request.replace("SB", "B").replace("SM", "R"), rest))
        elif request in ("PP", "P", "LP", "TP", "IP", "HP", "sp", "br", "TQ"):
            close()
            term = request in ("TP", "TQ")
            if request == "IP" and (mark := _arguments(rest)[:1]) and _inline(mark[0]) not in ("-", "*", "•"):
                blocks.append(f"**{_inline(mark[0]).replace('**', '')}**")
        elif request in ("nf", "EX"):
            close()
            literal = []
        elif request in SILENT or not m and line.startswith("."):
            continue
        elif request:
            say(_inline(" ".join(_arguments(rest))))
        elif line.strip():
            say(_inline(line.strip()))
        else:
            close()
    close()
    if literal:
        blocks.append("\n".join(["```", *literal, "```"]))
    return "\n\n".join(blocks)


@F.pandas_udf(StringType())
def roff_markdown(texts: pd.Series) -> pd.Series:
    return texts.map(roff_to_markdown)


def numbers_of(value: object, path: str = "") -> dict[str, float]:
    if isinstance(value, dict):
        return {k: v for name, inner in value.items() for k, v in numbers_of(inner, f"{path}.{name}" if path else name).items()}
    return {path: float(value)} if isinstance(value, int | float) and not isinstance(value, bool) else {}


@F.pandas_udf(MapType(StringType(), DoubleType()))
def flat_numbers(documents: pd.Series) -> pd.Series:
    """Numbers of a JSON object by dotted path; no booleans, no lists; empty for what isn't JSON."""

    def flat(text: str | None) -> dict[str, float]:
        try:
            return numbers_of(json.loads(text or ""))
        except ValueError:
            return {}

    return documents.map(flat)


def first_call(text: str | None, before: str | None, known: str) -> str | None:
    """The first JSON object in the text that is a call of a known tool, or else a bare call name(); none that repeats the one before."""
    decoder, names = json.JSONDecoder(), known.split(",")
    found, at = [], (text or "").find("{")
    while at >= 0:
        try:
            value, end = decoder.raw_decode(text, at)
        except ValueError:
            end = at + 1
        else:
            if isinstance(value, dict) and value.get("name") in names and isinstance(value.get("arguments"), dict):
                found.append({"name": value["name"], "arguments": value["arguments"]})
        at = text.find("{", end)
    found += [{"name": m, "arguments": {}} for m in re.findall(rf"\b({'|'.join(map(re.escape, names))})\(\s*\)", text or "")]
    written = [json.dumps(c, separators=(",", ":")) for c in found]
    return next((c for c in written if c != before), None)


@F.pandas_udf(StringType())
def repaired_call(texts: pd.Series, before: pd.Series, known: pd.Series) -> pd.Series:
    return pd.Series([first_call(*row) for row in zip(texts, before, known, strict=True)], dtype=object)
