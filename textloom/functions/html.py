"""HTML to text, titles, links; and to Markdown where that takes a parser's state."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.urls import resolved
from textloom.session import arrow_limits


def title(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))


def language(html: Column) -> Column:
    """The lang attribute of the html element, its first part in lower case; empty without one."""
    return F.lower(F.regexp_extract(html, r"(?is)<html[^>]*\slang=[\"']?([A-Za-z]+)", 1))


def licence_link(html: Column) -> Column:
    return F.regexp_extract(html, r"(?i)href=[\"']?([^\"'> ]*(?:creativecommons\.org|/licen[cs]e)[^\"'> ]*)", 1)


def plain_text(html: Column) -> Column:
    """Without scripts, styles, comments and tags; entities of markup decoded; white space collapsed."""
    out = html
    for pattern, to in ((r"(?is)<(?:script|style)\b.*?</(?:script|style)\s*>", " "), (r"(?s)<!--.*?-->", " "), (r"(?s)<[^>]*>", " "), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&"), (r"\s+", " ")):
        out = F.regexp_replace(out, pattern, to)
    return F.trim(out)


def links(html: Column) -> Column:
    """Targets of href in any quoting, in order; mailto, javascript, tel and bare fragments dropped."""
    found = F.transform(F.regexp_extract_all(html, F.lit(r"(?i)\bhref\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)"), F.lit(1)), lambda u: F.regexp_replace(u, "[\"']", ""))
    return F.filter(found, lambda u: (u != "") & ~u.rlike(r"(?i)^(?:mailto|javascript|tel):|^#"))


def links_of(html: Column, url: Column) -> Column:
    """Absolute URLs that a page leads to, in order: its links, then where it forwards to (meta refresh).

    They are relative to the page's base element, which itself is to the page's URL.
    """
    attribute = lambda text, name: F.regexp_replace(F.regexp_extract(text, rf"(?is)\b{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)", 1), "[\"']", "")
    own = attribute(F.regexp_extract(html, r"(?is)<base\b[^>]*>", 0), "href")
    base = F.when(own == "", url).otherwise(resolved(url, own))
    refresh = F.filter(F.regexp_extract_all(html, F.lit(r"(?is)<meta\b[^>]*>"), F.lit(0)), lambda m: attribute(m, "http-equiv").rlike("(?i)^refresh$"))
    to = F.filter(F.transform(refresh, lambda m: F.trim(F.regexp_replace(F.regexp_extract(m, r"(?is)\burl\s*=\s*[\"']?([^\s\"'>]+)", 1), "[\"']", ""))), lambda u: u != "")
    inside = F.regexp_replace(html, r"(?is)<base\b[^>]*>", "")
    return F.transform(F.concat(links(inside), to), lambda u: resolved(base, u))


#: One lexical unit of a page: a comment or declaration, a script or style with its content, or a tag.
_UNIT = re.compile(r"(?is)<!--.*?(?:-->|$)|<![^>]*>|<(script|style)\b[^>]*>.*?(?:</\1\s*>|$)|<(/?)([a-z][a-z0-9]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>")
_ROLE_MAIN = re.compile(r"(?i)\brole\s*=\s*[\"']?main\b")
#: Elements without content, elements left out with all they hold, and what starts a new block, with its mark.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
LEFT_OUT = frozenset(("head", "script", "style", "nav", "header", "footer", "svg", "button", "form"))
BLOCKS = {f"h{n}": "#" * n + " " for n in range(1, 7)} | {"li": "- "} | dict.fromkeys("p div section article main body table tr ul ol dl dt dd blockquote br hr td th pre aside figure".split(), "")


class _Blocks:
    """Text gathered into blocks; a block has the mark of the element that opened it."""

    def __init__(self):
        self.done: list[str] = []
        self.mark, self.text = "", []

    def close(self, mark: str = "") -> None:
        line = " ".join("".join(self.text).split())
        if line:
            self.done.append(self.mark + line)
        self.mark, self.text = mark, []

    def code(self, raw: str) -> None:
        self.close()
        if raw.strip():
            fence = "`" * max(3, 1 + max(map(len, re.findall("`+", raw)), default=0))
            self.done.append(f"{fence}\n{raw.strip(chr(10))}\n{fence}")


#: A character reference; one without its semicolon, as a cut text ends in, stays as it is written.
_REFERENCE = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


def unescaped(text: str) -> str:
    return _REFERENCE.sub(lambda m: html.unescape(m.group()), text)


def html_to_markdown(page: str | None) -> str:
    """Headings, lists and code of the main region if there is one, else of the page; nothing of what is LEFT_OUT.

    The units are walked with a stack of open elements.  An end tag closes all elements down to its own; one that
    closes nothing is ignored.  Whether text shows depends on what is open alone: no left-out element, and a main
    one where the page has any.
    """
    page = page or ""
    units = list(_UNIT.finditer(page))
    is_main = lambda name, rest: name == "main" or bool(_ROLE_MAIN.search(rest))
    only_main = any(u.group(3) and not u.group(2) and is_main(u.group(3).lower(), u.group(4)) for u in units)
    opened: list[tuple[str, bool]] = []  # name, whether it is the main region
    blocks, code, at = _Blocks(), [], 0

    def shows() -> bool:
        return not any(name in LEFT_OUT for name, _ in opened) and (not only_main or any(main for _, main in opened))

    def inside(name: str) -> bool:
        return any(own == name for own, _ in opened)

    for unit in [*units, None]:
        text = unescaped(page[at : unit.start() if unit else len(page)])
        if text and shows():
            (code if inside("pre") else blocks.text).append(text)
        if unit is None:
            break
        at, name = unit.end(), (unit.group(3) or "").lower()
        if not name:
            continue
        if unit.group(2):
            if not inside(name):
                continue
            if shows() and name == "code" and not inside("pre"):
                blocks.text.append("`")
            if shows() and name == "pre":
                blocks.code("".join(code))
                code.clear()
            elif shows() and name in BLOCKS:
                blocks.close()
            while opened.pop()[0] != name:
                pass
        else:
            if shows() and name in BLOCKS and not inside("pre"):
                # a paragraph directly in a list item keeps the item's mark
                blocks.close(blocks.mark if name == "p" and not "".join(blocks.text).strip() else BLOCKS[name])
            if name not in VOID and not unit.group(4).rstrip().endswith("/"):
                opened.append((name, is_main(name, unit.group(4))))
            if shows() and name == "code" and not inside("pre"):
                blocks.text.append("`")
    blocks.code("".join(code))
    out = ""
    for block in blocks.done:
        between = "\n" if block.startswith("- ") and out.rsplit("\n", 1)[-1].startswith("- ") else "\n\n"
        out += (between if out else "") + block
    return out


def markdown(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, markdown) of every page, in Arrow batches of bounded size."""
    arrow_limits(pages.sparkSession)

    def convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "markdown": pdf[html].map(html_to_markdown)})

    return pages.select(key, html).mapInPandas(convert, f"{key} {pages.schema[key].dataType.simpleString()}, markdown string")
