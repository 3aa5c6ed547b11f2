"""Plain Python versions of what the operators compute, straight from their contracts."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import xxhash

BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def token_ids(tokenizer, text: str | None) -> list[int]:
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def ids_crc(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def contamination(text: str | None, items: list[tuple]) -> tuple:
    """(n_words, n_hit, item ids) by looking at every place of its first word for every window."""
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words, hit, found = pattern.findall(lower(text)), set(), set()
    places = {}
    for at, word in enumerate(words):
        places.setdefault(word, []).append(at)
    for item, item_text in items:
        own = pattern.findall(lower(item_text))
        for i in range(max(0, len(own) - 12) or bool(own)):
            window = own[i : i + 13]
            for at in places.get(window[0], []):
                if words[at : at + len(window)] == window:
                    hit.update(range(at, at + len(window)))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


def simhash(text: str | None) -> int:
    words = BLANK.findall(lower(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints: list[int], radius: int) -> list[int]:
    """For each fingerprint the place of the first one of its group, over all pairs."""
    root = list(range(len(prints)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(prints))]


def luhn(digits: str) -> bool:
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(digits[::-1])]
    return sum(d // 10 + d % 10 for d in doubled) % 10 == 0


def personal(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns."""
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def text_counts(text: str | None) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    text = text or ""
    words = BLANK.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if BLANK.search(line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(covered)


def tree_log10(texts: list[str], scored: str, classes: np.ndarray, depth: int) -> float:
    """Context-tree weighting by direct recursion: every context is a node; the mixture is fixed after training."""
    from math import exp, lgamma, log, log10, pi

    def symbols(text: str) -> list[tuple[tuple[int, ...], int]]:
        raw = text.encode() + b"\0"
        kinds = [0] * depth + [int(classes[b]) for b in raw]
        return [(tuple(kinds[i : i + depth][::-1]), b) for i, b in enumerate(raw)]

    counts: Counter = Counter()
    kids: dict[tuple, set] = {}
    for text in texts:
        for context, byte in symbols(text):
            for d in range(depth + 1):
                kids.setdefault(context[:d], set())
                if d:
                    kids[context[: d - 1]].add(context[:d])
                for level in range(8):
                    counts[context[:d], level, byte >> (8 - level), byte >> (7 - level) & 1] += 1

    def own(c: tuple, level: int, path: int) -> float:
        a, b = counts[c, level, path, 0], counts[c, level, path, 1]
        return lgamma(a + 0.5) + lgamma(b + 0.5) - log(pi) - lgamma(a + b + 1)

    def below(c: tuple, level: int, path: int) -> float:
        return sum(weighted(k, level, path) for k in kids.get(c, ()))

    def weighted(c: tuple, level: int, path: int) -> float:
        if len(c) == depth:
            return own(c, level, path)
        x, y = own(c, level, path), below(c, level, path)
        return max(x, y) + log(1 + exp(-abs(x - y))) - log(2)

    def one(context: tuple, d: int, level: int, path: int) -> float:
        c = context[:d]
        a, b = counts[c, level, path, 0], counts[c, level, path, 1]
        p = (b + 0.5) / (a + b + 1)
        if d == depth:
            return p
        share = 1 / (1 + exp(below(c, level, path) - own(c, level, path)))
        child = one(context, d + 1, level, path) if context[: d + 1] in kids else 0.5
        return share * p + (1 - share) * child

    total = 0.0
    for context, byte in symbols(scored):
        for level in range(8):
            p = one(context, 0, level, byte >> (8 - level))
            total += log10(p if byte >> (7 - level) & 1 else 1 - p)
    return total
