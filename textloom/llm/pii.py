"""Personal data: exact patterns, and a character-level bidirectional LSTM with a CRF on top.

The network is trained here, in numpy, on labelled spans: windows drawn from
the whole corpus, whose spans the patterns label, and the same windows with
their spans rewritten in ways that the patterns miss (spelled-out signs, other
separators, other prefixes).  Every stretch of a text near a digit or a sign
that one of the kinds can't do without is cut into overlapping windows, which
are decoded in batches by Viterbi; of each window the spans in its middle part
count, and what overlapping windows say is reconciled over the whole text.
The patterns' spans always stay; the network's are added where they touch
none of them and hold what their kind consists of.  A span of more characters
than a window can't come from the network.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, discard, materialize, with_text

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, kind, end

# Fixed patterns of the four kinds
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")  # as [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+), in linear time
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What no span can do without: a digit, or a sign of an address, be it spelled out.
_TRIGGER = re.compile(r"[@0-9]|[(\[{]at[)\]}]|[(\[{ ]dot[)\]} ]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, leftmost and not overlapping, without rescanning long runs."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text[start - 1]):
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns, in order of start, then of kind; code points, end exclusive."""
    if not _TRIGGER.search(text):
        return []
    out = [(a, 0, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


# -- the network ------------------------------------------------------------

WINDOW, STRIDE, REACH = 96, 48, 24
TAGS = 1 + 2 * len(KINDS)  # outside; begin and inside of each kind
#: Characters as 99 symbols: none, printable ASCII, blanks and controls, other letters, the rest.
SYMBOLS = 99


def symbols(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    out = np.where((points >= 33) & (points < 127), points - 31, np.where(points < 128, 1, 98))
    if len(text) and points.max() > 127:
        for i in np.flatnonzero(points > 127):
            out[i] = 97 if text[i].isalpha() else 98
    return out.astype(np.int64)


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches within REACH of a trigger, merged."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def window_starts(a: int, b: int) -> list[int]:
    return [a, *range(a + STRIDE, max(a + 1, b - WINDOW + STRIDE), STRIDE)]


def tags_of(spans: list[Span], start: int) -> np.ndarray:
    out = np.zeros(WINDOW, np.int64)
    for a, kind, b in spans:
        if a < start + WINDOW and b > start and not out[max(0, a - start) : b - start].any():
            out[max(0, a - start) : b - start] = 2 + 2 * kind
            if a >= start:
                out[a - start] = 1 + 2 * kind
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def lstm(x: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, back: bool) -> tuple[np.ndarray, list]:
    """Hidden states (steps, batch, size) over inputs (steps, batch, width), from the end if back; what training needs."""
    steps, batch, _ = x.shape
    size = u.shape[0]
    from_x = x @ w + b
    h, c = np.zeros((batch, size), x.dtype), np.zeros((batch, size), x.dtype)
    out, trace = np.empty((steps, batch, size), x.dtype), []
    for t in range(steps - 1, -1, -1) if back else range(steps):
        z = from_x[t] + h @ u
        gates = sigmoid(z[:, : 3 * size])
        new = np.tanh(z[:, 3 * size :])
        i, f, o = gates[:, :size], gates[:, size : 2 * size], gates[:, 2 * size :]
        before_h, before_c = h, c
        c = f * c + i * new
        bent = np.tanh(c)
        h = o * bent
        out[t] = h
        trace.append((t, i, f, o, new, before_h, before_c, bent))
    return out, trace


def lstm_gradient(x: np.ndarray, d_out: np.ndarray, trace: list, w: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, ...]:
    d_z_all = np.empty((*x.shape[:2], 4 * u.shape[0]), x.dtype)
    d_u = np.zeros_like(u)
    d_h, d_c = np.zeros_like(d_out[0]), np.zeros_like(d_out[0])
    for t, i, f, o, new, before_h, before_c, bent in reversed(trace):
        d_h = d_h + d_out[t]
        d_c = d_c + d_h * o * (1 - bent * bent)
        d_z = np.hstack([d_c * new * i * (1 - i), d_c * before_c * f * (1 - f), d_h * bent * o * (1 - o), d_c * i * (1 - new * new)])
        d_z_all[t] = d_z
        d_u += before_h.T @ d_z
        d_h, d_c = d_z @ u.T, d_c * f
    flat = d_z_all.reshape(-1, d_z_all.shape[2])
    return d_z_all @ w.T, x.reshape(-1, x.shape[2]).T @ flat, d_u, flat.sum(0)


def allowed_moves() -> np.ndarray:
    """-1e4 for moves into the inside of a kind from outside of it."""
    a = np.zeros((TAGS, TAGS))
    for k in range(len(KINDS)):
        a[:, 2 + 2 * k] = -1e4
        a[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = 0
    return a


MOVES = allowed_moves()


@dataclass
class Tagger:
    p: dict[str, np.ndarray]

    @staticmethod
    def fresh(seed: int = 7, width: int = 12, size: int = 20) -> Tagger:
        r = np.random.default_rng(seed)
        p = {"embed": r.normal(0, 0.3, (SYMBOLS, width)), "out": r.normal(0, 0.2, (2 * size, TAGS)), "out_b": np.zeros(TAGS), "moves": np.zeros((TAGS, TAGS))}
        for d in "fb":
            p |= {f"w{d}": r.normal(0, 0.25, (width, 4 * size)), f"u{d}": r.normal(0, 0.2, (size, 4 * size)), f"b{d}": np.concatenate([np.zeros(size), np.ones(size), np.zeros(2 * size)])}
        return Tagger({k: v.astype(np.float32) for k, v in p.items()})

    def unary(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Scores (steps, batch, tags) of symbols (steps, batch)."""
        p = self.p
        e = p["embed"][x]
        hf, tf = lstm(e, p["wf"], p["uf"], p["bf"], False)
        hb, tb = lstm(e, p["wb"], p["ub"], p["bb"], True)
        h = np.concatenate([hf, hb], 2)
        return h @ p["out"] + p["out_b"], (e, h, tf, tb)

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tags y (steps, batch) and its gradient."""
        p = self.p
        scores, (e, h, tf, tb) = self.unary(x)
        steps, batch, _ = scores.shape
        top = scores.max(2, keepdims=True)
        unary, move = np.exp(scores - top), np.exp(p["moves"] + MOVES)
        forward = np.empty_like(scores)
        log_z = top.sum(0)[:, 0].astype(float)
        for t in range(steps):
            a = (forward[t - 1] @ move if t else np.ones((batch, TAGS))) * unary[t]
            z = a.sum(1, keepdims=True)
            log_z += np.log(z[:, 0])
            forward[t] = a / z
        d_scores, d_moves = np.empty_like(scores), np.zeros((TAGS, TAGS))
        back = np.ones((batch, TAGS))
        for t in range(steps - 1, -1, -1):
            m = forward[t] * back
            d_scores[t] = m / m.sum(1, keepdims=True)
            if t:
                b = unary[t] * back
                z = ((forward[t - 1] @ move) * b).sum(1, keepdims=True)
                d_moves += (forward[t - 1].T @ (b / z)) * move
                back = b @ move.T
                back /= back.sum(1, keepdims=True)
        gold = np.take_along_axis(scores, y[:, :, None], 2)[:, :, 0].sum(0) + (p["moves"] + MOVES)[y[:-1], y[1:]].sum(0)
        loss = float((log_z - gold).mean())
        np.put_along_axis(d_scores, y[:, :, None], np.take_along_axis(d_scores, y[:, :, None], 2) - 1, 2)
        np.add.at(d_moves, (y[:-1].ravel(), y[1:].ravel()), -1)
        d_scores = (d_scores / batch).astype(np.float32)
        size = p["uf"].shape[0]
        d_h = d_scores @ p["out"].T
        d_ef, d_wf, d_uf, d_bf = lstm_gradient(e, d_h[:, :, :size], tf, p["wf"], p["uf"])
        d_eb, d_wb, d_ub, d_bb = lstm_gradient(e, d_h[:, :, size:], tb, p["wb"], p["ub"])
        d_embed = np.zeros_like(p["embed"])
        np.add.at(d_embed, x.ravel(), (d_ef + d_eb).reshape(-1, e.shape[2]))
        flat = d_scores.reshape(-1, TAGS)
        return loss, {"embed": d_embed, "out": h.reshape(-1, 2 * size).T @ flat, "out_b": flat.sum(0), "moves": (d_moves / batch).astype(np.float32), "wf": d_wf, "uf": d_uf, "bf": d_bf, "wb": d_wb, "ub": d_ub, "bb": d_bb}

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Best tags (batch, steps) of symbols (batch, steps), by Viterbi."""
        scores, _ = self.unary(np.ascontiguousarray(x.T))
        moves = self.p["moves"] + MOVES
        best, came = scores[0] + moves[0], []  # as after an outside tag
        for t in range(1, len(scores)):
            through = best[:, :, None] + moves
            came.append(through.argmax(1))
            best = through.max(1) + scores[t]
        at = best.argmax(1)
        tags = [at]
        for c in reversed(came):
            at = c[np.arange(len(at)), at]
            tags.append(at)
        return np.stack(tags[::-1], 1)


Window = tuple[str, list[Span]]  # text, spans in it


def rewritten(kind: int, span: str, r: random.Random) -> str:
    """The span in a form that people write and the patterns miss."""
    if kind == 0:
        local, domain = span.split("@", 1)
        at, dot = r.choice([(" at ", " dot "), ("(at)", "."), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" @ ", ".")])
        return local + at + domain.replace(".", dot)
    if kind == 1:
        return r.choice(["[.]", "(.)", " . ", " dot "]).join(span.split("."))
    digits = _NOT_DIGIT.sub("", span)
    if kind == 2:
        return r.choice([".", "/", "  ", " - ", "_"]).join(digits[i : i + 4] for i in range(0, len(digits), 4))
    cuts = sorted(r.sample(range(2, len(digits) - 2), 2))
    return r.choice(["+", "00"]) + r.choice(["/", " / ", "\u2013", "_"]).join([digits[: cuts[0]], digits[cuts[0] : cuts[1]], digits[cuts[1] :]])


def invented(kind: int, r: random.Random) -> str:
    """A span of the kind that the patterns know."""
    if kind == 0:
        first, last, host = ("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 8))) for _ in range(3))
        return f"{first}{r.choice(['', '.', '_', '-'])}{r.choice(['', last, str(r.randint(0, 99))])}@{host}{r.choice(['', str(r.randint(0, 9))])}.{r.choice(['com', 'org', 'net', 'de', 'example.com'])}"
    if kind == 1:
        return ".".join(str(r.randint(0, 255)) for _ in range(4))
    if kind == 2:
        digits = "".join(r.choice("0123456789") for _ in range(15))
        digits = next(d for d in (digits + str(i) for i in range(10)) if luhn(d))
        return r.choice(["", " ", "-"]).join(digits[i : i + 4] for i in range(0, 16, 4))
    return f"+{r.randint(1, 99)} {r.randint(100, 999)} {r.randint(100, 999)} {r.randint(1000, 9999)}"


def replaced(window: Window, which: int, new: str) -> Window:
    """The window with other text for one of its spans, the spans after it moved along."""
    text, spans = window
    a, kind, b = spans[which]
    by = len(new) - (b - a)
    moved = [(x, k, y) if y <= a else (x + by, k, y + by) for i, (x, k, y) in enumerate(spans) if i != which and (y <= a or x >= b)]
    return text[:a] + new + text[b:], sorted([*moved, (a, kind, a + len(new))])


def labelled_windows(found: dict[int, list[Window]], per_kind: int, seed: int = 5) -> list[Window]:
    """Training windows: those found (by kind; without spans under -1), filled up with invented spans; each is rewritten too, addresses more often."""
    r, plain = random.Random(seed), found.get(-1, [])
    out = list(plain)
    for kind in range(len(KINDS)):
        own = list(found.get(kind, []))[:per_kind]
        for i in range(len(own), per_kind):
            text = plain[i % len(plain)][0] if plain else ""
            at = text.find(" ", r.randint(0, max(1, len(text) // 2))) + 1
            own.append(replaced((f"{text[:at]}? {text[at:]}", [(at, kind, at + 1)]), 0, invented(kind, r)))
        for window in own:
            out.append(window)
            # a window may cut others of the kind at its ends; the one it was chosen for is whole
            which = next(i for i, (a, k, b) in enumerate(window[1]) if k == kind and a >= 0 and b <= len(window[0]))
            a, _, b = window[1][which]
            out += [replaced(window, which, rewritten(kind, window[0][a:b], r)) for _ in range(4 if kind == 0 else 2)]
    return out


def train_tagger(windows: list[Window], epochs: int = 12, batch: int = 64, rate: float = 0.01) -> Tagger | None:
    """A tagger from labelled windows; None if there is none."""
    if not windows:
        return None
    xs = [padded(symbols(text), 0) for text, _ in windows]
    ys = [tags_of(spans, 0) for _, spans in windows]
    x, y = np.stack(xs), np.stack(ys)
    tagger = Tagger.fresh()
    m = {k: np.zeros_like(v) for k, v in tagger.p.items()}
    v = {k: np.zeros_like(w) for k, w in tagger.p.items()}
    shuffle, step = np.random.default_rng(11), 0
    for epoch in range(epochs):
        order = shuffle.permutation(len(x))
        for i in range(0, len(x), batch):
            some = order[i : i + batch]
            _, g = tagger.gradient(np.ascontiguousarray(x[some].T), np.ascontiguousarray(y[some].T))
            norm = np.sqrt(sum(float((d * d).sum()) for d in g.values()))
            step += 1
            for k, d in g.items():
                d = d * min(1.0, 5 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.99 * v[k] + 0.01 * d * d
                tagger.p[k] = (tagger.p[k] - rate * (1 - 0.8 * epoch / epochs) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return tagger


def padded(symbol: np.ndarray, start: int) -> np.ndarray:
    part = symbol[start : start + WINDOW]
    return np.pad(part, (0, WINDOW - len(part)))


_ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+( ?@ ?| ?[(\[{]at[)\]}] ?| at )[A-Za-z0-9-]+(( ?\. ?| ?[(\[{]dot[)\]}] ?| dot )[A-Za-z0-9-]+)+")
_PARTS = re.compile(r"([0-9]{1,3})([^0-9A-Za-z]{1,3}| dot )([0-9]{1,3})\2([0-9]{1,3})\2([0-9]{1,3})")
_GROUPS = re.compile(r"[0-9]+([^0-9A-Za-z]{1,3}[0-9]+)*")


def plausible(kind: int, span: str) -> bool:
    """Whether the span holds what its kind consists of, however that is written.

    An address has a name, an at and a domain with a dot; an IP four numbers up to 255, parted alike; a card 14 to 19
    digits passing Luhn; a phone number + or 00 and 10 to 15 digits more, in groups.
    """
    digits = _NOT_DIGIT.sub("", span)
    if kind == 0:
        return bool(_ADDRESS.fullmatch(span))
    if kind == 1:
        m = _PARTS.fullmatch(span)
        return bool(m) and all(int(m.group(i)) <= 255 for i in (1, 3, 4, 5))
    if kind == 2:
        return bool(_GROUPS.fullmatch(span)) and 14 <= len(digits) <= 19 and luhn(digits)
    head = next((h for h in ("+", "00") if span.startswith(h)), None)
    return head is not None and bool(_GROUPS.fullmatch(span[len(head) :])) and len(digits) < len(span) - len(head.strip("0")) and 10 <= len(digits) - len(head.strip("+")) <= 15


def network_spans(texts: list[str], tagger: Tagger | None, batch: int = 256) -> list[list[Span]]:
    """For each text, the spans that its windows give, reconciled: those in a window's own middle part, the earlier and longer of overlapping ones."""
    out: list[list[Span]] = [[] for _ in texts]
    if tagger is None:
        return out
    held: list[tuple[int, int, int, int, np.ndarray]] = []

    def flush() -> None:
        tags = tagger.decode(np.stack([w[4] for w in held]))
        for (which, start, low, high, _), row in zip(held, tags, strict=True):
            begins = np.flatnonzero(row % 2 == 1)
            for a in begins.tolist():
                b = a + 1
                while b < WINDOW and row[b] == row[a] + 1:
                    b += 1
                if low <= start + (a + b) // 2 < high and start + b <= len(texts[which]):
                    out[which].append((start + a, int(row[a]) // 2, start + b))
        held.clear()

    for which, text in enumerate(texts):
        symbol = None
        for a, b in regions(text):
            symbol = symbols(text) if symbol is None else symbol
            starts = window_starts(a, b)
            for i, start in enumerate(starts):
                low = start + STRIDE // 2 if i else a
                high = start + WINDOW - STRIDE // 2 if i + 1 < len(starts) else b
                held.append((which, start, low, high, padded(symbol, start)))
                if len(held) == batch:
                    flush()
    if held:
        flush()
    for which, spans in enumerate(out):
        kept: list[Span] = []
        for a, k, b in sorted(spans, key=lambda s: (s[0], -s[2])):
            if not kept or a >= kept[-1][2]:
                kept.append((a, k, b))
        out[which] = kept
    return out


def all_spans(texts: list[str], tagger: Tagger | None) -> list[tuple[list[Span], list[Span]]]:
    """For each text: the patterns' spans, and these with the network's that touch none of them."""
    out = []
    for text, more in zip(texts, network_spans(texts, tagger), strict=True):
        base = base_spans(text)
        added = [(a, k, b) for a, k, b in more if plausible(k, text[a:b]) and not any(a < e and s < b for s, _, e in base)]
        out.append((base, sorted([*base, *added])))
    return out


def redacted(text: str, spans: list[Span]) -> str:
    """The text with [EMAIL], [IP], [CARD] or [PHONE] for each span; overlapping ones are one, named by the first."""
    parts, at = [], 0
    for a, k, b in spans:
        if a >= at:
            parts += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*parts, text[at:]])


def candidate_windows(text: str) -> Iterator[tuple[int, int, str, list[int]]]:
    """(kind, hash, window, its spans in a row): of a text at most one window for each kind of span, and one without spans.

    The window lies around a span, or in a region, at a place that depends on a hash; so does which of them is taken.
    """
    base = base_spans(text)
    best: dict[int, tuple[int, int]] = {}
    for a, kind, b in base:
        h = zlib.crc32(text[max(0, a - 40) : b + 40].encode("utf-8", "replace"))
        if b - a < WINDOW and (kind not in best or h < best[kind][0]):
            best[kind] = (h, max(0, a - h % (WINDOW - (b - a))))
    for a, b in regions(text):
        h = zlib.crc32(text[a:b].encode("utf-8", "replace"))
        start = max(0, a - h % STRIDE)
        if (-1 not in best or h < best[-1][0]) and not any(x < start + WINDOW and y > start for x, _, y in base):
            best[-1] = (h, start)
    for kind, (h, start) in best.items():
        inside = [(x - start, k, y - start) for x, k, y in base if x < start + WINDOW and y > start]
        yield kind, h, text[start : start + WINDOW], [v for x, k, y in inside for v in (x, k, y)]


def learn_tagger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_kind: int = 100, without: int = 300) -> Tagger | None:
    """A tagger from labelled windows: per_kind with a span of each kind and `without` without any, of all whole texts.

    Of all documents' windows those of smallest hash are taken, at most one of a kind from a document, so neither long
    documents nor a frequent source fill the sample; its size is these two parameters.  Where the corpus has fewer
    spans of a kind, invented ones stand in.  Each span is also learned in two other forms that the patterns miss.
    None where no text has a digit or one of the signs.
    """
    rows = with_text(docs, id_col, text_col).select("text")
    arrow_limits(docs.sparkSession)

    def smallest(held: dict[int, dict[int, tuple[str, list[int]]]], n: int) -> None:
        for kind, own in held.items():
            if len(own) > n:
                held[kind] = {h: own[h] for h in sorted(own)[: most[kind]]}

    most = {-1: without} | dict.fromkeys(range(len(KINDS)), per_kind)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict[int, tuple[str, list[int]]]] = {kind: {} for kind in most}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if _TRIGGER.search(text):
                    for kind, h, window, spans in candidate_windows(text):
                        held[kind][h] = min(held[kind].get(h, (window, spans)), (window, spans))
            smallest(held, 4 * max(per_kind, without))
        smallest(held, 0)
        rows = [(kind, h, *window) for kind, own in held.items() for h, window in own.items()]
        columns = list(zip(*rows, strict=True)) or [()] * 4
        kinds = [pa.int32(), pa.int64(), pa.string(), pa.list_(pa.int32())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["kind", "h", "text", "spans"])

    drawn, path = materialize(rows.mapInArrow(gather, "kind int, h long, text string, spans array<int>").groupBy("kind", "h").agg(F.min(F.struct("text", "spans")).alias("w")).select("kind", "h", "w.*"), "windows")
    found = {}
    for kind, n in most.items():
        taken = drawn.where(F.col("kind") == kind).orderBy("h").limit(n).collect()
        found[kind] = [(r.text, list(zip(r.spans[::3], r.spans[1::3], r.spans[2::3], strict=True))) for r in sorted(taken, key=lambda r: r.h)]
    discard(docs.sparkSession, path)
    return train_tagger(labelled_windows(found, per_kind)) if any(found.values()) else None


def find_personal_data(docs: DataFrame, tagger: Tagger | None, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """(doc_id, ..., n_email, n_ip, n_card, n_phone, base_sha256, spans, redacted); one row a document, no shuffle.

    The counts and the digest are of the patterns' spans, `spans` has the network's too, and `redacted` is the text
    with all of them replaced.  Null and empty texts have no spans.  Equal rows are kept.
    """
    arrow_limits(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(tagger)  # about 40 KB
    rows = with_text(docs, id_col, text_col, *more)
    rows = rows.select("text", *[c for c in rows.columns if c != "text"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "redacted"]
        for batch in batches:
            texts = batch.column(0).to_pylist()
            found = all_spans(texts, sent.value)
            counts = [pa.array([sum(s[1] == k for s in base) for base, _ in found], pa.int64()) for k in range(len(KINDS))]
            digests = pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found], pa.string())
            listed = pa.array([joined(spans) for _, spans in found], pa.string())
            texts = pa.array([redacted(t, spans) for t, (_, spans) in zip(texts, found, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *counts, digests, listed, texts], names=[*batch.schema.names[1:], *names])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[1:])
    return rows.mapInArrow(find, f"{kept}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, redacted string")
