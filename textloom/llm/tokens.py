"""Encoding with a public tokenizer inside Spark tasks, each piece of text once per worker."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# White space as the tokenizers library's patterns know it (Unicode White_Space); Python's \s has four more.
_FAR_SPACE = "\x85\xa0  -     　"
_SPACE = f"\t-\r {_FAR_SPACE}"

#: Ways to cut a text at places where the tokenizer cuts it as well, whatever stands on either side.
SPLITS = {
    # byte-level BPE: a run of non-spaces with the one blank before it, or a run of spaces
    "byte_level": re.compile(rf" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"),
    # BPE that drops white space and marks word ends
    "words": re.compile(r"[^\x20\x09-\x0D]+"),
}
#: Stops and signs that the tokenizers' patterns cut off the word before them; an apostrophe may belong to it.
_SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_NOT_ASCII_SPACE = re.compile(f"[{_FAR_SPACE}]")
#: Bytes of text cut and joined at a time.
CHUNK = 4_000_000


def strings_of(values: pa.BinaryArray) -> list[bytes]:
    """values.to_pylist(), for an array without nulls, in a fifth of the time."""
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, np.int32, len(values) + 1, 4 * values.offset).tolist()
    raw = data.to_pybytes() if data is not None else b""
    return [raw[a:b] for a, b in zip(at, at[1:], strict=False)]


class CachedEncoder:
    """Token ids as little-endian uint32 bytes, remembering those of short pieces.

    Joined ids of a text's pieces equal encode(text, add_special_tokens=False), as the tokenizer never merges over the
    places where `split` cuts.  As there, the name of an added token in a text is that token: names are cut out first.
    Many texts are cut in one go, on their bytes, and each of their different pieces is looked up once.  At most about
    `limit` pieces of up to 48 bytes are remembered; then the memory starts afresh.
    """

    def __init__(self, path: str, split: str, limit: int = 900_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values()):
            raise ValueError(f"{path}: an added token that takes in what stands around it")
        self.added = {t.content.encode(): np.array([i], "<u4").tobytes() for i, t in added.items()}
        # the leftmost and of these the longest
        self.names = re.compile("(" + "|".join(sorted((re.escape(t.content) for t in added.values()), key=len, reverse=True)) + ")") if added else None
        self.find = SPLITS[split].findall
        self.starts = split == "byte_level"  # a token with the blank starts a word; else one with the end mark ends it
        vocabulary = self.tokenizer.get_vocab()
        self.edge = np.zeros(max(vocabulary.values()) + 1, bool)
        self.edge[[i for t, i in vocabulary.items() if (t.startswith("Ġ") if self.starts else t.endswith("</w>"))]] = True
        self.known: dict[bytes, bytes] = dict(self.added)
        self.limit = limit

    def unusual(self, text: str) -> bool:
        """Whether the text is not to be cut by its bytes: it has an added token's name, or white space beyond ASCII."""
        return bool(self.names and self.names.search(text)) or self.starts and not text.isascii() and bool(_NOT_ASCII_SPACE.search(text))

    def pieces(self, text: str) -> list[bytes]:
        parts = self.names.split(text) if self.names else [text]
        return [p.encode() for i, part in enumerate(parts) for p in ([part] if i % 2 else self.find(part))]

    def __call__(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        held, size = [], 0
        for i, text in enumerate(texts):
            if self.unusual(text):
                pieces = self.pieces(text)
                values = dict(zip(pieces, self.ids_of(pieces), strict=True))
                out[i] = b"".join(map(values.__getitem__, pieces))
                continue
            held.append((i, text.encode()))
            size += len(held[-1][1])
            if size > CHUNK:
                self._join(held, out)
                held, size = [], 0
        if held:
            self._join(held, out)
        return out

    def cut(self, raws: list[bytes]) -> tuple[pa.BinaryArray, np.ndarray]:
        """All pieces of the texts, in a row, and the number of each text's."""
        sizes = np.fromiter(map(len, raws), np.int64, len(raws))
        ends = np.cumsum(sizes + 1)  # a byte between texts
        buffer = np.frombuffer(b"\0".join([*raws, b""]), np.uint8)
        solid = buffer > 32
        solid |= (buffer < 9) | (buffer > 13) & (buffer < 32)
        solid[ends - 1] = False
        starts = solid.copy()
        starts[1:] &= ~solid[:-1]  # first byte of a word
        if not self.starts:
            last = solid.copy()
            last[:-1] &= ~solid[1:]
            first = np.flatnonzero(starts)
            lengths = np.flatnonzero(last) + 1 - first
            data, where = buffer[solid], first
        else:
            space = ~solid
            space[ends - 1] = False
            before = np.zeros(len(buffer), bool)
            before[1:] = space[:-1]
            first = space & ~before  # of a run of spaces
            final = space.copy()  # the last space before a word
            final[:-1] &= solid[1:]
            blank = final & (buffer == 32)  # goes with the word
            starts[1:] &= ~blank[:-1]
            starts |= first | final
            starts[ends - 1] = True
            where = np.flatnonzero(starts)
            lengths = np.diff(np.append(where, len(buffer)))
            own = np.ones(len(where), bool)
            own[np.searchsorted(where, ends - 1)] = False
            where, lengths = where[own], lengths[own]
            inside = np.ones(len(buffer), bool)
            inside[ends - 1] = False
            data = buffer[inside]
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        return pieces, np.diff(np.searchsorted(where, ends), prepend=0)

    def _join(self, held: list[tuple[int, bytes]], out: list[bytes]) -> None:
        pieces, counts = self.cut([raw for _, raw in held])
        coded = pieces.dictionary_encode()
        codes = coded.indices.to_numpy()
        values = self.ids_of(strings_of(coded.dictionary))
        sizes = np.fromiter(map(len, values), np.int64, len(values)) >> 2
        ids = np.frombuffer(b"".join(values), "<u4")
        at, n = (np.cumsum(sizes) - sizes)[codes], sizes[codes]
        ends = np.cumsum(n)
        raw = ids[np.repeat(at - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        last = np.concatenate([[0], ends])[np.cumsum(counts)]
        for (i, _), a, b in zip(held, (4 * np.concatenate([[0], last[:-1]])).tolist(), (4 * last).tolist(), strict=True):
            out[i] = raw[a:b]

    def ids_of(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece; those not known yet are encoded together."""
        known = self.known
        if len(known) > self.limit:
            known.clear()
            known.update(self.added)
        found = list(map(known.get, pieces))
        new = [p for p, ids in zip(pieces, found, strict=True) if ids is None]
        if not new:
            return found
        long = {p.decode() for p in new if len(p) > 48}
        self._learn({p.decode() for p in new if len(p) <= 48})
        at_hand = {p.encode(): ids for p, ids in self._each(list(long))}
        return [known.get(p) or at_hand.get(p, b"") if ids is None else ids for p, ids in zip(pieces, found, strict=True)]

    def _learn(self, short: set[str]) -> None:
        """Adds the short pieces to the memory; words of letters are encoded many at a time, those with stops from both parts."""
        known, composed, asked = self.known, [], set()
        for p in short:
            word = p.rstrip(_SIGNS)
            if len(word) < len(p) and word.removeprefix(" ").lower().isalpha():
                composed.append((p, word, p[len(word) :]))
                asked.update(composed[-1][1:])
            else:
                asked.add(p)
        got: dict[str, bytes] = {}
        words, rest = [], []
        for p in asked:
            ids = known.get(p.encode())
            if ids is not None:
                got[p] = ids
            else:
                (words if (p[0] == " " and p[1:].isalpha() if self.starts else p.isalpha()) else rest).append(p)
        for i in range(0, len(words), 1000):
            some = words[i : i + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast([("" if self.starts else " ").join(some)], add_special_tokens=False)[0].ids, "<u4")
            edges = np.flatnonzero(self.edge[ids])
            if len(edges) == len(some):  # each word has one edge at least, so each has one
                bounds = ([*edges.tolist(), len(ids)] if self.starts else [0, *(edges + 1).tolist()])
                raw = ids.tobytes()
                got.update((p, raw[4 * a : 4 * b]) for p, a, b in zip(some, bounds, bounds[1:], strict=False))
            else:
                rest += some
        got.update(self._each(rest))
        got.update([(p, got[a] + got[b]) for p, a, b in composed])
        known.update((p.encode(), ids) for p, ids in got.items())

    def _each(self, pieces: list[str]) -> Iterator[tuple[str, bytes]]:
        for i in range(0, len(pieces), 20_000):
            some = pieces[i : i + 20_000]
            for piece, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                yield piece, np.array(e.ids, "<u4").tobytes()


_encoders: dict[tuple[str, str], CachedEncoder] = {}


def encoder(path: str, split: str) -> CachedEncoder:
    """One for each tokenizer in a Python worker, kept from task to task."""
    if (path, split) not in _encoders:
        _encoders[path, split] = CachedEncoder(path, split)
    return _encoders[path, split]
