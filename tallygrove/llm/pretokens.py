"""Byte-level BPE pre-tokens of many texts at once, in numpy: the split of public_tokenizers.PATTERN.

Defined cases: an empty text has no pre-token, and no texts give none; a text of one unbroken run is one pre-token, however long; equal
texts get equal rows. Texts are str, so nulls are the caller's to replace.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import regex

from tallygrove.llm.common import span_classes

LETTER, NUMBER, OTHER, SPACE, EDGE = range(5)


@cache
def classes() -> np.ndarray:
    """The class of every code point."""
    table = np.full(0x110000, OTHER, dtype=np.uint8)
    every = "".join(map(chr, [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]))
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\p{White_Space}")):
        found = "".join(regex.findall(pattern, every))
        table[np.frombuffer(found.encode("utf-32-le"), dtype=np.uint32)] = kind
    return table


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points one after the other, and where each text begins (one entry more than texts)."""
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32), offsets


def starts(cp: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin. Texts are told apart by offsets, so a white-space run at the end of a text stays whole."""
    n = len(cp)
    if not n:
        return np.zeros(0, dtype=np.int64)
    kind = classes()[cp]
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    before = np.full(n, EDGE, dtype=np.uint8)
    before[1:] = kind[:-1]
    before[first[:n]] = EDGE
    after = np.full(n, EDGE, dtype=np.uint8)
    after[:-1] = kind[1:]
    after[first[1:]] = EDGE
    space = kind == SPACE
    attached = np.zeros(n, dtype=bool)  # the blank before it belongs to the same pre-token
    attached[1:] = (cp[:-1] == 0x20) & ~space[1:] & ~first[1:n]
    out = np.where(space, (before != SPACE) | (after < SPACE), (before != kind) & ~attached)
    quotes = np.flatnonzero((cp == 0x27) & out)
    if len(quotes):
        end = offsets[np.searchsorted(offsets, quotes, side="right")]
        padded = np.concatenate([cp, np.zeros(2, dtype=cp.dtype)])
        a = np.where(quotes + 1 < end, padded[quotes + 1], 0)
        b = np.where(quotes + 2 < end, padded[quotes + 2], 0)
        one = np.isin(a, [ord(x) for x in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        length = np.where(one, 2, np.where(two, 3, 0))
        q, length, end = quotes[length > 0], length[length > 0], end[length > 0]
        out[q + 1] = False
        rest = q + length
        out[rest[rest < end]] = True
    return np.flatnonzero(out)


class Vocabulary:
    """Numbers for distinct pre-tokens, which are compared as strings, kept for later blocks. store.add(words) turns new words into whatever the caller keeps by
    number; beyond limit words both start anew."""

    def __init__(self, store, limit: int = 400_000):
        self.store, self.limit = store, limit
        self.clear()

    def clear(self) -> None:
        self.store.clear()
        self.numbers: dict[str, int] = {}

    def lookup(self, words: list[str]) -> np.ndarray:
        """Numbers of words, of which some may be equal."""
        if len(self.numbers) > self.limit:
            self.clear()
        new = [w for w in dict.fromkeys(words) if w not in self.numbers]
        if new:
            self.store.add(new)
            self.numbers.update(zip(new, range(len(self.numbers), len(self.numbers) + len(new)), strict=True))
        return np.fromiter(map(self.numbers.__getitem__, words), dtype=np.int64, count=len(words))


def word_rows(texts: list[str], vocabulary: Vocabulary, chunk: int = 1_000_000):
    """For slices of texts of about chunk characters: (first text, word rows in the vocabulary, words of each text).

    Equal words are found by comparing them. The vocabulary is asked once for all slices.
    """
    parts, start, size = [], 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > chunk:
            parts.append((start, i))
            start, size = i, 0
        size += len(t)
    parts.append((start, len(texts)))
    codes, words, sizes = [], [], []
    for a, b in parts:
        cp, offsets = code_points(texts[a:b])
        begin = starts(cp, offsets)
        end = np.append(begin[1:], len(cp))[: len(begin)]
        own, first = span_classes(cp, begin, end)
        joined = "".join(texts[a:b])
        words += [joined[s:e] for s, e in zip(begin[first].tolist(), end[first].tolist(), strict=True)]
        codes.append((own.astype(np.int32), len(first)))
        sizes.append(np.diff(np.searchsorted(begin, offsets)))
    rows = vocabulary.lookup(words)
    del words
    at = 0
    for (a, _), (own, n), size in zip(parts, codes, sizes, strict=True):
        yield a, rows[at : at + n][own], size
        at += n


def gathered(numbers: np.ndarray, flat: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces flat[bounds[k]:bounds[k + 1]] for every k of numbers, end to end, and the length of each."""
    length = (bounds[1:] - bounds[:-1])[numbers]
    total = int(length.sum())
    shift = np.repeat(bounds[numbers] - (np.cumsum(length) - length), length)
    return flat[shift + np.arange(total)], length
