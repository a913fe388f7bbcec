"""Pre-tokens of a chunk of texts, found on arrays of code points, and a store of what each one gives.

Two splitting patterns are known, those of the two vocabulary files used here:

    byte level  's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
    word        's|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+   (over lower case)
"""

from __future__ import annotations

import functools

import numpy as np
import regex

from .textkit import U, run_hashes

SPACE, LETTER, DIGIT, OTHER = 0, 1, 2, 3
STORED = 1_000_000
#: Values of all stored pieces, of 4 bytes each.
VALUES = 16 << 20


@functools.cache
def classes() -> np.ndarray:
    """The class of every code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for found in regex.finditer(pattern, every):
            a, b = found.span()
            table[np.frombuffer(every[a:b].encode("utf-32-le"), np.uint32)] = kind
    return table


@functools.cache
def lowered() -> np.ndarray:
    """Every code point in lower case; 0 where that is more than one."""
    out = np.arange(0x110000, dtype=np.uint32)
    for i in range(0x110000):
        if not 0xD800 <= i < 0xE000:
            x = chr(i).lower()
            if len(x) > 1:
                out[i] = 0
            elif ord(x) != i:
                out[i] = ord(x)
    return out


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' code points and each text's first (one more at the end)."""
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    first = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=first[1:])
    return cp, first


def _runs(cp: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of each, whether a run of one class starts there, whether a text does."""
    n = len(cp)
    kind = classes()[cp]
    begin = np.zeros(n + 1, bool)
    begin[first] = True
    begin = begin[:n]
    start = begin.copy()
    start[1:] |= kind[1:] != kind[:-1]
    return kind, start, begin


def _contractions(cp: np.ndarray, kind: np.ndarray, start: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Makes each apostrophe that starts a piece one with s, t, m, d, re, ve or ll; returns where those are, and their sizes."""
    n = len(cp)
    at = np.flatnonzero((cp == 0x27) & start)
    same = lambda i, k: (i + k < n) & ~np.any([begin[np.minimum(i + j, n - 1)] for j in range(1, k + 1)], axis=0)
    get = lambda i, k: np.where(same(i, k), cp[np.minimum(i + k, n - 1)], 0)
    if not len(at):
        return at, at
    a, b = get(at, 1), get(at, 2)
    one = np.isin(a, [ord(c) for c in "stmd"])
    two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
    at, size = at[one | two], np.where(one, 2, 3)[one | two]
    start[at + 1] = False
    after = at + size
    inside = after < n
    after = after[inside]
    start[after] |= (kind[after] == LETTER) & ~begin[after]
    return at, size


def byte_level(cp: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Piece starts; then, for prefixes: starts of three-character contractions, and spans of blank runs whose last character left them."""
    n = len(cp)
    kind, start, begin = _runs(cp, first)
    blank = kind == SPACE
    last = np.zeros(n, bool)
    last[:-1] = blank[:-1] & ~blank[1:] & ~begin[1:]
    run = np.maximum.accumulate(np.where(start, np.arange(n), 0)) if n else np.zeros(0, np.int64)
    lasts = np.flatnonzero(last)
    run_start = run[lasts]
    start[lasts] = True
    start[lasts[cp[lasts] == 0x20] + 1] = False
    at, size = _contractions(cp, kind, start, begin)
    many = run_start < lasts
    return np.flatnonzero(start), at[size == 3], run_start[many], lasts[many] + 1, kind


def word_level(cp: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces; blanks are in none."""
    kind, start, begin = _runs(cp, first)
    start |= kind == DIGIT
    _contractions(cp, kind, start, begin)
    edge = np.append(np.flatnonzero(start), len(cp))
    starts, ends = edge[:-1], edge[1:]
    words = kind[starts] != SPACE
    return starts[words], ends[words]


class Store:
    """What each distinct piece gives, an array of small integers, by the piece's hash.

    It lives as long as the Python worker and starts afresh when it has STORED pieces or VALUES values, so its
    memory is bounded but for the pieces of one chunk; it saves work only and never changes a result.
    """

    def __init__(self, give):
        self.give = give
        self.clear()

    def clear(self) -> None:
        self.keys, self.begin, self.size = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.values, self.used = np.zeros(1 << 16, np.int32), 0

    def look_up(self, cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each piece where its values begin in self.values, and how many there are."""
        keys, at, back = np.unique(run_hashes(cp, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) > STORED or self.used > VALUES:
            self.clear()
        place = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == keys[inside]
        if not known.all():
            new = np.flatnonzero(~known)
            text = cp.tobytes()
            strings = [text[4 * a : 4 * b].decode("utf-32-le", "surrogatepass") for a, b in zip(starts[at[new]].tolist(), ends[at[new]].tolist(), strict=True)]
            given = self.give(strings)
            size = np.fromiter(map(len, given), np.int64, len(given))
            flat = np.fromiter((v for g in given for v in g), np.int32, int(size.sum()))
            while self.used + len(flat) > len(self.values):
                self.values = np.concatenate([self.values, np.zeros(len(self.values), np.int32)])
            self.values[self.used : self.used + len(flat)] = flat
            begin = self.used + np.cumsum(size) - size
            self.used += len(flat)
            where = np.searchsorted(self.keys, keys[new])
            self.keys = np.insert(self.keys, where, keys[new])
            self.begin = np.insert(self.begin, where, begin)
            self.size = np.insert(self.size, where, size)
            place = np.searchsorted(self.keys, keys)
        back = back.reshape(-1)
        return self.begin[place][back], self.size[place][back]


def spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indexes begin[i] to begin[i] + size[i], for each i in turn."""
    total = int(size.sum())
    ends = np.cumsum(size)
    out = np.arange(total)
    out += np.repeat(begin - (ends - size), size)
    return out
