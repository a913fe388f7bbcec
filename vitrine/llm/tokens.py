"""Exact token counts at every prefix of a text, by dynamic programming over byte-pair encodings.

The encoding of a pre-token's first i bytes is that of its first j bytes and one more token,
for the one token that ends there and may follow the last of them. So one pass gives the count
at every prefix. A text's prefix has the counts of its whole pre-tokens and of the prefix of the
next. Two cases differ from the pre-tokens of the whole text and are put right: a prefix that
ends where a run of blanks does (the run's last character has not joined the next word yet), and
one that ends inside 're, 've or 'll.

Distinct pre-tokens are worked out once a worker. A special token's string inside a text is that
token, as the library's default has it, and ends the text before it.

Defined cases: null text is empty and has no tokens; rows are independent, so null ids, ties and
repeated rows come back as they are; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import pieces
from .shared import texts
from .textkit import chunks


@functools.cache
def _byte_letters() -> dict[str, int]:
    """The printable letters that byte-level vocabularies write bytes with."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in plain}
    letters.update({chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)})
    return letters


class PrefixCounter:
    """The dynamic programme over one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        letters = _byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        self.specials = [a["content"] for a in model["added_tokens"]]
        names = [t for t in model["model"]["vocab"] if t not in self.specials]
        self.ids = {raw(t): k for k, t in enumerate(names)}
        self.ranks = {(raw(a), raw(b)): k for k, (a, b) in enumerate(pairs)}
        self.longest = max(map(len, self.ids))
        # All tokens that end at a byte, the longest first, in one walk over a text, however long its pieces are.
        self.tokens = ahocorasick.Automaton()
        for token in self.ids:
            self.tokens.add_word(token.decode("latin-1"), len(token))
        self.tokens.make_automaton()
        self.follows: dict[tuple[bytes, bytes], bool] = {}
        self.whole: dict[bytes, bool] = {}
        self.store = pieces.Store(self.give)

    def merged(self, data: bytes) -> list[bytes]:
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get((parts[i], parts[i + 1]), 1 << 30))
            if (pair := (parts[best], parts[best + 1])) not in self.ranks:
                break
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def may_follow(self, a: bytes, b: bytes) -> bool:
        known = self.follows.get((a, b))
        if known is None:
            if len(self.follows) > 2_000_000:
                self.follows.clear()
            known = self.follows[a, b] = self.merged(a + b) == [a, b]
        return known

    def is_whole(self, token: bytes) -> bool:
        known = self.whole.get(token)
        if known is None:
            known = self.whole[token] = self.merged(token) == [token]
        return known

    def byte_counts(self, data: bytes, last: list[bytes], counts: list[int], done: int) -> None:
        """Fill in last token and count of data[:i] for i beyond ``done``; both lists have them up to there."""
        follows = self.follows
        del last[done + 1 :], counts[done + 1 :]
        for end, size in self.tokens.iter(data.decode("latin-1"), max(0, done + 1 - self.longest)):
            i = end + 1
            # One token ends at each byte; what else ends there is shorter.
            if i <= done or len(last) > i:
                continue
            j = i - size
            token = data[j:i]
            if j:
                known = follows.get((last[j], token))
                fits = self.may_follow(last[j], token) if known is None else known
            else:
                fits = self.is_whole(token)
            if fits:
                last.append(token)
                counts.append(counts[j] + 1)

    def give(self, strings: list[str]) -> list[list[int]]:
        """The counts at every character of each string; in sorted order, strings share the work of common prefixes."""
        out: list[list[int]] = [[]] * len(strings)
        raw = [s.encode("utf-8", "surrogatepass") for s in strings]
        before, last, counts = b"", [b""], [0]
        for k in sorted(range(len(raw)), key=raw.__getitem__):
            data, same = raw[k], 0
            for same, (x, y) in enumerate(zip(before, data, strict=False)):  # noqa: B007
                if x != y:
                    break
            else:
                same = min(len(before), len(data))
            self.byte_counts(data, last, counts, same)
            before = data
            n = len(data)
            out[k] = counts[1:] if n == len(strings[k]) else [counts[i + 1] for i in range(n) if i + 1 == n or data[i + 1] & 0xC0 != 0x80]
        return out

    def prefixes(self, rows: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Counts after each character of each text (without special tokens), and each text's first."""
        cp, first = pieces.code_points(rows)
        if not len(cp):
            return np.zeros(0, np.int64), first
        starts, three, blank_from, blank_to, _ = pieces.byte_level(cp, first)
        ends = np.append(starts[1:], len(cp))
        begin, size = self.store.look_up(cp, starts, ends)
        inside = self.store.values[pieces.spread(begin, size)].astype(np.int64)
        total = inside[ends - 1]
        before = np.cumsum(total) - total
        # Each text's pieces count from its own first piece.
        piece_first = np.searchsorted(starts, first)
        row_base = np.append(before, total.sum())[piece_first]
        base = before - np.repeat(row_base[:-1], np.diff(piece_first))
        counts = np.repeat(base, size) + inside
        if len(three):
            counts[three + 1] = counts[three] + 1
        if len(blank_from):
            b, s = self.store.look_up(cp, blank_from, blank_to)
            piece = np.searchsorted(starts, blank_from, "right") - 1
            counts[blank_to - 1] = base[piece] + self.store.values[b + s - 1]
        return counts, first

    def special_prefixes(self, text: str) -> np.ndarray:
        """Counts after each character of a text that holds special tokens' strings."""
        out, base, at = np.zeros(len(text), np.int64), 0, 0
        while at < len(text):
            found = min(((p, s) for s in self.specials if (p := text.find(s, at)) >= 0), default=(len(text), ""))
            part = self.prefixes([text[at : found[0] + max(0, len(found[1]) - 1)]])[0]
            out[at : at + len(part)] = base + part
            if found[0] > at:
                base = out[found[0] - 1]
            if not found[1]:
                break
            at = found[0] + len(found[1])
            base += 1
            out[at - 1] = base
        return out


@functools.cache
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def token_counts(docs: DataFrame, path: str, limit: int = 1024, prefixes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, fit_chars; with ``prefixes`` the whole table of each text.

    fit_chars: characters of the longest prefix of at most ``limit`` tokens. prefix_steps: the
    change of the count at each character, 16-bit integers; ``count_at`` reads it.
    """
    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long" + ", prefix_steps binary" * prefixes

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        programme = counter(path)
        for chunk in chunks(batches):
            rows = chunk.texts.to_pylist()
            special = {i for i, t in enumerate(rows) if any(s in t for s in programme.specials)}
            counts, first = programme.prefixes(["" if i in special else t for i, t in enumerate(rows)])
            n_tokens, fit, steps = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), []
            for i, text in enumerate(rows):
                own = programme.special_prefixes(text) if i in special else counts[first[i] : first[i + 1]]
                n_tokens[i] = own[-1] if len(own) else 0
                if n_tokens[i] <= limit:
                    fit[i] = len(own)
                else:
                    fits = np.flatnonzero(own <= limit)
                    fit[i] = fits[-1] + 1 if len(fits) else 0
                if prefixes:
                    steps.append(np.diff(own, prepend=0).astype("<i2").tobytes())
            columns = [chunk.batch.column("doc_id"), pa.array(np.diff(chunk.offsets)), pa.array(n_tokens), pa.array(n_tokens > limit), pa.array(fit)]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(steps, pa.binary())] * prefixes, names=[f.split()[0] for f in schema.split(", ")])

    return texts(docs).mapInArrow(count, schema)


def count_at(prefix_steps: bytes, chars: int) -> int:
    """Tokens of a text's first ``chars`` characters, from its stored steps alone."""
    return int(np.frombuffer(prefix_steps, "<i2")[:chars].sum(dtype=np.int64))
