"""Packing documents' tokens into sequences of a fixed length, by non-negative least squares.

Each task packs its documents in blocks of bounded tokens, so nothing is shuffled. In a block,
whole windows are first cut off long documents. The rest is counted in a histogram of lengths,
in units of window / 32. All combinations of at most four lengths that fill a window are
enumerated; non-negative least squares gives how often each is to be used for the histogram;
the counts are rounded down and each use takes documents of those lengths. Documents left over
are the residual. It is packed greedily: cut freely, it fills the windows' slack to the last
token and then windows of its own. What still remains is cut at powers of two, which need no
padding; so there is none.

Defined cases: a null text is empty, and an empty text is the end token alone; null ids and
repeated rows are packed like any other; an empty table gives no pieces; a text beyond a
block's bound is a block of its own; other columns are ignored. A block's packing depends on
its documents alone, so a task that is run again gives the same pieces.
"""

from __future__ import annotations

import functools
import unicodedata
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import pieces
from .shared import texts
from .textkit import chunks

UNITS, DEPTH = 32, 4
BLOCK_TOKENS = 1 << 22
SCHEMA = "doc_id long, start long, length long, tokens binary, doc_tokens long, sequence_id long, offset long, sequence_tokens long"


class WordEncoder:
    """Ids of texts as the library gives them for a lower-casing word vocabulary.

    Pieces are found on arrays and each distinct one is encoded by the library once a worker.
    Texts that its normaliser changes by more than the case of single letters, or that hold
    special tokens' strings, are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.store = pieces.Store(self.give)

    def give(self, strings: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(strings, add_special_tokens=False)]

    def plain(self, text: str) -> bool:
        if any(s in text for s in self.specials) or "\u0130" in text:
            return False
        return text.isascii() or max(text) < "\u0300" or unicodedata.is_normalized("NFC", text)

    def encode(self, rows: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and each text's first."""
        plain = [self.plain(t) for t in rows]
        cp, first = pieces.code_points([t if ok else "" for t, ok in zip(rows, plain, strict=True)])
        if len(cp):
            cp = pieces.lowered()[cp]
            starts, ends = pieces.word_level(cp, first)
            begin, size = self.store.look_up(cp, starts, ends)
            ids = self.store.values[pieces.spread(begin, size)]
            total = np.zeros(len(starts) + 1, np.int64)
            np.cumsum(size, out=total[1:])
            at = total[np.searchsorted(starts, first)]
        else:
            ids, at = np.zeros(0, np.int32), np.zeros(len(rows) + 1, np.int64)
        if all(plain):
            return ids, at
        parts = [ids[at[i] : at[i + 1]] if ok else np.array(self.library.encode(t, add_special_tokens=False).ids, np.int32) for i, (t, ok) in enumerate(zip(rows, plain, strict=True))]
        first = np.zeros(len(rows) + 1, np.int64)
        np.cumsum([len(p) for p in parts], out=first[1:])
        return np.concatenate(parts), first


@functools.cache
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


@functools.cache
def combinations(units: int = UNITS, depth: int = DEPTH) -> np.ndarray:
    """A column for each multiset of at most ``depth`` lengths that adds up to ``units``: how often it has each length."""
    found = []

    def extend(parts: tuple[int, ...], left: int, most: int) -> None:
        if left == 0:
            found.append(parts)
        elif len(parts) < depth:
            for part in range(min(left, most), 0, -1):
                extend((*parts, part), left - part, part)

    extend((), units, units)
    table = np.zeros((units + 1, len(found)))
    for k, parts in enumerate(found):
        for part in parts:
            table[part, k] += 1
    return table


def non_negative_least_squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x >= 0 of least |a x - b|, by the active-set method of Lawson and Hanson."""
    n = a.shape[1]
    x, used = np.zeros(n), np.zeros(n, bool)
    gradient = a.T @ (b - a @ x)
    for _ in range(3 * n):
        if used.all() or gradient[~used].max() <= 1e-9 * max(1.0, np.abs(b).max()):
            break
        used[np.flatnonzero(~used)[np.argmax(gradient[~used])]] = True
        while True:
            s = np.zeros(n)
            s[used] = np.linalg.lstsq(a[:, used], b, rcond=None)[0]
            low = used & (s <= 0)
            if not low.any():
                break
            step = np.min(x[low] / np.maximum(x[low] - s[low], 1e-300))
            x = x + step * (s - x)
            used &= x > 1e-12
            x[~used] = 0
        x = s
        gradient = a.T @ (b - a @ x)
    return x


def plan(lengths: np.ndarray, window: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length) that hold each token of each document once."""
    lengths = np.asarray(lengths, np.int64)
    sequences = [[(int(d), int(k) * window, window)] for d in np.flatnonzero(lengths >= window) for k in range(lengths[d] // window)]
    rest = lengths % window
    unit = -(-window // UNITS)
    bins: dict[int, list[int]] = {}
    for d in np.argsort(-rest, kind="stable").tolist():
        if rest[d]:
            bins.setdefault(-(-int(rest[d]) // unit), []).append(d)
    histogram = np.array([len(bins.get(u, ())) for u in range(UNITS + 1)], float)
    table = combinations()
    uses = np.floor(non_negative_least_squares(table, histogram) + 1e-9).astype(int)
    filled = []
    for k in np.argsort(-uses, kind="stable"):
        parts = Counter({u: int(table[u, k]) for u in range(1, UNITS + 1) if table[u, k]})
        times = min([uses[k], *(len(bins.get(u, ())) // m for u, m in parts.items())])
        for _ in range(times):
            window_docs = [bins[u].pop() for u, m in parts.items() for _ in range(m)]
            filled.append([(d, int(lengths[d] - rest[d]), int(rest[d])) for d in window_docs])
    slack = lambda seq: window - sum(p[2] for p in seq)
    filled.sort(key=slack)
    pool = deque((d, int(lengths[d] - rest[d]), int(rest[d])) for u in sorted(bins, reverse=True) for d in bins[u])
    in_pool, open_room = sum(p[2] for p in pool), sum(map(slack, filled))
    while in_pool < open_room:
        given_up = filled.pop()
        open_room -= slack(given_up)
        in_pool += window - slack(given_up)
        pool.extend(given_up)

    def take(room: int) -> list[tuple[int, int, int]]:
        out = []
        while room:
            d, start, length = pool.popleft()
            if length > room:
                pool.appendleft((d, start + room, length - room))
                length = room
            out.append((d, start, length))
            room -= length
        return out

    for seq in filled:
        room = slack(seq)
        in_pool -= room
        sequences.append(seq + take(room))
    while in_pool >= window:
        sequences.append(take(window))
        in_pool -= window
    for power in range(in_pool.bit_length() - 1, -1, -1):
        if in_pool >> power & 1:
            sequences.append(take(1 << power))
    return sequences


def packed(docs: DataFrame, path: str, end_id: int = 2, window: int = 4096) -> DataFrame:
    """The pieces of the packed sequences; columns as in SCHEMA.

    tokens: the piece's ids, little-endian unsigned 32-bit. start: ids of the document before it.
    offset: its place in the sequence. sequence_tokens: the sequence's length, which is
    ``window`` or a power of two. sequence_id: the task's number and the sequence's in it.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(path).encode
        serial = TaskContext.get().partitionId() << 32
        block: list[tuple[int | None, np.ndarray]] = []
        size = 0

        def rows() -> Iterator[pa.RecordBatch]:
            nonlocal serial
            out: list[tuple] = []
            held = 0
            for seq in plan(np.array([len(t) for _, t in block], np.int64), window):
                offset, whole = 0, sum(p[2] for p in seq)
                for d, start, length in seq:
                    doc_id, tokens = block[d]
                    out.append((doc_id, start, length, tokens[start : start + length].tobytes(), len(tokens), serial, offset, whole))
                    offset += length
                    held += length
                serial += 1
                if held > 1 << 19:
                    yield _batch(out)
                    out, held = [], 0
            if out:
                yield _batch(out)

        for chunk in chunks(batches):
            ids, first = ids_of(chunk.texts.to_pylist())
            # The end token goes behind each document's ids.
            tokens = np.insert(ids.astype("<u4"), first[1:], end_id)
            first = first + np.arange(len(first))
            for i, doc_id in enumerate(chunk.batch.column("doc_id").to_pylist()):
                own = tokens[first[i] : first[i + 1]]
                if block and size + len(own) > BLOCK_TOKENS:
                    yield from rows()
                    block, size = [], 0
                block.append((doc_id, own))
                size += len(own)
        if block:
            yield from rows()

    return texts(docs).mapInArrow(pack, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "tokens" else pa.int64()) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names=names)
