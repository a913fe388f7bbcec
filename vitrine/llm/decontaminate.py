"""Benchmark decontamination: windows of an item's size, an exact bound, exact check, SimHash distance.

A document's windows of as many words as an item has are compared to the item by their weighted
word shingles (five words; a shingle weighs as many bytes as its words have; repeated shingles
count as often as they occur): a window matches if sum of minima / sum of maxima is at least
``similarity``. That needs shared shingles of ``similarity`` of the item's weight, so a window that
has only shingles of less than that in all cannot match. For each item, shingles of just less are left
out, those that most items have first; windows around any other shingle of the item are looked at. The
shared weight of such a window, if repeats were not limited by the item's, and its own weight bound
its similarity from above; windows whose bound reaches ``similarity`` are compared exactly. Neither
step drops a match, however weight is spread. ``hamming`` is the distance of the 64-bit SimHashes
of the weighted shingles of the best window and the item; nothing is chosen by it.

Why nothing is chosen by it: a window of a similarity of 0.8 can be at any distance, since SimHash follows the
heaviest shingles, so a radius loses matches; and a radius as wide as the spread of even weights needs
(20 of 64 bits) blocks of 3 bits, in which most items are candidates of each window. The README has figures.

Items are taken in blocks of bounded bytes, each against all documents. A task and the driver hold one block:
where there are several, what one finds is written before the next is gathered.

Words are lower-case runs of a-z, 0-9 and characters beyond ASCII. Defined cases: null text
is empty and matches nothing, on either side; an item of fewer than five words is one shingle;
a document with fewer words than an item is one window; repeated items of one id and text count
once; null ids are kept as null; an empty table gives no row. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import spread
from .shared import dropped, texts, written
from .textkit import _BASE, LOWER_WORD, U, Chunk, chunks, mix, run_hashes, shingles

WORDS, SIMILARITY = 5, 0.8
BLOCK_BYTES = 16 << 20
#: Pairs of an item and a place in a document that are held at once.
PAIRS = 1 << 20
_BITS = np.arange(64, dtype=U)
SCHEMA = "doc_id long, item_id long, start_word long, n_words long, similarity double, hamming int"


def _signs(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """One row of 64 signed weights for each shingle."""
    bits = (mix(values ^ U(0x51A5))[:, None] >> _BITS) & U(1)
    return np.where(bits == 1, weights[:, None], -weights[:, None]).astype(np.int32)


def _fingerprint(sums: np.ndarray) -> np.ndarray:
    return ((sums > 0).astype(U) << _BITS).sum(1, dtype=U)


@dataclass
class Group:
    """The items of one number of words: their fingerprints and their shingles."""

    ids: list
    fingerprints: np.ndarray
    vectors: list[tuple[np.ndarray, np.ndarray, np.ndarray]]


class Index:
    """One block of items."""

    def __init__(self, items: list[tuple], least: float = SIMILARITY):
        batch = pa.RecordBatch.from_pydict({"text": pa.array([t for _, t in items], pa.string())})
        chunk = Chunk(batch, lower=True)
        values, weights, first, word_first = vectors(chunk)
        sizes = np.diff(word_first)
        found: dict[int, list[int]] = {}
        for i, n in enumerate(sizes.tolist()):
            if n:
                found.setdefault(n, []).append(i)
        self.groups = {}
        long: list[tuple[int, int]] = []
        every = [np.zeros(0, U)]
        for n, rows in found.items():
            sums = np.stack([_signs(values[first[i] : first[i + 1]], weights[first[i] : first[i + 1]]).sum(0) for i in rows])
            bags = []
            for k, i in enumerate(rows):
                v, at, c = np.unique(values[first[i] : first[i + 1]], return_index=True, return_counts=True)
                bags.append((v, c, weights[first[i] : first[i + 1]][at]))
                if n >= WORDS:
                    long.append((n, k))
                    every.append(v)
            self.groups[n] = Group([items[i][0] for i in rows], _fingerprint(sums), bags)
        # Each item's shingles but those that most items have, of less than ``least`` of its weight.
        known, common = np.unique(np.concatenate(every), return_counts=True)
        looked, holder = [np.zeros(0, U)], [np.zeros(0, np.int64)]
        for i, (n, k) in enumerate(long):
            v, c, w = self.groups[n].vectors[k]
            order = np.lexsort((v, -common[np.searchsorted(known, v)]))
            left_out = np.cumsum((c * w)[order]) < least * float((c * w).sum()) * (1 - 1e-9)
            looked.append(v[order][~left_out])
            holder.append(np.full(len(looked[-1]), i))
        shingle, item = np.concatenate(looked), np.concatenate(holder)
        order = np.argsort(shingle, kind="stable")
        #: The shingles that are looked up, in order, and the item of each: a place in ``long``.
        self.shared, self.item, self.long = shingle[order], item[order], long
        self.span = np.array([n - WORDS + 1 for n, _ in long], np.int64)
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.shared & U((1 << 20) - 1)).astype(np.int64)] = True

    def has(self, values: np.ndarray) -> np.ndarray:
        """Where an item is looked up by the shingle."""
        at = np.flatnonzero(self.filter[(values & U((1 << 20) - 1)).astype(np.int64)])
        if not len(at):
            return at
        place = np.minimum(np.searchsorted(self.shared, values[at]), len(self.shared) - 1)
        return at[self.shared[place] == values[at]]

    def places(self, values: np.ndarray, row: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Runs (item, first, last) of hits of an item that share windows, in one row; a run may be cut in two."""
        hits = self.has(values)
        low, high = np.searchsorted(self.shared, values[hits], "left"), np.searchsorted(self.shared, values[hits], "right")
        total = np.cumsum(high - low)
        at = 0
        while at < len(hits):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
            size = high[at:to] - low[at:to]
            item, hit = self.item[spread(low[at:to], size)], np.repeat(hits[at:to], size)
            order = np.lexsort((hit, item))
            item, hit = item[order], hit[order]
            begin = np.append(True, (item[1:] != item[:-1]) | (row[hit[1:]] != row[hit[:-1]]) | (np.diff(hit) >= self.span[item[1:]]))
            end = np.append(begin[1:], True)
            yield from zip(item[begin].tolist(), hit[begin].tolist(), hit[end].tolist(), strict=True)
            at = to


def vectors(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingles and their weights in order, each row's first shingle, each row's first word."""
    starts, ends, word_first = chunk.runs(LOWER_WORD)
    hashes = run_hashes(chunk.data, starts, ends)
    values, at, rows = shingles(hashes, word_first, WORDS)
    size = np.zeros(len(hashes) + 1, np.int64)
    np.cumsum(ends - starts, out=size[1:])
    weights = size[np.minimum(at + WORDS, word_first[rows + 1])] - size[at]
    return values, weights, np.searchsorted(rows, np.arange(chunk.rows + 1)), word_first


def similarity(values: np.ndarray, weights: np.ndarray, bag: tuple[np.ndarray, np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of a window's shingles, with repeats, and an item's."""
    known, counts, item_weights = bag
    own, own_counts = np.unique(values, return_counts=True)
    place = np.minimum(np.searchsorted(known, own), len(known) - 1)
    same = known[place] == own
    both = float((np.minimum(own_counts[same], counts[place[same]]) * item_weights[place[same]]).sum())
    return both / (float(weights.sum()) + float((counts * item_weights).sum()) - both)


def matches(chunk: Chunk, index: Index, least: float) -> dict[tuple[int, int, int], tuple[float, int, int, int]]:
    """(row, item's words, item's place in its group) to (-similarity, start word, words, distance) of the best window."""
    values, weights, first, word_first = vectors(chunk)
    best: dict[tuple[int, int, int], tuple[float, int, int, int]] = {}
    words = np.diff(word_first)
    row_of_shingle = np.repeat(np.arange(chunk.rows), np.diff(first))
    starts, ends, _ = chunk.runs(LOWER_WORD)
    hashes = None
    for n, group in index.groups.items():
        if n < WORDS:
            # One shingle: a window matches if its words are the item's.
            hashes = run_hashes(chunk.data, starts, ends) if hashes is None else hashes
            total = np.zeros(max(0, len(hashes) - n + 1), U)
            for k in range(n):
                total = total * _BASE + hashes[k : k + len(total)]
            at = np.arange(len(total))
            at = at[np.searchsorted(word_first, at, "right") == np.searchsorted(word_first, at + n - 1, "right")]
            own = mix_short(total[at])
            for i, (v, _, _) in enumerate(group.vectors):
                for s in at[own == v[0]].tolist():
                    r = int(np.searchsorted(word_first, s, "right") - 1)
                    best.setdefault((r, n, i), (-1.0, s - int(word_first[r]), n, 0))
    weight = np.zeros(len(values) + 1, np.int64)
    np.cumsum(weights, out=weight[1:])
    for item, hit, last in index.places(values, row_of_shingle):
        (n, i), span, r = index.long[item], int(index.span[item]), int(row_of_shingle[hit])
        group, begin, end = index.groups[n], int(first[r]), int(first[r + 1])
        known, counts, item_weights = bag = group.vectors[i]
        # Windows start from ``low`` to ``high``; a row of fewer words than the item is one window.
        low, high = max(hit - span + 1, begin), min(last, max(end - span, begin))
        to = min(high + span, end)
        place = np.minimum(np.searchsorted(known, values[low:to]), len(known) - 1)
        same = np.zeros(to - low + 1, np.int64)
        np.cumsum(np.where(known[place] == values[low:to], weights[low:to], 0), out=same[1:])
        s = np.arange(low, high + 1)
        e = np.minimum(s + span, end)
        whole = int((counts * item_weights).sum())
        both = np.minimum(same[e - low] - same[s - low], whole)
        able = np.flatnonzero(both * (1 + least) >= least * (weight[e] - weight[s] + whole) * (1 - 1e-9))
        for a, z in zip(s[able].tolist(), e[able].tolist(), strict=True):
            sim = similarity(values[a:z], weights[a:z], bag)
            if sim >= least:
                key, start = (r, n, i), a - begin
                if key not in best or (-sim, start) < best[key][:2]:
                    own = _fingerprint(_signs(values[a:z], weights[a:z]).sum(0)[None])[0]
                    best[key] = (-sim, start, min(n, int(words[r])), int(np.bitwise_count(own ^ group.fingerprints[i])))
    return best


def mix_short(total: np.ndarray) -> np.ndarray:
    """The hash that ``shingles`` gives a row of fewer words than a shingle has."""
    return mix(total ^ U(0x5555555555555555))


def blocks(items: DataFrame, least: float = SIMILARITY, item_id: str = "item_id", text: str = "text") -> Iterator[tuple[Index, bool]]:
    """The items, a block of about BLOCK_BYTES at a time: what a task holds and the driver gathers at once; and whether it is the only one."""
    own = items.select(F.col(item_id).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).distinct()
    total = own.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = -(-total // BLOCK_BYTES)
    for k in range(n):
        part = own.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k).collect()
        yield Index(sorted(((r.id, r.text) for r in part), key=lambda x: (x[0] is None, x[0] or 0, x[1])), least), n == 1


def contaminated(docs: DataFrame, items: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The best window of each document and item that match; columns as in SCHEMA."""
    found = None
    for index, only in blocks(items, least):

        def search(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for chunk in chunks(batches, lower=True):
                best = matches(chunk, index, least)
                ids = chunk.batch.column("doc_id")
                rows = [(ids[r].as_py(), index.groups[n].ids[i], start, words, -sim, far) for (r, n, i), (sim, start, words, far) in sorted(best.items())]
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in SCHEMA.split(", ")])

        part = texts(docs).mapInArrow(search, SCHEMA)
        part = part if only else written(part, "found")
        found = part if found is None else found.unionByName(part)
    return docs.sparkSession.createDataFrame([], SCHEMA) if found is None else found


def cleaned(docs: DataFrame, items: DataFrame, least: float = SIMILARITY, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all their columns, that no item matches."""
    before = None
    for index, only in blocks(items, least):

        def keep(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for chunk in chunks(batches, text, lower=True):
                clean = np.ones(chunk.rows, bool)
                clean[[r for r, _, _ in matches(chunk, index, least)]] = False
                yield chunk.batch.filter(pa.array(clean))

        docs = docs.mapInArrow(keep, docs.schema)
        if not only:
            docs = written(docs, "clean")
            dropped(before)
            before = docs
    return docs
