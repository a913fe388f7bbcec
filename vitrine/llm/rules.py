"""Quality rules: gradient-boosted trees over document statistics.

Statistics come from arrays over whole chunks of texts. The trees are fitted to quality labels
on a bounded sample of labelled documents (``SAMPLE`` documents, chosen by a seeded hash), each
on the gradient of the logistic loss, with splits on quantile bins. For features in ``MONOTONE``
a split is allowed only where its children's values keep the sign, and children inherit the
bounds this sets, so more repetition or more symbols never raise a score. The fitted trees are
flattened into node arrays and scored for a whole chunk at once.

Defined cases: null text is empty; a text without words has zero counts, fails the base rule
and is not kept; null ids and repeated rows are scored like any other; without labels, or with
one class only, there are no trees and the base rule alone decides; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import texts
from .textkit import NOT_BLANK, NOT_NEWLINE, U, Chunk, chunks, grams, mix, row_of, run_hashes

#: Labelled documents that the trees are fitted to, at most.
SAMPLE = 20_000
#: The symbols that n_symbols counts.
SYMBOLS = "#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(SYMBOLS.encode(), np.uint8)] = True
_UPPER, _DIGIT, _PUNCTUATION = (np.zeros(256, bool) for _ in range(3))
_UPPER[65:91], _DIGIT[48:58] = True, True
_PUNCTUATION[np.frombuffer(b".,;:!?", np.uint8)] = True

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: The model's features, and for some the only direction in which they may move a score.
FEATURES = ("log_words", "mean_word", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "upper_ratio", "digit_ratio", "mark_ratio", "bang_ratio", "line_words", "distinct_ratio")
MONOTONE = {"symbol_ratio": -1, "dup_line_ratio": -1, "repeat_ratio": -1, "bang_ratio": -1}


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key occurs again anywhere, and whether it has occurred before."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    again, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:]] = same
    again[order[1:]] |= same
    again[order[:-1]] |= same
    return again, later


def _per_row(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[edges])


def statistics(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """COUNTS (rows x 5) and FEATURES (rows x 11) of a chunk."""
    data, n = chunk.data, chunk.rows
    starts, ends, first = chunk.runs(NOT_BLANK)
    words = np.diff(first)
    hashes = run_hashes(data, starts, ends)
    inside = NOT_BLANK[data]
    leading = (data & 0xC0) != 0x80
    chars = _per_row(inside & leading, chunk.offsets)
    symbols = _per_row(_SYMBOL[data], chunk.offsets)
    row_salt = mix(np.arange(1, n + 1, dtype=U))
    windows, at = grams(hashes, first, 3)
    again, _ = _repeated(windows ^ row_salt[np.searchsorted(first, at, "right") - 1]) if len(at) else (np.zeros(0, bool), None)
    covered = np.zeros(len(hashes), bool)
    for k in range(3):
        covered[at[again] + k] = True
    repeats = _per_row(covered, first)
    line_start, line_end, line_first = chunk.runs(NOT_NEWLINE)
    any_word = np.zeros(len(data) + 1, np.int64)
    np.cumsum(inside, out=any_word[1:])
    has_word = any_word[line_end] > any_word[line_start]
    line_row = row_of(line_first)[has_word]
    _, later = _repeated(run_hashes(data, line_start[has_word], line_end[has_word]) ^ row_salt[line_row])
    dup_lines = np.bincount(line_row[later], minlength=n)
    lines = np.bincount(line_row, minlength=n)
    _, word_later = _repeated(hashes ^ row_salt[row_of(first)])
    distinct = words - _per_row(word_later, first)
    counts = np.stack([words, chars, symbols, dup_lines, repeats], 1).astype(np.int64)
    w, c = np.maximum(words, 1), np.maximum(chars, 1)
    ratio = lambda table: _per_row(table[data], chunk.offsets)
    bang = np.zeros(256, bool)
    bang[33] = True
    features = np.stack(
        [np.log1p(words), chars / w, symbols / w, dup_lines / np.maximum(lines, 1), repeats / w, ratio(_UPPER) / c, ratio(_DIGIT) / c, ratio(_PUNCTUATION) / c, ratio(bang) / w, words / np.maximum(lines, 1), distinct / w], 1
    )
    return counts, features


def base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])


@dataclass
class Trees:
    """All trees' nodes in one set of arrays; a leaf is its own child."""

    feature: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    threshold: np.ndarray = field(default_factory=lambda: np.zeros(0))
    left: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    right: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    value: np.ndarray = field(default_factory=lambda: np.zeros(0))
    roots: tuple[int, ...] = ()
    depth: int = 0
    base: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            out += self.value[node]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, signs: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: float = 2.0) -> Trees:
    """Boosted trees for the logistic loss; signs: -1, 0 or 1 for each feature."""
    if not len(y) or y.min() == y.max():
        return Trees()
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
    prior = y.mean()
    base = float(np.log(prior / (1 - prior)))
    margin = np.full(len(y), base)
    nodes: list[list[float]] = []
    roots = []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        me = len(nodes)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        value = float(np.clip(-total_g / (total_h + ridge), low, high))
        nodes.append([0, 0.0, me, me, rate * value])
        best = (1e-6, -1, 0, 0.0, 0.0)
        if level < depth:
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                hist_g = np.cumsum(np.bincount(binned[rows, f], g[rows], len(e) + 1))[:-1]
                hist_h = np.cumsum(np.bincount(binned[rows, f], h[rows], len(e) + 1))[:-1]
                vl = np.clip(-hist_g / (hist_h + ridge), low, high)
                vr = np.clip(-(total_g - hist_g) / (total_h - hist_h + ridge), low, high)
                worth = lambda gs, hs, v: -(gs * v + 0.5 * (hs + ridge) * v * v)
                gain = worth(hist_g, hist_h, vl) + worth(total_g - hist_g, total_h - hist_h, vr) - worth(total_g, total_h, value)
                gain[(hist_h < least) | (total_h - hist_h < least) | (signs[f] * (vr - vl) < 0)] = -1
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], f, k, vl[k], vr[k])
        _, f, k, vl, vr = best
        if f >= 0:
            go = binned[rows, f] <= k
            middle = (vl + vr) / 2
            lower, upper = ((low, middle), (middle, high)) if signs[f] > 0 else ((middle, high), (low, middle)) if signs[f] < 0 else ((low, high), (low, high))
            left = grow(rows[go], g, h, level + 1, *lower)
            right = grow(rows[~go], g, h, level + 1, *upper)
            nodes[me] = [f, edges[f][k], left, right, 0.0]
        return me

    flat = lambda: Trees(*(np.array(c, t) for c, t in zip(zip(*nodes, strict=True), (np.int32, float, np.int32, np.int32, float), strict=True)), tuple(roots), depth, base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        first = len(nodes)
        roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), 0, -np.inf, np.inf))
        one = flat()
        one.roots, one.base = (first,), 0.0
        margin += one.margin(x)
    return flat()


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, eligible=None) -> DataFrame:
    """doc_id, text, label of at most ``most`` documents, chosen by a seeded hash of doc_id.

    The labels are cut down first, so the join to the texts has one side of bounded size.
    A document with differing labels counts by the larger one.
    """
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IS NOT NULL")
    if eligible is not None:
        chosen = chosen.where(eligible(F.col("doc_id")))
    chosen = chosen.groupBy("doc_id").agg(F.max("label").alias("label")).withColumn("h", F.xxhash64(F.lit(17), "doc_id"))
    # The lowest hashes: a bound that a few more than ``most`` are under, so that no task is sent more of them.
    share = (most + 6 * most**0.5 + 10) / max(1, chosen.count())
    if share < 1:
        chosen = chosen.where(F.col("h") <= F.lit(int(-(2.0**63) + share * 2.0**64)))
    chosen = chosen.orderBy("h", "doc_id").limit(most).drop("h")
    # At most ``most`` rows of two numbers, whatever the size of the tables.
    return texts(docs).join(F.broadcast(chosen), "doc_id")


def trained(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE, eligible=None, **options) -> Trees:
    """Trees fitted on the driver to the statistics, eleven numbers each, of the bounded sample."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            _, x = statistics(chunk)
            yield pa.RecordBatch.from_arrays([chunk.batch.column("doc_id"), *map(pa.array, x.T), chunk.batch.column("label")], names=["doc_id", *FEATURES, "label"])

    schema = "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES) + ", label int"
    rows = labelled_sample(docs, labels, label, most, eligible).mapInArrow(measure, schema).toPandas().sort_values(["doc_id", *FEATURES])
    signs = np.array([MONOTONE.get(f, 0) for f in FEATURES])
    return fit(rows[list(FEATURES)].to_numpy(float), rows["label"].to_numpy(float), signs, **options)


def judged(docs: DataFrame, model: Trees, least: float = 0.3) -> DataFrame:
    """doc_id, COUNTS, base_failed, score and kept of every document."""
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, score double, kept boolean"

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            counts, x = statistics(chunk)
            failed = base_failed(counts)
            score = model.score(x) if model.roots else np.ones(len(x))
            yield pa.RecordBatch.from_arrays(
                [chunk.batch.column("doc_id"), *map(pa.array, counts.T), pa.array(failed), pa.array(score), pa.array(~failed & (score >= least))],
                names=["doc_id", *COUNTS, "base_failed", "score", "kept"],
            )

    return texts(docs).mapInArrow(judge, schema)
