"""Quality classifier: a linear hinge-loss model over n-gram indicators scaled by class log-count ratios.

Features of a text are n-grams of two kinds over its blank-separated words, as indicators in
``2**BITS`` hashed places: of the words' shapes (runs of upper case, lower case, digits and other
bytes, each run as one; a word equal to the one before is marked) for each order in SHAPE_ORDERS,
and of the words themselves for each order in WORD_ORDERS.

Each place is scaled by r = log((p / |p|) / (q / |q|)): p and q are the numbers of documents of
either class that have it, plus that class's share of all, so a place that no document has is 0.
The scaled indicators, divided by their norm, are the rows of a support vector machine, solved
by dual coordinate descent. A logistic curve turns margins into scores from 0 to 1; it is fitted
to each sampled document's margin under a model of the FOLDS - 1 parts that do not hold it.

The model is fitted on the driver, to a sample of at most ``SAMPLE`` labelled documents chosen by a
seeded hash: their places, 2**BITS at most for each, are all that is gathered. Scoring reads whole texts.

Defined cases: null text is empty, and without a word the margin is the bias; null ids and
repeated rows are scored like any other; without labels, or with one class only, every score is
the share of label 1 (1 without any); an empty table gives no row; other columns are ignored,
``lang`` and ``source`` among them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import labelled_sample
from .shared import texts
from .textkit import NOT_BLANK, U, Chunk, chunks, grams, mix, row_of, run_hashes

BITS = 18
#: Labelled documents that the model is fitted to, at most.
SAMPLE = 6_000
FOLDS = 4
SHAPE_ORDERS = (1, 2, 3)
WORD_ORDERS = (1, 2)

# A byte's shape: upper case, lower case (all bytes beyond ASCII too), digit, or the byte itself.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91] = 65
_SHAPE[97:123] = 97
_SHAPE[48:58] = 48
_SHAPE[128:] = 97


def places(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hashed places of all n-grams of a chunk, and each one's row."""
    data = chunk.data
    starts, ends, first = chunk.runs(NOT_BLANK)
    words = run_hashes(data, starts, ends)
    shape = _SHAPE[data]
    keep = np.ones(len(data), bool)
    keep[1:] = shape[1:] != shape[:-1]
    keep[starts] = True
    kept = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=kept[1:])
    shapes = run_hashes(shape[keep], kept[starts], kept[ends])
    same = np.zeros(len(words), bool)
    same[1:] = words[1:] == words[:-1]
    same[first[:-1][first[:-1] < len(words)]] = False
    shapes[same] ^= U(0xABCDEF)
    at_row, out, rows = row_of(first), [], []
    for salt, (hashes, orders) in enumerate(((shapes, SHAPE_ORDERS), (words, WORD_ORDERS))):
        for n in orders:
            values, at = grams(hashes, first, n)
            out.append(mix(values ^ U(1 + salt * 16 + n)) >> U(64 - BITS))
            rows.append(at_row[at])
    return np.concatenate(out).astype(np.int32), np.concatenate(rows)


def by_row(chunk: Chunk) -> Iterator[np.ndarray]:
    """The distinct places of each text, in ascending order."""
    values, rows = places(chunk)
    order = np.argsort(rows, kind="stable")
    values, edges = values[order], np.searchsorted(rows[order], np.arange(chunk.rows + 1))
    seen = np.zeros(1 << BITS, bool)
    for i in range(chunk.rows):
        seen[values[edges[i] : edges[i + 1]]] = True
        found = np.flatnonzero(seen)
        seen[found] = False
        yield found


@dataclass
class Model:
    """weight and square: for each place what it adds to the margin and to the squared norm."""

    weight: np.ndarray
    square: np.ndarray
    bias: float
    slope: float
    shift: float

    def score(self, found: np.ndarray) -> float:
        norm = np.sqrt(self.square[found].sum()) or 1.0
        return float(1 / (1 + np.exp(-(self.slope * (self.weight[found].sum() / norm + self.bias) + self.shift))))


def ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """r of every place."""
    n1, n0 = y.sum(), len(y) - y.sum()

    def count(label: int) -> np.ndarray:
        total = np.zeros(1 << BITS, np.int64)
        for r, v in zip(rows, y, strict=True):
            if v == label:
                total[r] += 1
        return total

    return np.log((count(1) + n1 / len(y)) / n1) - np.log((count(0) + n0 / len(y)) / n0)


def descend(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray, cost: float = 1.0, rounds: int = 12, seed: int = 1) -> tuple[np.ndarray, float]:
    """Weights of the scaled places and the bias, of least cost * hinge loss + squares / 2."""
    signs = np.where(y == 1, 1.0, -1.0)
    # Either class has the same cost in all.
    most = cost * np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    # All rows' values are in one array, which goes back to the system as a whole.
    edges = np.cumsum([0, *map(len, rows)])
    values = np.empty(edges[-1])
    scaled = [values[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
    for found, x in zip(rows, scaled, strict=True):
        x[:] = r[found]
        x /= np.sqrt(x @ x) or 1.0
    w, bias, alpha = np.zeros(1 << BITS), 0.0, np.zeros(len(y))
    random = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in random.permutation(len(y)):
            found, x = rows[i], scaled[i]
            gradient = signs[i] * (w[found] @ x + bias) - 1
            # The norm of a row is 1, and the bias is one more feature of value 1.
            new = min(max(alpha[i] - gradient / 2.0, 0.0), most[i])
            if (step := new - alpha[i]) != 0.0:
                w[found] += step * signs[i] * x
                bias += step * signs[i]
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, bias


def logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the curve of likeliest labels, by Newton's method over softened labels."""
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margin, np.ones(len(margin))], 1)
    b = np.array([1.0, np.log((n1 + 1) / (n0 + 1))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-(x @ b)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (target - p))
        b += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(b[0]), 1e-3), float(b[1])


def fit(rows: list[np.ndarray], y: np.ndarray) -> Model:
    none = np.zeros(1 << BITS, np.float32)
    if not len(y) or y.min() == y.max():
        share = min(max(float(y.mean()), 1e-6), 1 - 1e-6) if len(y) else 1 - 1e-6
        return Model(none, none, 0.0, 0.0, float(np.log(share / (1 - share))))
    margin = np.zeros(len(y))
    for fold in range(FOLDS):
        apart = np.arange(len(y)) % FOLDS == fold
        if len({*y[~apart]}) < 2:
            apart[:] = False
        part = _weighted([r for r, a in zip(rows, apart, strict=True) if not a], y[~apart])
        for k in range(fold, len(y), FOLDS):
            margin[k] = part.weight[rows[k]].sum() / (np.sqrt(part.square[rows[k]].sum()) or 1.0) + part.bias
    model = _weighted(rows, y)
    model.slope, model.shift = logistic(margin, y)
    return model


def _weighted(rows: list[np.ndarray], y: np.ndarray) -> Model:
    r = ratios(rows, y)
    w, bias = descend(rows, y, r)
    return Model((w * r).astype(np.float32), (r * r).astype(np.float32), bias, 1.0, 0.0)


def in_training(doc_id: Column) -> Column:
    return ~held_out(doc_id)


def held_out(doc_id: Column) -> Column:
    """Rows no label is learnt from: crc32 of the id as text is 0 modulo 5; a null id is not one."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def trained(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE, eligible=in_training) -> Model:
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            found = [f.astype("<i4").tobytes() for f in by_row(chunk)]
            yield pa.RecordBatch.from_arrays([chunk.batch.column("doc_id"), pa.array(found, pa.binary()), chunk.batch.column("label")], names=["doc_id", "places", "label"])

    rows = labelled_sample(docs, labels, label, most, eligible).mapInArrow(gather, "doc_id long, places binary, label int").toArrow().combine_chunks()
    # By hash, so that a fold is no stretch of ids.
    ids, y = rows.column("doc_id").to_numpy().astype(np.int64), rows.column("label").to_numpy().astype(float)
    order = np.argsort(mix(ids.astype(U)), kind="stable")
    # Views of the gathered table: the places of the sample are in the driver's memory once.
    found = [np.frombuffer(x.as_buffer(), "<i4") for x in rows.column("places")]
    return fit([found[i] for i in order], y[order])


def scored(docs: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """doc_id, score and predicted (1 if score >= least) of every document."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            s = np.array([model.score(found) for found in by_row(chunk)], float)
            yield pa.RecordBatch.from_arrays([chunk.batch.column("doc_id"), pa.array(s), pa.array((s >= least).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return texts(docs).mapInArrow(score, "doc_id long, score double, predicted int")


def filtered(docs: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all their columns, that the model does not reject."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            s = np.array([model.score(found) for found in by_row(chunk)], float)
            yield chunk.batch.filter(pa.array(s >= least))

    return docs.mapInArrow(keep, docs.schema)
