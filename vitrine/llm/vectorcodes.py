"""Product codes of vectors: a small codebook for each part of a vector, by weighted Lloyd rounds.

A component x becomes the integer floor(256 x). Vectors are cut into equal parts. A block of
vectors names each distinct part once, with its number of copies, and a vector by the places of
its parts. Over all blocks a part becomes one weighted row of (position, part), so however many
vectors share it, it is judged once a round. A round sends the codebooks (parts x entries x
components, all parameters) to the tasks and gets sums for each entry back. Codes and errors are
joined to the blocks' distinct parts, and go back to vectors by their places.

A part that a third of all vectors have is one row a block, so no key is hot. The same holds for
labels: a block sums its errors by label before they meet.

All arithmetic is exact: in doubles where every square is below 2**53, in Python's integers
beyond. Components are limited to +-2**62 and errors to 2**63 - 1, the largest long.

Defined cases: a null vector, and one with a component that is null, NaN or infinite, is dropped;
an empty vector has the error 0 and the code of entry 0; a vector whose length differs from that of
the first codebook vector has a null code, a null error and no part in the sums; a length that is no
multiple of the parts is filled up with zeros; null ids and labels are kept (null labels are one
label) and a null id comes after all others; of repeated ids all are kept, ordered by their
integers where the first codebook is drawn; with fewer vectors than entries the codebook is
shorter; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, written

#: Components of the vectors in one block.
BLOCK_VALUES = 1 << 19
BOUND, LONGEST = 2**62, 2**63 - 1
_PARTS = "array<struct<position int, place int, part array<long>, copies long>>"
_VECTORS = "array<struct<vec_id long, label string, places array<int>>>"


def _usable(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows whose vector holds finite numbers only."""
    vectors = batch.column("embedding")
    flat = np.asarray(pc.fill_null(pc.list_flatten(vectors), float("nan")), np.float64)
    sizes = np.asarray(pc.fill_null(pc.list_value_length(vectors), 0), np.int64)
    ends = np.cumsum(sizes)
    bad = np.append(0, np.cumsum(~np.isfinite(flat)))
    return batch.filter(pa.array((bad[ends] == bad[ends - sizes]) & np.asarray(vectors.is_valid())))


def _integers(vectors: pa.Array, parts: int) -> np.ndarray:
    """The vectors (all of one length) as rows of integers, filled up to a multiple of ``parts``."""
    flat = np.asarray(pc.list_flatten(vectors), np.float64)
    width = len(flat) // len(vectors)
    x = np.clip(np.floor(flat.reshape(len(vectors), width) * 256.0), -float(BOUND), float(BOUND)).astype(np.int64)
    return np.pad(x, ((0, 0), (0, -width % parts)))


def _blocks(vectors: DataFrame, parts: int, width: int) -> DataFrame:
    """One row a block: its vectors, each by the places of its parts, and its distinct parts."""

    def block(number: int, batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        x = _integers(batch.column("embedding"), parts)
        size = x.shape[1] // parts
        places, found = np.zeros((n, parts), np.int32), []
        for p in range(parts):
            own, back, copies = np.unique(x[:, p * size : (p + 1) * size], axis=0, return_inverse=True, return_counts=True)
            places[:, p] = back.reshape(-1)
            found.append((own, copies))
        many = [len(c) for _, c in found]
        values = pa.array(np.concatenate([own.reshape(-1) for own, _ in found]))
        shown = pa.StructArray.from_arrays(
            [
                pa.array(np.repeat(np.arange(parts, dtype=np.int32), many)),
                pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in many])),
                pa.ListArray.from_arrays(pa.array(np.arange(sum(many) + 1, dtype=np.int32) * size), values),
                pa.array(np.concatenate([c.astype(np.int64) for _, c in found])),
            ],
            names=["position", "place", "part", "copies"],
        )
        rows = pa.StructArray.from_arrays(
            [batch.column("vec_id"), batch.column("label"), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * parts), pa.array(places.reshape(-1)))],
            names=["vec_id", "label", "places"],
        )
        whole = lambda items: pa.ListArray.from_arrays(pa.array([0, len(items)], pa.int32()), items)
        return pa.RecordBatch.from_arrays([pa.array([number]), whole(rows), whole(shown)], names=["block", "vectors", "parts"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        step, waiting = max(1, BLOCK_VALUES // max(width, 1)), []
        for batch in batches:
            batch = _usable(batch)
            waiting.append(batch.filter(pc.equal(pc.list_value_length(batch.column("embedding")), width)))
            if sum(b.num_rows for b in waiting) < step:
                continue
            rows = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            whole = rows.num_rows // step * step
            for k in range(0, whole, step):
                yield block(number, rows.slice(k, step))
                number += 1
            waiting = [rows.slice(whole)]
        if sum(b.num_rows for b in waiting):
            for rows in pa.Table.from_batches(waiting).combine_chunks().to_batches():
                yield block(number, rows)
                number += 1

    return vectors.mapInArrow(cut, f"block long, vectors {_VECTORS}, parts {_PARTS}")


def _nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of integers the least index of its nearest entry, and the squared distance."""
    most = max((int(np.abs(a).max()) for a in (points, entries) if a.size), default=0)
    if 4 * max(1, points.shape[1]) * most * most < 1 << 53:
        a, b = points.astype(np.float64), entries.astype(np.float64)
        distance = (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]
        at = distance.argmin(1)
        return at, distance[np.arange(len(a)), at].astype(np.int64)
    a, b = points.astype(object), entries.astype(object)
    at, error = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    for i, row in enumerate(a):
        own = ((row - b) ** 2).sum(1) if points.shape[1] else np.zeros(len(b), np.int64)
        at[i] = min(range(len(b)), key=own.__getitem__)
        error[i] = min(own[at[i]], LONGEST)
    return at, error


def _points(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each position in a batch of parts: the rows and their integers."""
    position = np.asarray(batch.column("position"))
    flat = np.asarray(pc.list_flatten(batch.column("part")), np.int64)
    points = flat.reshape(len(position), -1)
    for p in np.unique(position):
        rows = np.flatnonzero(position == p)
        yield int(p), rows, points[rows]


def _round(distinct: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Each entry becomes the rounded-down mean of the parts nearest to it."""
    size = books[0].shape[1]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((len(b), size + 1), object) for b in books]
        for batch in batches:
            if not batch.num_rows:
                continue
            copies = np.asarray(batch.column("copies"), np.int64)
            for p, rows, points in _points(batch):
                at, _ = _nearest(points, books[p])
                values = np.column_stack([points, np.ones(len(rows), np.int64)])
                if int(np.abs(values).max()) * int(copies[rows].sum()) < LONGEST:
                    own = np.zeros((len(books[p]), size + 1), np.int64)
                    np.add.at(own, at, values * copies[rows][:, None])
                    sums[p] += own.astype(object)
                else:
                    np.add.at(sums[p], at, values.astype(object) * copies[rows].astype(object)[:, None])
        found = [(p, e, j, x) for p, own in enumerate(sums) for e, row in enumerate(own.tolist()) if row[-1] for j, x in enumerate(row)]
        columns = list(zip(*found, strict=True)) or [()] * 4
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.decimal128(38, 0)]
        columns[3] = [Decimal(x) for x in columns[3]]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["position", "entry", "j", "total"])

    added = distinct.mapInArrow(add, "position int, entry int, j int, total decimal(38,0)").groupBy("position", "entry", "j").agg(F.sum("total").cast("decimal(38,0)").alias("total"))
    totals = {(r.position, r.entry, r.j): int(r.total) for r in added.collect()}
    new = [b.copy() for b in books]
    for p, book in enumerate(new):
        for e in range(len(book)):
            if count := totals.get((p, e, size)):
                book[e] = [totals[p, e, j] // count for j in range(size)]
    return new


def _coded(distinct: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """Each distinct part with its entry and squared distance."""

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            code, error = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
            for p, rows, points in _points(batch):
                code[rows], error[rows] = _nearest(points, books[p])
            yield pa.RecordBatch.from_arrays([batch.column("position"), batch.column("part"), pa.array(code), pa.array(error)], names=["position", "part", "code", "error"])

    return distinct.select("position", "part").mapInArrow(give, "position int, part array<long>, code int, error long")


def _back(key: tuple, vectors: pa.Table, codes: pa.Table) -> pa.Table:
    """The vectors of one block with the codes and errors of their parts."""
    position, place = np.asarray(codes.column("position")), np.asarray(codes.column("place"))
    parts, most = int(position.max()) + 1, int(place.max()) + 1
    code, error = np.zeros((parts, most), np.uint8), np.zeros((parts, most), np.int64)
    code[position, place] = np.asarray(codes.column("code"))
    error[position, place] = np.asarray(codes.column("error"))
    rows = pa.concat_arrays([c.flatten() for c in vectors.column("vectors").chunks])
    places = np.asarray(pc.list_flatten(rows.field("places"))).reshape(len(rows), parts)
    each = error[np.arange(parts), places]
    if int(error.max()) < LONGEST // parts:
        total = each.sum(1)
    else:
        total = np.array([min(sum(r), LONGEST) for r in each.tolist()], np.int64)
    data = pa.FixedSizeBinaryArray.from_buffers(pa.binary(parts), len(rows), [None, pa.py_buffer(np.ascontiguousarray(code[np.arange(parts), places]))])
    return pa.table({"block": pa.array([key[0].as_py()] * len(rows), pa.int64()), "vec_id": rows.field("vec_id"), "label": rows.field("label"), "code": data.cast(pa.binary()), "error": pa.array(total)})


def _first_entries(vectors: DataFrame, parts: int, entries: int) -> tuple[list[np.ndarray], int]:
    """The codebooks to start with, and the vectors' length; of the kept vectors of the least ids."""

    def integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = _usable(batch)
            vectors = batch.column("embedding")
            flat = np.clip(np.floor(np.asarray(pc.list_flatten(vectors), np.float64) * 256.0), -float(BOUND), float(BOUND)).astype(np.int64)
            ends = np.append(0, np.cumsum(np.asarray(pc.list_value_length(vectors), np.int64))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["vec_id", "x"])

    order = [F.col("vec_id").asc_nulls_last(), F.col("x").asc()]
    kept = vectors.select("vec_id", "embedding").mapInArrow(integers, "vec_id long, x array<long>")
    rows = [r.x for r in kept.orderBy(*order).limit(entries).collect()]
    if not rows:
        return [], 0
    width = len(rows[0])
    if any(len(x) != width for x in rows):
        rows = [r.x for r in kept.where(F.size("x") == width).orderBy(*order).limit(entries).collect()]
    x = np.array(rows, np.int64).reshape(len(rows), width)
    x = np.pad(x, ((0, 0), (0, -width % parts)))
    size = x.shape[1] // parts
    return [x[:, p * size : (p + 1) * size].copy() for p in range(parts)], width


def compressed(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> tuple[DataFrame, list[np.ndarray]]:
    """vec_id, label, code (a byte for each part), error, label_error; and the codebooks by part.

    ``vectors``: vec_id, embedding (array of numbers), label. ``entries`` is at most 256.
    """
    if not 1 <= entries <= 256 or parts < 1:
        raise ValueError("entries go from 1 to 256, parts from 1 up")
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    books, width = _first_entries(given, parts, entries)
    blocks = written(_blocks(given, parts, width), "vector-blocks")
    named = blocks.select("block", F.inline("parts"))
    distinct = written(named.groupBy("position", "part").agg(F.sum("copies").alias("copies")), "vector-parts")
    for _ in range(rounds if books else 0):
        books = _round(distinct, books)
    codes = named.select(F.col("block").alias("of_block"), "position", "place", "part").join(_coded(distinct, books), ["position", "part"])
    back = (
        blocks.select("block", "vectors")
        .groupBy("block")
        .cogroup(codes.select("of_block", "position", "place", "code", "error").groupBy("of_block"))
        .applyInArrow(_back, "block long, vec_id long, label string, code binary, error long")
    )
    coded = written(back, "vector-codes")
    dropped(blocks, distinct)
    inside = coded.groupBy(F.col("block").alias("own_block"), F.col("label").alias("own_label")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("own_error"))
    most = F.lit(LONGEST).cast("decimal(38,0)")
    labels = inside.groupBy(F.col("own_label").alias("all_label")).agg(F.least(F.sum("own_error").cast("decimal(38,0)"), most).cast("long").alias("label_error"))
    by_block = inside.join(labels, F.col("own_label").eqNullSafe(F.col("all_label")))
    result = coded.join(by_block, (F.col("block") == F.col("own_block")) & F.col("label").eqNullSafe(F.col("own_label"))).select("vec_id", "label", "code", "error", "label_error")
    other = given.mapInArrow(lambda batches: _misfits(batches, width), "vec_id long, label string")
    return result.unionByName(other, allowMissingColumns=True), books


def _misfits(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Kept vectors of another length than the codebooks'."""
    for batch in batches:
        batch = _usable(batch)
        yield batch.filter(pc.not_equal(pc.list_value_length(batch.column("embedding")), width)).select(["vec_id", "label"])


def books_sha256(books: list[np.ndarray]) -> str:
    """Of all entries' decimal integers by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(int(x)) for book in books for x in book.reshape(-1)).encode()).hexdigest()
