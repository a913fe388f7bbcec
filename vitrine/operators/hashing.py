"""Texts as vectors of hashed terms, and exact nearest neighbours among them.

A term's digest names its place and its sign; its weight, 1 and an eighth for each letter up to eight, is added
there. Weights are kept in eighths, as integers, so sums and products are exact and
do not hang on the order of terms, batches or tasks. A vector is sparse: its places in order and the eighths there.

Defined cases: null and empty texts, and texts whose terms cancel out, have no place, norm 0 and a cosine of 0 with all;
repeated rows are rows; ties in the cosine go to the lower id; a row without an id is no neighbour; no rows give no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions.text import search_tokens
from vitrine.session import kept as written

from .ranking import top_k
from .vectors import QUERIES, Best

#: Bytes of query vectors, and of what is best for them so far, that a task holds at once, and rows that are multiplied at once.
BLOCK_BYTES, CHUNK = 32 << 20, 1024


def hashed(terms: pa.Array, places: int) -> tuple[np.ndarray, np.ndarray]:
    """The place of each term and what it adds there, in eighths."""
    digests = b"".join(hashlib.sha256(t).digest() for t in terms.cast(pa.binary()).to_numpy(zero_copy_only=False))
    digests = np.frombuffer(digests, np.uint8).reshape(-1, 32)
    weights = 8 + np.minimum(pc.utf8_length(terms).to_numpy(), 8).astype(np.int64)
    return digests[:, :4].copy().view("<u4")[:, 0].astype(np.int64) % places, np.where(digests[:, 4] % 2, -weights, weights)


def embedded(rows: DataFrame, item: str, terms: Column | None = None, text: str = "text", places: int = 384) -> DataFrame:
    """``item``, places array<int>, eighths array<int> of each row, where its text is read. Each distinct term counts once."""
    own = F.array_distinct(terms if terms is not None else search_tokens(F.coalesce(F.col(text), F.lit(""))))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, CHUNK) for b in batches for at in range(0, b.num_rows, CHUNK)):
            lists = batch.column(1)
            coded = lists.flatten().dictionary_encode()
            place, weight = hashed(coded.dictionary, places)
            term = coded.indices.to_numpy()
            row = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
            # One sum a row and place, exact in floats; those that cancel out are no places.
            sums = np.bincount(row * places + place[term], weight[term], len(lists) * places)
            cells = np.flatnonzero(sums)
            sums = sums[cells]
            offsets = pa.array(np.searchsorted(cells, np.arange(len(lists) + 1) * places).astype(np.int32))
            listed = lambda v: pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), listed(cells % places), listed(sums)], names=[item, "places", "eighths"])

    return rows.select(F.col(item).cast("long").alias(item), own.alias("terms")).mapInArrow(vectors, f"{item} long, places array<int>, eighths array<int>")


def norm(eighths: Column) -> Column:
    """The length of a vector before it is scaled to 1."""
    return F.sqrt(F.aggregate(eighths, F.lit(0).cast("long"), lambda acc, e: acc + e.cast("long") * e)) / 8


def _dense(lists: pa.ListArray, values: pa.ListArray, places: int, kind: type = float) -> np.ndarray:
    matrix = np.zeros((len(lists), places), kind)
    row = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
    matrix[row, lists.flatten().to_numpy()] = values.flatten().to_numpy()
    return matrix


def _squares(lists: pa.ListArray, values: pa.ListArray) -> np.ndarray:
    row = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
    return np.bincount(row, values.flatten().to_numpy().astype(float) ** 2, len(lists))


def _units(matrix: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in four bytes a place; those without length stay 0."""
    scale = np.divide(1, size, out=np.zeros(len(size)), where=size > 0).astype(np.float32)
    return matrix.astype(np.float32) * scale[:, None]


def _scorer(ids: np.ndarray, places_of: pa.ListArray, eighths: pa.ListArray, k: int, item: str, places: int, skip_self: bool, least: np.ndarray | None = None) -> Callable:
    """The step of a task. Cosines are multiplied in four bytes first; what these and their error leave as possible is multiplied exactly.

    ``least``: of each query a cosine that its k-th neighbour has or exceeds.
    """
    # Rounding of two unit vectors and of their product, each sum of ``places`` terms, with a factor of two to spare.
    slack = (places + 8) * 2.0**-23

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, sizes = _dense(places_of, eighths, places, np.int32), np.sqrt(_squares(places_of, eighths))
        units, blank = _units(asked, sizes), sizes == 0
        kept = Best(len(ids), k)
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                own = part.column(0).to_numpy()
                rows, lengths = _dense(part.column(1), part.column(2), places, np.int32), np.sqrt(_squares(part.column(1), part.column(2)))
                turned = _units(rows, lengths).T
                mine = np.flatnonzero(np.isin(own, ids)) if skip_self else own[:0]
                by_id = np.argsort(own, kind="stable") if blank.any() else own[:0]
                for start in range(0, len(ids), QUERIES):
                    some = slice(start, start + QUERIES)
                    near = units[some] @ turned
                    q, r = np.nonzero(ids[some, None] == own[mine])
                    near[q, mine[r]] = -np.inf
                    for q in np.flatnonzero(blank[some]):
                        # All cosines are 0: the lowest ids.
                        low = by_id[np.isfinite(near[q, by_id])][:k]
                        near[q] = -np.inf
                        near[q, low] = 0
                    bar = kept.scores[some, -1] if least is None else np.maximum(kept.scores[some, -1], least[some])
                    better = (near >= np.nextafter((bar - slack).astype(np.float32), np.float32(-np.inf))[:, None])
                    if len(own) > k and better.sum() > 4 * k * len(near):
                        better &= near >= np.partition(near, len(own) - k, axis=1)[:, len(own) - k, None] - np.float32(2 * slack)
                    query, row = np.divmod(np.flatnonzero(better), len(own))
                    ok = np.isfinite(near[query, row])
                    query, row = query[ok], row[ok]
                    for first in range(0, len(query), CHUNK):
                        q, r = query[first : first + CHUNK] + start, row[first : first + CHUNK]
                        dot = (asked[q].astype(float) * rows[r]).sum(1)
                        size = sizes[q] * lengths[r]
                        score = np.divide(dot, size, out=np.zeros(len(q)), where=size > 0)
                        ok = score >= (-np.inf if least is None else least[q])
                        kept.take(q[ok], own[r[ok]], score[ok])
        yield from kept.rows(ids, item)

    return best


def least_copies(rows: DataFrame, text: Column, k: int, item: str = "doc_id") -> DataFrame:
    """Of rows with equal text the k of the lowest ids: their vectors are equal, so no other is among the k nearest of anything."""
    order = Window.partitionBy("__text").orderBy(item)
    return rows.where(F.col(item).isNotNull()).withColumn("__text", text).withColumn("__place", F.row_number().over(order)).where(F.col("__place") <= k).drop("__text", "__place")


def nearest(rows: DataFrame, queries: DataFrame, k: int, item: str = "doc_id", places: int = 384, skip_self: bool = True, first: int = 0) -> DataFrame:
    """query_id, ``item``, score (cosine), rank of the k nearest rows of each query; both sides are ``embedded``.

    Queries are taken in blocks of bounded bytes by hash of their id, and the sparse rows are multiplied with some queries of a
    block at a time where they are read. k rows of each query leave a task. Where there are several blocks, each one's result is
    written before the next is read, so the driver and a task hold one block at a time.

    ``first``: so many of the rows, one in each, are searched before all are. Their k-th neighbour is a bound of a query's own, so
    that tasks pass over, and do not send, what cannot be among its k; it takes nothing from the result.
    """
    count = queries.count()
    schema = f"query_id long, {item} long, score double"
    blocks = max(1, -(-count * (places * 8 + k * 16) // BLOCK_BYTES))
    known = rows.where(F.col(item).isNotNull()).select(item, "places", "eighths")
    found = None
    for b in range(blocks):
        part = queries.where(F.col(item).isNotNull() & (F.pmod(F.xxhash64(item), F.lit(blocks)) == b)).select(item, "places", "eighths").toArrow().combine_chunks()
        if not part.num_rows:
            continue
        ids, lists, values = (part.column(c).combine_chunks() for c in (item, "places", "eighths"))
        ids, least = ids.to_numpy(), None
        if first:
            some = known.where(F.pmod(F.xxhash64(item, F.lit(first)), F.lit(first)) == 0).mapInArrow(_scorer(ids, lists, values, k, item, places, skip_self), schema)
            bound = top_k(some, k, item=item).where(F.col("rank") == k).select("query_id", "score").toArrow()
            have = bound.column("query_id").to_numpy()
            order = np.argsort(have)
            at = np.minimum(np.searchsorted(have, ids, sorter=order), max(len(have) - 1, 0))
            least = np.full(len(ids), -np.inf)
            if len(have):
                least = np.where(have[order][at] == ids, bound.column("score").to_numpy()[order][at], -np.inf)
        own = known.mapInArrow(_scorer(ids, lists, values, k, item, places, skip_self, least), schema)
        own = written(own, "nearest") if blocks > 1 else own
        found = own if found is None else found.unionByName(own)
    found = rows.sparkSession.createDataFrame([], schema) if found is None else found
    return top_k(found, k, item=item)
