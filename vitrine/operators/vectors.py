"""Exact nearest neighbours: blocks of query vectors against all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import top_k

#: Bytes of query vectors, and of what is best for them so far, that a task holds at once.
BLOCK_BYTES = 32 << 20
#: Rows and queries that are multiplied at once.
ROWS, QUERIES = 2048, 512
#: A score rounded to ``DECIMALS`` is no further than this from what it was.
DECIMALS, SLACK = 6, 1.1e-6


class Best:
    """The k best rows of each of ``count`` queries so far: score descending, then id. ``slack`` is how far ``rounded`` can move a score."""

    def __init__(self, count: int, k: int, slack: float = 0.0, decimals: int | None = None):
        self.k, self.slack, self.decimals = k, slack, decimals
        self.ids = np.full((count, k), np.iinfo(np.int64).max)
        self.scores = np.full((count, k), -np.inf)

    def add(self, start: int, own: np.ndarray, scores: np.ndarray) -> None:
        """More rows, ``own``, with their scores for the queries from ``start`` on (a row each)."""
        count, n = scores.shape
        held = self.scores[start : start + count]
        # Only what can beat a query's k-th so far, of those held or of these rows, is rounded and sorted.
        better = scores >= held[:, -1:] - self.slack
        if n > self.k and better.sum() > 4 * self.k * count:
            better &= scores >= np.partition(scores, n - self.k, axis=1)[:, n - self.k, None] - self.slack
        query, row = np.nonzero(better)
        near, score = own[row], scores[query, row]
        if self.decimals is not None:
            score = np.round(score, self.decimals)
        self.take(query + start, near, score)

    def take(self, query: np.ndarray, near: np.ndarray, score: np.ndarray) -> None:
        """Single rows, ``near``, each with its score for one query."""
        ids, held = self.ids, self.scores
        ok = (score > held[query, -1]) | ((score == held[query, -1]) & (near < ids[query, -1]))
        query, near, score = query[ok], near[ok], score[ok]
        if not len(query):
            return
        some = np.unique(query)
        query = np.append(np.repeat(some, self.k), query)
        near, score = np.append(ids[some].ravel(), near), np.append(held[some].ravel(), score)
        order = np.lexsort((near, -score, query))
        first = np.searchsorted(query[order], some)
        take = order[first[:, None] + np.arange(self.k)]
        ids[some], held[some] = near[take], score[take]

    def rows(self, queries: np.ndarray, item: str) -> Iterator[pa.RecordBatch]:
        """query_id, ``item``, score of what was found, some queries at a time."""
        for at in range(0, len(queries), QUERIES):
            ids, scores = self.ids[at : at + QUERIES], self.scores[at : at + QUERIES]
            ok = np.isfinite(scores)
            query = np.broadcast_to(queries[at : at + QUERIES, None], ids.shape)[ok]
            yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(ids[ok]), pa.array(scores[ok])], names=["query_id", item, "score"])


def _vectors(lists: pa.ListArray, count: int) -> np.ndarray:
    return np.asarray(lists.flatten()).reshape(count, -1)


def nearest(rows: DataFrame, queries: DataFrame, k: int, measure: str = "cosine", item: str = "vec_id", vector: str = "embedding", skip_self: bool = True) -> DataFrame:
    """query_id, item, score, rank of the k nearest rows of each query.

    Queries are taken in blocks of bounded bytes, by hash of their id. A task multiplies some rows
    with some queries of the block at a time and keeps the k best of each query, so what it holds hangs neither on
    the rows nor on the number of queries; the k best of all tasks are the result. Rows are never shuffled.
    """
    count, width = queries.agg(F.count(F.lit(1)), F.max(F.size(vector))).first()
    if not count:
        return queries.sparkSession.createDataFrame([], f"query_id long, {item} long, score double, rank long")
    blocks = -(-count * ((width or 1) * 8 + k * 16) // BLOCK_BYTES)
    found = None
    for b in range(blocks):
        part = queries.where(F.pmod(F.xxhash64(item), F.lit(blocks)) == b).select(item, vector).toArrow()
        ids = part.column(item).to_numpy()
        asked = _vectors(part.column(vector).combine_chunks(), len(ids))

        def best(batches: Iterator[pa.RecordBatch], ids: np.ndarray = ids, asked: np.ndarray = asked) -> Iterator[pa.RecordBatch]:
            kept = Best(len(ids), k, SLACK, DECIMALS)
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    part = batch.slice(at, ROWS)
                    own = part.column(0).to_numpy()
                    data = _vectors(part.column(1), len(own)).astype(float)
                    lengths, squared = np.linalg.norm(data, axis=1), (data**2).sum(1)
                    for start in range(0, len(ids), QUERIES):
                        some = asked[start : start + QUERIES].astype(float)
                        scores = some @ data.T
                        if measure == "cosine":
                            size = np.outer(np.linalg.norm(some, axis=1), lengths)
                            scores = np.divide(scores, size, out=np.zeros_like(scores), where=size > 0)
                        else:
                            squares = (some**2).sum(1)[:, None] + squared - 2 * scores
                            scores = 1 - np.sqrt(np.maximum(squares, 0) / some.shape[1])
                        if skip_self:
                            scores[ids[start : start + QUERIES, None] == own] = -np.inf
                        kept.add(start, own, scores)
            yield from kept.rows(ids, item)

        part = rows.select(F.col(item).cast("long").alias(item), vector).mapInArrow(best, f"query_id long, {item} long, score double")
        found = part if found is None else found.unionByName(part)
    return top_k(found, k, item=item)
