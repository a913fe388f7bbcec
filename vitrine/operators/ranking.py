"""Ranked retrieval: inverted index, BM25, lexical overlap, fusion, top-k."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions.text import search_tokens as tokens

#: Fixed values of the ranking formula.
K1, B, EPSILON = 1.5, 0.75, 0.25
#: Fixed value of reciprocal rank fusion.
RRF_K = 60
#: Bytes of the weights of one block of queries, which a task holds.
BLOCK_BYTES = 64 << 20
#: Documents that are scored at once.
CHUNK = 1024


def postings(docs: DataFrame, doc_id: str, text: str, positions: bool = False) -> DataFrame:
    """term, doc_id, tf, dl (tokens of the document), and positions if asked for.

    A document's counts never meet another's, so the partial sums of a scan are complete and the
    shuffle moves a row for each distinct term of a document, not for each token.
    """
    row = docs.select(F.col(doc_id).alias("doc_id"), tokens(F.col(text)).alias("all"))
    each = row.select("doc_id", F.size("all").cast("long").alias("dl"), F.posexplode("all").alias("pos", "term"))
    found = [F.count(F.lit(1)).alias("tf"), F.min("dl").alias("dl")]
    if positions:
        found.append(F.array_join(F.transform(F.sort_array(F.collect_list("pos")), lambda p: p.cast("string")), ",").alias("positions"))
    return each.groupBy("doc_id", "term").agg(*found)


def index_stats(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row: n_docs, total_len, avgdl."""
    return docs.select(F.size(tokens(F.col(text))).cast("long").alias("dl")).agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("dl").alias("total_len"), F.avg("dl").alias("avgdl")
    )


def frequencies(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The index's statistics: df of each term, and n_docs under the term null."""
    row = docs.select(F.col(doc_id).alias("doc_id"), F.array_distinct(tokens(F.col(text))).alias("all"))
    # An empty term for each document counts the documents in the same pass.
    each = row.select(F.explode(F.concat(F.array(F.lit("")), "all")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return each.select(F.when(F.col("term") != "", F.col("term")).alias("term"), "df")


def changed(index: DataFrame, gone: DataFrame, new: DataFrame | None, doc_id: str, text: str) -> DataFrame:
    """term, df and n_docs of an index (``frequencies``) after texts have gone and others have come; terms of no text are dropped."""
    delta = frequencies(gone, doc_id, text).withColumn("df", -F.col("df"))
    both = index.unionByName(delta) if new is None else index.unionByName(delta).unionByName(frequencies(new, doc_id, text))
    total = both.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
    count = total.where("term IS NULL").select(F.col("df").alias("n_docs"))
    return total.where("term IS NOT NULL").crossJoin(F.broadcast(count))  # one row


def idf(n: Column, df: Column) -> Column:
    return F.greatest(F.log((n - df + 0.5) / (df + 0.5) + 1), F.lit(EPSILON))


@dataclass
class Asked:
    """A block of queries: their ids, the terms that they use, and how often each query has each term."""

    ids: np.ndarray
    terms: pa.Array
    times: np.ndarray

    def places(self, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """Of each token that a query uses: which list it is in and which term it is."""
        at = pc.index_in(lists.flatten(), self.terms)
        row = np.repeat(np.arange(len(lists)), np.asarray(pc.fill_null(pc.list_value_length(lists), 0)))
        known = np.asarray(at.is_valid())
        return row[known], np.asarray(pc.fill_null(at, 0)).astype(np.int64)[known]


def blocks(queries: DataFrame, query_id: str, query_text: str) -> Iterator[Asked]:
    """The queries, so many at a time that their weights stay within BLOCK_BYTES."""
    own = queries.select(F.col(query_id).cast("long").alias("query_id"), tokens(F.col(query_text)).alias("terms"))
    count, total = own.agg(F.count(F.lit(1)), F.sum(F.size("terms"))).first()
    # n queries of m terms each take 8 * n * n * m bytes at most.
    n = max(1, int(np.ceil(np.sqrt(8.0 * count * (total or 0) / BLOCK_BYTES))))
    for b in range(n):
        part = own.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == b).toArrow().combine_chunks()
        if part.num_rows:
            lists = part.column("terms").combine_chunks()
            flat = lists.flatten()
            block = Asked(part.column("query_id").to_numpy(), pc.unique(flat), np.zeros((0, 0)))
            row, term = block.places(lists)
            block.times = np.zeros((len(block.terms), part.num_rows))
            np.add.at(block.times, (term, row), 1)
            yield block


def term_statistics(tokenised: DataFrame, asked: Asked) -> tuple[int, float, np.ndarray]:
    """Documents, their mean length, and how many have each of the block's terms. One partial sum leaves each task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, rows, length = np.zeros(len(asked.terms), np.int64), 0, 0
        for batch in batches:
            lists = batch.column(1)
            row, term = asked.places(lists)
            df += np.bincount(np.unique(row * len(asked.terms) + term) % len(asked.terms), minlength=len(asked.terms)) if len(row) else 0
            rows, length = rows + batch.num_rows, length + len(lists.flatten())
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([at, [-1, -2]])), pa.array(np.concatenate([df[at], [rows, length]]))], names=["term", "n"])

    sums = tokenised.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = sums.column("term").to_numpy(), sums.column("n").to_numpy()
    df = np.zeros(len(asked.terms), np.int64)
    df[term[term >= 0]] = n[term >= 0]
    rows, length = int(n[term == -1].sum()), int(n[term == -2].sum())
    return rows, length / max(rows, 1), df


def _best(kept: tuple[np.ndarray, np.ndarray], ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each query (column): those kept before and those of more documents. Score descending, then id."""
    all_ids = np.concatenate([kept[0], np.broadcast_to(ids[:, None], scores.shape)])
    all_scores = np.concatenate([kept[1], scores])
    order = np.lexsort((all_ids, -all_scores), axis=0)[:k]
    return np.take_along_axis(all_ids, order, 0), np.take_along_axis(all_scores, order, 0)


def scored(docs: DataFrame, queries: DataFrame, doc_id: str, text: str, query_id: str, query_text: str, k: int) -> DataFrame:
    """route, query_id, doc_id, score, rank: the k best documents of each query by "bm25" and by "overlap" (its distinct terms that the document has).

    Texts are scored where they are read: one pass counts the queries' terms, a second multiplies each
    chunk of documents with the block's weights, and k rows of each query leave a task. No posting is
    dealt, so a term that is in every text costs as much as any other. Repeated query terms add again.
    """
    tokenised = docs.select(F.col(doc_id).cast("long").alias("doc_id"), tokens(F.coalesce(F.col(text), F.lit(""))).alias("all"))
    found = None
    for asked in blocks(queries, query_id, query_text):
        n, avgdl, df = term_statistics(tokenised, asked)
        rarity = np.maximum(np.log((n - df + 0.5) / (df + 0.5) + 1), EPSILON)

        def score(batches: Iterator[pa.RecordBatch], asked: Asked = asked, rarity: np.ndarray = rarity, avgdl: float = avgdl) -> Iterator[pa.RecordBatch]:
            weights = {"bm25": asked.times * rarity[:, None], "overlap": np.minimum(asked.times, 1)}
            kept = {r: (np.zeros((0, len(asked.ids)), np.int64), np.zeros((0, len(asked.ids)))) for r in weights}
            for batch in batches:
                for at in range(0, batch.num_rows, CHUNK):
                    part = batch.slice(at, CHUNK)
                    lists = part.column(1)
                    row, term = asked.places(lists)
                    tf = np.bincount(row * len(asked.terms) + term, minlength=part.num_rows * len(asked.terms)).reshape(part.num_rows, -1).astype(float)
                    length = np.asarray(pc.list_value_length(lists)).astype(float)
                    damped = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / max(avgdl, 1e-9))[:, None])
                    for route, matrix in (("bm25", damped), ("overlap", np.minimum(tf, 1))):
                        kept[route] = _best(kept[route], part.column(0).to_numpy(), np.round(matrix @ weights[route], 6), k)
            for route, (ids, scores) in kept.items():
                ok = scores > 0
                query = np.broadcast_to(asked.ids, ids.shape)[ok]
                yield pa.RecordBatch.from_arrays([pa.array([route] * len(query), pa.string()), pa.array(query), pa.array(ids[ok]), pa.array(scores[ok])], names=["route", "query_id", "doc_id", "score"])

        part = tokenised.where("doc_id IS NOT NULL").mapInArrow(score, "route string, query_id long, doc_id long, score double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], "route string, query_id long, doc_id long, score double, rank long")
    order = Window.partitionBy("route", "query_id").orderBy(F.desc("score"), F.asc("doc_id"))
    return found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def top_k(scored: DataFrame, k: int, by: str = "query_id", item: str = "doc_id") -> DataFrame:
    """Rank 1 to k of each query by score, ties by item. Spark limits each partition before the shuffle."""
    order = Window.partitionBy(by).orderBy(F.desc("score"), F.asc(item))
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def rrf(ranked: DataFrame) -> DataFrame:
    """query_id, doc_id, score: the sum over a document's places in the routes' lists of 1 / (60 + rank)."""
    return ranked.groupBy("query_id", "doc_id").agg(F.round(F.sum(1 / (F.lit(RRF_K) + F.col("rank"))), 6).alias("score"))


def both(ranked: DataFrame) -> DataFrame:
    """query_id, doc_id, a, b: the scores of both routes in one aggregate over ``scored``, a missing score is 0."""
    of = lambda route: F.coalesce(F.max(F.when(F.col("route") == route, F.col("score"))), F.lit(0.0))
    return ranked.groupBy("query_id", "doc_id").agg(of("bm25").alias("a"), of("overlap").alias("b"))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def clipped(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
