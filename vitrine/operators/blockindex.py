"""A stored index with block maxima: written once, searched by term.

Documents are dealt to lanes of ``LANE`` in the order in which they are read, so a lane's blocks are made where
its texts are. A block is what one term has in one lane: the documents' places in the lane with their counts, in
4 bytes each, and two numbers that bound what it can add to a score, its greatest count and its least text
length. A lane's ids and lengths are stored once. Terms are in buckets by their hash, a
folder each, so a search opens the folders of its own terms only; in a folder blocks are sorted
by term and lane. A term that is in a third of all documents is many blocks, dealt to ``parts`` files.

A search first reads terms, lanes and bounds alone. The sum of a query's bounds in a lane is at least
the score of every document there. The ``SEEDS`` lanes with the highest sums are scored in
full and give each query its k-th best score so far; after that only lanes whose sum reaches
that score are. No document that could be among the k best is passed over.

Defined cases: a null text has no terms but counts as a document; a null id is left out, from the statistics
too; rows of one id are documents of their own; empty tables give empty indexes and no rows; a
query without known terms, or with a null id, has no rows; equal scores go by document id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitrine.functions.text import search_tokens as tokens
from vitrine.session import kept

from .ranking import EPSILON, K1, B, top_k

LANE, SEEDS = 512, 4
#: Documents for each folder, for each file of one folder, and queries scored together in a lane.
FOLDER, FILE, TOGETHER = 8192, 1 << 22, 1000
#: Half of the last digit of a rounded score: a bound this much lower may still be reached.
SLACK = 1e-6
#: The folder of the lanes' ids and lengths.
LANES = -1
SCHEMAS = {
    "blocks": "term string, lane long, df int, most_tf long, least_dl long, data binary, bucket int",
    "terms": "term string, df long, bucket int",
}


def _lane_rows(size: int, lane: int, ids: np.ndarray, lists: pa.ListArray) -> pa.RecordBatch:
    """The blocks of one lane, and a row without a term for its ids and lengths."""
    length = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
    words = lists.flatten().dictionary_encode()
    row = np.repeat(np.arange(len(ids)), length)
    pair, tf = np.unique(np.asarray(words.indices, np.int64) * size + row, return_counts=True)
    term, place = np.divmod(pair, size)
    first = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(term)))
    packed = tf * size + place
    wide = len(packed) and int(packed.max()) >= 1 << 32
    data = packed.astype("<u8" if wide else "<u4")
    most = np.maximum.reduceat(tf, first) if len(first) else first
    least = np.minimum.reduceat(length[place], first) if len(first) else first
    offsets = np.append(first, len(term)) * data.itemsize
    whole = np.concatenate([ids, length]).astype("<i8").tobytes()
    blocks = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())
    columns = [
        pa.concat_arrays([words.dictionary.take(pa.array(term[first])), pa.array([None], pa.string())]),
        pa.array([lane] * (len(first) + 1), pa.int64()),
        pa.array([*n.tolist(), len(ids)], pa.int32()),
        pa.array([*most.tolist(), 0], pa.int64()),
        pa.array([*least.tolist(), int(length.sum())], pa.int64()),
        pa.concat_arrays([blocks, pa.array([whole], pa.binary())]),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["term", "lane", "df", "most_tf", "least_dl", "data"])


def _pack(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lane = TaskContext.get().partitionId() << 32
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            part = batch.slice(at, size)
            yield _lane_rows(size, lane, np.asarray(part.column(0), np.int64), part.column(1))
            lane += 1


def write(docs: DataFrame, doc_id: str, text: str, path: str, lane: int = LANE) -> None:
    """Three tables below ``path``: a summary (one row), terms with their document frequencies, blocks."""
    spark = docs.sparkSession
    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), tokens(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("words"))
    n_docs = rows.count()
    buckets, parts = min(max(n_docs // FOLDER, 16), 1 << 16), n_docs // FILE + 1
    blocks = rows.mapInArrow(lambda batches: _pack(lane, batches), "term string, lane long, df int, most_tf long, least_dl long, data binary")
    blocks = blocks.withColumn("bucket", F.when(F.col("term").isNull(), LANES).otherwise(_bucket(buckets)))
    dealt = blocks.repartition("bucket", F.pmod(F.xxhash64("lane"), F.lit(parts))).sortWithinPartitions("bucket", "term", "lane")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/blocks")
    stored = spark.read.schema(SCHEMAS["blocks"]).parquet(f"{path}/blocks")
    total = stored.where(F.col("bucket") == LANES).agg(F.coalesce(F.sum("least_dl"), F.lit(0))).first()[0]
    spark.createDataFrame([(n_docs, max(total / max(n_docs, 1), 1e-9), buckets, lane)], "n_docs long, average double, buckets int, lane int").write.mode("overwrite").parquet(f"{path}/summary")
    frequencies = stored.where(F.col("bucket") != LANES).groupBy("bucket", "term").agg(F.sum("df").alias("df"))
    frequencies.sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")


class Index:
    """A stored index, opened; its summary is one row."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.n_docs, self.average, self.buckets, self.lane = spark.read.parquet(f"{path}/summary").first()

    def asked(self, queries: DataFrame, query_id: str, query_text: str) -> DataFrame:
        """query_id, term, times, bucket of each query's terms."""
        each = queries.where(F.col(query_id).isNotNull()).select(F.col(query_id).cast("long").alias("query_id"), F.explode(tokens(F.col(query_text))).alias("term"))
        return each.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times")).withColumn("bucket", _bucket(self.buckets))

    def folders(self, asked: DataFrame) -> list[int]:
        """The buckets of some terms: at most as many numbers as the index has folders."""
        return sorted(r.bucket for r in asked.select("bucket").distinct().collect())

    def table(self, what: str, folders: list[int]) -> DataFrame:
        """Blocks or terms, of some folders only."""
        return self.spark.read.schema(SCHEMAS[what]).parquet(f"{self.path}/{what}").where(F.col("bucket").isin(folders))

    def weighted(self, asked: DataFrame, folders: list[int]) -> DataFrame:
        """query_id, bucket, term, weight: times the term's rarity."""
        df = F.col("df")
        rarity = F.greatest(F.log((self.n_docs - df + 0.5) / (df + 0.5) + 1), F.lit(EPSILON))
        return asked.join(self.table("terms", folders), ["bucket", "term"]).select("query_id", "bucket", "term", (F.col("times") * rarity).alias("weight"))

    def bounds(self, weighted: DataFrame, folders: list[int]) -> DataFrame:
        """query_id, lane, bound: what a document of the lane can score at most."""
        blocks = self.table("blocks", folders).select("bucket", "term", "lane", "most_tf", "least_dl")
        tf = F.col("most_tf")
        impact = tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("least_dl") / self.average))
        return weighted.join(blocks, ["bucket", "term"]).groupBy("query_id", "lane").agg(F.sum(F.col("weight") * impact).alias("bound"))


def _score(size: int, average: float, k: int, blocks: pa.Table, asked: pa.Table) -> pa.Table:
    """The k best of each query in one lane. blocks: those of any query's terms, and the lane's ids and lengths, which have no term."""
    out: tuple[list, list, list] = ([], [], [])
    own = {t: (n, d) for t, n, d in zip(*(blocks.column(c).to_pylist() for c in ("term", "df", "data")), strict=True)} if asked.num_rows else {}
    if None in own:
        both = np.frombuffer(own[None][1], "<i8")
        ids, length = both[: len(both) // 2], both[len(both) // 2 :]
        norm = K1 * (1 - B + B * length / average)
        queries, at = np.unique(np.asarray(asked.column("query_id"), np.int64), return_inverse=True)
        scores = np.zeros((len(queries), len(ids)))
        asks: dict[str, list[tuple[int, float]]] = {}
        for q, term, weight in zip(at.reshape(-1).tolist(), asked.column("term").to_pylist(), asked.column("weight").to_pylist(), strict=True):
            asks.setdefault(term, []).append((q, weight))
        for term, uses in asks.items():
            if term in own:
                n, data = own[term]
                tf, place = np.divmod(np.frombuffer(data, "<u8" if len(data) == 8 * n else "<u4").astype(np.int64), size)
                part = tf * (K1 + 1) / (tf + norm[place])
                for q, weight in uses:
                    scores[q, place] += weight * part
        for q, row in zip(queries.tolist(), np.round(scores, 6), strict=True):
            best = np.lexsort((ids, -row))[:k]
            best = best[row[best] > 0]
            out[0].extend([q] * len(best))
            out[1].extend(ids[best].tolist())
            out[2].extend(row[best].tolist())
    return pa.table({"query_id": pa.array(out[0], pa.int64()), "doc_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})


def search(spark: SparkSession, path: str, queries: DataFrame, query_id: str, query_text: str, k: int, seeds: int = SEEDS) -> DataFrame:
    """query_id, doc_id, score, rank: the k best documents of each query, from the stored index alone.

    A block leaves its file once, whatever the number of queries that ask for its term; bounds and the first
    scores are written, so they are worked out once.
    """
    index = Index(spark, path)
    asked = index.asked(queries, query_id, query_text)
    folders = index.folders(asked)
    weighted = kept(index.weighted(asked, folders), "index-weights")
    bounds = kept(index.bounds(weighted, folders), "index-bounds")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "lane"))
    seeded = bounds.withColumn("place", place).where(F.col("place") <= seeds).select("query_id", "lane")
    size, average, groups = index.lane, index.average, max(1, -(-queries.count() // TOGETHER))
    terms = weighted.select("bucket", "term").distinct()
    blocks = index.table("blocks", folders).join(terms, ["bucket", "term"], "left_semi").select("term", F.col("lane").alias("of_lane"), "df", "data")
    blocks = blocks.unionByName(index.table("blocks", [LANES]).select("term", F.col("lane").alias("of_lane"), "df", "data"))

    def score(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        return _score(size, average, k, left, right)

    def scored(chosen: DataFrame) -> DataFrame:
        """The k best of each query in some of its lanes."""
        own = blocks.join(chosen.select("lane").distinct(), F.col("of_lane") == F.col("lane"), "left_semi")
        own = own.select("of_lane", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<bigint>")).alias("of_part"), "term", "df", "data")
        uses = chosen.join(weighted, "query_id").select("lane", F.pmod(F.xxhash64("query_id"), F.lit(groups)).alias("part"), "query_id", F.col("term").alias("term"), "weight")
        rows = own.groupBy("of_lane", "of_part").cogroup(uses.groupBy("lane", "part")).applyInArrow(score, "query_id long, doc_id long, score double")
        return top_k(rows, k)

    first = kept(scored(seeded), "index-first")
    rest = _reached(bounds, first, k).join(seeded, ["query_id", "lane"], "left_anti")
    return top_k(first.unionByName(scored(rest)).drop("rank"), k)


def _reached(bounds: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """query_id, lane: lanes whose bound is not below the query's k-th score; all of them where there are fewer scores."""
    least = found.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    return bounds.join(least, "query_id", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - SLACK)).select("query_id", "lane")


def passed_over(spark: SparkSession, path: str, queries: DataFrame, query_id: str, query_text: str, k: int) -> DataFrame:
    """query_id, lanes, reached: how many lanes have a term of the query, and in how many the k-th score can be reached."""
    index = Index(spark, path)
    asked = index.asked(queries, query_id, query_text)
    folders = index.folders(asked)
    bounds = index.bounds(index.weighted(asked, folders), folders)
    reached = _reached(bounds, search(spark, path, queries, query_id, query_text, k), k).withColumn("in", F.lit(1))
    return bounds.join(reached, ["query_id", "lane"], "left").groupBy("query_id").agg(F.count(F.lit(1)).alias("lanes"), F.count("in").alias("reached"))
