"""The stored index against a plain BM25, and what a search reads of it."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vitrine.operators import blockindex
from vitrine.session import scratch


def plain(docs, queries, k):
    """BM25 in plain Python; tokens are runs of two letters or more."""
    cut = lambda t: [w for w in (t or "").lower().split() if len(w) > 1]
    rows = [(d, cut(t)) for d, t in docs]
    n, average = len(rows), sum(len(t) for _, t in rows) / max(len(rows), 1)
    df = Counter(w for _, t in rows for w in set(t))
    found = []
    for q, text in queries:
        scores = []
        for d, words in rows:
            count = Counter(words)
            s = sum(max(math.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1), 0.25) * count[w] * 2.5 / (count[w] + 1.5 * (0.25 + 0.75 * len(words) / average)) for w in cut(text) if count[w])
            if s > 0 and d is not None:
                scores.append((-round(s, 6), d))
        found += [(q, d, -s, i + 1) for i, (s, d) in enumerate(sorted(scores)[:k])]
    return sorted(found)


@pytest.fixture(scope="module")
def corpus():
    random.seed(11)
    words = [f"w{i}" for i in range(10, 400)]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i * 37 % 100_003, " ".join(random.choices(words, weights, k=random.randint(1, 60)))) for i in range(600)]
    docs += [(5_000_001, None), (5_000_002, ""), (-7, "w10 w11 w12"), (2**60, "w10 w11 w12"), (5_000_003, "w10 w11 w12")]
    queries = [(i, " ".join(random.choices(words, k=random.randint(1, 8)))) for i in range(25)] + [(50, "w10 w10 w11"), (51, "absent"), (52, None), (53, "")]
    return docs, queries


@pytest.fixture(scope="module")
def stored(spark, corpus):
    path = scratch(spark, "test-index")
    blockindex.write(spark.createDataFrame(corpus[0], "key long, body string").withColumnRenamed("key", "term"), "term", "body", path, lane=16)
    return path


@pytest.mark.parametrize("k", [1, 3, 1000])
def test_equals_plain_scores(spark, corpus, stored, k):
    asked = spark.createDataFrame(corpus[1], "lane long, term string")
    got = sorted((r.query_id, r.doc_id, r.score, r.rank) for r in blockindex.search(spark, stored, asked, "lane", "term", k).collect())
    want = plain(*corpus, k)
    assert [(q, r) for q, _, _, r in got] == [(q, r) for q, _, _, r in want]
    assert all(a[1] == b[1] and abs(a[2] - b[2]) < 2e-6 for a, b in zip(got, want, strict=True))


def test_repeated_ids_and_null_ids(spark):
    path = scratch(spark, "test-index")
    rows = [(1, "same words here"), (1, "same words"), (None, "same words"), (2, "other text")]
    blockindex.write(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", path)
    asked = spark.createDataFrame([(1, "same"), (None, "same")], "q long, t string")
    assert [(r.query_id, r.doc_id, r.rank) for r in blockindex.search(spark, path, asked, "q", "t", 9).collect()] == [(1, 1, 1), (1, 1, 2)]


def test_lanes_are_passed_over(spark, corpus, stored):
    asked = spark.createDataFrame(corpus[1], "lane long, term string")
    rows = blockindex.passed_over(spark, stored, asked, "lane", "term", 1).collect()
    assert sum(r.reached for r in rows) < 0.7 * sum(r.lanes for r in rows)
    assert all(0 < r.reached <= r.lanes for r in rows)


def test_a_search_opens_the_folders_of_its_terms(spark, corpus, stored):
    index = blockindex.Index(spark, stored)
    named = lambda df: {r[0] for r in df.select(F.input_file_name()).distinct().collect()}
    files = lambda words: named(index.table("blocks", index.folders(index.asked(spark.createDataFrame([(1, words)], "q long, t string"), "q", "t"))))
    every = named(spark.read.parquet(f"{stored}/blocks"))
    one, three = files("w10"), files("w10 w11 w12")
    assert one and one < three and len(three) < len(every) / 2


def test_empty(spark):
    path = scratch(spark, "test-index")
    docs = spark.createDataFrame([], "doc_id long, text string")
    blockindex.write(docs, "doc_id", "text", path)
    asked = spark.createDataFrame([(1, "some words")], "q long, t string")
    assert blockindex.search(spark, path, asked, "q", "t", 3).count() == 0
    assert blockindex.search(spark, path, asked.limit(0), "q", "t", 3).count() == 0
