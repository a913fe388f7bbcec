"""Nearest neighbours: what a task holds does not grow with its rows or queries, and ties stay as they are."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from vitrine.operators import vectors


def brute(queries, rows, k):
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    scores = np.round(unit(queries[1]) @ unit(rows[1]).T, 6)
    scores[queries[0][:, None] == rows[0]] = -np.inf
    return [[int(rows[0][j]) for j in np.lexsort((rows[0], -s))[:k]] for s in scores]


@pytest.mark.parametrize("shuffled", [False, True])
def test_best_with_many_ties(shuffled):
    """A third of the rows are one vector; ids come in order or not; the chunks are smaller than k or larger."""
    draw = np.random.default_rng(5)
    own = np.arange(900)
    data = draw.integers(-2, 3, (900, 4)).astype(float) + 0.1
    data[::3] = data[0]
    if shuffled:
        own = draw.permutation(own)
    want = brute((own[:40], data[:40]), (own, data), 7)
    for chunk in (3, 64, 900):
        best = vectors.Best(40, 7, vectors.SLACK, vectors.DECIMALS)
        for at in range(0, 900, chunk):
            part = data[at : at + chunk]
            scores = data[:40] @ part.T / np.outer(np.linalg.norm(data[:40], axis=1), np.linalg.norm(part, axis=1))
            scores[own[:40, None] == own[at : at + chunk]] = -np.inf
            best.add(0, own[at : at + chunk], scores)
        assert best.ids.tolist() == want


def task_of(spark, queries, rows, k, monkeypatch):
    """The function that a task runs, taken from the call."""
    taken = []

    class Rows:
        def select(self, *_):
            return self

        def mapInArrow(self, f, schema):
            taken.append(f)
            return spark.createDataFrame([], schema)

    asked = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(*queries, strict=True)], "vec_id long, embedding array<float>")
    vectors.nearest(Rows(), asked, k)
    return taken


def test_memory_of_a_task(spark, monkeypatch):
    """10,000 rows at once and 3,000 queries: one matrix of them has 240 MB."""
    draw = np.random.default_rng(6)
    q = (np.arange(3000), draw.normal(size=(3000, 8)).astype(np.float32))
    (task,) = task_of(spark, q, None, 10, monkeypatch)
    data = draw.normal(size=(10000, 8)).astype(np.float32)
    lists = pa.FixedSizeListArray.from_arrays(pa.array(data.ravel()), 8).cast(pa.list_(pa.float32()))
    tracemalloc.start()
    found = list(task(iter([pa.RecordBatch.from_arrays([pa.array(np.arange(10000)), lists], names=["vec_id", "embedding"])])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(b.num_rows for b in found) == 30000 and peak < 80e6
