"""Places, the store of recent keys against a simulated one, sliding percentiles against sorting each window."""

import random
from collections import OrderedDict

import pytest

from vitrine.operators import sequence


@pytest.fixture(scope="module")
def uses():
    random.seed(31)
    keys = [str(k) for k in range(40)]
    rows = []
    for i in range(900):
        # Stretches of few keys, of many, and one key in a third of all rows.
        key = "hot" if random.random() < 0.33 else random.choice(keys[: 5 if i // 150 % 2 else 40])
        rows.append((i, i // 3, None if i % 97 == 0 else key, random.choice([None, 1.0, 2.0, random.random()])))
    random.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, at long, key string, value double").selectExpr("*", "1 AS n", "2 AS last").repartition(3)


def test_places(spark, uses):
    got = sequence.placed(frame(spark, uses), ["at", "id"], 37).collect()
    assert [(r.place, r.block) for r in sorted(got, key=lambda r: r.id)] == [(k, k // 37) for k in range(len(uses))]


@pytest.mark.parametrize(("capacity", "block", "fan"), [(1, 50, 2), (6, 7, 3), (6, 1000, 8), (30, 11, 8), (100, 50, 2)])
def test_store_equals_a_simulated_one(spark, uses, capacity, block, fan):
    store, want = OrderedDict(), {}
    for i, _, key, _ in sorted(uses):
        if key is None:
            continue
        names = list(store)
        want[i] = (len(names) - 1 - names.index(key) if key in store else None, key in store)
        store.pop(key, None)
        if len(store) >= capacity:
            store.popitem(last=False)
        store[key] = True
    rows = frame(spark, uses).withColumnRenamed("last", "note")
    got = {r.id: (r.distance, r.held) for r in sequence.least_recently_used(rows, "key", ["at", "id"], capacity, block, fan).collect()}
    assert got == want


@pytest.mark.parametrize(("last", "block"), [(1, 10), (25, 30), (25, 25), (2000, 50)])
def test_sliding_percentiles(spark, uses, last, block):
    values, want = [v for _, _, _, v in sorted(uses)], {}
    for i in range(len(values)):
        window = sorted(v for v in values[max(0, i + 1 - last) : i + 1] if v is not None)
        want[i] = (len(window), sequence.percentile(window, 0.5), sequence.percentile(window, 0.95))
    rows = frame(spark, uses).drop("n", "last")
    got = {r.id: (r.n, r.p50, r.p95) for r in sequence.sliding_percentiles(rows, "value", ["at", "id"], last, {"p50": 0.5, "p95": 0.95}, block).collect()}
    assert got == want


def test_empty(spark, uses):
    none = frame(spark, uses[:1]).drop("n", "last").limit(0)
    assert sequence.placed(none, ["at", "id"]).count() == 0
    assert sequence.least_recently_used(none, "key", ["at", "id"], 3).count() == 0
    assert sequence.sliding_percentiles(none, "value", ["at", "id"], 3, {"p": 0.5}).count() == 0
