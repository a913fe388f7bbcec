"""Admission, cancelling and paying against a fold over all moves, one after the other."""

import random
from collections import defaultdict

import pytest

from vitrine.operators import orders

SCHEMA = "order_id long, at long, gone_at long, paid_at long, sku long, quantity long"


def fold(lines, stock):
    """Every move in its place; a dict of the answers and what each product has left."""
    items, when, back = defaultdict(lambda: defaultdict(int)), {}, {}
    broken = set()
    for o, at, gone, _, sku, q in lines:
        if q is None:
            broken.add(o)
        items[o][sku] += q or 0
        when[o] = min(at, when.get(o, at))
        if gone is not None:
            back[o] = min(gone, back.get(o, gone))
    left = dict(stock)
    moves = [(at, o, 0) for o, at in when.items()] + [(max(back[o], when[o]), o, 1) for o in back]
    taken = {}
    for _, o, step in sorted(moves):
        if step == 0:
            taken[o] = o not in broken and all(s in left and q <= left[s] for s, q in items[o].items())
        if taken[o]:
            for s, q in items[o].items():
                left[s] += -q if step == 0 else q
    return taken, left


def check(spark, lines, stock):
    frame = spark.createDataFrame(lines, SCHEMA).selectExpr("*", "'c' AS step", "1 AS sure")
    shelf = spark.createDataFrame(stock, "sku long, available long")
    got = orders.admitted(frame, shelf)
    want, left = fold(lines, stock)
    assert {r.order_id: r.accepted for r in got.collect()} == want
    # What is on the shelf at the end is what the ledger has, but for orders that were paid and are cancelled later.
    ledger = {r.sku: r.available for r in orders.ledger(frame.withColumn("paid_at", frame.gone_at + 10**6), shelf, got).collect()}
    assert ledger == left
    return want


def test_a_refused_order_takes_nothing(spark):
    lines = [(1, 1, None, None, 7, 5), (2, 2, None, None, 7, 8), (3, 3, None, None, 7, 4), (4, 4, None, None, 7, 1), (4, 4, None, None, 8, 1), (5, 5, None, None, 7, 1)]
    assert check(spark, lines, [(7, 10), (8, 0)]) == {1: True, 2: False, 3: True, 4: False, 5: True}


def test_a_cancelled_order_gives_back_at_its_time(spark):
    lines = [(1, 1, 3, None, 7, 9), (2, 2, None, None, 7, 9), (3, 3, None, None, 7, 9), (4, 4, 1, None, 7, 1), (5, 4, None, None, 7, 1)]
    assert check(spark, lines, [(7, 10)]) == {1: True, 2: False, 3: True, 4: True, 5: True}


@pytest.mark.parametrize("seed", [1, 2])
def test_many_orders_and_a_hot_product(spark, seed):
    random.seed(seed)
    lines = []
    for o in range(250):
        at = random.randrange(40)
        gone = random.choice([None, None, at + random.randrange(20), at - 1])
        for sku in {0 if random.random() < 0.4 else random.randrange(1, 15) for _ in range(random.randint(1, 4))}:
            lines += [(o, at, gone, None, sku, random.randint(1, 9))] * random.choice([1, 1, 2])
    lines += [(900, 5, None, None, 99, 1), (901, 5, None, None, 3, None), (902, 6, None, None, 3, 0)]
    answers = check(spark, lines, [(s, 150 if s == 0 else 40) for s in range(15)])
    assert 50 < sum(answers.values()) < 250 and not answers[900] and not answers[901]


def test_ledger(spark):
    rows = [(1, 1, 9, 5, 7, 2), (2, 1, 5, 9, 7, 3), (3, 1, None, None, 7, 1), (4, 1, None, 2, 7, 1), (5, 1, None, None, 7, 50)]
    lines, stock = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(7, 20), (8, 5)], "sku long, available long")
    taken = spark.createDataFrame([(k, k < 5) for k in range(1, 6)], "order_id long, accepted boolean")
    found = {r.sku: tuple(r)[1:] for r in orders.ledger(lines, stock, taken).collect()}
    assert found == {7: (20 - 1 - 3, 1, 3, 3), 8: (5, 0, 0, 0)}


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    stock = spark.createDataFrame([(7, 20)], "sku long, available long")
    assert orders.admitted(none, stock).count() == 0
    assert [tuple(r) for r in orders.ledger(none, stock, orders.admitted(none, stock)).collect()] == [(7, 20, 0, 0, 0)]


def test_rounds_carry_open_orders_only(spark, monkeypatch):
    """What is taken leaves the rows of the next rounds but one, though its products have open orders for long."""
    from vitrine.operators import orders

    # Product 1 has a chain of orders that are decided one a round; a hundred others of it are taken in the first.
    lines = [(i, i, 1, 1) for i in range(100)] + [(1000 + i, 1000 + i, sku, 60) for i in range(6) for sku in (i + 1, i + 2)] + [(2000, 2000, 1, 60)]
    sizes, real = [], orders.kept

    def kept(df, name):
        found = real(df, name)
        if name == "orders-open":
            sizes.append(found.count())
        return found

    monkeypatch.setattr(orders, "kept", kept)
    own = spark.createDataFrame([(*row, None) for row in lines], "order_id long, at long, sku long, quantity long, gone_at long")
    stock = spark.createDataFrame([(1, 200)] + [(s, 100) for s in range(2, 9)], "sku long, available long")
    got = {r.order_id: r.accepted for r in orders.admitted(own, stock).collect()}
    left, want = {1: 200, **{s: 100 for s in range(2, 9)}}, {}
    for o in sorted({row[0] for row in lines}):
        mine = [(row[2], row[3]) for row in lines if row[0] == o]
        want[o] = all(left[s] >= q for s, q in mine)
        for s, q in mine:
            left[s] -= q if want[o] else 0
    assert got == want and len(sizes) > 3 and max(sizes[2:]) < 20


def test_reservations_in_one_pass(spark, tmp_path, monkeypatch):
    """An order of one product needs no rounds, and so no written tables."""
    import datetime

    from vitrine.operators import orders
    from vitrine.plans.commerce import stock_reservation

    day = datetime.datetime(2020, 1, 1)
    rows = [(o, o % 3, float(1 + o * 7 % 50), day + datetime.timedelta(days=o * 5 % 11)) for o in range(200)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_quantity double, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(orders, "kept", None)
    got = {r.sku: (r.accepted, r.refused, r.reserved) for r in stock_reservation(spark, str(tmp_path)).collect()}
    for sku in range(3):
        held = taken = 0
        own = sorted((d, o, q) for o, s, q, d in rows if s == sku)
        for _, _, q in own:
            if held + q <= 300:
                held, taken = held + q, taken + 1
        assert got[sku] == (taken, len(own) - taken, held)
