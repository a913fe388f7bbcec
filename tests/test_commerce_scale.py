"""Prices as of an order: odd rows against the SQL, and no table of days or orders held in a task."""

import random

import duckdb

from vitrine.plans import SQL
from vitrine.plans.commerce import order_asof_price


def write(spark, tmp_path):
    draw = random.Random(4)
    orders = [(i, draw.choice([None, *range(1, 12)])) for i in range(60)] + [(3, 5), (3, 9), (4, 2)]
    lines = [
        (draw.choice([None, *range(60)]), draw.choice([None, *range(6)]), draw.choice([None, *range(1, 12)]), draw.choice([None, 10.0, 20.0, 35.0]), draw.choice([None, 1.0, 2.0, 4.0])) for _ in range(900)
    ]
    day = lambda c: f"CASE WHEN {c} IS NULL THEN NULL ELSE timestamp_ntz'2020-01-01' + make_dt_interval({c}) END AS {c}"
    spark.createDataFrame(orders, "o_orderkey long, o_orderdate int").selectExpr("o_orderkey", day("o_orderdate")).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_shipdate int, l_extendedprice double, l_quantity double").selectExpr(
        "l_orderkey", "l_partkey", day("l_shipdate"), "l_extendedprice", "l_quantity"
    ).write.parquet(f"{tmp_path}/lineitem.parquet")


def test_odd_orders_and_lines(spark, tmp_path):
    """Nulls in every column, repeated orders and lines, days without a price."""
    write(spark, tmp_path)
    db = duckdb.connect()
    for t in ("orders", "lineitem"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    key = lambda r: tuple((v is None, v) for v in r)
    want = sorted(db.execute(SQL["order_asof_price"]).fetchall(), key=key)
    assert want and sorted((tuple(r) for r in order_asof_price(spark, str(tmp_path)).collect()), key=key) == want


def test_nothing_is_gathered_by_day_or_order(spark, sf):
    """A table of nearly as many groups as rows is what a task's memory would grow by."""
    plan = order_asof_price(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "Aggregate" not in plan
