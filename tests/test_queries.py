"""Every registered query against its SQL on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

from vitrine.plans import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return db


def shown(value):
    if hasattr(value, "item"):
        value = value.item()
    if value is None or value is pd.NA or value != value:
        return "null"
    if isinstance(value, float):
        return f"{value:.6g}" if math.isfinite(value) else str(value)
    return f"{value:.6g}" if type(value).__name__ == "Decimal" else str(value)


def rows(frame):
    return sorted(tuple(map(shown, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


def same(a, b):
    return a == b or a.replace(".0", "") == b.replace(".0", "") or (a.replace(".", "").isdigit() and b.replace(".", "").isdigit() and float(a) == float(b))


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf, con, name):
    got, want = rows(QUERIES[name](spark, sf).toPandas()), rows(con.execute(SQL[name]).df())
    assert len(got) == len(want)
    assert all(len(x) == len(y) and all(map(same, x, y)) for x, y in zip(got, want, strict=True))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
