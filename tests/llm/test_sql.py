"""Queries with SQL equivalents, compared on the smallest tables."""

import duckdb
import pytest

from vitrine.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf).toPandas()
    want = con.execute(queries.SQL[name]).df()[list(got.columns)]
    rows = lambda frame: sorted(map(str, frame.astype(object).where(frame.notna(), None).values.tolist()))
    assert [r.replace(".0", "") for r in rows(got)] == [r.replace(".0", "") for r in rows(want)]


def test_chat_sql_on_control_strings(spark, tmp_path):
    """Texts and roles that hold control strings, though their plain form would parse back."""
    import pandas as pd

    turns = [(1, 0, "user", "what does <s> mean"), (1, 1, "assistant", "a mark"), (2, 0, "user", "see [/ROLE] here"), (2, 1, "to[ROLE]ol", "<~s> <<SYS>>"), (3, 0, "user", "none")]
    pd.DataFrame(turns, columns=["conv_id", "turn", "role", "text"]).to_parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet'")
    got = queries.QUERIES["op4_chat"](spark, str(tmp_path)).toPandas()
    want = con.execute(queries.SQL["op4_chat"]).df()[list(got.columns)]
    assert sorted(map(str, got.values.tolist())) == sorted(map(str, want.values.tolist()))
    assert dict(zip(got.conv_id, got.escaped, strict=True)) == {-1: True, 1: True, 2: True, 3: False}
