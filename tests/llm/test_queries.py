"""Queries of the training-data operators on the smallest tables, held against their SQL in DuckDB."""

import duckdb
import pytest

from lodestrata.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(repr([r[c] for c in columns]) for r in df.collect())
    assert got
    if name in ORACLES:
        con = duckdb.connect()
        for t in ("conversations", "documents", "pages"):
            con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
        want = con.sql(ORACLES[name])
        assert sorted(want.columns) == columns
        at = [want.columns.index(c) for c in columns]
        assert got == sorted(repr([r[i] for i in at]) for r in want.fetchall())
