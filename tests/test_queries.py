"""Every query with SQL against DuckDB over the same tables."""

from pathlib import Path

import __spark_entry__ as entry
import duckdb
import pandas as pd
import pytest
from chainloom import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def rows(df):
    text = lambda v: "null" if pd.isna(v) else str(int(v)) if isinstance(v, float) and v == int(v) else str(v)
    return sorted(tuple(map(text, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), duck.execute(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(want)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).columns == ["chain_id", "block_number", "transaction_count", "tx_count"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
