"""The text queries that have SQL, against DuckDB over the same tables."""

from pathlib import Path

import duckdb
import pytest
from chainloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{Path(SF) / table}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(want.fetchall())


def test_text_hashes():
    from chainloom.llm.common import text_hashes

    texts = [b"", b" ", b"\n\n", b"a", b" a  b\ta\x0bab ba \xc3\xa9 ", b"x" * 200_000 + b" a", b"a\x1cb a b", b"ab cd " * 300_000, b"y" * 1_500_000]
    seen = {}
    for text in texts:
        words = text.split()
        found = text_hashes(text)
        assert len(found) == len(words)
        for word, h in zip(words, found.tolist()):
            assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)
