"""Every registered query with SQL against DuckDB on the small tables."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

from paperloom.catalog import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def same(a: pd.DataFrame, b: pd.DataFrame) -> None:
    assert sorted(a.columns) == sorted(b.columns)
    columns = sorted(a.columns)
    plain = lambda v: None if pd.isna(v) else int(v) if isinstance(v, float) and v == int(v) else v
    key = lambda d: sorted(repr(tuple(map(plain, r))) for r in d[columns].astype(object).itertuples(index=False))
    assert key(a) == key(b)
    kinds = lambda d: {c: pd.api.types.infer_dtype(d[c].dropna()).replace("floating", "integer" if d[c].isna().any() else "floating") for c in columns}
    assert kinds(a) == kinds(b)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert name in ORACLE_SQL
    same(got, duck.execute(ORACLE_SQL[name]).df())
