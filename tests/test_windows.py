"""Windows over an order's lines: one sort for all of them, and the results of the SQL on odd rows."""

from __future__ import annotations

import duckdb
import pytest

from paperloom.operators import QUERIES, SQL

LINES = "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_quantity double, l_returnflag string"
ODD = [(1, 1, 10, 1, 1.0, "R"), (1, 2, None, 2, 2.0, "R"), (1, None, 12, 3, 3.0, None), (1, 2, 11, 1, 4.0, "N"), (2, 5, 7, 7, 5.0, "R"), (3, 1, 4, 4, 6.0, "N"), (None, 1, 8, 8, 7.0, "R"), (None, 2, 9, 9, 8.0, "N"), (4, 3, None, None, 9.0, "R"), (4, 1, None, 5, 1.0, "N"), (4, 9, 6, 6, 2.0, "A")]


@pytest.mark.parametrize("name", ["context_radius", "visual_columns", "delete_row"])
def test_lines_are_sorted_once(spark, name):
    plan = spark._jvm.PythonSQLUtils.explainString(QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution(), "simple")
    assert plan.count("Sort [") == 1 and plan.count("Exchange hashpartitioning") == 1


def test_neighbours_of_odd_lines(spark, tmp_path):
    """Null parts and numbers are neighbours like any; lines without an order join with nothing."""
    rows = [r for r in ODD if r[1] is not None]  # where nulls are sorted is each engine's own
    rows = [(*r[:2], r[2] if r[1] != 2 else r[2] or 13, *r[3:]) for r in rows]
    spark.createDataFrame(rows, LINES).write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    got = QUERIES["context_radius"](spark, str(tmp_path)).collect()
    want = con.execute(SQL["context_radius"]).fetchall()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want)) and None in {r[4] for r in want}
