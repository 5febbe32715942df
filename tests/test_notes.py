"""Annotations of targets: what is shuffled, and results on odd rows against the SQL."""

from __future__ import annotations

import duckdb

from paperloom.operators import QUERIES, SQL


def test_annotations_are_shuffled_as_rows_not_as_a_row_for_each_value(spark):
    plan = spark._jvm.PythonSQLUtils.explainString(QUERIES["target_annotations"](spark, "/root/testdata/sf0.001")._jdf.queryExecution(), "simple")
    assert "Generate" not in plan and plan.count("Exchange") == 1
    above, _, below = plan.partition("Exchange")
    assert "collect_set" in above and "collect_set" not in below


def test_annotations_of_odd_rows(spark, tmp_path):
    lines = [(1, 1, 10, 1, "R", "O"), (1, 2, 9, 1, " ", None), (1, 2, 9, 1, "R", "F"), (1, 3, None, 1, "", "O"), (1, 5, 10, 2, "A", "O"), (1, 9, 3, 1, "N", "F"), (2, 1, None, None, None, " "), (None, 1, 5, 5, "N", "O"), (3, 4, 7, 7, "é", "𝄞")]
    orders = [(1, 100, "1-URGENT"), (2, None, None), (4, 7, ""), (4, 7, "5-LOW"), (None, 3, "x")]
    spark.createDataFrame(lines, "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_returnflag string, l_linestatus string").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    con = duckdb.connect()
    for t in ("lineitem", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = QUERIES["target_annotations"](spark, str(tmp_path))
    want = con.execute(SQL["target_annotations"]).df()
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.itertuples(index=False)))
