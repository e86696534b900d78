"""The pN_ queries on the smallest tables: columns, SQL, and plans."""

import os

import duckdb
import pytest

from siltstream.llm import oracles, queries

QUERIES, SQL = queries.queries(), oracles.oracle_sql()
COLUMNS = {
    "p1_found": {"item_id": "bigint", "line_no": "bigint"}, "p2_found": {"origin": "string", "record_key": "string"}, "p3_found": {"item_id": "bigint"},
    "p4_found": {"item_id_a": "bigint", "item_id_b": "bigint"}, "p5_found": {"item_id": "bigint", "line_no": "bigint"}, "p8_found": {"doc_id": "bigint", "eval_id": "bigint"},
    "p9_found": {"doc_id_a": "bigint", "doc_id_b": "bigint"},
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    df = QUERIES[name](spark, tables)
    if name in COLUMNS:
        assert dict(df.dtypes) == COLUMNS[name]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    rows = df.collect()
    if name.endswith("_found"):
        assert len(rows) == len(set(map(tuple, rows)))
    if name in SQL:
        con = duckdb.connect()
        for table in os.listdir(tables):
            con.sql(f"CREATE VIEW {table.removesuffix('.parquet')} AS SELECT * FROM '{tables}/{table}'")
        want = con.sql(SQL[name])
        order = [want.columns.index(c) for c in df.columns]
        assert sorted(map(repr, map(tuple, rows))) == sorted(repr(tuple(r[i] for i in order)) for r in want.fetchall())
