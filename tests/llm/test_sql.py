"""Registered SQL beside the queries on rows that the given tables lack."""

import duckdb
import pytest

from snapgrid.llm.queries import ORACLES, QUERIES

ROWS = [(k, f"text {k} {'é' * (k % 4)} 文") for k in range(60)]
ROWS += [(None, None), (None, "no id"), (-3, ""), (-(2**63), "least"), (2**63 - 1, "greatest"), (7, "text 7"), (7, "text 7"), (8, "again")]


@pytest.mark.parametrize("rows", [ROWS, []], ids=["rows", "empty"])
def test_sharding_sql(spark, tmp_path, rows):
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    found = db.sql(ORACLES["op9_sharding"])
    order = lambda r: tuple((x is not None, x) for x in r)
    got = QUERIES["op9_sharding"](spark, folder).select(*found.columns).collect()
    assert sorted(map(tuple, got), key=order) == sorted(found.fetchall(), key=order)
    assert len(got) == len(rows)
