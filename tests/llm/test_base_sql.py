"""What SQL can tell of op8 and op10, on the smallest tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")
from evigraph.llm import queries  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.mark.parametrize("name", ["quality_base", "pii_base"])
def test_same_rows_as_sql(spark, name):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = c.sql(queries.oracle_sql()[name])
    df = queries.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(want.columns)
    cols = want.columns
    assert sorted(tuple(str(r[c]) for c in cols) for r in df.collect()) == sorted(tuple(map(str, r)) for r in want.fetchall())
