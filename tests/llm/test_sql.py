"""The operators that SQL can express against their SQL on DuckDB."""

import glob
import os

import duckdb
import pytest

from millrace.llm import queries
from tests.llm.samples import documents, embeddings, labels
from tests.test_queries import rows


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_operator_equals_its_sql(name, spark, sf):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        connection.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    got, want = queries.QUERIES[name](spark, sf).toPandas(), connection.sql(queries.ORACLES[name]).df()
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_operator_equals_its_sql_on_odd_rows(name, spark, tmp_path):
    """Nulls, repeated rows, empty and long texts, extra columns."""
    connection = duckdb.connect()
    for table in (documents, embeddings, labels):
        table(spark).coalesce(1).write.parquet(f"{tmp_path}/{table.__name__}.parquet")
        connection.sql(f"CREATE VIEW {table.__name__} AS SELECT * FROM '{tmp_path}/{table.__name__}.parquet/*.parquet'")
    got, want = queries.QUERIES[name](spark, str(tmp_path)).toPandas(), connection.sql(queries.ORACLES[name]).df()
    assert rows(got) == rows(want)
