"""Every registered query against its SQL on DuckDB, and the contract's functions."""

import glob
import numbers
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from millrace.plans import registry
from millrace.plans import retrieval_queries as Q


def rows(table):
    """Sorted rows with the columns in name order; numbers to nine digits."""
    columns = sorted(table.columns)

    def shown(v):
        if pd.isna(v):
            return None
        return round(float(v), 9) if isinstance(v, numbers.Number) else str(v)

    return columns, sorted((tuple(shown(v) for v in r) for r in table[columns].itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def oracle(sf):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        connection.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(name, spark, sf, oracle):
    got, want = registry.QUERIES[name](spark, sf).toPandas(), oracle.sql(registry.ORACLES[name]).df()
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_runs(name, spark, sf):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_semantic_hits_come_from_all_chunks(spark, sf, tmp_path):
    texts = [(5000 + i, f"word{i} " * 120 + ("Released under the MIT License" if i == 3 else f"tail{i}"), "en", "s", 0) for i in range(8)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    os.symlink(f"{sf}/embeddings.parquet", f"{tmp_path}/embeddings.parquet")
    vector, embed = Q.EMBEDDER([Q.QUERY])[0], Q.EMBEDDER
    want = []
    for r in Q.chunks(spark, str(tmp_path)).collect():
        if r.content and r.content.strip():
            v = embed([r.content])[0]
            size = np.linalg.norm(v) * np.linalg.norm(vector)
            want.append((-round(float(v @ vector) / size, 6) if size else 0.0, r.file_id, r.chunk_index))
    got = registry.QUERIES["hybrid_search_embedded"](spark, str(tmp_path)).orderBy("position").collect()
    hits = [(r.file_id, r.chunk_index) for r in got if r.source == "semantic"]
    assert hits == [w[1:] for w in sorted(want)[:5]] and any(c > 0 for _, c in hits)
    lengths = {(r.file_id, r.chunk_index): len(r.content) for r in Q.chunks(spark, str(tmp_path)).collect()}
    again = registry.QUERIES["rerank_function_embedded"](spark, str(tmp_path)).orderBy("position").collect()
    assert {(r.file_id, r.chunk_index) for r in again} >= set(hits) and [r.rerank_score for r in again] == sorted((-float(lengths[r.file_id, r.chunk_index]) for r in again), reverse=True)


def test_contract(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() == 1
    assert set(contract.oracle_sql()) <= set(contract.queries())
