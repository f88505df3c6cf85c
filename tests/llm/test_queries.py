"""The corpus queries with SQL against DuckDB; all of them on the smallest tables."""

import duckdb
import pytest

from tallyline.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_duckdb(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    df, theirs = QUERIES[name](spark, sf_dir), con.sql(ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(theirs.columns)
    at = [theirs.columns.index(c) for c in columns]
    assert sorted(str([r[c] for c in columns]) for r in df.collect()) == sorted(str([r[i] for i in at]) for r in theirs.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_gives_a_row_a_document(spark, sf_dir, name):
    out, docs = QUERIES[name](spark, sf_dir), spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert (out.where("start = 0") if name == "op13_packing" else out).count() == docs.count()
