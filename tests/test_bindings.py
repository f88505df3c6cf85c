"""Every bound query against the same result in DuckDB."""

import duckdb
import pytest

from tallyline.plans.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def cell(v):
    return "null" if v is None or v != v else repr(round(v, 9)) if isinstance(v, float) else str(v)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_duckdb(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    theirs = duck.sql(ORACLE_SQL[name])
    assert rows(df.columns, df.collect()) == rows(theirs.columns, theirs.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() >= 0


def test_assignment_uses_each_side_once(spark, sf_dir):
    out = QUERIES["payment_assignment"](spark, sf_dir)
    n = out.count()
    assert out.select("o_orderkey").distinct().count() == n == out.select("line").distinct().count()


def test_entry_without_the_corpus_operators(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/tallyline", tmp_path / "tallyline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'view_control_totals' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_every_token_has_a_weight(spark, duck, sf_dir):
    want = dict(duck.sql("SELECT token, count(*) FROM (SELECT unnest(regexp_extract_all(text, '[a-z]{3,}')) AS token FROM documents) GROUP BY 1").fetchall())
    got = QUERIES["surname_weight"](spark, sf_dir).collect()
    assert {r.token: r.n for r in got} == want and min(want.values()) == 1 and max(want.values()) > 20
    assert len({r.weight for r in got}) > 1
