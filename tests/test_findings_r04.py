"""Bound queries on odd inputs, against their SQL."""

import random
from datetime import date
from decimal import Decimal as D

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyline.functions import similarity
from tallyline.operators import joins, similar_sets
from tallyline.plans import null_models, setup
from tallyline.plans.queries import ORACLE_SQL, QUERIES


def same_as_sql(spark, folder, name):
    """The query's rows over the folder's tables, after they were found equal to those of its SQL on one thread."""
    con = duckdb.connect()
    con.execute("SET threads = 1")
    for file in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}{'/*.parquet' if file.is_dir() else ''}'")
    theirs = con.execute(ORACLE_SQL[name])
    columns, want = [c[0] for c in theirs.description], theirs.fetchall()
    out = QUERIES[name](spark, str(folder))
    got = out.select(*columns).collect()
    assert sorted(out.columns) == sorted(columns) and sorted(tuple(map(str, r)) for r in got) == sorted(tuple(map(str, r)) for r in want)
    return got


@pytest.mark.parametrize("parts", [1, 5])
def test_refunds_count_rounded_seconds(spark, tmp_path, parts):
    rows = [(1, "2024-01-01 00:00:00.4", 7, "purchase"), (2, "2024-01-01 00:00:00.6", 7, "error"), (3, "2024-01-01 00:00:01.4", 7, "error")]  # 2 is a second later by rounding
    rows += [(4, "2024-01-01 00:00:00.9", 8, "purchase"), (5, "2024-01-04 18:00:01.3", 8, "error")]  # 90 hours by rounding
    rows += [(6, "2024-01-01 00:00:02.5", 9, "purchase"), (7, "2024-01-01 00:00:03.4", 9, "error"), (8, "2024-01-01 00:00:03.5", 9, "error"), (9, "2024-01-01 00:00:04.5", 9, "error")]
    e = spark.createDataFrame(rows, "event_id long, at string, user_id long, event_type string")
    e.select("event_id", F.col("at").cast("timestamp_ntz").alias("ts"), "user_id", "event_type").repartition(parts).write.parquet(str(tmp_path / "events.parquet"))
    assert {(r.bought, r.failed) for r in same_as_sql(spark, tmp_path, "refund_interval_firstfit")} == {(1, 2), (4, 5), (6, 7)}


@pytest.mark.parametrize("turned", [False, True])
def test_partial_sums_of_lines_that_share_a_number_and_a_day(spark, tmp_path, turned):
    """The SQL leaves open which of two such lines comes first; here it is the smaller amount, however the rows lie."""
    x = [(1, 3, 300000.0), (1, 3, 300500.0), (1, 2, 100000.0), (2, 1, 70000.0), (2, 1, 69000.0), (2, 4, 30000.0)]
    rows = spark.createDataFrame(x[::-1] if turned else x, "l_orderkey long, l_linenumber int, l_extendedprice double").withColumn("l_shipdate", F.lit("1996-07-29").cast("timestamp_ntz"))
    rows.coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(1, 400200.0), (2, 99500.0)], "o_orderkey long, o_totalprice double").withColumn("o_orderdate", F.lit("1996-07-29").cast("timestamp_ntz")).coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    got = QUERIES["partial_sum_sets"](spark, str(tmp_path)).collect()
    assert {(r.o_orderkey, r.parts, float(r.total)) for r in got} == {(1, "2,3", 400000.0), (2, "1,4", 99000.0)}


def test_nearest_reads_a_key_once(spark):
    """A key with many rows costs two sorts: no frame reaches to its end, which would be read again for every row."""
    left = spark.range(3000).select(F.lit(1).alias("k"), F.col("id").alias("i"), (F.col("id") * 7919 % 5003).alias("t"))
    right = spark.range(1500).select(F.lit(1).alias("k"), F.col("id").alias("j"), (F.col("id") * 104729 % 4999).alias("u"))
    out = joins.nearest(left, right, ["k"], "t", "u", "j")
    assert "unboundedfollowing" not in out._jdf.queryExecution().toString().lower()
    others = [(r.u, r.j) for r in right.collect()]
    assert {(r.i, r.near_j) for r in out.collect()} == {(r.i, min((abs(u - r.t), j) for u, j in others)[1]) for r in left.collect()}


def test_quotes_never_broadcast_pages(spark, tmp_path):
    """The words of a small file's pages are many times its size: no plan may send them all to every task."""
    spark.range(300).select(F.col("id").alias("p_partkey"), F.concat_ws(" ", F.lit("blue"), F.concat(F.lit("bolt"), "id")).alias("p_name")).write.parquet(str(tmp_path / "part.parquet"))
    out = QUERIES["quote_locate_windows"](spark, str(tmp_path))
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert {(r.field_id, r.found, r.scope, r.crop_status) for r in same_as_sql(spark, tmp_path, "quote_locate_windows")} >= {(3, "blue bolt3", "bbox", "anchored"), (4, "blue bolt4", "page", "approximate"), (5, None, None, "page_only")}


def test_contributions_of_a_large_community_are_many_tasks_work(spark, monkeypatch):
    monkeypatch.setattr(setup, "UNITS", 10, raising=False)
    units = [(i if i else None, "c", None if i % 9 == 0 else D(i % 4)) for i in range(100)] + [(500, "d", D(0)), (501, None, D(1))]
    rules = [(1, "c", "coeficiente", D(1200), None, date(2024, 1, 31), 3), (2, "c", "partes_iguales", None, 25, date(2024, 1, 1), 1), (3, "c", "partes_iguales", None, None, date(2024, 1, 1), 1), (4, "d", "coeficiente", D(10), None, date(2024, 1, 1), 2), (5, "c", "coeficiente", D(9), None, None, 2), (6, "c", "coeficiente", D(9), None, date(2024, 1, 1), 0)]
    u = spark.createDataFrame(units, "id int, community_id string, quota decimal(7,4)").coalesce(1)
    r = spark.createDataFrame(rules, "derrama_id int, community_id string, criterion string, total decimal(18,2), per_unit int, starts_on date, months int").coalesce(1)
    out = setup.contribution_ledger(r, u)
    every = sum(q or 0 for _, c, q in units if c == "c")
    want = {(1, i, date(2024, m, d), round(float(1200 * (q or 0) / every / 3), 2)) for i, c, q in units if c == "c" for m, d in ((1, 31), (2, 29), (3, 31))} | {(2, i, date(2024, 1, 1), 25.0) for i, c, _ in units if c == "c"}
    got = [(x.derrama_id, x.unit_id, x.period, float(x.expected)) for x in out.collect()]
    assert len(got) == len(want) and set(got) == want
    assert out.select(F.spark_partition_id()).distinct().count() > 1


def test_similar_lines_are_sorted_twice(spark):
    """One sort by text and one by text and vendor, each line's name in the second alone; lines without vendor, day or words stay."""
    rng = random.Random(4)
    rows = [(i, rng.choice(["u", "v", "w", None]), rng.choice([None, *range(400)]), rng.choice(["", "red valve seat", "red valve seats", "valve red seat", "blue pipe"])) for i in range(300)]
    df = spark.createDataFrame(rows, "line int, v string, n int, t string").withColumn("d", F.expr("date_add(DATE '2024-01-01', n)"))
    out = similar_sets.similar_lines(df, "line", "v", "d", "t", percent=70)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Window ") == 2
    alike = {(r.a, r.b) for r in similar_sets.similar_sets(spark.createDataFrame([(t,) for t in {r[3] for r in rows}], "t string").withColumn("g", similar_sets.trigrams(F.col("t"))), "t", "g", 70).collect()}
    same = lambda x, y: x != "" and (sorted(x.split()) == sorted(y.split()) or (x, y) in alike or (y, x) in alike)
    want = {i: sum(w is not None and m is not None and v is not None and n is not None and v != w and abs(m - n) <= 120 and same(t, s) for _, w, m, s in rows) for i, v, n, t in rows}
    assert {r.line: r.similar for r in out.collect()} == want and max(want.values()) > 10


def test_permutations_where_rows_lie_and_by_tables_agree(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(f"i{i}", rng.choice("ab"), rng.choice([1, 2, None]), rng.choice(["x", "y", "z", None]), rng.choice([True, False, None])) for i in range(200)] + [("j", "c", 1, None, True)]
    df = spark.createDataFrame(rows, "id string, s string, t int, e string, hit boolean")
    found = []
    for most in (1_000_000, 40, 0):  # all strata in one task each, some of them, none
        monkeypatch.setattr(null_models, "STRATUM", most)
        found.append(sorted(map(tuple, null_models.permutation_null(df.repartition(3), "id", ["s", "t"], "e", "hit", 30, 3).collect())))
    assert found[0] == found[1] == found[2] and len(found[0]) == 3


def test_distinct_names_are_scored_in_workers(spark):
    rng = random.Random(6)
    words = ["supplier", "lift", "lifts", "obres", "grup", "0000123", "0000132", "0050123", "a", ""]
    names = [" ".join(rng.choice(words) for _ in range(rng.randrange(4))) for _ in range(40)]
    pairs = spark.createDataFrame([(rng.choice(names), rng.choice([*names, None])) for _ in range(400)], "a string, b string")
    out = similarity.scored(pairs, "a", "b", "s")
    assert "MapInArrow" in out._jdf.queryExecution().optimizedPlan().toString()
    want = pairs.select("a", "b", F.when(F.col("b").isNotNull(), similarity.name_similarity(F.col("a"), F.col("b"))).alias("s"))
    assert sorted(map(str, out.select("a", "b", "s").collect())) == sorted(map(str, want.collect()))
