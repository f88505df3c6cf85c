import hashlib

from pyspark.sql import functions as F

from tallyline.operators import ordered
from tallyline.sources import sinks
from tallyline.streaming import ingest


def test_csv_and_digest(spark, tmp_path):
    df = spark.createDataFrame([(2, 'a "b", c', None), (1, "mail a@b.es", "x")], "id int, note string, other string")
    assert [r.line for r in sinks.csv_lines(df, ["id"], ["note"]).collect()] == ["1,mail [EMAIL],x", '2,"a ""b"", c",']
    sinks.export(df, f"{tmp_path}/out", ["id"])
    back = spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/out")
    assert [tuple(r) for r in back.orderBy("id").collect()] == [("1", "mail a@b.es", "x"), ("2", 'a "b", c', None)]
    assert sinks.content_digest(df, ["id"]) == sinks.content_digest(df.repartition(3), ["id"]) != sinks.content_digest(df.limit(1), ["id"])
    assert sinks.manifest({"t": (df, ["id"])})[0][:2] == ("t", 2)


def test_merkle_root(spark):
    def plain(level):
        while len(level) > 1:
            level = [hashlib.sha256((level[i] + level[min(i + 1, len(level) - 1)]).encode()).hexdigest() for i in range(0, len(level), 2)]
        return level[0]

    for n in (1, 2, 3, 7, 20):
        leaves = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)]
        df = spark.createDataFrame([(i, h) for i, h in enumerate(leaves)], "i int, h string").repartition(3)
        assert ordered.merkle_root(df, ["i"], "h") == plain(leaves)
    assert ordered.merkle_root(spark.createDataFrame([], "i int, h string"), ["i"], "h") is None


def test_streams(spark, tmp_path):
    src = f"{tmp_path}/in"
    rows = spark.createDataFrame([(1, "a", "2024-01-01 00:00:00", 1), (1, "a", "2024-01-01 00:00:00", 1), (2, "b", "2024-01-02 00:00:00", 5)], "id int, k string, at string, v int").withColumn("at", F.to_timestamp("at"))
    rows.write.parquet(src)
    stream = spark.readStream.schema(rows.schema).parquet(src)
    ingest.run_available(ingest.once(stream, "at", ["id", "k"]), f"{tmp_path}/cp", ingest.merge_latest(f"{tmp_path}/t", ["id"], ["at"]))
    spark.createDataFrame([(1, "c", "2024-01-03 00:00:00", 9)], "id int, k string, at string, v int").withColumn("at", F.to_timestamp("at")).write.mode("append").parquet(src)
    ingest.run_available(ingest.once(stream, "at", ["id", "k"]), f"{tmp_path}/cp", ingest.merge_latest(f"{tmp_path}/t", ["id"], ["at"]))
    assert {(r.id, r.k, r.v) for r in spark.read.parquet(f"{tmp_path}/t/state").collect()} == {(1, "c", 9), (2, "b", 5)}
    assert ingest.activity(stream, "at", "k", "v").isStreaming
