from tallyline.llm import common
from tallyline.llm.common import partitions_for


def test_partitions_follow_the_bytes(spark, sf_dir):
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert partitions_for(docs, 1 << 40) == least
    assert partitions_for(docs, size // (3 * least)) >= 3 * least
    literal = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert partitions_for(literal, 1 << 24) == least
    assert partitions_for(docs.limit(0), 1 << 24) == least


def test_texts_go_to_workers_in_small_batches(spark, sf_dir):
    import pyarrow as pa

    import corpus_pipeline

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    docs = spark.range(0, 9000, numPartitions=1).selectExpr("id AS doc_id", "'a b' AS text", "3 AS n_chars")
    try:
        corpus_pipeline.mask_personal_data(spark, docs, sf_dir)
        assert max(r.n for r in docs.mapInArrow(sizes, "n long").collect()) == common.TEXT_ROWS
        spark.conf.set(name, 10)
        corpus_pipeline.mask_personal_data(spark, docs, sf_dir)
        assert spark.conf.get(name) == "10"
    finally:
        spark.conf.set(name, before)
