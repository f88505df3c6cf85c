"""Streaming counterparts: imports that may repeat, the current state of a revision log, and windowed activity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.operators.ordered import latest


def once(stream: DataFrame, at: str, key: list[str], late: str = "30 days") -> DataFrame:
    """Rows of a stream, each key once within a watermark: a repeated import of an overlapping export adds nothing."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(key)


def activity(stream: DataFrame, at: str, key: str, value: str, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """(window, key, n, total) of a stream; rows later than the watermark are left out."""
    sums = stream.withWatermark(at, late).groupBy(F.window(at, window), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return sums.select(F.col("window.start").alias("start"), key, "n", "total")


def merge_latest(path: str, keys: list[str], order: list[str]):
    """A function for foreachBatch that keeps the newest row of each key in a Parquet table.

    A batch that runs again gives the same table, since the newest row wins whichever copy it comes from.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        target = f"{path}/state"
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(target)
        there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
        rows = batch if not there else spark.read.schema(batch.schema).parquet(target).unionByName(batch)
        from tallyline.sources.sinks import overwrite

        overwrite(latest(rows, keys, order), target)

    return run


def run_available(stream: DataFrame, checkpoint: str, fn) -> None:
    """Work off what has arrived, then stop; the checkpoint remembers it."""
    stream.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
