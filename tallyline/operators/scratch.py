"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def materialise(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in spark.checkpoint.dir (in local mode an own folder if that is unset), read back: lineage ends there."""
    spark = df.sparkSession
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = getattr(materialise, "own", None)
        if root is None:
            root = materialise.own = "file://" + tempfile.mkdtemp(prefix="spark-")
    path = f"{root.rstrip('/')}/tallyline-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
