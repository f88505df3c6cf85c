"""Helpers shared by the corpus operators: scratch tables, batches and connected components."""

from __future__ import annotations

import itertools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. In local mode, where that is one machine, an own one if it is unset."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = getattr(shared_dir, "own", None)
        if path is None:
            path = shared_dir.own = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{path.rstrip('/')}/tallyline-{spark.sparkContext.applicationId}"


def materialise(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    The lineage ends there, so a lost executor never makes Spark run the work before it again,
    and the table's size is known to the optimizer.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def chunks(items, size: int):
    """Lists of at most size items."""
    it = iter(items)
    while part := list(itertools.islice(it, size)):
        yield part


def by_bytes(texts: list, limit: int):
    """(start, stop) of slices of texts with about limit characters each; a longer text is a slice of its own."""
    start = total = 0
    for i, text in enumerate(texts):
        size = 0 if text is None else len(text)
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(texts):
        yield start, len(texts)


def partitions_for(df: DataFrame, size: int) -> int:
    """spark.sql.shuffle.partitions, or one partition for each size bytes of df's files if that is more."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(n, -(-known // size)) if known < 1 << 60 else n  # a table that isn't read from files says no size


#: Rows of whole texts that go to a Python worker at once; what it and its executor hold for a batch follows.
TEXT_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches have at most TEXT_ROWS rows; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= TEXT_ROWS:
        spark.conf.set(name, TEXT_ROWS)


def row_keys(text: Column) -> list[Column]:
    """h and k: together 128 bits that, beside the id, name a row by its text; of null texts they are those of a null."""
    return [F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("k")]


def keep_one(docs: DataFrame, found: DataFrame) -> DataFrame:
    """One row of docs(doc_id, text, ...) of each class in found(id, h, k, root): the smallest by id (none is last) and text.

    Rows are named by id and text, so a repeated id takes no other text along; of rows equal in both, the smallest stays.
    """
    rows = found.groupBy("root", "id", "h", "k").agg(F.count(F.lit(1)).alias("n"))
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h", "k")).alias("first"))
    rows = rows.join(first, "root")
    stays = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("h") == F.col("first.h")) & (F.col("k") == F.col("first.k"))
    rows = materialise(rows.select("id", "h", "k", "n", stays.alias("stays")).where("n > 1 OR NOT stays"), "gone")
    again = rows.where("stays").select("id", "h", "k")
    names = docs.columns
    own = [next(n for n in (c + "_" * i for i in itertools.count()) if n not in names) for c in ("_h", "_k")]  # whatever docs' columns are called
    keyed = docs.withColumns(dict(zip(own, row_keys(docs["text"]))))

    def same(other):
        return keyed["doc_id"].cast("bigint").eqNullSafe(other["id"]) & (keyed[own[0]] == other["h"]) & (keyed[own[1]] == other["k"])

    kept = keyed.join(rows, same(rows), "left_anti").select(names)
    if again.isEmpty():
        return kept
    row = F.struct(*names)  # the least as JSON, for maps have no order
    copies = keyed.join(again, same(again), "left_semi").groupBy("doc_id", *own).agg(F.min_by(row, F.to_json(row)).alias("row"))
    return kept.unionByName(copies.select("row.*"))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the smallest node that it reaches.

    Alternates large-star and small-star steps: each node hands its smallest neighbour to its
    larger, then to its smaller neighbours. Rounds grow with the logarithm of the longest path.
    Minima are pre-aggregated before they are shuffled, so a node with very many links is no
    hot group; each round is a written table. Empty edges give an empty result.
    """
    pairs = materialise(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges"
    )

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        else:
            both = e
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        joined = both.join(low, "u")
        if large:
            out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
                low.select("u", F.col("m").alias("v"))
            )
        return out.where("u <> v").distinct()

    def state(e: DataFrame) -> tuple:
        row = e.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.col("v").cast("decimal(38,0)"))
        ).first()
        return tuple(row)

    before = state(pairs)
    for _ in range(max_rounds):
        if not before[0]:
            break
        pairs = materialise(star(star(pairs, large=True), large=False), "star")
        after = state(pairs)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
