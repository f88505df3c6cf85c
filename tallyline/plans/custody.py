"""Custody chain: hash anchors over append-only tables, each chained to the one before, with proofs that a row, and an earlier anchor, are in it.

An anchor's leaves are, in this order: the root of the anchor before, if there is one, then each table's rows by id. A leaf is the SHA-256 of
`previous_root:<root>` or `<table>:<row hash>`, so equal rows of different tables differ. Nodes are hashed in pairs of raw digests; an odd
last node is paired with itself; the root of nothing is that of an empty text. Levels are tables: a level is one grouping of half the rows below it, and
siblings are joined level by level, so neither leaves nor nodes ever meet in one task or on the driver.

Rows without an id come first. Tables that are missing, or have no rows, give no leaves.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.operators.scratch import materialise

#: The tables that an anchor covers, in the order of its leaves.
TABLES = ("files", "extraction_runs", "field_revisions", "validator_results", "finding_reviews", "audit_log", "external_checks")
EMPTY_ROOT = hashlib.sha256(b"").hexdigest()


class Anchor(NamedTuple):
    root: str
    leaf_count: int
    previous_root: str | None
    row_counts: dict[str, int]
    levels: list[DataFrame]


def row_hash(*columns: Column) -> Column:
    """The SHA-256 of a row's values as a JSON list, nulls included."""
    return F.sha2(F.to_json(F.array(*(c.cast("string") for c in columns)), {"ignoreNullFields": "false"}), 256)


def _pair(left: Column, right: Column) -> Column:
    return F.sha2(F.concat(F.unhex(left), F.unhex(right)), 256)


def leaves(tables: dict[str, DataFrame], previous_root: str | None = None) -> DataFrame:
    """(i, source, id, h): the leaves of tables, which have columns (id, row_hash), numbered from 0. Written.

    Rows are dealt by ranges of (table, id) and numbered within each; the ranges' sizes, added up, give where each begins.
    """
    spark = next(iter(tables.values())).sparkSession
    rows = None
    for place, name in enumerate(t for t in TABLES if t in tables):
        own = tables[name].select(F.lit(place).alias("place"), F.lit(name).alias("source"), F.col("id").cast("string").alias("id"), F.sha2(F.concat(F.lit(f"{name}:"), F.col("row_hash")), 256).alias("h"))
        rows = own if rows is None else rows.unionByName(own)
    if previous_root:
        first = spark.createDataFrame([(-1, "previous_root", None, hashlib.sha256(f"previous_root:{previous_root}".encode()).hexdigest())], rows.schema)
        rows = rows.unionByName(first)
    order = ("place", "id", "h")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialise(rows.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "leaves")
    counts = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    starts = counts.alias("a").join(counts.alias("b"), F.col("b.part") < F.col("a.part"), "left").groupBy(F.col("a.part").alias("part")).agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("start"))  # a row a range
    own = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return materialise(dealt.withColumn("own", own).join(starts, "part").select((F.col("start") + F.col("own")).alias("i"), "source", "id", "h"), "numbered")


def anchor(tables: dict[str, DataFrame], previous_root: str | None = None) -> Anchor:
    """The anchor over tables, with the levels of its tree, each (i, h), the leaves' with source and id."""
    level = leaves(tables, previous_root)
    counts = {r.source: r.n for r in level.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a table
    size = total = sum(counts.values())
    levels = [level]
    while size > 1:
        pairs = level.groupBy(F.floor(F.col("i") / 2).alias("p")).agg(F.min_by("h", "i").alias("a"), F.max_by("h", "i").alias("b"))  # one alone is its own pair
        level = materialise(pairs.select(F.col("p").alias("i"), _pair(F.col("a"), F.col("b")).alias("h")), "level")
        levels.append(level)
        size = (size + 1) // 2
    root = level.first().h if total else EMPTY_ROOT
    return Anchor(root, total, previous_root, {k: v for k, v in counts.items() if k != "previous_root"}, levels)


def proofs(found: Anchor, rows: DataFrame) -> DataFrame:
    """(i, source, id, h, path) of the leaves that rows(source, id) names: path has (right, sibling) from the leaf up, right saying on which side it stands."""
    at = found.levels[0].join(rows.select("source", "id").distinct(), ["source", "id"]).select("i", "source", "id", "h", F.col("i").alias("at"), F.array().cast("array<struct<right: boolean, sibling: string>>").alias("path"))
    size = found.leaf_count
    for level in found.levels[:-1]:
        other = F.when(F.col("at") % 2 == 1, F.col("at") - 1).otherwise(F.least(F.col("at") + 1, F.lit(size - 1)))
        step = F.struct((F.col("at") % 2 == 0).alias("right"), F.col("sibling"))
        at = at.withColumn("other", other).join(level.select(F.col("i").alias("other"), F.col("h").alias("sibling")), "other")
        at = at.select("i", "source", "id", "h", F.floor(F.col("at") / 2).alias("at"), F.array_append("path", step).alias("path"))
        size = (size + 1) // 2
    return at.drop("at")


def folded(h: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, h, lambda a, s: F.when(s["right"], _pair(a, s["sibling"])).otherwise(_pair(s["sibling"], a)))


def follows(later: Anchor, earlier: Anchor) -> bool:
    """Whether later is chained to earlier: its first leaf is earlier's root, and its proof leads to later's root."""
    first = later.levels[0].where("i = 0").select("source", "id", "i", "h")
    if later.previous_root != earlier.root or first.first() is None or first.first().source != "previous_root":
        return False
    want = hashlib.sha256(f"previous_root:{earlier.root}".encode()).hexdigest()
    at, h, size = 0, want, later.leaf_count
    for level in later.levels[:-1]:
        sibling = level.where(F.col("i") == min(at ^ 1, size - 1)).first().h
        h = hashlib.sha256(bytes.fromhex(h) + bytes.fromhex(sibling)).hexdigest() if at % 2 == 0 else hashlib.sha256(bytes.fromhex(sibling) + bytes.fromhex(h)).hexdigest()
        at, size = at // 2, (size + 1) // 2
    return h == later.root


def missing(earlier: Anchor, tables: dict[str, DataFrame]) -> DataFrame:
    """(source, id): leaves of an earlier anchor that tables no longer have as they were: rows changed or deleted since."""
    now = leaves(tables)
    return earlier.levels[0].where("source <> 'previous_root'").join(now.select("source", "id", "h"), ["source", "id", "h"], "left_anti").select("source", "id")
