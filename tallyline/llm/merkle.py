"""Merkle dataset manifest by iterative DataFrame levels.

A row is a leaf: the sha256, in lowercase hex, of its fields, each with its byte count. Within a group leaves ascend by their
order; a row's number, floor-divided by the fan-out, is its parent's. A level is grouped by parent, the sorted array of a
parent's children is hashed into it, and so on until each group has one node, its subroot; the subroots, ordered by
group, make a tree in the same way, whose last node is the root. Coming down again, one join a level hands each node what its parent
holds (the siblings of all levels above) and appends the node's own siblings. So a proof is made once for
all leaves that share it, and the last join makes the rows.

Rows are numbered without bringing a group together: they are dealt by ranges of (group, order), numbered within each range,
and the ranges' counts, summed in order, are added. Every level is a written table in the folder that executors share, a
fan-out smaller than the one below it.

A null field is the byte `-`; null groups come first and are a group. Rows equal in group and id ascend by their leaf;
of wholly equal rows any order gives the same tree. Rows without an id come first in their group. Texts are hashed whole, however long; an empty one differs from a null one.
An empty table gives no rows. Columns that are not named as fields don't matter, whatever they are called.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.llm.common import materialise

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(fields: list[Column]) -> Column:
    """H of fields: each `-` if null, else its bytes in UTF-8, counted, then `:` and the value."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _key(group: Column) -> Column:
    """A group as a text that is never null; null's comes first, others keep their order."""
    return F.when(group.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), group.cast("string")))


def number(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows(key, ...) with i, from 0 in order within key, and n, the key's rows. Written; equal rows are dealt apart by a number of their own."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = materialise(rows.withColumn("_row", F.monotonically_increasing_id()), "unnumbered")
    dealt = materialise(rows.repartitionByRange(n, "key", *order, "_row").withColumn("_part", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("key", "_part").agg(F.count(F.lit(1)).alias("_n"))
    by = Window.partitionBy("key")
    before = F.sum("_n").over(by.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    counts = materialise(counts.select("key", "_part", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(by).alias("n")), "counts")
    own = F.row_number().over(Window.partitionBy("key", "_part").orderBy(*order, "_row"))
    numbered = dealt.withColumn("_own", own).join(counts, ["key", "_part"])
    return numbered.withColumn("i", F.col("_before") + F.col("_own") - 1).drop("_row", "_part", "_own", "_before")


def levels(nodes: DataFrame, fanout: int = FANOUT) -> tuple[list[DataFrame], DataFrame]:
    """(families, tops) of nodes(key, i, n, h, ...).

    families[k] has (key, i, n, h, children) of each parent of nodes of level k, children being structs of the columns of the level, by i;
    tops has (key, level, h) of each key's last node.
    """
    families, tops, level, n = [], [], 0, nodes
    most = n.agg(F.max("n")).first()[0] or 0
    while most:
        tops.append(n.where("n = 1").select("key", F.lit(level).alias("level"), "h"))
        if most == 1:
            break
        inner = [c for c in n.columns if c not in ("key", "n")]
        child = F.struct("i", *(c for c in inner if c != "i"))
        grouped = n.where("n > 1").groupBy("key", F.floor(F.col("i") / fanout).alias("p")).agg(F.first("n").alias("n"), F.sort_array(F.collect_list(child)).alias("children"))
        up = grouped.select(
            "key", F.col("p").alias("i"), F.ceil(F.col("n") / fanout).alias("n"), F.sha2(F.array_join(F.transform("children", lambda c: c["h"]), ""), 256).alias("h"), "children"
        )
        families.append(materialise(up, "level"))
        n, most, level = families[-1].select("key", "i", "n", "h"), -(-most // fanout), level + 1
    out = nodes.select("key", F.lit(0).alias("level"), "h").limit(0)
    for part in tops:
        out = out.unionByName(part)
    return families, out


def descend(families: list[DataFrame], tops: DataFrame, alone: DataFrame) -> DataFrame:
    """Every leaf's columns beside what tops(key, level, path, ...) has for its key, path being (left, right) siblings from the leaf up.

    alone are the leaves of keys with one; path ends with the siblings that tops has.
    """
    carried = [c for c in tops.columns if c not in ("key", "level", "path")]
    down = None
    for level in range(len(families) - 1, -1, -1):
        starts = tops.where(F.col("level") == level + 1).select("key", F.lit(0).cast("bigint").alias("i"), "path", *carried)
        above = starts if down is None else down.select("key", "i", "path", *carried).unionByName(starts)
        met = families[level].select("key", "i", "children").join(above, ["key", "i"])
        each = met.select("key", "path", *carried, "children", F.explode("children").alias("c"))

        def side(before: bool):
            part = F.filter("children", lambda x: (x["i"] < F.col("c")["i"]) if before else (x["i"] > F.col("c")["i"]))
            return F.array_join(F.transform(part, lambda x: x["h"]), "")

        step = F.array(F.struct(side(True).alias("left"), side(False).alias("right")))
        down = each.select("key", "c.*", F.concat(step, F.col("path")).alias("path"), *carried)
    single = alone.join(tops.where("level = 0"), "key").select(*alone.columns, "path", *carried)
    return single if down is None else down.unionByName(single.select(down.columns))


def fold(leaf: Column, path: Column) -> Column:
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def manifest(docs: DataFrame, changed: Column, tampered: Column, fields=FIELDS, id_col: str = "doc_id", group_col: str = "lang", text_col: str = "text", fanout: int = FANOUT) -> DataFrame:
    """id_col, leaf, subroot, root, proof_sha256, folded_root and verified of every row, and its proof, (left, right) siblings from the leaf up.

    folded_root folds the proof into the row's leaf as it is now: where changed holds, of the row with tampered in place of text_col. It equals
    root (verified) if the row is still the one that the manifest was made of.
    """
    now = [tampered if f == text_col else docs[f] for f in fields]
    leaves = docs.select(_key(docs[group_col]).alias("key"), docs[id_col].alias("id"), digest([docs[f] for f in fields]).alias("h"), F.when(changed, digest(now)).alias("altered"))
    leaves = materialise(number(leaves, ["id", "h"]).select("key", "i", "n", "h", "id", "altered"), "leaves")
    families, tops = levels(leaves, fanout)
    tops = materialise(tops, "subroots")
    groups = number(tops.select(F.lit("").alias("key"), F.col("key").alias("own"), F.col("level").alias("depth"), "h"), ["own"])
    groups = materialise(groups.select("key", "i", "n", "h", "own", "depth"), "groups")
    above, roots = levels(groups, fanout)
    empty = F.array().cast("array<struct<left: string, right: string>>")
    roots = roots.select("key", "level", empty.alias("path"), F.col("h").alias("root"))
    named = descend(above, roots, groups.where("n = 1").drop("n"))
    named = materialise(named.select(F.col("own").alias("key"), F.col("depth").alias("level"), "path", F.col("h").alias("subroot"), "root"), "subroots")
    out = descend(families, named, leaves.where("n = 1").drop("n"))
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    out = out.select(
        F.col("id").alias(id_col), F.col("h").alias("leaf"), "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), fold(F.coalesce("altered", "h"), F.col("path")).alias("folded_root"), F.col("path").alias("proof")
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def audit(docs: DataFrame) -> DataFrame:
    """manifest() of documents, held against rows of which those whose id's crc32 3 divides have their text in lower case."""
    text = docs["text"]
    return manifest(docs, F.crc32(docs["doc_id"].cast("string")) % 3 == 0, lower_ascii(text)).drop("proof")


_FIELD_SQL = "coalesce(strlen({0}) || ':' || {0}, '-')"
_ROW_SQL = " || ".join(_FIELD_SQL.format(f"CAST({f} AS VARCHAR)") for f in FIELDS)
_TAMPERED_SQL = _ROW_SQL.replace("CAST(text AS VARCHAR)", f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')")
# crc32 of a short text from its definition, bit by bit
_CRC_SQL = (
    "list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, strlen(CAST(doc_id AS VARCHAR)) + 1), lambda p: ascii(substr(CAST(doc_id AS VARCHAR), p::INT, 1))::BIGINT)),"
    " lambda c, b: list_reduce(list_prepend(xor(c, b), range(1, 9)), lambda a, k: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END)))"
)


def _tree_sql(name: str, leaves: str) -> str:
    """name_nodes: every node; name_sides: beside it its run's hashes before and after it."""
    run = f"OVER (PARTITION BY key, lvl, i // {FANOUT} ORDER BY i ROWS BETWEEN"
    return f"""{name}_nodes(key, lvl, i, n, h) AS (
  SELECT key, 0, i, n, h FROM {leaves}
  UNION ALL
  SELECT key, lvl + 1, i // {FANOUT}, (any_value(n) + {FANOUT - 1}) // {FANOUT}, sha256(string_agg(h, '' ORDER BY i)) FROM {name}_nodes WHERE n > 1 GROUP BY key, lvl, i // {FANOUT}
), {name}_sides AS (
  SELECT *, coalesce(string_agg(h, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM {name}_nodes WHERE n > 1
)"""


def _climb_sql(name: str, start: str) -> str:
    return f"""{name}_climb(id, key, lvl, i, f, s) AS (
  {start}
  UNION ALL
  SELECT c.id, c.key, c.lvl + 1, c.i // {FANOUT}, sha256(x.l || c.f || x.r), c.s || x.l || x.r FROM {name}_climb c JOIN {name}_sides x ON x.key = c.key AND x.lvl = c.lvl AND x.i = c.i
)"""


AUDIT_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY key) AS n, row_number() OVER () AS id
  FROM (SELECT doc_id, CASE WHEN lang IS NULL THEN '0' ELSE '1' || lang END AS key, sha256({_ROW_SQL}) AS h, CASE WHEN xor({_CRC_SQL}, 4294967295) % 3 = 0 THEN sha256({_TAMPERED_SQL}) END AS altered FROM documents)
), {_tree_sql("low", "leaves")}, subroots AS (
  SELECT '' AS key, key AS own, h, row_number() OVER (ORDER BY key) - 1 AS i, count(*) OVER () AS n FROM low_nodes WHERE n = 1
), {_tree_sql("top", "subroots")},
{_climb_sql("low", "SELECT id, key, 0, i, coalesce(altered, h), '' FROM leaves")},
{_climb_sql("top", "SELECT c.id, '', 0, t.i, c.f, c.s FROM low_climb c JOIN low_nodes d ON d.key = c.key AND d.lvl = c.lvl AND d.i = c.i AND d.n = 1 JOIN subroots t ON t.own = c.key")},
root AS (SELECT h FROM top_nodes WHERE n = 1)
SELECT e.doc_id, e.h AS leaf, t.h AS subroot, root.h AS root, sha256(c.s) AS proof_sha256, c.f AS folded_root, c.f = root.h AS verified
FROM top_climb c JOIN top_nodes z ON z.lvl = c.lvl AND z.i = c.i AND z.n = 1 JOIN leaves e ON e.id = c.id JOIN subroots t ON t.own = e.key CROSS JOIN root
"""
