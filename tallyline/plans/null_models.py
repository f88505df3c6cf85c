"""Null models: what a pattern's count would be by chance, by seeded permutations, and the gate that a pattern finding must pass.

A permutation deals the entities' labels anew among the rows of each stratum: the row whose hash of (seed, permutation, id) ranks r-th gets the label
of the row whose id ranks r-th. Which row goes where depends on the hash alone, so a seed gives one answer whatever the partitions. A stratum's rows
are dealt once and permuted where they lie; only those of strata over STRATUM rows are written once for each permutation, whose groups are then tasks of their own.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyline.operators.scratch import materialise

#: Rules whose hits are patterns: their findings need a null model.
PATTERN_RULES = ("C4", "C5", "A5", "A10", "B3")
#: Fixed value: rows of a stratum that a task holds to permute them.
STRATUM = 1_000_000


def _dealt(labelled: DataFrame, permutations: int, seed: int) -> DataFrame:
    """(entity, _p, n) of labelled(_stratum, _text, _r, entity, _hit): in each permutation, the hits on each entity's places. A task holds a stratum of at most STRATUM rows."""
    rows = labelled.select("_stratum", "_r", F.col("_text").alias("_id"), "_hit", "entity").repartition("_stratum").sortWithinPartitions("_stratum", "_r")
    schema = rows.select("entity", F.lit(0).alias("_p"), F.lit(0).cast("bigint").alias("n")).schema

    def count(table):
        hits, labels = np.flatnonzero(table.column("_hit").to_numpy()), table.column("entity").combine_chunks().dictionary_encode()
        if not len(hits):
            return
        ids = [b"|" + i.encode() for i in table.column("_id").to_pylist()]
        place = labels.indices.fill_null(len(labels.dictionary)).to_numpy(zero_copy_only=False)
        for p in range(permutations):
            head = hashlib.md5(f"{seed}|{p}".encode(), usedforsecurity=False)
            key = []
            for i in ids:
                made = head.copy()
                made.update(i)
                key.append(made.digest())
            key = np.frombuffer(b"".join(key), dtype=">u8").reshape(-1, 2)
            order = np.argsort(key[:, 0], kind="stable")  # rows lie by id, which decides between equal hashes
            first = key[order, 0]
            if (first[1:] == first[:-1]).any():
                order = np.lexsort((key[:, 1], key[:, 0]))
            rank = np.empty(len(order), dtype=np.int64)
            rank[order] = np.arange(len(order))
            n = np.bincount(place[rank[hits]], minlength=len(labels.dictionary) + 1)[:-1]
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([labels.dictionary.take(pa.array(some)), pa.array(np.full(len(some), p, dtype=np.int32)), pa.array(n[some])], names=["entity", "_p", "n"])

    def run(batches):
        key, held = None, []
        for batch in batches:
            names = batch.column(0).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if held and names[a] != key:
                    yield from count(pa.Table.from_batches(held))
                    held = []
                key = names[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from count(pa.Table.from_batches(held))

    return rows.mapInArrow(run, schema)


def permutation_null(rows: DataFrame, row_id: str, strata: list[str], entity: str, hit: str, permutations: int = 200, seed: int = 1, percent: int = 95) -> DataFrame:
    """(entity, observed, null_mean, null_p95, p_value, permutations, exceeds): each entity's rows with hit against its count under permutations.

    null_p95 is the smallest count that at least percent % of the permutations do not pass, p_value the share of permutations (and the data themselves) whose
    count is at least the observed one. Rows without an entity keep their place in the stratum, but are nobody's. Ids must be distinct.
    """
    stratum = F.to_json(F.struct(*(F.col(s).alias(f"s{i}") for i, s in enumerate(strata))), {"ignoreNullFields": "false"}).alias("_stratum")
    rows = rows.select(stratum, F.col(row_id).alias("_id"), F.col(entity).alias("entity"), F.coalesce(F.col(hit), F.lit(False)).alias("_hit"))
    labelled = materialise(rows.withColumn("_r", F.row_number().over(Window.partitionBy("_stratum").orderBy("_id"))), "labelled")
    text = F.col("_id").cast("string")
    size = labelled.groupBy("_stratum").agg(F.count(F.lit(1)).alias("_size"), F.count(text).alias("_ids"))
    few = (F.col("_size") <= STRATUM) & (F.col("_ids") == F.col("_size"))
    small = labelled.withColumn("_text", text).join(size.where(few).select("_stratum"), "_stratum", "left_semi")
    large = labelled.join(size.where(~few).select("_stratum"), "_stratum", "left_semi")
    labels = large.select("_stratum", "_r", "entity")
    dealt = large.select("_stratum", "_id", "_hit", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))).alias("_p"))
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("_p").cast("string"), text).cast("binary"))
    dealt = dealt.withColumn("_r", F.row_number().over(Window.partitionBy("_p", "_stratum").orderBy(key, "_id"))).where("_hit")
    counts = dealt.join(labels, ["_stratum", "_r"]).groupBy("entity", "_p").agg(F.count(F.lit(1)).alias("n")).unionByName(_dealt(small, permutations, seed))
    counts = counts.where("entity IS NOT NULL").groupBy("entity", "_p").agg(F.sum("n").alias("n"))
    observed = rows.where("entity IS NOT NULL").groupBy("entity").agg(F.count_if("_hit").alias("observed"))
    listed = counts.groupBy("entity").agg(F.array_sort(F.collect_list("n")).alias("_n"))  # at most one a permutation; the others are 0
    both = observed.join(listed, "entity", "left").withColumn("_n", F.coalesce("_n", F.array().cast("array<bigint>")))
    zeros, rank = permutations - F.size("_n"), -(-percent * permutations // 100)
    at_least = F.when(F.col("observed") <= 0, permutations).otherwise(F.size(F.filter("_n", lambda n: n >= F.col("observed"))))
    total = F.aggregate("_n", F.lit(0).cast("bigint"), lambda a, n: a + n)
    out = both.select(
        "entity", "observed", (total / permutations).alias("null_mean"), F.coalesce(F.get("_n", (F.lit(rank) - zeros - 1).cast("int")), F.lit(0)).alias("null_p95"), ((at_least + 1) / (permutations + 1)).alias("p_value"), F.lit(permutations).alias("permutations")
    )
    return out.withColumn("exceeds", F.col("observed") > F.col("null_p95"))


def gate(findings: DataFrame, nulls: DataFrame, rule: str = "rule_code", entity: str = "entity") -> DataFrame:
    """findings with worklist_eligible: those of pattern rules only where nulls(rule, entity, exceeds) says that the count exceeds chance."""
    known = nulls.select(F.col(rule).alias("_rule"), F.col(entity).alias("_entity"), F.col("exceeds").alias("_exceeds"))
    met = findings.join(known, (F.col(rule) == F.col("_rule")) & (F.col(entity) == F.col("_entity")), "left")
    pattern = F.col(rule).isin(*PATTERN_RULES)
    return met.withColumn("worklist_eligible", ~F.coalesce(pattern, F.lit(False)) | F.coalesce("_exceeds", F.lit(False))).drop("_rule", "_entity", "_exceeds")
