"""Joins that Spark has no operator for: ranges, as-of, nearest, first fit, and joins that must be unique."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def range_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, start: str, end: str, width: int, how: str = "inner") -> DataFrame:
    """Rows of left (start, end: inclusive whole numbers) with the rows of right whose at lies between, and equal keys.

    Ranges are dealt to bins of width, a point falls into one bin, so the join is an equi-join on keys and bin; every
    pair meets in exactly one bin. Choose width near the usual length of a range.
    """
    bins = left.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    points = right.withColumn("_bin", F.floor(F.col(at) / width))
    joined = bins.join(points, [*keys, "_bin"], how).where(F.col(at).between(F.col(start), F.col(end)))
    return joined.drop("_bin")


def amount_range_join(left: DataFrame, right: DataFrame, keys: list[str], amount: str, other: str, tolerance_cents: int) -> DataFrame:
    """Rows whose amounts in cents differ by at most a tolerance, over an equi-join on bins of the tolerance's size."""
    width = max(tolerance_cents, 1)
    low, high = F.col(amount) - tolerance_cents, F.col(amount) + tolerance_cents
    return range_join(left.withColumns({"_low": low, "_high": high}), right, keys, other, "_low", "_high", width).drop("_low", "_high")


def asof_latest(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, values: list[str], tie: list[str], allow_later: int = 0) -> DataFrame:
    """Each row of left with the values of right's latest row at or before left_at (plus allow_later); null if none.

    Both sides are sorted once by key and time; the last right row seen is carried forward, so a key with
    many rows on both sides costs a sort, never their product. tie orders right rows of equal time.
    """
    sides = ["_side", "_at", "_tie", "_left", "_right"]
    lefts = left.select(*keys, F.lit(1).alias("_side"), (F.col(left_at) + allow_later).alias("_at"), F.lit(None).alias("_tie"), F.struct(*left.columns).alias("_left"), F.lit(None).alias("_right"))
    rights = right.select(*keys, F.lit(0).alias("_side"), F.col(right_at).alias("_at"), F.struct(*tie).alias("_tie"), F.lit(None).alias("_left"), F.struct(right_at, *values).alias("_right"))
    both = rights.unionByName(lefts)
    order = Window.partitionBy(*keys).orderBy("_at", "_side", F.col("_tie").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_seen", F.last("_right", ignorenulls=True).over(order)).where("_side = 1")
    return seen.select("_left.*", *(F.col(f"_seen.{c}").alias(f"asof_{c}") for c in [right_at, *values])).drop(*sides)


def parameter_asof(rows: DataFrame, versions: DataFrame, key: str, day: str, by_version: bool = True) -> DataFrame:
    """rows with the value of parameter key valid on day: the newest version that has begun, as column key.

    versions(key, value, version, valid_from) is small: only one parameter's rows are used. by_version ranks by
    version, then start; otherwise by start, then version.
    """
    rank = F.struct("version", "valid_from") if by_version else F.struct("valid_from", "version")
    own = versions.where(F.col("key") == key).select("value", "valid_from", rank.alias("rank"))
    listed = own.agg(F.collect_list(F.struct("rank", "valid_from", "value")).alias("_versions"))
    begun = F.filter("_versions", lambda v: v["valid_from"] <= F.col(day))
    best = F.array_max(F.transform(begun, lambda v: F.struct(v["rank"].alias("rank"), v["value"].alias("value"))))
    return rows.join(F.broadcast(listed)).withColumn(key, best["value"]).drop("_versions")  # one row: the versions of one parameter


def nearest(left: DataFrame, right: DataFrame, keys: list[str], value: str, other: str, tie: str) -> DataFrame:
    """Each row of left with right's row of equal keys and nearest value, ties to the smallest tie.

    Only two neighbours can be nearest, the last at or below and the first at or above: each is the last one seen in a sort of
    its own. (A frame up to the end of the key would be read again for every row.)
    """
    lefts = left.select(*keys, F.lit(1).alias("_side"), F.col(value).alias("_v"), F.lit(None).alias("_tie"), F.struct(*left.columns).alias("_left"), F.lit(None).alias("_right"))
    best = right.groupBy(*keys, other).agg(F.min_by(F.struct(*right.columns), tie).alias("_right"), F.min(tie).alias("_tie"))
    rights = best.select(*keys, F.lit(0).alias("_side"), F.col(other).alias("_v"), "_tie", F.lit(None).alias("_left"), "_right")
    both = rights.unionByName(lefts)
    up = Window.partitionBy(*keys).orderBy("_v", "_side").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*keys).orderBy(F.col("_v").desc(), "_side").rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumns({"_below": F.last("_right", ignorenulls=True).over(up), "_above": F.last("_right", ignorenulls=True).over(down)}).where("_side = 1")
    gap_below, gap_above = F.col("_v") - F.col(f"_below.{other}"), F.col(f"_above.{other}") - F.col("_v")
    below_wins = F.col("_above").isNull() | (gap_below < gap_above) | ((gap_below == gap_above) & (F.col(f"_below.{tie}") <= F.col(f"_above.{tie}")))
    picked = near.withColumn("_best", F.when(F.col("_below").isNotNull() & below_wins, F.col("_below")).otherwise(F.col("_above")))
    return picked.select("_left.*", *(F.col(f"_best.{c}").alias(f"near_{c}") for c in right.columns if c not in keys))


def unique_match(left: DataFrame, right: DataFrame, key: Column | str, other: Column | str, left_id: str, right_id: str) -> DataFrame:
    """(left_id, right_id) where a key stands exactly once on each side."""

    def once(df, k, i):
        return df.select(k.alias("_k") if isinstance(k, Column) else F.col(k).alias("_k"), i).where("_k IS NOT NULL").groupBy("_k").agg(F.count(F.lit(1)).alias("n"), F.min(i).alias(i)).where("n = 1").drop("n")

    return once(left, key, left_id).join(once(right, other, right_id), "_k").select(left_id, right_id)


def two_phase_match(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], left_id: str, right_id: str) -> DataFrame:
    """(left_id, right_id, phase): unique matches on the first key; what is left is tried on the next one."""
    out = None
    for phase, (key, other) in enumerate(keys, 1):
        found = unique_match(left, right, key, other, left_id, right_id).withColumn("phase", F.lit(phase))
        out = found if out is None else out.unionByName(found)
        left, right = left.join(found, left_id, "left_anti"), right.join(found, right_id, "left_anti")
    return out


def attribute_or(rows: DataFrame, units: DataFrame, row_id: str, unit: str, pairs: list[tuple[str, str]], day: str, valid_from: str, valid_to: str) -> DataFrame:
    """(row_id, unit) for rows that exactly one unit matches on any of the key pairs while it is valid.

    The OR is a union of equi-joins, so no nested loop is needed.
    """
    found = None
    for mine, theirs in pairs:
        side = units.select(F.col(theirs).alias("_k"), unit, valid_from, valid_to).where("_k IS NOT NULL")
        hit = rows.withColumn("_k", F.col(mine)).join(side, "_k")
        hit = hit.where((F.col(valid_from).isNull() | (F.col(valid_from) <= F.col(day))) & (F.col(valid_to).isNull() | (F.col(valid_to) >= F.col(day))))
        hit = hit.select(row_id, unit)
        found = hit if found is None else found.unionByName(hit)
    return found.groupBy(row_id).agg(F.min(unit).alias(unit), F.max(unit).alias("_max")).where(F.col(unit) == F.col("_max")).drop("_max")


def shared_attributes(rows: DataFrame, entity: str, kind: str, value: str) -> DataFrame:
    """(kind, value, entity, n): the entities that share an attribute value, one row each, with how many they are.

    Links are membership in the value's class, not pairs, so a value that very many share stays linear.
    """
    members = rows.select(kind, value, entity).where(F.col(value).isNotNull()).distinct()
    size = members.groupBy(kind, value).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return members.join(size, [kind, value])


def numeric_band(rows: DataFrame, group: str, entity: str, number: str, band: int) -> DataFrame:
    """Pairs (entity, other, number, other_number) of a group with numbers at most band apart and different entities."""
    a = rows.select(group, F.col(entity).alias("entity"), F.col(number).alias("number"), (F.col(number) + 1).alias("_from"), (F.col(number) + band).alias("_to"))
    b = rows.select(group, F.col(entity).alias("other"), F.col(number).alias("other_number"))
    apart = range_join(a, b, [group], "other_number", "_from", "_to", band).drop("_from", "_to")
    same = a.drop("_from", "_to").join(b.withColumn("number", F.col("other_number")), [group, "number"]).where("entity < other")
    return apart.unionByName(same.select(apart.columns)).where("entity <> other")


def interval_overlap(left: DataFrame, right: DataFrame, keys: list[str], start: str, end: str, other_start: str, other_end: str) -> DataFrame:
    """left with covered: whether any interval of right overlaps it, over month bins of both sides."""

    def months(df, a, b):
        return df.withColumn("_m", F.explode(F.sequence(F.trunc(a, "MM"), F.trunc(b, "MM"), F.expr("interval 1 month"))))

    mine = months(left.withColumn("_row", F.struct(*left.columns)), start, end)
    theirs = months(right.select(*keys, F.col(other_start).alias("_a"), F.col(other_end).alias("_b")), "_a", "_b")
    hit = mine.join(theirs, [*keys, "_m"]).where((F.col("_a") <= F.col(end)) & (F.col("_b") >= F.col(start))).select("_row").distinct()
    marked = left.withColumn("_row", F.struct(*left.columns)).join(hit.withColumn("covered", F.lit(True)), "_row", "left")
    return marked.drop("_row").withColumn("covered", F.coalesce("covered", F.lit(False)))
