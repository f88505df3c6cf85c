"""Ordered operators: latest rows, coverage, chains, folds, groupings and votes."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the largest by order (ties go to the later columns of order).

    A partial aggregate: only the best row of a key leaves each task.
    """
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_best"))
    return best.select(*keys, *(F.col("_best")[c].alias(c) for c in rest))


def month_coverage(spans: DataFrame, periods: DataFrame, key: str, first: str, last: str, start: str, end: str) -> DataFrame:
    """(key, month, covered): each month from first to last of spans, and whether a period of periods overlaps it."""
    months = spans.select(key, F.explode(F.sequence(F.trunc(first, "MM"), F.trunc(last, "MM"), F.expr("interval 1 month"))).alias("month"))
    held = periods.select(key, F.explode(F.sequence(F.trunc(start, "MM"), F.trunc(end, "MM"), F.expr("interval 1 month"))).alias("month")).distinct()
    return months.join(held.withColumn("_held", F.lit(True)), [key, "month"], "left").select(key, "month", F.coalesce("_held", F.lit(False)).alias("covered"))


def segments(rows: DataFrame, key: str, order: str, mark: str) -> DataFrame:
    """rows with segment: a number that grows by one wherever mark differs from the row before."""
    by = Window.partitionBy(key).orderBy(order)
    changed = F.coalesce((F.col(mark) != F.lag(mark).over(by)).cast("int"), F.lit(0))
    return rows.withColumn("_changed", changed).withColumn("segment", F.sum("_changed").over(by.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_changed")


def chain_index(rows: DataFrame, key: str, order: str, base: str, value: str, links: DataFrame | None = None) -> DataFrame:
    """rows with chained: all values on the last segment's base.

    Where base changes, the values before it are multiplied by a factor: links(key, order, link) names it for the first
    row of a segment, else it is that row's value over the last one before (a series that restarts at the same level).
    A missing link makes everything before it null.
    """
    seg = segments(rows, key, order, base)
    by = Window.partitionBy(key).orderBy(order)
    starts = F.col("segment") != F.lag("segment").over(by)
    if links is None:
        seg = seg.withColumn("_link", F.when(starts, F.col(value) / F.lag(value).over(by)))
    else:
        seg = seg.join(links.select(key, order, F.col("link").alias("_given")), [key, order], "left").withColumn("_link", F.when(starts, F.col("_given"))).drop("_given")
    seg = seg.withColumn("_start", F.coalesce(starts, F.lit(False)))
    later = by.rowsBetween(1, Window.unboundedFollowing)
    lost = F.coalesce(F.max(F.col("_start") & F.col("_link").isNull()).over(later), F.lit(False))
    factor = F.exp(F.coalesce(F.sum(F.when(F.col("_start"), F.log("_link"))).over(later), F.lit(0.0)))
    return seg.withColumn("chained", F.when(~lost, F.col(value) * factor)).drop("_link", "_start")


def last_value_at(rows: DataFrame, keys: list[str], order: str, value: str, day: Column) -> DataFrame:
    """(keys, value): the last observation at or before day."""
    return rows.where(F.col(order) <= day).groupBy(*keys).agg(F.max_by(value, order).alias(value))


def running_balance(rows: DataFrame, key: str, order: list[str], amount: str, balance: str, opening: str, tolerance: float = 0.01) -> DataFrame:
    """(key, n, breaks): rows of a key checked against their printed balances; a break re-anchors the sum.

    After a break the printed balance goes on, so one wrong row counts once. Equivalent to comparing each printed
    balance with the last printed one plus the amounts since, so windows express it: no row-by-row fold.
    """
    by = Window.partitionBy(key).orderBy(*order)
    upto, before = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum(F.col(amount).cast("decimal(38,2)")).over(upto)
    printed = rows.withColumn("_sum", total)
    anchor = F.last(F.when(F.col(balance).isNotNull(), F.struct(F.col(balance).cast("decimal(38,2)").alias("b"), F.col("_sum").alias("s"))), ignorenulls=True).over(before)
    start = F.struct(F.col(opening).cast("decimal(38,2)").alias("b"), F.lit(0).cast("decimal(38,2)").alias("s"))
    printed = printed.withColumn("_anchor", F.coalesce(anchor, start))
    expected = F.col("_anchor.b") + F.col("_sum") - F.col("_anchor.s")
    off = F.abs(F.col(balance).cast("decimal(38,2)") - expected) > F.lit(f"{tolerance}").cast("decimal(10,4)")
    return printed.withColumn("_off", F.coalesce(off, F.lit(False))).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_off").cast("int")).cast("bigint").alias("breaks"))


def earliest_per_kind(events: DataFrame, keys: list[str], kind: str, at: str, ref: str) -> DataFrame:
    return events.groupBy(*keys, kind).agg(F.min(F.struct(at, ref)).alias("_m")).select(*keys, kind, F.col(f"_m.{at}").alias(at), F.col(f"_m.{ref}").alias(ref))


def sequence_check(firsts: DataFrame, order: DataFrame, key: str, kind: str, at: str) -> DataFrame:
    """(key, kind, at, before, before_at, ok): stages against those that must precede them.

    order(kind, before, tolerance_days) is a small table of rules. ok is null where the earlier stage is missing.
    """
    wanted = firsts.join(F.broadcast(order), kind)  # a dozen rules
    earlier = firsts.select(key, F.col(kind).alias("before"), F.col(at).alias("before_at"))
    met = wanted.join(earlier, [key, "before"], "left")
    return met.select(key, kind, at, "before", "before_at", (F.datediff(at, "before_at") >= -F.col("tolerance_days")).alias("ok"))


def majority(votes: DataFrame, group: str, value: str, order: str, mixed: str = "mixed") -> DataFrame:
    """(group, value, votes): the commonest value, `mixed` if several are equally common; first_seen names the earliest of them."""
    counts = votes.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first"))
    best = counts.groupBy(group).agg(F.max("_n").alias("_top"))
    top = counts.join(best, group).where("_n = _top").groupBy(group).agg(
        F.count(F.lit(1)).alias("_ties"), F.min_by(value, "_first").alias("first_seen"), F.max("_n").alias("votes")
    )
    return top.select(group, F.when(F.col("_ties") > 1, F.lit(mixed)).otherwise(F.col("first_seen")).alias(value), "first_seen", "votes")


def recurring(rows: DataFrame, key: str, amount: str, least: int = 3, band: float = 0.3) -> DataFrame:
    """(key, n, median): keys with at least `least` amounts, all within band of their median."""
    size = rows.withColumn("_a", F.abs(amount))
    mid = size.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.median("_a").alias("median"), F.min("_a").alias("_low"), F.max("_a").alias("_high"))
    inside = (F.col("_low") >= F.col("median") * (1 - band)) & (F.col("_high") <= F.col("median") * (1 + band))
    return mid.where((F.col("n") >= least) & inside).select(key, "n", "median")


def group_pages(pages: DataFrame, batch: str, order: str, kind: str, link: str, cap: int = 30) -> DataFrame:
    """pages with group: a page opens a new group unless it continues the one before, at most cap pages each.

    link says of a page whether it continues (true), begins (false) or leaves it open (null); an open page continues if it is of
    the commonest kind of its group so far, the first seen of equally common ones. That kind depends on where the group began, so a
    batch is one sorted stream; a task holds the counts of one group.
    """
    sent = pages.repartition(batch).sortWithinPartitions(batch, order)
    at = [pages.columns.index(c) for c in (batch, kind, link)]

    def run(batches):
        key, n, size, counts = None, 0, 0, {}
        for rows in batches:
            groups = []
            for k, what, linked in zip(*(rows.column(i).to_pylist() for i in at)):
                if not groups and not n or k != key:
                    key, n, size = k, 0, 0
                main = max(counts, key=counts.get) if size else None  # dicts keep the order of first sight
                joins = size > 0 and (linked if linked is not None else what is not None and what == main)
                if not joins or size >= cap:
                    n, size, counts = n + 1, 0, {}
                size += 1
                counts[what] = counts.get(what, 0) + 1
                groups.append(n)
            yield rows.append_column("group", pa.array(groups, pa.int32()))

    return sent.mapInArrow(run, StructType([*pages.schema.fields, StructField("group", IntegerType())]))


def context(rows: DataFrame, key: str, order: str, value: str, before: int = 2, after: int = 1) -> DataFrame:
    """rows with context: the values around each row, in order."""
    around = Window.partitionBy(key).orderBy(order).rowsBetween(-before, after)
    return rows.withColumn("context", F.collect_list(value).over(around))


def twins(rows: DataFrame, key: str, order: list[str], row_id: str) -> DataFrame:
    """rows with twin_of: the id of the first row with the same key, null for that one."""
    first = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*order, row_id)).alias("_first"))
    named = rows.join(first.select(key, F.col(f"_first.{row_id}").alias("_id")), key, "left")
    return named.withColumn("twin_of", F.when(F.col("_id") != F.col(row_id), F.col("_id"))).drop("_id")


def near_pages(pages: DataFrame, batch: str, page: str, at: str, bits: str, most_bits: int = 4, seconds: int = 10) -> DataFrame:
    """(page, near): each page with the earliest earlier page within seconds and most_bits of its hash.

    An equi-join on batch and time bins meets neighbours only.
    """
    width = max(seconds, 1)
    mine = pages.select(batch, page, F.col(at).alias("_t"), F.col(bits).alias("_b")).withColumn("_bin", F.explode(F.array(F.floor(F.col("_t") / width) - 1, F.floor(F.col("_t") / width))))
    other = pages.select(batch, F.col(page).alias("near"), F.col(at).alias("_u"), F.col(bits).alias("_c")).withColumn("_bin", F.floor(F.col("_u") / width))
    found = mine.join(other, [batch, "_bin"]).where(
        ((F.col("_u") < F.col("_t")) | ((F.col("_u") == F.col("_t")) & (F.col("near") < F.col(page)))) & (F.col("_t") - F.col("_u") <= seconds) & (F.bit_count(F.col("_b").bitwiseXOR(F.col("_c"))) <= most_bits)
    )
    return found.groupBy(page).agg(F.min(F.struct("_u", "near")).alias("_m")).select(page, F.col("_m.near").alias("near"))


def quota_schedule(units: DataFrame, unit: str, share: str, total: float, start: str, months: int) -> DataFrame:
    """(unit, month, expected): total dealt by share over months, in cents; nulls count as no share."""
    month = F.explode(F.sequence(F.lit(start).cast("date"), F.add_months(F.lit(start).cast("date"), months - 1), F.expr("interval 1 month"))).alias("month")
    due = (F.lit(f"{total}").cast("decimal(18,2)") * F.coalesce(share, F.lit(0)).cast("decimal(9,4)") / 100 / months).cast("decimal(18,2)")
    return units.select(unit, month, due.alias("expected"))


def set_diff(old: DataFrame, new: DataFrame, key: str, compare: list[str]) -> DataFrame:
    """(key, state): missing, unexpected or changed rows between two sets."""
    a = old.select(key, F.struct(*compare).alias("_old"))
    b = new.select(key, F.struct(*compare).alias("_new"))
    state = F.when(F.col("_new").isNull(), "missing").when(F.col("_old").isNull(), "unexpected").when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
    return a.join(b, key, "full").select(key, state.alias("state")).where("state IS NOT NULL")


def merge_keeping(old: DataFrame, new: DataFrame, keys: list[str], status: str, open_status: str = "proposed") -> DataFrame:
    """old merged with new, decided rows kept: outcome is inserted, updated, kept or untouched."""
    columns = [c for c in new.columns if c not in keys]
    a = old.select(*keys, F.struct(*columns).alias("_old"))
    b = new.select(*keys, F.struct(*columns).alias("_new"))
    outcome = F.when(F.col("_old").isNull(), "inserted").when(F.col("_new").isNull(), "untouched").when(F.col(f"_old.{status}") == open_status, "updated").otherwise("kept")
    merged = a.join(b, keys, "full").withColumn("outcome", outcome)
    row = F.when(F.col("outcome").isin("inserted", "updated"), F.col("_new")).otherwise(F.col("_old"))
    return merged.select(*keys, row.alias("_row"), "outcome").select(*keys, *(F.col("_row")[c].alias(c) for c in columns), "outcome")


def merkle_root(leaves: DataFrame, order: list[str], leaf: str) -> str | None:
    """Root of a binary hash tree over leaves in order; an odd last node is paired with itself.

    Each level is one grouping of half its size, so only the root reaches the driver.
    """
    from tallyline.operators.scratch import materialise

    parts = leaves.repartitionByRange(*order).sortWithinPartitions(*order).select(F.col(leaf).alias("h"), F.monotonically_increasing_id().alias("m"))
    parts = materialise(parts, "leaves").withColumn("p", F.shiftright("m", 33))
    before = {}
    total = 0
    for r in parts.groupBy("p").agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect():  # one row a partition
        before[r.p], total = total, total + r.n
    if not total:
        return None
    starts = F.create_map(*(F.lit(x) for pair in before.items() for x in pair))
    level = parts.select("h", (starts[F.col("p")] + F.col("m").bitwiseAND(F.lit((1 << 33) - 1))).alias("i"))
    depth = 0
    while total > 1:
        pairs = level.groupBy(F.floor(F.col("i") / 2).alias("i")).agg(F.array_sort(F.collect_list(F.struct("i", "h"))).alias("s"))
        level = pairs.select("i", F.sha2(F.concat(F.col("s")[0]["h"], F.coalesce(F.get("s", F.lit(1))["h"], F.col("s")[0]["h"])), 256).alias("h"))
        total, depth = (total + 1) // 2, depth + 1
        if depth % 8 == 0:
            level = materialise(level, "level")
    return level.first().h
