"""Expected prices from four layers, expected contributions of units, and index factors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.operators.ordered import chain_index

#: Layer weights, band widths, and from how far outside its band a price is material.
WEIGHTS = {"contract": 0.45, "budget": 0.25, "official": 0.30, "other": 0.20, "history": 0.10, "recurring": 0.35}
SINGLE_BAND, OPEN_BAND, CHANGE_ORDER, HISTORY_EXTRA, MATERIAL = 0.05, 0.10, 0.10, 0.03, 0.25
#: Fixed value: euros a period that a unit may be off.
QUOTA_TOLERANCE = 5


def _layer(rows: DataFrame, name: str, point: Column, low: Column, high: Column, weight: Column | float, tier: Column | None = None) -> DataFrame:
    return rows.select(
        "target_id", F.lit(name).alias("layer"), point.cast("double").alias("price"), low.cast("double").alias("low"), high.cast("double").alias("high"),
        (weight if isinstance(weight, Column) else F.lit(weight)).alias("weight"), (tier if tier is not None else F.lit(None).cast("string")).alias("source_tier"),
    )


def layers(targets: DataFrame, contracts: DataFrame, budgets: DataFrame, benchmarks: DataFrame, history: DataFrame) -> DataFrame:
    """All layers of targets(target_id, qty).

    contracts(target_id, unit_price, fixed_price, change_order), budgets(target_id, approved, tolerance_pct),
    benchmarks(target_id, median, low, high, index_factor, source_tier), history(target_id, prior, ipc, recurring).
    """
    c = contracts.join(targets, "target_id").withColumn("p", F.col("unit_price") * F.col("qty"))
    open_, change = ~F.coalesce("fixed_price", F.lit(False)), F.coalesce("change_order", F.lit(False))
    low = F.when(open_, F.col("p") * (1 - OPEN_BAND)).otherwise(F.col("p"))
    high = F.when(open_, F.col("p") * (1 + OPEN_BAND)).when(change, F.col("p") * (1 + CHANGE_ORDER)).otherwise(F.col("p"))
    tol = F.abs(F.coalesce("tolerance_pct", F.lit(0.0)))
    b = benchmarks.join(targets, "target_id").withColumn("f", F.col("qty") * F.when(F.col("index_factor") > 0, F.col("index_factor")).otherwise(1.0))
    known = contracts.select("target_id").distinct().withColumn("_c", F.lit(True))
    h = history.join(known, "target_id", "left").withColumn("i", F.coalesce("ipc", F.lit(0.0))).withColumn("p", F.col("prior") * (1 + F.col("i")))
    width = F.abs("i") + HISTORY_EXTRA
    return reduce(
        DataFrame.unionByName,
        [
            _layer(c, "contract", F.col("p"), low, high, WEIGHTS["contract"]),
            _layer(budgets, "budget", F.col("approved"), F.col("approved") * (1 - tol), F.col("approved") * (1 + tol), WEIGHTS["budget"]),
            _layer(b, "benchmark", F.col("median") * F.col("f"), F.col("low") * F.col("f"), F.col("high") * F.col("f"), F.when(F.col("source_tier") == "official", WEIGHTS["official"]).otherwise(WEIGHTS["other"]), F.col("source_tier")),
            _layer(h, "history", F.col("p"), F.col("p") * (1 - width), F.col("p") * (1 + width), F.when(F.coalesce("recurring", F.lit(False)) & F.col("_c").isNull(), WEIGHTS["recurring"]).otherwise(WEIGHTS["history"]), F.lit("own_history")),
        ],
    )


def expected(found: DataFrame) -> DataFrame:
    """(target_id, expected, low, high, layers, confidence): the weighted mean and the union of the bands; one layer alone gets a band."""
    s = found.where("price > 0").groupBy("target_id").agg(
        (F.sum(F.col("price") * F.col("weight")) / F.sum("weight")).alias("expected"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("weight").alias("weight"),
        F.array_sort(F.collect_set("layer")).alias("layers"), F.count(F.lit(1)).alias("n"),
    )
    one = F.col("n") == 1
    confidence = F.when((F.array_contains("layers", "contract") & (F.col("n") >= 2)) | (F.col("weight") >= 0.65), "high").when(F.col("weight") >= 0.25, "medium").otherwise("low")
    return s.select(
        "target_id", "expected", F.when(one, F.least("low", F.col("expected") * (1 - SINGLE_BAND))).otherwise(F.col("low")).alias("low"),
        F.when(one, F.greatest("high", F.col("expected") * (1 + SINGLE_BAND))).otherwise(F.col("high")).alias("high"), "layers", confidence.alias("confidence"),
    )


def judged(prices: DataFrame, actual: DataFrame) -> DataFrame:
    """expected() with actual(target_id, actual): deviation, where it lies, and whether it is material."""
    out = prices.join(actual, "target_id")
    above, below = F.col("actual") > F.col("high"), F.col("actual") < F.col("low")
    outside = F.when(above, (F.col("actual") - F.col("high")) / F.col("high")).when(below, (F.col("low") - F.col("actual")) / F.col("low")).otherwise(0.0)
    grade = F.when(outside == 0, "within").when((outside >= MATERIAL) & (F.col("confidence") != "low"), "material").otherwise("outside")
    return out.withColumns({"deviation": F.col("actual") / F.col("expected") - 1, "outside": outside, "grade": grade})


def quota_schedule(units: DataFrame, start: str, months: int = 12) -> DataFrame:
    """(unit_id, period, ordinary, extraordinary, expected) of units(unit_id, quota_pct, budget, rule, rule_amount, rule_months).

    rule is flat_per_unit (rule_amount a period), quota (rule_amount shared by quota over rule_months) or null. Each part
    is rounded to cents on its own.
    """
    cents = "decimal(18,2)"
    share = F.coalesce("quota_pct", F.lit(0)).cast("decimal(9,4)") / 100
    ordinary = ((F.coalesce("budget", F.lit(0)).cast(cents) * share).cast(cents) / months).cast(cents)
    n = F.when(F.col("rule") == "flat_per_unit", F.greatest("rule_months", F.lit(0))).when(F.col("rule") == "quota", F.greatest("rule_months", F.lit(1))).otherwise(0)
    extra = F.when(F.col("rule") == "flat_per_unit", F.col("rule_amount").cast(cents)).when(F.col("rule") == "quota", ((F.col("rule_amount").cast(cents) * share).cast(cents) / F.col("_n")).cast(cents)).otherwise(F.lit(0).cast(cents))
    rows = units.withColumn("_n", n).withColumns({"ordinary": ordinary, "_extra": extra, "_i": F.explode(F.sequence(F.lit(0), F.lit(months - 1)))})
    due = F.when(F.col("_i") < F.col("_n"), F.col("_extra")).otherwise(F.lit(0).cast(cents))
    rows = rows.withColumns({"period": F.add_months(F.trunc(F.lit(start).cast("date"), "MM"), F.col("_i")), "extraordinary": due})
    return rows.select("unit_id", "period", "ordinary", "extraordinary", (F.col("ordinary") + F.col("extraordinary")).cast(cents).alias("expected"))


def quota_deviations(schedule: DataFrame, observed: DataFrame) -> DataFrame:
    """schedule beside observed(unit_id, period, observed): delta and whether it is above the tolerance; a missing period counts as zero."""
    seen = observed.groupBy("unit_id", "period").agg(F.sum("observed").alias("observed"))
    out = schedule.join(seen, ["unit_id", "period"], "left").withColumn("observed", F.coalesce("observed", F.lit(0).cast("decimal(18,2)")))
    delta = F.col("observed") - F.col("expected")
    return out.withColumns({"delta": delta, "reportable": F.abs(delta) > QUOTA_TOLERANCE})


def index_factor(series: DataFrame, first: str, last: str) -> DataFrame:
    """(series, factor, variation) of chained values between the last observations at or before two days.

    series(series, period, base, value); null where a link is missing or a day lies before the series.
    """
    chained = chain_index(series, "series", "period", "base", "value")

    def at(day, name):
        return chained.where(F.col("period") <= F.lit(day).cast("date")).groupBy("series").agg(F.max_by("chained", "period").alias(name))

    return at(first, "a").join(at(last, "b"), "series", "full").select("series", (F.col("b") / F.col("a")).alias("factor"), ((F.col("b") / F.col("a") - 1) * 100).alias("variation"))
