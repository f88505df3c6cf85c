"""Scoring of rule hits: confidence, collapse by event, tiers, entity scores, gates and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of an entity's four best hits, and its score's cap.
WEIGHTS, CAP = (1.0, 0.5, 0.25, 0.125), 8.0


def scored(hits: DataFrame) -> DataFrame:
    """hits(severity, extraction_quality, specificity, independence) with confidence and hit_score."""

    def unit(c):
        return F.least(F.greatest(F.col(c).cast("double"), F.lit(0.0)), F.lit(1.0))

    confidence = F.round((unit("extraction_quality") * unit("specificity") * unit("independence")).cast("decimal(10,6)"), 3)
    return hits.withColumn("confidence", confidence.cast("decimal(4,3)")).withColumn("hit_score", (F.col("severity") * F.col("confidence")).cast("decimal(6,3)"))


def collapse(hits: DataFrame, by: list[Column], key: str = "event_key", code: str = "rule_code") -> DataFrame:
    """One hit for each event: the first in by (then code); absorbed lists the codes of the others, sorted. Without a key all stay."""
    keyed = hits.withColumn("_key", F.when(F.coalesce(key, F.lit("")) == "", F.concat(F.lit("#"), F.monotonically_increasing_id().cast("string"))).otherwise(F.col(key)))
    best = Window.partitionBy("_key").orderBy(*by, F.col(code))
    every = Window.partitionBy("_key")
    ranked = keyed.withColumns({"_n": F.row_number().over(best), "_codes": F.collect_list(code).over(every)})
    top = ranked.where("_n = 1").withColumn("absorbed", F.array_sort(F.array_except("_codes", F.array(code))))
    return top.drop("_key", "_n", "_codes")


def collapse_by_event(hits: DataFrame) -> DataFrame:
    """Highest severity, then independence."""
    return collapse(hits, [F.col("severity").desc(), F.col("independence").desc()])


def collapse_core(hits: DataFrame, position: str) -> DataFrame:
    """Highest severity, then confidence, then input order."""
    return collapse(hits, [F.col("severity").desc(), F.col("confidence").desc(), F.col(position)])


def tier(never: Column) -> Column:
    """Tier of one scored hit."""
    first = (F.col("extraction_quality") >= 0.99) & (F.col("independence") >= 1) & (F.col("severity") >= 4) & (F.col("confidence") >= 0.8)
    return F.when(never, "T3").when(first, "T1").when((F.col("severity") >= 2) & (F.col("confidence") >= 0.5), "T2").otherwise("T3")


def assign_tier(hits: DataFrame, entity: str, direct: Column | None = None, confirmed_only: Column | None = None) -> DataFrame:
    """(entity, tier) of a set of collapsed hits; direct says that a leg comes from its issuer, confirmed_only that only people confirmed it."""
    usable = ~F.coalesce("never_t1_t2", F.lit(False))
    families = F.size(F.collect_set(F.when(usable & (F.col("severity") >= 3) & (F.col("confidence") >= 0.7), F.col("family"))))
    strong = F.bool_or(usable & (F.col("severity") == 4) & (F.col("confidence") >= 0.8))
    second = F.bool_or(usable & (F.col("severity") >= 2) & (F.col("confidence") >= 0.5))
    open_ = (F.bool_or(direct) if direct is not None else F.lit(True)) & (~F.bool_or(confirmed_only) if confirmed_only is not None else F.lit(True))
    sums = hits.groupBy(entity).agg(families.alias("_f"), strong.alias("_s"), second.alias("_t"), open_.alias("_o"))
    return sums.select(entity, F.when((F.col("_s") | (F.col("_f") >= 2)) & F.col("_o"), "T1").when(F.col("_t"), "T2").otherwise("T3").alias("tier"))


def entity_score(hits: DataFrame, entity: str, document: str = "document_id") -> DataFrame:
    """(entity, base, families, documents, multiplier, score): its four best hits weighted, raised by families over two documents, capped."""
    best = Window.partitionBy(entity).orderBy(F.col("hit_score").desc(), "event_key")
    ranked = hits.withColumn("_n", F.row_number().over(best))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.least("_n", F.lit(4)))
    sums = ranked.groupBy(entity).agg(
        F.sum(F.when(F.col("_n") <= 4, F.col("hit_score").cast("double") * weight)).alias("base"),
        F.count_distinct("family").alias("families"),
        F.count_distinct(document).alias("documents"),
        F.sum(F.when(F.col("severity") >= 3, F.col("amount"))).alias("at_stake"),
    )
    many = F.col("documents") >= 2
    multiplier = F.when(many & (F.col("families") >= 3), 2.0).when(many & (F.col("families") >= 2), 1.5).otherwise(1.0)
    return sums.withColumn("multiplier", multiplier).withColumn("score", F.least(F.col("base") * F.col("multiplier"), F.lit(CAP)))


def independence(chain: Column) -> Column:
    """Independence of a leg by the worst link of its provenance chain (an array of kinds)."""
    #: Fixed values.
    values = {"issuer_direct": 1.0, "bank_export": 1.0, "registry": 0.9, "administrator": 0.7, "manual": 0.5}
    known = F.create_map(*(F.lit(x) for pair in values.items() for x in pair))
    return F.coalesce(F.array_min(F.transform(chain, lambda k: F.coalesce(known[k], F.lit(0.5)))), F.lit(0.5))


def wilson_lower(good: Column, n: Column, z: float = 1.959964) -> Column:
    """Lower bound of the 95 % Wilson interval; null without trials."""
    p = good / n
    return F.when(n > 0, (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n))


def link_points(signals: DataFrame, party: str, role: str, additive: str = "S8") -> DataFrame:
    """(party, role, points, band): signals(signal, points) added up, each signal's best only, but `additive` counts all."""
    each = signals.groupBy(party, role, "signal").agg(F.sum("points").alias("_sum"), F.max("points").alias("_max"))
    points = F.sum(F.when(F.col("signal") == additive, F.col("_sum")).otherwise(F.col("_max")))
    total = each.groupBy(party, role).agg(points.cast("bigint").alias("points"), F.array_sort(F.collect_list("signal")).alias("signals"))
    return total.withColumn("band", F.when(F.col("points") >= 80, "high").when(F.col("points") >= 40, "medium").otherwise("low"))


def expected_price(layers: DataFrame, key: str) -> DataFrame:
    """(key, expected, low, high, layers) from layers(key, price, low, high, weight): the weighted mean and the union of the bands."""
    known = layers.where("price IS NOT NULL AND weight > 0")
    return known.groupBy(key).agg(
        (F.sum(F.col("price") * F.col("weight")) / F.sum("weight")).alias("expected"), F.min("low").alias("low"), F.max("high").alias("high"), F.count(F.lit(1)).alias("layers")
    )


def price_severity(paid: Column, expected: Column, high: Column) -> Column:
    """0 inside the band, up to 3 by how far a price is above what was expected."""
    ratio = paid / expected
    return F.when(expected.isNull() | (paid <= high), 0).when(ratio >= 2, 3).when(ratio >= 1.5, 2).otherwise(1)


def gates(hits: DataFrame) -> DataFrame:
    """hits with bucket: withheld where a gate stops them, worklist or published else. Gates run in order; the first to stop names it.

    Columns read: replied, citation_verified, tier, base_rate, hit_score.
    """
    gate = (
        F.when(~F.coalesce("replied", F.lit(False)) & (F.col("severity") >= 3), "reply")
        .when(~F.coalesce("citation_verified", F.lit(True)), "citation")
        .when(F.coalesce("base_rate", F.lit(0.0)) > 0.2, "base_rate")
        .when(F.col("tier") == "T3", "tier")
    )
    held = hits.withColumn("gate", gate)
    return held.withColumn("bucket", F.when(F.col("gate").isin("reply", "citation"), "withheld").when(F.col("gate").isNotNull(), "worklist").otherwise("published"))
