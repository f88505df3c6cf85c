"""Signals that link a vendor to an office-holder or another vendor, and their points.

Inputs are digests and normalised parts of names; the reference persons of a community are a handful, so name signals
are equi-joins on surnames. Shared attributes are classes with a size, never pairs of all members.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.functions.text import fold
from tallyline.operators import joins, scoring

#: People in the reference population, and the frequency (per mille) from which one surname says nothing.
POPULATION, COMMON = 1_600_000, 5.0
COLUMNS = ("party_id", "role", "signal", "points", "basis", "expected_homonyms")


def rarity(per_mille: Column) -> Column:
    """Weight of a surname by its frequency; unknown ones count as fairly common."""
    return F.when(per_mille.isNull(), 0.6).when(per_mille < 0.1, 1.3).when(per_mille <= 1, 1.0).when(per_mille <= 10, 0.6).otherwise(0.3)


def homonyms(*per_mille: Column) -> Column:
    return F.round(reduce(lambda a, f: a * f / 1000, per_mille, F.lit(float(POPULATION))), 2)


def address(c: Column) -> Column:
    return F.nullif(fold(F.coalesce(c, F.lit("")), "upper", "A-Z0-9"), F.lit(""))


def signal(rows: DataFrame, code: str, points, basis: str, role=None, expected=None) -> DataFrame:
    return rows.select(
        "party_id", (F.col(role) if role else F.lit(None).cast("string")).alias("role"), F.lit(code).alias("signal"), (points if isinstance(points, Column) else F.lit(points)).cast("int").alias("points"),
        F.lit(basis).alias("basis"), (F.lit(None) if expected is None else expected).cast("double").alias("expected_homonyms"),
    )


def identity(vendors: DataFrame, officers: DataFrame, reference: DataFrame) -> DataFrame:
    """S1: a digest of the vendor or an officer equals a reference person's."""
    ref = reference.where("nif_hmac IS NOT NULL").select("nif_hmac", "role").distinct()
    return signal(vendors.join(ref, "nif_hmac"), "S1", 100, "party_nif", "role").unionByName(signal(officers.join(ref, "nif_hmac"), "S1", 100, "officer_nif", "role"))


def names(officers: DataFrame, reference: DataFrame, surnames: DataFrame) -> DataFrame:
    """S2 to S4 from officers(party_id, given, surname1, surname2), reference(role, given, surname1, surname2) and surnames(surname, per_mille)."""
    o = officers.select("party_id", F.col("given").alias("g"), F.col("surname1").alias("a"), F.col("surname2").alias("b"))
    r = reference.select("role", F.col("given").alias("rg"), F.col("surname1").alias("ra"), F.col("surname2").alias("rb"))
    o = o.withColumn("_s", F.explode(F.array_distinct(F.array_compact(F.array("a", "b")))))
    r = r.withColumn("_s", F.explode(F.array_distinct(F.array_compact(F.array("ra", "rb")))))
    met = o.where("_s <> ''").join(r.where("_s <> ''"), "_s")
    same, reversed_ = (F.col("a") == F.col("ra")) & (F.col("b") == F.col("rb")), (F.col("a") == F.col("rb")) & (F.col("b") == F.col("ra"))
    met = met.withColumns({"same": F.coalesce(same, F.lit(False)), "rev": F.coalesce(reversed_, F.lit(False))})
    for name in ("ra", "rb"):
        f = surnames.select(F.col("surname").alias(name), F.col("per_mille").alias(f"f_{name}"))
        met = met.join(f, name, "left")
    own = F.when(F.col("_s") == F.col("ra"), F.col("f_ra")).otherwise(F.col("f_rb"))
    both = met.where("same OR rev").dropDuplicates(["party_id", "role", "g", "a", "b", "rg", "ra", "rb"])
    full = F.col("same") & (F.lower("g") == F.lower("rg")) & (F.col("rg") != "")
    weight = F.sqrt(rarity(F.col("f_ra")) * rarity(F.col("f_rb")))
    pair = homonyms(F.col("f_ra"), F.col("f_rb"))
    one = met.where("NOT same AND NOT rev").withColumn("f", own).where(F.col("f").isNull() | (F.col("f") <= COMMON))
    # exactly one of the reference's surnames is the officer's
    single = one.groupBy("party_id", "role", "g", "a", "b", "rg", "ra", "rb").agg(F.count(F.lit(1)).alias("n"), F.first("f").alias("f")).where("n = 1")
    two = F.coalesce(full, F.lit(False))
    return reduce(
        DataFrame.unionByName,
        [
            signal(both.where(two), "S2", 90, "full_name", "role", pair),
            signal(both.where(~two), "S3", F.round(F.when(F.col("same"), 45).otherwise(30) * weight), "both_surnames", "role", pair),
            signal(single, "S4", F.round(8 * rarity(F.col("f"))), "one_surname", "role", homonyms(F.col("f"))),
        ],
    )


def addresses(vendors: DataFrame, buildings: DataFrame, reference: DataFrame, companies_at: DataFrame | None = None) -> DataFrame:
    """S5: the building's or an office-holder's address; S6: one shared with another vendor or the administrator."""
    v = vendors.withColumn("key", address(F.col("address"))).where("key IS NOT NULL")
    b = buildings.select(address(F.col("address")).alias("key")).where("key IS NOT NULL").distinct()
    r = reference.where("address IS NOT NULL").select(address(F.col("address")).alias("key"), "role").distinct()
    shared = joins.shared_attributes(v.withColumn("kind", F.lit("address")).withColumnRenamed("key", "value"), "party_id", "kind", "value")
    if companies_at is not None:
        listed = companies_at.select(address(F.col("address")).alias("value"), F.col("companies"))
        shared = shared.join(listed, "value", "left").withColumn("n", F.greatest("n", F.coalesce("companies", F.lit(0))))
    return reduce(
        DataFrame.unionByName,
        [signal(v.join(b, "key"), "S5", 80, "building"), signal(v.join(r, "key"), "S5", 80, "reference_address", "role"), signal(shared, "S6", F.when(F.col("n") >= 5, 15).otherwise(40), "shared_address")],
    )


def shared(vendors: DataFrame, payer_keys: DataFrame) -> DataFrame:
    """S7: accounts, telephones, mailboxes and domains shared between vendors, and accounts that pay the presidency's quotas."""
    mail = F.lower(F.trim("email"))
    kinds = F.array(
        *(F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in (("iban", F.col("iban_hmac")), ("phone", F.nullif(F.regexp_replace("phone", r"\D", ""), F.lit(""))), ("mailbox", mail), ("domain", F.nullif(F.regexp_extract(mail, "@(.+)$", 1), F.lit("")))))
    )
    each = vendors.select("party_id", F.explode(kinds).alias("k")).select("party_id", "k.kind", "k.value")
    found = joins.shared_attributes(each, "party_id", "kind", "value")
    points = F.create_map(*(F.lit(x) for p in {"iban": 90, "phone": 60, "mailbox": 50, "domain": 50}.items() for x in p))
    best = found.withColumn("p", points[F.col("kind")]).groupBy("party_id").agg(F.max("p").alias("p"))
    president = payer_keys.where("role = 'president'").select("iban_hmac").distinct()
    pays = vendors.join(president, "iban_hmac").withColumn("role", F.lit("president"))
    return signal(best, "S7", F.col("p"), "shared_contact").unionByName(signal(pays, "S7", 100, "presidency_account", "role"))


def company(vendors: DataFrame, first_invoice: DataFrame) -> DataFrame:
    """S8: young, thinly capitalised, or registered for another trade; its parts add up."""
    v = vendors.join(first_invoice.select("party_id", F.col("first")), "party_id", "left")
    months = F.datediff("first", "incorporated_on") / 30.4375
    return reduce(
        DataFrame.unionByName,
        [
            signal(v.where((months >= 0) & (months < 12)), "S8", F.when(months < 3, 45).otherwise(25), "age"),
            signal(v.where("capital <= 3000"), "S8", 10, "capital"),
            signal(v.where("trade_related = false"), "S8", 25, "activity"),
        ],
    )


def registers(checks: DataFrame) -> DataFrame:
    """S10 from the latest checks(party_id, check_type, status, matched): the gravest counts."""
    kind, status = F.col("check_type"), F.col("status")
    points = F.when((kind == "rasic") & (status == "not_found"), 50).when((kind == "rea") & (status == "not_found"), 30).when((kind == "aeat_census") & (F.col("matched") == False), 60).when((kind == "checksum") & (F.col("matched") == False), 20)  # noqa: E712
    worst = checks.withColumn("p", points).where("p IS NOT NULL").groupBy("party_id").agg(F.max("p").alias("p"))
    return signal(worst, "S10", F.col("p"), "register")


def quotes(fingerprints: DataFrame) -> DataFrame:
    """S9 for vendors(party_id) whose quotes share a fingerprint with another vendor's."""
    return signal(fingerprints.select("party_id").distinct(), "S9", 50, "quotes")


def advisers(signers: DataFrame) -> DataFrame:
    """S11 for vendors whose signer also advises in the minutes."""
    return signal(signers.where("advises"), "S11", 40, "signer_advises")


def queue(signals: DataFrame) -> DataFrame:
    """(party_id, role, points, signals, tier): what to look at first."""
    total = scoring.link_points(signals.withColumn("role", F.coalesce("role", F.lit(""))), "party_id", "role").drop("band")
    return total.withColumn("tier", F.when(F.col("points") >= 80, "priority").when(F.col("points") >= 40, "review").otherwise("note"))
