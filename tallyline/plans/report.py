"""Report queries, access, review states and reproduction, over the domain tables and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.operators import ordered
from tallyline.plans import views
from tallyline.plans.schemas import Tables


def secured(rows: DataFrame, members: DataFrame, user: str, roles: tuple[str, ...] = ("owner", "reviewer", "admin")) -> DataFrame:
    """Rows of the communities that a user may see: members(community_id, user_id, role)."""
    mine = members.where((F.col("user_id") == user) & F.col("role").isin(*roles)).select("community_id").distinct()
    return rows.join(mine, "community_id", "left_semi")


def supported_spend(t: Tables) -> DataFrame:
    """One row a community: outflows, and how much of them an accepted invoice, and an authorised one, stands behind."""
    out = t["bank_transactions"].where("importe < 0 AND tx_kind <> 'internal'").select("community_id", F.col("id").alias("tx_id"), (-F.col("importe")).alias("v"))
    paid = views.accepted(t, "paid_by").where("from_type = 'invoice'").select("from_id", F.col("to_id").alias("tx_id"))
    authorised = views.accepted(t, "authorised_by").where("from_type = 'invoice'").select("from_id").distinct().withColumn("a", F.lit(True))
    marks = paid.join(authorised, "from_id", "left").groupBy("tx_id").agg(F.lit(True).alias("i"), F.bool_or(F.coalesce("a", F.lit(False))).alias("a"))
    rows = out.join(marks, "tx_id", "left")
    return rows.groupBy("community_id").agg(
        F.sum("v").alias("outflows"), F.coalesce(F.sum(F.when(F.col("i"), F.col("v"))), F.lit(0)).alias("with_invoice"), F.coalesce(F.sum(F.when(F.col("a"), F.col("v"))), F.lit(0)).alias("with_resolution"), F.count(F.lit(1)).alias("n")
    )


def counters(t: Tables, *names: str) -> DataFrame:
    """(community_id, table, n) of the tables named."""
    out = None
    for name in names:
        one = t[name].groupBy("community_id").agg(F.count(F.lit(1)).alias("n")).select("community_id", F.lit(name).alias("table"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def derrama_by_unit(t: Tables) -> DataFrame:
    sums = t["derrama_ledger"].groupBy("community_id", "derrama_id", "unit_id").agg(F.sum("expected").alias("expected"), F.sum("paid").alias("paid"), F.count_if(F.col("status") == "missing").alias("missing"))
    return sums.withColumn("open", F.col("expected") - F.coalesce("paid", F.lit(0)))


def parameters_in_force(t: Tables, day) -> DataFrame:
    """(community_id, key, value_num, version, valid_from): of each parameter the one that began last."""
    return ordered.latest(t["parameters"].where(F.col("valid_from") <= F.lit(day)), ["community_id", "key"], ["valid_from", "version"])


def checks_by_kind(t: Tables) -> DataFrame:
    return t["external_checks"].groupBy("community_id", "check_type", "status").agg(F.count(F.lit(1)).alias("n"), F.max("fetched_at").alias("latest"))


def vendor_sheet(t: Tables) -> DataFrame:
    """One row a vendor: what was invoiced and paid, its first and last invoice, its checks and open links."""
    key = ["community_id", "party_id"]
    inv = views.unique_invoices(t).groupBy("community_id", F.col("vendor_party_id").alias("party_id")).agg(
        F.count(F.lit(1)).alias("invoices"), F.sum("total").alias("invoiced"), F.min("fecha_expedicion").alias("first"), F.max("fecha_expedicion").alias("last")
    )
    owner = t["invoices"].select(F.col("id").alias("from_id"), F.col("vendor_party_id").alias("party_id"))
    paid = views.accepted(t, "paid_by").where("from_type = 'invoice'").join(owner, "from_id").groupBy(*key).agg(F.sum("amount_matched").alias("paid"))
    found = ordered.latest(t["external_checks"], [*key, "check_type"], ["fetched_at", "status"]).groupBy(*key).agg(F.array_sort(F.collect_list(F.concat_ws(":", "check_type", "status"))).alias("checks"))
    points = t["party_links"].where("status <> 'rejected'").groupBy(*key).agg(F.sum("points").alias("link_points"))
    out = t["parties"].where("kind IN ('vendor', 'architect')").withColumnRenamed("id", "party_id")
    for part in (inv, paid, found, points):
        out = out.join(part, key, "left")
    return out


def review_state(findings: DataFrame, reviews: DataFrame) -> DataFrame:
    """findings with the newest review's status, and when they were first confirmed: reviews(id, finding_id, to_status, at)."""
    last = reviews.groupBy(F.col("finding_id").alias("id")).agg(F.max_by("to_status", F.struct("at", "id")).alias("_s"), F.min(F.when(F.col("to_status") == "confirmed", F.col("at"))).alias("confirmed_at"))
    return findings.join(last, "id", "left").withColumn("status", F.coalesce("_s", "status")).drop("_s")


def drift(then: DataFrame, now: DataFrame) -> DataFrame:
    """Parameters that differ between two snapshots (community_id, key, value_num)."""
    key = F.concat_ws("|", "community_id", "key").alias("parameter")
    return ordered.set_diff(then.select(key, "value_num"), now.select(key, "value_num"), "parameter", ["value_num"])


def reproduced(stored: DataFrame, again: DataFrame) -> DataFrame:
    """Findings that a second run misses, adds or changes: (fingerprint, state)."""
    return ordered.set_diff(stored, again, "fingerprint", ["rule_code", "severity", "amount_at_stake"])


# ---- catalogued tests that need invoices and quotes only


def duplicate_invoices(t: Tables) -> DataFrame:
    """(invoice_id, twin_id, severity): equal totals of a vendor within a year, and near totals within 45 days."""
    inv = views.unique_invoices(t).where("total IS NOT NULL AND vendor_party_id IS NOT NULL").select("community_id", "vendor_party_id", F.col("id").alias("invoice_id"), "numero", "fecha_expedicion", "total")
    by = Window.partitionBy("community_id", "vendor_party_id", "total").orderBy("fecha_expedicion", "invoice_id")
    same = inv.withColumn("b", F.lag(F.struct("invoice_id", "fecha_expedicion", "numero")).over(by)).where(F.datediff("fecha_expedicion", "b.fecha_expedicion") <= 365)
    one = same.select(F.col("b.invoice_id").alias("invoice_id"), F.col("invoice_id").alias("twin_id"), F.lit(3).alias("severity"))
    # near totals: bins of one per cent in the logarithm, a pair meets in one bin or its neighbour
    step = 0.01
    a = inv.withColumn("bin", F.explode(F.transform(F.array(F.lit(0), F.lit(1)), lambda k: F.floor(F.log(F.col("total").cast("double")) / step) + k))).where("total > 0")
    b = inv.where("total > 0").select("community_id", "vendor_party_id", F.col("invoice_id").alias("twin_id"), F.col("fecha_expedicion").alias("d"), F.col("total").alias("v")).withColumn("bin", F.floor(F.log(F.col("v").cast("double")) / step))
    met = a.join(b, ["community_id", "vendor_party_id", "bin"]).where((F.col("total") < F.col("v")) & (F.col("v") <= F.col("total") * F.lit("1.01").cast("decimal(4,2)")) & (F.abs(F.datediff("d", "fecha_expedicion")) <= 45))
    return one.unionByName(met.select("invoice_id", "twin_id", F.lit(2).alias("severity")))


def split_invoices(t: Tables, days: int = 7) -> DataFrame:
    """Invoices of a vendor, each under its community's authority threshold, that pass it together within a few days."""
    inv = views.parameter(views.unique_invoices(t), t, "authority_threshold", F.col("fecha_expedicion"), default=1000).where("total <= authority_threshold")
    by = Window.partitionBy("community_id", "vendor_party_id").orderBy(F.unix_date("fecha_expedicion")).rangeBetween(-days, 0)
    out = inv.withColumns({"together": F.sum("total").over(by), "n": F.count(F.lit(1)).over(by)})
    return out.where((F.col("n") > 1) & (F.col("together") > F.col("authority_threshold"))).select("community_id", "vendor_party_id", F.col("id").alias("invoice_id"), "together", "n")


def number_order(t: Tables) -> DataFrame:
    """Invoices whose number comes after an earlier-numbered one but whose date comes before it."""
    n = F.regexp_extract("numero", r"(\d+)\s*$", 1).try_cast("bigint")
    inv = views.unique_invoices(t).withColumn("n", n).where("n IS NOT NULL")
    by = Window.partitionBy("community_id", "vendor_party_id", F.coalesce("serie", F.lit("")), F.year("fecha_expedicion")).orderBy("n", "id").rowsBetween(Window.unboundedPreceding, -1)
    return inv.withColumn("latest", F.max("fecha_expedicion").over(by)).where("fecha_expedicion < latest").select("community_id", "vendor_party_id", F.col("id").alias("invoice_id"), "n", "fecha_expedicion", "latest")


def round_totals(t: Tables, least: int = 5, share: float = 0.3) -> DataFrame:
    """Vendors with at least `least` invoices of which more than a share have round totals."""
    flag = (F.col("total") % 50 == 0).cast("int")
    g = views.unique_invoices(t).groupBy("community_id", "vendor_party_id").agg(F.count(F.lit(1)).alias("n"), F.avg(flag).alias("share"))
    return g.where((F.col("n") >= least) & (F.col("share") > share))


def weekend_invoices(t: Tables) -> DataFrame:
    return views.unique_invoices(t).where(F.dayofweek("fecha_expedicion").isin(1, 7)).select("community_id", F.col("id").alias("invoice_id"), "fecha_expedicion")


def few_quotes(t: Tables) -> DataFrame:
    """Packages over 3,000 with fewer than two quotes, or awarded above 1.1 times the lowest."""
    q = t["quotes"].groupBy("works_package_id").agg(F.count_distinct("vendor_party_id").alias("quotes"), F.min("total").alias("lowest"))
    rows = t["works_packages"].select("community_id", F.col("id").alias("works_package_id"), "contract_price").where("contract_price > 3000").join(q, "works_package_id", "left")
    few = F.coalesce("quotes", F.lit(0)) < 2
    return rows.withColumn("severity", F.when(few, 2).when(F.col("contract_price") > F.col("lowest") * F.lit("1.10").cast("decimal(4,2)"), 3)).where("severity IS NOT NULL")


def first_digits(rows: DataFrame, amount: str) -> DataFrame:
    """(digit, n, share, expected, chi_square) of leading digits against their logarithmic law."""
    digit = F.regexp_extract(F.abs(amount).cast("decimal(38,6)").cast("string"), "[1-9]", 0).try_cast("int")
    counts = rows.withColumn("digit", digit).where("digit IS NOT NULL").groupBy("digit").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    out = counts.join(F.broadcast(total)).withColumn("expected", F.log10(1 + 1 / F.col("digit")))  # one row
    share = F.col("n") / F.col("total")
    return out.select("digit", "n", share.alias("share"), "expected", (F.col("total") * F.pow(share - F.col("expected"), 2) / F.col("expected")).alias("chi_square"))


def relative_size(rows: DataFrame, key: str, amount: str) -> DataFrame:
    """(key, n, largest, factor): each key's largest amount over its second largest."""
    top = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.col(amount).desc()))).where("_n <= 2")
    g = top.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max(amount).alias("largest"), F.min(amount).alias("second"))
    return g.where("n = 2 AND second > 0").select(key, "n", "largest", (F.col("largest") / F.col("second")).alias("factor"))


def price_drift(rows: DataFrame, key: str, day: str, price: str) -> DataFrame:
    """(key, n, slope): a key's price change a day, by least squares; keys with three prices or more."""
    g = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.regr_slope(F.col(price), F.unix_date(day)).alias("slope"))
    return g.where("n >= 3")


def concentration_index(rows: DataFrame, group: str, member: str, amount: str) -> DataFrame:
    """(group, hhi): the sum of squared shares of a group's members."""
    each = rows.groupBy(group, member).agg(F.sum(amount).alias("v"))
    share: Column = F.col("v") / F.sum("v").over(Window.partitionBy(group))
    return each.withColumn("s", share).groupBy(group).agg(F.sum(F.col("s") * F.col("s")).alias("hhi"))
