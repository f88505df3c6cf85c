"""The analytical views over the domain tables, each a DataFrame plan. as_of is always given, never today."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.functions.dates import challenge_windows
from tallyline.operators.joins import interval_overlap
from tallyline.plans.schemas import Tables

W = "decimal(20,2)"


def _fiscal(day: str):
    start = F.coalesce("fy_start_month", F.lit(1))
    return (F.year(day) + ((start > 1) & (F.month(day) >= start)).cast("int")).alias("fiscal_year")


def parameter(rows: DataFrame, t: Tables, key: str, day, name: str | None = None, default=None) -> DataFrame:
    """rows with a parameter of their community as of a day: the highest version that has begun, latest start first."""
    own = t["parameters"].where(F.col("key") == key).groupBy("community_id").agg(F.collect_list(F.struct("version", "valid_from", "value_num")).alias("_v"))
    begun = F.filter("_v", lambda v: v["valid_from"] <= day)
    value = F.array_max(begun)["value_num"].cast("decimal(20,4)")
    joined = rows.join(own, "community_id", "left")
    return joined.withColumn(name or key, F.coalesce(value, F.lit(default).cast("decimal(20,4)")) if default is not None else value).drop("_v")


def unique_invoices(t: Tables) -> DataFrame:
    """Invoices whose document isn't another's duplicate."""
    kept = t["documents"].where("duplicate_of_document_id IS NULL").select(F.col("id").alias("document_id"))
    return t["invoices"].join(kept, "document_id", "left_semi")


def accepted(t: Tables, link_type: str) -> DataFrame:
    return t["recon_links"].where((F.col("link_type") == link_type) & (F.col("status") == "accepted"))


def control_totals(t: Tables) -> DataFrame:
    c = t["communities"].select(F.col("id").alias("community_id"), "fy_start_month")
    key = ["community_id", "fiscal_year"]
    heads = t["liquidations"].groupBy("community_id", F.col("ejercicio").alias("fiscal_year")).agg(
        F.max("acreedores_pendientes").alias("closing_payables"), F.max("retenciones_pendientes").alias("retentions_held"), F.max("basis").alias("basis")
    )
    lines = t["liquidation_lines"].drop("community_id").join(t["liquidations"].select(F.col("id").alias("liquidation_id"), "community_id", F.col("ejercicio").alias("fiscal_year")), "liquidation_id")
    sums = lines.groupBy(*key).agg(
        F.sum(F.when(F.col("side") == "gasto", F.col("importe"))).cast(W).alias("liq_expenses"), F.sum(F.when(F.col("side") == "ingreso", F.col("importe"))).cast(W).alias("liq_income")
    )
    liq = heads.join(sums, key, "left")
    before = liq.select("community_id", (F.col("fiscal_year") + 1).alias("fiscal_year"), F.col("closing_payables").alias("opening_payables"))
    v = F.col("importe")
    bank = t["bank_transactions"].join(c, "community_id").groupBy("community_id", _fiscal("fecha_operacion")).agg(
        F.sum(F.when((v < 0) & (F.col("tx_kind") != "internal"), -v)).cast(W).alias("bank_debits"),
        F.sum(F.when((v > 0) & (F.col("tx_kind") == "quota_in"), v)).cast(W).alias("owner_credits"),
        F.sum(F.when((v > 0) & F.col("tx_kind").isin("subsidy", "loan"), v)).cast(W).alias("external_credits"),
    )
    inv = unique_invoices(t).join(c, "community_id").groupBy("community_id", _fiscal("fecha_expedicion")).agg(F.sum("total").cast(W).alias("invoices_total"), F.count(F.lit(1)).alias("invoice_count"))
    years = liq.select(*key).union(bank.select(*key)).union(inv.select(*key)).distinct()
    out = years.join(liq, key, "left").join(before, key, "left").join(bank, key, "left").join(inv, key, "left")
    zero = F.lit(0).cast(W)
    bridge = F.col("liq_expenses") - F.coalesce("bank_debits", zero) - F.coalesce("closing_payables", zero) + F.coalesce("opening_payables", zero) - F.coalesce("retentions_held", zero)
    return parameter(out.withColumn("bridged_difference", bridge.cast(W)), t, "pm_ordinary", F.make_date("fiscal_year", F.lit(12), F.lit(31)))


def year_balance_continuity(t: Tables) -> DataFrame:
    """Opening against the year before; one row a liquidation even where a year has several."""
    liq = t["liquidations"]
    before = liq.groupBy("community_id", (F.col("ejercicio") + 1).alias("ejercicio")).agg(F.max_by("saldo_final", "id").alias("prev_saldo_final"))
    close = t["bank_statements"].groupBy("community_id", "periodo_hasta").agg(F.sum("saldo_final").cast(W).alias("bank_saldo_at_close"))
    out = liq.join(before, ["community_id", "ejercicio"], "left").join(close, ["community_id", "periodo_hasta"], "left")
    out = out.withColumn("opening_gap", F.col("saldo_inicial") - F.col("prev_saldo_final")).withColumnRenamed("id", "liquidation_id").withColumnRenamed("ejercicio", "fiscal_year")
    return parameter(out, t, "pm_ordinary", F.coalesce("periodo_hasta", F.make_date("fiscal_year", F.lit(12), F.lit(31))))


def works_funding(t: Tables) -> DataFrame:
    p = "works_package_id"

    def own(name):
        return t[name].where(f"{p} IS NOT NULL")

    inv = unique_invoices(t).where(f"{p} IS NOT NULL")
    certified = t["works_events"].where("event_type IN ('certification', 'final_certification')").groupBy(p).agg(F.sum("amount").cast(W).alias("certified_total"))
    invoiced = inv.groupBy(p).agg(F.sum("total").cast(W).alias("invoiced_total"), F.sum(F.when(F.col("is_extra"), F.col("total")).otherwise(0)).cast(W).alias("extras_total"))
    paid = accepted(t, "paid_by").where("from_type = 'invoice'").join(own("invoices").select(F.col("id").alias("from_id"), p), "from_id").groupBy(p).agg(F.sum("amount_matched").cast(W).alias("paid_total"))
    derr = t["derrama_ledger"].join(own("derramas").select(F.col("id").alias("derrama_id"), p), "derrama_id").groupBy(p).agg(F.sum("paid").cast(W).alias("derrama_collected"), F.sum("expected").cast(W).alias("derrama_expected"))
    subs = own("subsidies").groupBy(p).agg(F.sum(F.when(F.col("paid_to_is_community"), F.col("import_pagat")).otherwise(0)).cast(W).alias("subsidy_received"))
    loans = own("loans").groupBy(p).agg(F.sum(F.when(F.col("paid_to_is_community"), F.col("principal")).otherwise(0)).cast(W).alias("loan_received"))
    out = t["works_packages"].withColumnRenamed("id", p)
    for part in (certified, invoiced, paid, derr, subs, loans):
        out = out.join(part, p, "left")
    zero = F.lit(0).cast(W)

    def known(c):
        return F.coalesce(F.col(c).cast(W), zero)

    committed = F.greatest(known("contract_price"), known("invoiced_total"))
    available = known("derrama_collected") + known("subsidy_received") + known("loan_received")
    return out.withColumns({"committed": committed, "available": available.cast(W), "funding_gap": (committed - available).cast(W)})


def challengeable_resolutions(t: Tables, as_of: datetime.date) -> DataFrame:
    m = t["meetings"].select(F.col("id").alias("meeting_id"), F.col("fecha").alias("meeting_date"), "fecha_notificacion")
    out = t["resolutions"].withColumnRenamed("id", "resolution_id").join(m, "meeting_id").withColumn("w", challenge_windows(F.col("fecha_notificacion"), F.col("meeting_date")))
    day = F.lit(as_of)
    return out.select(
        "community_id", "resolution_id", "meeting_date", "punto", "kind", "importe_aprobado", F.col("w.short").alias("challenge_3m_until"), F.col("w.long").alias("challenge_12m_until"),
        (F.col("w.short") >= day).alias("open_3m"), (F.col("w.long") >= day).alias("open_12m"), F.col("fecha_notificacion").isNull().alias("notification_date_unknown"),
    )


def limitation_clocks(t: Tables) -> DataFrame:
    out = t["findings"].where("act_date_last IS NOT NULL").withColumnRenamed("id", "finding_id")
    years = {"civil_general_until": 10, "civil_periodic_until": 3, "criminal_base_until": 5, "criminal_aggravated_until": 10}
    return out.withColumns({name: F.add_months("act_date_last", 12 * n) for name, n in years.items()})


def document_matrix(t: Tables) -> DataFrame:
    return t["document_requests"].withColumn("files_received", F.when(F.col("received_file_ids").isNotNull(), F.size("received_file_ids")))


def statement_coverage(t: Tables) -> DataFrame:
    s = t["bank_statements"].where("periodo_desde IS NOT NULL AND periodo_hasta IS NOT NULL")
    bounds = s.groupBy("community_id", "bank_account_id").agg(F.min("periodo_desde").alias("a"), F.max("periodo_hasta").alias("b"))
    months = bounds.select("community_id", "bank_account_id", F.explode(F.sequence(F.trunc("a", "MM"), F.trunc("b", "MM"), F.expr("interval 1 month"))).alias("month_start"))
    months = months.withColumn("month_end", F.last_day("month_start"))
    return interval_overlap(months, s, ["bank_account_id"], "month_start", "month_end", "periodo_desde", "periodo_hasta").drop("month_end")


def suspension_status(t: Tables) -> DataFrame:
    p = "works_package_id"
    packages = t["works_packages"].where("suspension_date IS NOT NULL").withColumnRenamed("id", p)
    cut = packages.select(p, "suspension_date")
    certified = t["works_events"].where("event_type IN ('certification', 'final_certification')").join(cut, p).where("event_date <= suspension_date").groupBy(p).agg(F.sum("amount").cast(W).alias("certified_at_suspension"))
    inv = t["invoices"].join(cut, p)
    invoiced = inv.groupBy(p).agg(
        F.sum(F.when(F.col("fecha_expedicion") <= F.col("suspension_date"), F.col("total"))).cast(W).alias("invoiced_at_suspension"), F.count_if(F.col("fecha_expedicion") > F.col("suspension_date")).alias("invoices_after_suspension")
    )
    tx = t["bank_transactions"].select(F.col("id").alias("to_id"), "fecha_operacion")
    links = accepted(t, "paid_by").where("from_type = 'invoice' AND to_type = 'bank_transaction'").join(inv.select(F.col("id").alias("from_id"), p, "suspension_date"), "from_id").join(tx, "to_id")
    paid = links.where("fecha_operacion <= suspension_date").groupBy(p).agg(F.sum("amount_matched").cast(W).alias("paid_at_suspension"))
    contracts = t["contracts"].select(F.col("id").alias("contract_id"), p)
    advances = t["contract_milestones"].where("is_advance").join(contracts, "contract_id").groupBy(p).agg(F.sum("importe").cast(W).alias("contractual_advances"))
    out = packages.join(certified, p, "left").join(invoiced, p, "left").join(paid, p, "left").join(advances, p, "left")
    return out.withColumn("invoices_after_suspension", F.coalesce("invoices_after_suspension", F.lit(0)))


def r1_invoices_without_payment(t: Tables) -> DataFrame:
    paid = accepted(t, "paid_by").where("from_type = 'invoice'").select(F.col("from_id").alias("id"))
    return unique_invoices(t).join(paid, "id", "left_anti").withColumnRenamed("id", "invoice_id")


#: Kinds of debits that need no invoice.
NO_INVOICE_KINDS = ("direct_debit_recurring", "fee", "tax", "internal", "interest", "loan", "returned")


def r2_debits_without_invoice(t: Tables) -> DataFrame:
    used = t["recon_links"].where("to_type = 'bank_transaction' AND link_type IN ('paid_by', 'refunds') AND status = 'accepted'").select(F.col("to_id").alias("id"))
    debits = t["bank_transactions"].where("importe < 0").where(~F.col("tx_kind").isin(*NO_INVOICE_KINDS))
    large = parameter(debits, t, "outflow_min", F.col("fecha_operacion"), default=300).where(-F.col("importe") > F.col("outflow_min"))
    out = large.join(used, "id", "left_anti").withColumnRenamed("id", "bank_transaction_id")
    return out.withColumn("person_beneficiary", F.coalesce(F.array_contains("flags", "person_beneficiary"), F.lit(False)))


def r3_lines_unsupported(t: Tables) -> DataFrame:
    used = accepted(t, "reported_as").where("to_type = 'liquidation_line'").select(F.col("to_id").alias("id"))
    years = t["liquidations"].select(F.col("id").alias("liquidation_id"), "ejercicio")
    return t["liquidation_lines"].where("side = 'gasto'").join(used, "id", "left_anti").join(years, "liquidation_id").withColumnRenamed("id", "liquidation_line_id")


def r4_spend_without_resolution(t: Tables) -> DataFrame:
    direct = accepted(t, "authorised_by").where("from_type = 'invoice'").select(F.col("from_id").alias("id"))
    approved = t["contracts"].where("authorised_by_resolution_id IS NOT NULL").select(F.col("id").alias("to_id"))
    through = accepted(t, "under_contract").where("from_type = 'invoice' AND to_type = 'contract'").join(approved, "to_id", "left_semi").select(F.col("from_id").alias("id"))
    large = parameter(unique_invoices(t), t, "authority_threshold", F.col("fecha_expedicion"), default=1000).where("total > authority_threshold")
    return large.join(direct, "id", "left_anti").join(through, "id", "left_anti").withColumnRenamed("id", "invoice_id")


def r5_milestones_paid_without_invoice(t: Tables) -> DataFrame:
    return t["contract_milestones"].where("status IN ('paid_without_invoice', 'overpaid')").withColumnRenamed("id", "milestone_id")


def r6_derrama_residual(t: Tables) -> DataFrame:
    return t["derrama_ledger"].where("status IN ('missing', 'partial', 'excess')").withColumn("residual", F.col("expected") - F.col("paid"))


def r7_statement_months_missing(t: Tables) -> DataFrame:
    return statement_coverage(t).where("NOT covered").drop("covered")


RESIDUALS = {
    "R1": r1_invoices_without_payment, "R2": r2_debits_without_invoice, "R3": r3_lines_unsupported, "R4": r4_spend_without_resolution,
    "R5": r5_milestones_paid_without_invoice, "R6": r6_derrama_residual, "R7": r7_statement_months_missing,
}


def residual_counts(t: Tables) -> DataFrame:
    """(residual, n) for R1 to R7."""
    out = None
    for name, view in RESIDUALS.items():
        one = view(t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("residual"), "n")
        out = one if out is None else out.unionByName(one)
    return out
