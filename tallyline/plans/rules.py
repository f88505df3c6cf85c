"""The audit rules: each reads the domain tables and returns hits of one shape.

run() unites all of them, collapses hits that share an event, scores and tiers them. Every hit names its event, its
entity and a fingerprint that stays the same from run to run. Texts for people are made outside, from computed.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.functions.hashing import fingerprint
from tallyline.functions.text import fold, norm_text
from tallyline.operators import joins, ordered, scoring
from tallyline.plans import views
from tallyline.plans.schemas import Tables

HIT = (
    "rule_code string, family string, severity int, event_key string, fingerprint string, entity_type string, entity_id string, community_id string, works_package_id string, "
    "fiscal_year int, amount_at_stake decimal(14,2), act_date_first date, act_date_last date, computed string, independence double, extraction_quality double, specificity double"
)
SEED, EXTRACTED, RECORD = (0.7, 0.9), (0.7, 0.9), (1.0, 1.0)  # (independence, extraction quality) by where figures come from
#: Independence of a bank statement's source.
SOURCES = {"norma43": 1.0, "camt053": 1.0, "csv": 1.0, "pdf_native": 0.85, "pdf_scan": 0.7, "photo": 0.7, "seed": 0.7}


@dataclass
class Context:
    tables: Tables
    today: datetime.date

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]


RULES: dict[str, Callable[[Context], list[DataFrame]]] = {}


def rule(code: str):
    def add(fn):
        RULES[code] = fn
        return fn

    return add


def text(*parts) -> Column:
    return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))


def hit(rows: DataFrame, code: str, severity, event: Column, marks: list, entity: tuple[str, Column], basis=RECORD, amount=None, first=None, last=None, year=None, package=None, computed=None) -> DataFrame:
    """rows as hits. marks are the parts of the fingerprint after the code."""

    def col(value, kind):
        return (value if isinstance(value, Column) else F.lit(value)).cast(kind)

    independence, quality = basis
    parts = [p if isinstance(p, Column) else F.lit(p) for p in marks]
    return rows.select(
        F.lit(code).alias("rule_code"), F.lit(code[0]).alias("family"), col(severity, "int").alias("severity"), event.alias("event_key"), fingerprint(F.lit(code), *parts).alias("fingerprint"),
        F.lit(entity[0]).alias("entity_type"), entity[1].cast("string").alias("entity_id"), "community_id", col(package, "string").alias("works_package_id"), col(year, "int").alias("fiscal_year"),
        col(amount, "decimal(14,2)").alias("amount_at_stake"), col(first, "date").alias("act_date_first"), col(last, "date").alias("act_date_last"),
        (F.to_json(F.struct(*computed)) if computed else F.lit(None).cast("string")).alias("computed"), col(independence, "double").alias("independence"), col(quality, "double").alias("extraction_quality"), F.lit(1.0).alias("specificity"),
    )


def with_source(c: Context, rows: DataFrame) -> DataFrame:
    """rows(statement_id) with independence by their statement's source."""
    known = F.create_map(*(F.lit(x) for p in SOURCES.items() for x in p))
    s = c["bank_statements"].select(F.col("id").alias("statement_id"), known[F.col("source")].alias("_i"))
    return rows.join(s, "statement_id", "left").withColumn("independence", F.coalesce("_i", F.lit(0.7))).drop("_i")


def cash_limit(c: Context, rows: DataFrame, day: str) -> DataFrame:
    default = F.when(F.col(day) >= F.lit("2021-07-11").cast("date"), 1000).otherwise(2500).cast("decimal(20,4)")
    return views.parameter(rows, c.tables, "cash_limit", F.col(day)).withColumn("cash_limit", F.coalesce("cash_limit", default))


def communities(c: Context) -> DataFrame:
    return c["communities"].select(F.col("id").alias("community_id"))


def per_community(c: Context, rows: DataFrame, **counts: Column) -> DataFrame:
    """(community_id, counts) of rows, 0 where a community has none."""
    sums = rows.groupBy("community_id").agg(*(F.coalesce(F.sum(v.cast("int")), F.lit(0)).alias(k) for k, v in counts.items()))
    return communities(c).join(sums, "community_id", "left").fillna(0)


def best_link(c: Context, link_type: str, to_type: str) -> DataFrame:
    """(invoice_id, to_id): each invoice's best scored link of a type."""
    links = c["recon_links"].where((F.col("link_type") == link_type) & (F.col("from_type") == "invoice") & (F.col("to_type") == to_type))
    return links.groupBy(F.col("from_id").alias("invoice_id")).agg(F.max_by("to_id", F.struct("score", "to_id")).alias("to_id"))


def latest_check(c: Context, *kinds: str) -> DataFrame:
    checks = c["external_checks"].where(F.col("check_type").isin(*kinds))
    return ordered.latest(checks, ["community_id", "party_id"], ["fetched_at", "status"])


def checked(row_archived: str = "archived") -> Column:
    return F.when(F.coalesce(row_archived, F.lit(False)), 1.0).otherwise(0.7)


# ---- D: accounts and money


@rule("D0")
def funding_gap(c):
    funding = views.works_funding(c.tables)
    bank = per_community(c, c["bank_transactions"], quota=F.col("tx_kind") == "quota_in")
    z = F.lit(0).cast(views.W)
    collected, expected = F.coalesce("derrama_collected", z), F.coalesce("derrama_expected", z)
    funded = F.when(F.col("quota") > 0, collected).otherwise(F.greatest(collected, expected)) + F.coalesce("subsidy_received", z) + F.coalesce("loan_received", z)
    sums = funding.join(bank, "community_id").where("committed > 0").groupBy("community_id").agg(F.sum("committed").alias("c"), F.sum(funded).alias("a"))
    sums = views.parameter(sums, c.tables, "funding_gap_min", F.lit(c.today), default=5000)
    over = sums.where(F.col("c") - F.col("a") > F.greatest("funding_gap_min", F.col("c") * F.lit("0.1").cast("decimal(3,2)")))
    me = F.col("community_id")
    return [hit(over, "D0", 3, text("community:", me, ":funding"), [me, "overall"], ("community", me), SEED, F.col("c") - F.col("a"), computed=["c", "a"])]


@rule("D1")
def unmatched(c):
    def large(rows, day, v):
        return views.parameter(rows.drop("outflow_min"), c.tables, "outflow_min", day, default=300).where(v > F.col("outflow_min"))

    today = F.lit(c.today)
    r1 = large(views.r1_invoices_without_payment(c.tables), today, F.col("total"))
    r2 = views.r2_debits_without_invoice(c.tables).where(~F.coalesce(F.array_contains("flags", "direct_debit_recurring"), F.lit(False)))
    r2 = with_source(c, large(r2, today, -F.col("importe")))
    r3 = large(views.r3_lines_unsupported(c.tables), today, F.col("importe"))
    i, t, x = F.col("invoice_id"), F.col("bank_transaction_id"), F.col("liquidation_line_id")
    return [
        hit(r1, "D1", 2, text("invoice:", i, ":unmatched"), ["R1", i], ("invoice", i), EXTRACTED, F.col("total"), F.col("fecha_expedicion"), package=F.col("works_package_id")),
        hit(r2, "D1", F.when(F.col("person_beneficiary"), 4).otherwise(3), text("tx:", t, ":unmatched"), ["R2", t], ("bank_transaction", t), (F.col("independence"), 1.0), -F.col("importe"), F.col("fecha_operacion")),
        hit(r3, "D1", 3, text("liquidation_line:", x, ":unsupported"), ["R3", x], ("liquidation_line", x), EXTRACTED, F.col("importe"), year=F.col("ejercicio")),
    ]


@rule("D2")
def cash_instruments(c):
    kinds = ["cash", "cheque", "card", "bizum"]
    tx = c["bank_transactions"].where("importe < 0").withColumn("amount", -F.col("importe"))
    flagged = F.array_intersect("flags", F.array(*map(F.lit, kinds)))
    tx = tx.withColumn("kind", F.when(F.col("tx_kind").isin(*kinds), F.col("tx_kind")).otherwise(F.get(flagged, F.lit(0)))).where("kind IS NOT NULL")
    tx = with_source(c, cash_limit(c, tx, "fecha_operacion"))
    over = views.parameter(tx, c.tables, "outflow_min", F.lit(c.today), default=300).where("amount > outflow_min")
    at_limit = (F.col("kind") == "cash") & (F.col("amount") >= F.col("cash_limit"))
    yearly = tx.where("kind = 'cash'").groupBy("community_id", F.year("fecha_operacion").alias("y")).agg(F.sum("amount").alias("amount")).where("amount > 3000")
    inv = cash_limit(c, views.unique_invoices(c.tables).where(norm_text(F.col("forma_pago")).rlike("efectivo|metalico|metal.lic|cash")), "fecha_expedicion").where("total >= cash_limit")
    i, me = F.col("id"), F.col("community_id")
    return [
        hit(over, "D2", F.when(at_limit, 3).otherwise(2), text("tx:", i, ":instrument"), [i], ("bank_transaction", i), (F.col("independence"), 1.0), F.col("amount"), F.col("fecha_operacion"), computed=["kind", "cash_limit"]),
        hit(yearly, "D2", 3, text("year:", F.col("y").cast("string"), ":cash_total"), ["year", F.col("y")], ("community", me), (0.85, 1.0), F.col("amount"), year=F.col("y")),
        hit(inv, "D2", 3, text("invoice:", i, ":cash"), ["invoice", i], ("invoice", i), EXTRACTED, F.col("total"), F.col("fecha_expedicion")),
    ]


@rule("D3")
def payees(c):
    tx = with_source(c, c["bank_transactions"].where("importe < 0"))
    i = F.col("id")
    paid = views.accepted(c.tables, "paid_by").where("from_type = 'invoice' AND to_type = 'bank_transaction'")
    vendors = c["invoices"].join(c["parties"].where("nif_kind = 'CIF'").select(F.col("id").alias("vendor_party_id")), "vendor_party_id").select(F.col("id").alias("from_id"))
    to_company = paid.join(vendors, "from_id", "left_semi").select(F.col("to_id").alias("id")).distinct()
    person = tx.where(F.array_contains("flags", "person_beneficiary")).join(to_company, "id", "left_semi")
    keys = c["payer_keys"].where("role = 'president' AND iban_hmac IS NOT NULL").select("community_id", F.col("iban_hmac").alias("counterparty_iban_hmac")).distinct()
    president = tx.join(keys, ["community_id", "counterparty_iban_hmac"], "left_semi")
    foreign = tx.where(F.array_contains("flags", "foreign_iban"))
    basis = (F.col("independence"), 1.0)

    def one(rows, severity, event, mark):
        return hit(rows, "D3", severity, text("tx:", i, event), [mark, i], ("bank_transaction", i), basis, -F.col("importe"), F.col("fecha_operacion"))

    return [one(person, 3, ":payee", "person"), one(president, 4, ":payee", "presidency"), one(foreign, 2, ":payee_account", "foreign")]


@rule("D4")
def payment_timing(c):
    links = views.accepted(c.tables, "paid_by").where("from_type = 'invoice' AND to_type = 'bank_transaction'").select(F.col("from_id").alias("invoice_id"), F.col("to_id").alias("tx_id"))
    inv = c["invoices"].select(F.col("id").alias("invoice_id"), "fecha_expedicion", "forma_pago", "works_package_id")
    tx = c["bank_transactions"].select(F.col("id").alias("tx_id"), "community_id", "fecha_operacion", "importe", "concepto_text", "statement_id")
    rows = with_source(c, links.join(inv, "invoice_id").join(tx, "tx_id")).withColumn("amount", F.abs("importe"))
    meetings = c["meetings"].select(F.col("id").alias("meeting_id"), F.col("fecha").alias("approved_on"))
    resolutions = c["resolutions"].select(F.col("id").alias("to_id"), "meeting_id").join(meetings, "meeting_id").select("to_id", "approved_on")
    approved = best_link(c, "authorised_by", "resolution").join(resolutions, "to_id").withColumnRenamed("to_id", "resolution_id")
    contracts = c["contracts"].select(F.col("id").alias("to_id"), F.col("fecha_firma").alias("signed_on"))
    signed = best_link(c, "under_contract", "contract").join(contracts, "to_id").withColumnRenamed("to_id", "contract_id")
    rows = rows.join(approved, "invoice_id", "left").join(signed, "invoice_id", "left")
    advance = F.concat_ws(" ", "forma_pago", "concepto_text").rlike("(?i)anticip|a cuenta|bestret|provisi")
    i, t, r, k, paid = (F.col(x) for x in ("invoice_id", "tx_id", "resolution_id", "contract_id", "fecha_operacion"))
    basis, who = (F.col("independence"), 1.0), ("bank_transaction", t)
    extra = {"amount": F.col("amount"), "package": F.col("works_package_id"), "first": paid}
    return [
        hit(rows.where((paid < F.col("fecha_expedicion")) & ~advance), "D4", 2, text("payment:", t, ":before_invoice:", i), ["before_invoice", i, t], who, basis, last=F.col("fecha_expedicion"), **extra),
        hit(rows.where(paid < F.col("approved_on")), "D4", 3, text("resolution:", r, ":payment_before:", t), ["before_resolution", r, t], who, basis, last=F.col("approved_on"), **extra),
        hit(rows.where(paid < F.col("signed_on")), "D4", 3, text("contract:", k, ":payment_before:", t), ["before_contract", k, t], who, basis, last=F.col("signed_on"), **extra),
    ]


@rule("D5")
def contributions(c):
    sums = c["derrama_ledger"].where("basis = 'bank'").groupBy("community_id", "derrama_id", "unit_id").agg(F.sum("expected").alias("e"), F.sum("paid").alias("p"))
    off = F.abs(F.col("e") - F.coalesce("p", F.lit(0)))
    rows = sums.where(off > F.greatest(F.lit(1000).cast("decimal(20,2)"), F.col("e") * F.lit("0.05").cast("decimal(3,2)")))
    d, u = F.col("derrama_id"), F.col("unit_id")
    return [hit(rows, "D5", 3, text("derrama:", d, ":unit:", u), [d, u], ("derrama", d), (1.0, 0.9), off, computed=["e", "p"])]


@rule("D6")
def reserve_fund(c):
    liq = c["liquidations"].where("fondo_reserva_final IS NOT NULL")
    budgets = c["meetings"].where("presupuesto_aprobado IS NOT NULL").groupBy("community_id", (F.year("fecha") - 1).alias("ejercicio")).agg(F.max_by("presupuesto_aprobado", "fecha").alias("b"))
    base = c["communities"].select(F.col("id").alias("community_id"), "ordinary_budget_default")
    rows = liq.join(budgets, ["community_id", "ejercicio"], "left").join(base, "community_id", "left").withColumn("budget", F.coalesce("b", "ordinary_budget_default"))
    least = F.col("budget") * F.lit("0.05").cast("decimal(3,2)")
    i, me = F.col("id"), F.col("community_id")
    accounts = per_community(c, c["bank_accounts"], n=F.lit(True), reserve=F.col("purpose") == "reserve").where("n > 0 AND reserve = 0")
    return [
        hit(rows.where((F.col("budget") > 0) & (F.col("fondo_reserva_final") < least)), "D6", 1, text("liquidation:", i, ":reserve"), [i, "minimum"], ("liquidation", i), SEED, least - F.col("fondo_reserva_final"), year=F.col("ejercicio")),
        hit(rows.where("saldo_en_poder_administrador > 0"), "D7", 3, text("liquidation:", i, ":funds_held"), [i, "held"], ("liquidation", i), SEED, F.col("saldo_en_poder_administrador"), year=F.col("ejercicio")),
        hit(accounts, "D6", 2, text("community:", me, ":reserve_account"), [me, "no_reserve_account"], ("community", me), (0.7, 1.0)),
    ]


@rule("D7")
def continuity(c):
    y = views.year_balance_continuity(c.tables)
    cent = F.lit("0.01").cast("decimal(4,2)")
    i, year = F.col("liquidation_id"), F.col("fiscal_year")
    close = F.col("saldo_final") - F.col("bank_saldo_at_close")
    totals = views.control_totals(c.tables).where("pm_ordinary > 0").where(F.abs("bridged_difference") > F.col("pm_ordinary"))

    def one(rows, what, mark, amount):
        return hit(rows, "D7", 3, text("liquidation:", i, what), [i, mark], ("liquidation", i), SEED, amount, year=year)

    return [
        one(y.where(F.abs("opening_gap") > cent), ":opening", "opening", F.abs("opening_gap")),
        one(y.where(F.abs(close) > cent), ":closing_vs_bank", "closing_vs_bank", F.abs(close)),
        one(y.where("saldo_en_poder_administrador > 0"), ":funds_held", "held", F.col("saldo_en_poder_administrador")),
        hit(totals, "D7", 3, text("year:", year.cast("string"), ":control_totals"), ["control_totals", year], ("community", F.col("community_id")), SEED, F.abs("bridged_difference"), year=year),
    ]


def _near_amounts(rows, others, amount, key):
    """(key) of rows with an amount within 1 % among others(community_id, v); over bins of equal width in the logarithm."""
    step = 0.01
    mine = rows.withColumn("_bin", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.floor(F.log(F.col(amount).cast("double")) / step) + k)))
    theirs = others.where("v > 0").withColumn("_bin", F.floor(F.log(F.col("v").cast("double")) / step)).distinct()
    close = mine.join(theirs, ["community_id", "_bin"]).where(F.abs(F.col("v") - F.col(amount)) <= F.greatest(F.col("v"), F.col(amount)) * F.lit("0.01").cast("decimal(3,2)"))
    return close.select(key).distinct()


@rule("D8")
def subsidies(c):
    s = c["subsidies"].withColumn("amount", F.coalesce("import_pagat", "import_atorgat")).where("amount > 0")
    income = c["liquidation_lines"].where("side = 'ingreso'").select("community_id", F.col("importe").alias("v"))
    credits = c["bank_transactions"].where("importe > 0").select("community_id", F.col("importe").alias("v"))
    linked = c["recon_links"].where("from_type = 'subsidy' AND link_type = 'funds'").select(F.col("from_id").alias("id"))
    absent = s.join(_near_amounts(s, income, "amount", "id"), "id", "left_anti").join(_near_amounts(s, credits, "amount", "id"), "id", "left_anti").join(linked, "id", "left_anti")
    i = F.col("id")
    return [
        hit(absent, "D8", 4, text("subsidy:", i, ":pass_through"), [i, "not_in_accounts"], ("subsidy", i), RECORD, F.col("amount"), F.col("paid_on"), package=F.col("works_package_id")),
        hit(s.where("paid_to_is_community = false"), "D8", 4, text("subsidy:", i, ":destination"), [i, "destination"], ("subsidy", i), RECORD, F.col("amount"), F.col("paid_on"), package=F.col("works_package_id")),
    ]


@rule("D11")
def loans(c):
    x = c["loans"]
    credits = c["bank_transactions"].where("importe > 0").select("community_id", F.col("importe").alias("v"))
    linked = c["recon_links"].where("from_type = 'loan' AND link_type = 'funds'").select(F.col("from_id").alias("id"))
    credited = _near_amounts(x.where("principal > 0"), credits, "principal", "id").union(linked).distinct().withColumn("credited", F.lit(True))
    rows = x.join(credited, "id", "left")
    repaid = c["bank_transactions"].where("importe < 0 AND tx_kind = 'loan'").select("community_id").distinct()
    i = F.col("id")
    return [
        hit(rows.where("credited IS NULL OR paid_to_is_community = false"), "D11", 4, text("loan:", i, ":disbursement"), [i, "disbursement"], ("loan", i), SEED, F.col("principal"), F.col("signed_on"), package=F.col("works_package_id")),
        hit(x.where("has_schedule").join(repaid, "community_id", "left_anti"), "D11", 2, text("loan:", i, ":repayments"), [i, "repayments"], ("loan", i), SEED, F.col("principal"), F.col("signed_on")),
    ]


# ---- E: meetings and authority


@rule("E1")
def authority(c):
    r4 = views.r4_spend_without_resolution(c.tables)
    quotes = c["quotes"].groupBy("works_package_id").agg(F.max("total").alias("cap"))
    delegated = c["resolutions"].where("kind = 'delegation' AND works_package_id IS NOT NULL").select("community_id", "works_package_id").distinct()
    spent = views.unique_invoices(c.tables).groupBy("works_package_id").agg(F.sum("total").alias("spent"))
    rows = delegated.join(quotes, "works_package_id").join(spent, "works_package_id")
    rows = views.parameter(rows, c.tables, "delegation_tolerance_pct", F.lit(c.today), default=0)
    over = rows.where((F.col("cap") > 0) & (F.col("spent") > F.col("cap") * (1 + F.col("delegation_tolerance_pct") / 100)))
    i, p = F.col("invoice_id"), F.col("works_package_id")
    return [
        hit(r4, "E1", 2, text("invoice:", i, ":authority"), ["R4", i], ("invoice", i), EXTRACTED, F.col("total"), F.col("fecha_expedicion"), package=p),
        hit(over, "E1", 3, text("works_package:", p, ":delegated_cap"), ["delegation", p], ("works_package", p), EXTRACTED, F.col("spent") - F.col("cap"), package=p),
    ]


#: What must come before each stage of works, and by how many days it may come after.
STAGES = (
    ("quote_accepted", "acta_approval", 15), ("contract_signed", "acta_approval", 0), ("permit_filed", "contract_signed", 0), ("permit_granted", "permit_filed", 0),
    ("start_of_works", "contract_signed", 0), ("start_of_works", "permit_granted", 0), ("certification", "contract_signed", 0), ("certification", "start_of_works", 0),
    ("invoice", "contract_signed", 0), ("final_certification", "certification", 0), ("payment", "acta_approval", 0), ("payment", "contract_signed", 0),
    ("retention_release", "final_certification", 0),
)


@rule("E2")
def sequence(c):
    first = ordered.earliest_per_kind(c["works_events"].where("event_date IS NOT NULL"), ["community_id", "works_package_id"], "event_type", "event_date", "ref_id")
    order = c.tables.spark.createDataFrame(STAGES, "event_type string, before string, tolerance_days int")
    bad = ordered.sequence_check(first, order, "works_package_id", "event_type", "event_date").where("ok = false")
    bad = bad.join(first.select("community_id", "works_package_id", "event_type", "ref_id"), ["works_package_id", "event_type"])
    earlier = first.select("works_package_id", F.col("event_type").alias("before"), F.col("ref_id").alias("before_ref"))
    bad = bad.join(earlier, ["works_package_id", "before"], "left")
    p, kind, before = F.col("works_package_id"), F.col("event_type"), F.col("before")
    severity = F.when(kind.isin("payment") | before.isin("permit_granted"), 3).otherwise(2)
    # a payment before its approval or contract is the event of rule D4 too
    ref, other = F.col("ref_id"), F.col("before_ref")
    paid = (kind == "payment") & ref.isNotNull() & other.isNotNull()
    event = (
        F.when(paid & (before == "contract_signed"), text("contract:", other, ":payment_before:", ref)).when(paid & (before == "acta_approval"), text("resolution:", other, ":payment_before:", ref))
        .otherwise(text("works_package:", p, ":", kind, ":", before, ":", F.coalesce(ref, F.col("event_date").cast("string"))))
    )
    return [hit(bad, "E2", severity, event, [p, kind, before, F.coalesce("ref_id", F.lit("")), F.col("event_date")], ("works_package", p), EXTRACTED, first=F.col("event_date"), last=F.col("before_at"), package=p)]


@rule("E3")
def minutes(c):
    m = c["meetings"]
    seats = m.where("attendees IS NOT NULL").select("id", "community_id", "fecha", F.explode("attendees").alias("a"))
    sums = seats.groupBy("id", "community_id", "fecha").agg(F.sum("a.quota").alias("q"))
    label = fold(F.col("a.unit"), "upper", "A-Z0-9")
    known = c["units"].select("community_id", fold(F.col("label"), "upper", "A-Z0-9").alias("l")).distinct()
    with_units = known.select("community_id").distinct()
    unknown = seats.where("a.unit IS NOT NULL").withColumn("l", label).join(with_units, "community_id", "left_semi").join(known, ["community_id", "l"], "left_anti")
    unknown = unknown.groupBy("id", "community_id", "fecha").agg(F.array_sort(F.collect_set("l")).alias("labels"))
    items = c["resolutions"].where("kind = 'accounts'").select(F.col("meeting_id").alias("id"))
    silent = m.where("tipo = 'ordinaria' AND coalesce(cuentas_aprobadas, false) = false").join(items, "id", "left_anti")
    i = F.col("id")

    def one(rows, what, mark):
        return hit(rows, "E3", 2, text("meeting:", i, what), [i, mark], ("meeting", i), SEED, first=F.col("fecha"))

    return [one(sums.where("q > 100.05"), ":quotas", "quota_sum"), one(unknown, ":unit_labels", "unit_labels"), one(silent, ":accounts_item", "accounts_item")]


@rule("E5")
def documents_withheld(c):
    open_ = c["document_requests"].where("status IN ('planned', 'requested', 'partial', 'refused', 'inspected_only')")
    severity = F.when(F.col("status") == "planned", 1).otherwise(2)
    missing = views.r7_statement_months_missing(c.tables).groupBy("community_id", "bank_account_id").agg(F.array_sort(F.collect_list(F.date_format("month_start", "yyyy-MM"))).alias("months"))
    i, a = F.col("id"), F.col("bank_account_id")
    return [
        hit(open_, "E5", severity, text("document_request:", i), [i], ("document_request", i), RECORD, first=F.col("requested_on"), year=F.col("fiscal_year")),
        hit(missing, "E5", 2, text("bank_account:", a, ":statements"), [a, "statements"], ("bank_account", a), RECORD, computed=["months"]),
    ]


@rule("E6")
def formal_deadlines(c):
    m, r, i = c["meetings"], c["request_clock"].where("request_date IS NOT NULL"), F.col("id")

    def one(rows, severity, what, mark):
        return hit(rows, "E6", severity, text("meeting:", i, what), [i, mark], ("meeting", i), SEED, first=F.col("fecha"))

    def clock(rows, severity, what, mark, day):
        return hit(rows, "E6", severity, text("request_clock:", i, what), [i, mark], ("request_clock", i), RECORD, first=F.col(day))

    return [
        one(m.where("notice_days < 8"), 2, ":notice", "notice"), one(m.where("signed_within_5d = false"), 1, ":signature", "signed"), one(m.where("sent_within_10d = false"), 1, ":notification", "sent"),
        clock(r.where("convocation_date IS NULL"), 1, ":convocation", "not_convened", "request_date"), clock(r.where("convocation_date IS NOT NULL AND notice_days < 8"), 2, ":notice", "notice", "convocation_date"),
    ]


@rule("E7")
def open_challenges(c):
    #: Kinds of resolutions whose challenge windows are watched.
    kinds = ("works_approval", "contractor_choice", "delegation", "derrama", "accounts", "budget", "loan", "subsidy", "election")
    rows = views.challengeable_resolutions(c.tables, c.today).where(F.col("kind").isin(*kinds)).where("open_3m OR open_12m")
    r = F.col("resolution_id")
    return [hit(rows, "E7", 1, text("resolution:", r, ":challenge"), [r], ("resolution", r), SEED, F.col("importe_aprobado"), F.col("meeting_date"), F.col("challenge_12m_until"))]


@rule("E8")
def double_majority(c):
    r = c["resolutions"].where("resultado = 'aprobado' AND kind IN ('works_approval', 'delegation', 'derrama', 'loan')")
    # unknown counts decide nothing; either count that is known to fall short does
    failed = F.coalesce(F.col("votes_for") * 2 <= F.col("owners_total"), F.lit(False)) | F.coalesce(F.col("quotas_for") <= 50, F.lit(False))
    i = F.col("id")
    return [hit(r.where(failed), "E8", 2, text("resolution:", i, ":majority"), [i], ("resolution", i), SEED, F.col("importe_aprobado"), computed=["votes_for", "owners_total", "quotas_for"])]


# ---- B: vendors


def _vendors(c):
    return c["parties"].where("kind IN ('vendor', 'architect')").withColumnRenamed("id", "party_id")


@rule("B1")
def company_age(c):
    inv = views.unique_invoices(c.tables).groupBy(F.col("vendor_party_id").alias("party_id")).agg(F.min("fecha_expedicion").alias("first"), F.sum(F.when(F.col("works_package_id").isNotNull(), F.col("total"))).alias("works"))
    check = latest_check(c, "company_profile").select("party_id", "archived")
    rows = _vendors(c).join(inv, "party_id").join(check, "party_id", "left")
    months = F.datediff("first", "incorporated_on") / 30.4375
    p, basis = F.col("party_id"), (checked(), 1.0)
    # trades that an activity code of two digits stands for
    division = F.left(F.col("cnae"), F.lit(2))
    unrelated = F.when(F.col("cnae").isNotNull() & (F.size("trades") > 0), ~division.isin("41", "42", "43", "71", "33", "81"))
    return [
        hit(rows.where((months >= 0) & (months < 12)), "B1", F.when(months < 6, 3).otherwise(2), text("party:", p, ":company_age"), [p, "age", F.col("incorporated_on"), F.col("first")], ("party", p), basis, first=F.col("incorporated_on"), last=F.col("first")),
        hit(rows.where("capital <= 3000 AND works > 20000"), "B1", 2, text("party:", p, ":capital_vs_works"), [p, "capital", F.col("capital")], ("party", p), basis, F.col("works")),
        hit(rows.where(unrelated), "B1", 2, text("party:", p, ":cnae"), [p, "cnae", F.col("cnae")], ("party", p), basis),
    ]


@rule("B2")
def addresses(c):
    p, role = F.col("party_id"), F.col("role")
    links = c["party_links"].where("status <> 'rejected' AND signal IN ('S5', 'S6')")
    severity = F.when(F.col("points") >= 80, 3).when(F.col("points") >= 40, 2).otherwise(1)
    key = fold(F.col("address"), "upper", "A-Z0-9")
    parties = c["parties"].withColumnRenamed("id", "party_id").where("address IS NOT NULL").withColumn("key", key).where("key <> ''")
    building = c["communities"].select(F.col("id").alias("community_id"), key.alias("key"))
    here = parties.where("kind IN ('vendor', 'architect')").join(building, ["community_id", "key"])
    size = parties.groupBy("community_id", "key").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("kind") == "administrator").alias("admin"))
    shared = parties.where("kind IN ('vendor', 'architect')").join(size, ["community_id", "key"]).where("n > 1")
    level = F.when(F.col("n") >= 5, 1).when(F.col("admin"), 3).otherwise(2)
    return [
        hit(links, "B2", severity, text("party:", p, ":address_link:", role), [p, role, F.col("signal")], ("party", p), (0.7, 1.0)),
        hit(here, "B2", 3, text("party:", p, ":address_building"), [p, "building"], ("party", p), (0.7, 0.9)),
        hit(shared, "B2", level, text("party:", p, ":address_shared"), [p, "shared", F.col("key")], ("party", p), (0.7, 0.9), computed=["n"]),
    ]


@rule("B3")
def name_links(c):
    links = c["party_links"].where("status <> 'rejected' AND signal IN ('S1', 'S2', 'S3', 'S4')")
    pts = F.col("points")
    severity = F.when(F.col("signal").isin("S1", "S2"), 4).when(F.col("signal") == "S4", F.when(pts >= 10, 3).otherwise(1)).when(pts >= 40, 4).when(pts >= 25, 3).when(pts >= 10, 2).otherwise(1)
    p, role = F.col("party_id"), F.col("role")
    return [hit(links, "B3", severity, text("party:", p, ":name_link:", role), [p, role, F.col("signal")], ("party", p), (0.7, 1.0), computed=["points"])]


@rule("B7")
def registers(c):
    p = F.col("party_id")

    def absent(kinds, trades, severity, what, mark):
        check = latest_check(c, *kinds).where("status = 'not_found'").select("community_id", "party_id", "archived")
        rows = _vendors(c).where(F.arrays_overlap("trades", F.array(*map(F.lit, trades)))).join(check, ["community_id", "party_id"])
        return hit(rows, "B7", severity, text("party:", p, what), [p, mark], ("party", p), (checked(), 1.0))

    #: Categories of work that need an entry in each register.
    rea = ("ELEV_CIVIL", "FACADE_REHAB", "BALCONY", "ROOF", "STAIR_REHAB", "MASONRY", "PLUMB_SEWER", "WATER_SUPPLY", "SCAFFOLD", "PAINT_INT", "ASBESTOS", "WINDOWS", "ENTRANCE_DOOR")
    rasic = ("ELEV_INSTALL", "ELEV_MAINT", "ELECTRICAL", "GAS", "INTERCOM", "FIRE")
    return [absent(("rea", "rea_manual"), rea, 2, ":rea_absent", "rea"), absent(("rasic", "rasic_manual"), rasic, 3, ":rasic_absent", "rasic")]


@rule("B8")
def concentration(c):
    inv = views.unique_invoices(c.tables).where("works_package_id IS NULL AND vendor_party_id IS NOT NULL")
    sums = inv.groupBy("community_id", "vendor_party_id").agg(F.sum("total").alias("v"))
    top = sums.groupBy("community_id").agg(F.sum("v").alias("total"), F.max_by(F.struct("v", "vendor_party_id"), F.struct("v", "vendor_party_id")).alias("t"))
    rows = top.where("total > 0").where(F.col("t.v") > F.col("total") * F.lit("0.6").cast("decimal(3,2)"))
    me, p = F.col("community_id"), F.col("t.vendor_party_id")
    return [hit(rows, "B8", 1, text("community:", me, ":vendor_concentration_ordinary"), [me, p], ("party", p), EXTRACTED, F.col("t.v"), computed=["total"])]


@rule("B9")
def implied_volume(c):
    number = F.regexp_extract("numero", r"(\d+)\s*$", 1).try_cast("bigint")
    inv = views.unique_invoices(c.tables).withColumn("n", number).where("n IS NOT NULL AND vendor_party_id IS NOT NULL AND fecha_expedicion IS NOT NULL")
    g = inv.groupBy("community_id", F.col("vendor_party_id").alias("party_id"), F.year("fecha_expedicion").alias("y")).agg(
        F.count(F.lit(1)).alias("k"), F.min("n").alias("a"), F.max("n").alias("b"), F.datediff(F.max("fecha_expedicion"), F.min("fecha_expedicion")).alias("d"), F.sum("total").alias("total")
    )
    implied = (F.col("b") - F.col("a")) / F.col("d") * 365
    p, y = F.col("party_id"), F.col("y")
    few = g.where("k >= 2 AND b > a AND d > 0 AND total > 10000").where(implied < 30)
    return [
        hit(few, "B9", 2, text("party:", p, ":implied_volume:", y.cast("string")), [p, "implied", y], ("party", p), EXTRACTED, F.col("total"), year=y, computed=["k", "a", "b", "d"]),
        hit(g.where("a <= 10"), "B9", 1, text("party:", p, ":first_number:", y.cast("string")), [p, "first_number", y], ("party", p), EXTRACTED, F.col("total"), year=y, computed=["a"]),
    ]


@rule("B10")
def census(c):
    check = latest_check(c, "aeat_census").where("status = 'ok' AND matched = false").select("community_id", "party_id", "archived")
    rows = _vendors(c).join(check, ["community_id", "party_id"])
    p = F.col("party_id")
    return [hit(rows, "B10", 3, text("party:", p, ":aeat_identity"), [p, "aeat_identity"], ("party", p), (checked(), 1.0))]


# ---- A: quotes; G: technical and tax documents


@rule("A10")
def quote_fingerprints(c):
    q = c["quotes"].where("works_package_id IS NOT NULL AND vendor_party_id IS NOT NULL")
    kinds = reduce(DataFrame.unionByName, (q.select("community_id", "works_package_id", "vendor_party_id", F.lit(k).alias("kind"), fold(F.col(k), "lower").alias("value")) for k in ("producer", "author", "phone")))
    same = kinds.where("value <> ''").groupBy("community_id", "works_package_id", "kind", "value").agg(F.count_distinct("vendor_party_id").alias("n")).where("n > 1").select("community_id", "works_package_id", "kind")
    close = joins.numeric_band(q.where("number IS NOT NULL"), "works_package_id", "vendor_party_id", "number", 5).select("works_package_id").distinct()
    close = q.select("community_id", "works_package_id").distinct().join(close, "works_package_id").select("community_id", "works_package_id", F.lit("sequential_numbers").alias("kind"))
    rows = same.unionByName(close).groupBy("community_id", "works_package_id").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
    severity = F.when((F.size("kinds") >= 2) | F.array_contains("kinds", "sequential_numbers"), 3).otherwise(2)
    p = F.col("works_package_id")
    return [hit(rows, "A10", severity, text("works_package:", p, ":quote_fingerprints"), [p, F.array_join("kinds", ",")], ("works_package", p), EXTRACTED, package=p, computed=["kinds"])]


def _counts(c, **parts):
    """(community_id, counts): parts are (table, condition)."""
    out = communities(c)
    for name, (table, condition) in parts.items():
        out = out.join(per_community(c, c[table], **{name: F.coalesce(condition, F.lit(False))}), "community_id")
    return out


@rule("G2")
def tax_filings(c):
    persons = c["parties"].where("nif_kind IN ('DNI', 'NIE')").select(F.col("id").alias("vendor_party_id"))
    natural = per_community(c, c["invoices"].join(persons, "vendor_party_id", "left_semi"), natural=F.lit(True))
    rows = _counts(
        c, filings=("documents", F.col("doc_type").isin("modelo_111", "modelo_190", "modelo_347")), asked=("document_requests", F.col("status").isin("requested", "partial", "refused", "inspected_only") & (F.col("class") == "modelo_347")),
        withheld=("invoices", F.col("retention_amount") > 0),
    ).join(natural, "community_id")
    me = F.col("community_id")
    rows = rows.where("filings = 0 AND (asked > 0 OR withheld > 0 OR natural > 0)")
    return [hit(rows, "G2", F.when(F.col("asked") > 0, 2).otherwise(1), text("community:", me, ":tax_filings_absent"), [me, "filings"], ("community", me), RECORD)]


@rule("G5")
def lifts(c):
    rows = _counts(
        c, packages=("works_packages", F.col("code") == "ELEVATOR"), bills=("invoices", F.col("category_code").isin("ELEV_INSTALL", "ELEV_CIVIL")), kept=("invoices", F.col("category_code") == "ELEV_MAINT"),
        inspected=("invoices", F.col("category_code") == "ELEV_INSPECT"), ce=("documents", F.col("doc_type") == "declaracio_responsable_ascensor"),
    ).where("packages + bills + kept > 0")
    me, p = F.col("community_id"), F.col("party_id")
    sellers = c["invoices"].where(F.col("category_code").isin("ELEV_INSTALL", "ELEV_CIVIL", "ELEV_MAINT")).select("community_id", F.col("vendor_party_id").alias("party_id")).distinct()
    absent = latest_check(c, "rasic", "rasic_manual").where("status = 'not_found'").join(sellers, ["community_id", "party_id"])
    return [
        hit(rows.where("ce = 0"), "G5", 1, text("community:", me, ":lift_ce_declaration"), [me, "ce"], ("community", me), RECORD),
        hit(absent, "G5", 2, text("party:", p, ":rasic_absent"), [p, "rasic"], ("party", p), (checked(), 1.0)),
        hit(rows.where("kept > 0 AND inspected = 0"), "G5", 1, text("community:", me, ":lift_oca_inspection"), [me, "oca"], ("community", me), RECORD),
    ]


@rule("G6")
def safety_coordination(c):
    rows = _counts(c, bills=("invoices", F.col("category_code").isin("CAE_PRL", "HS_COORD")), named=("documents", F.col("doc_type") == "full_encarrec"))
    crews = c["invoices"].where("works_package_id IS NOT NULL").groupBy("community_id").agg(F.count_distinct("vendor_party_id").alias("crews"))
    rows = rows.where("bills > 0 AND named = 0").join(crews, "community_id", "left")
    me = F.col("community_id")
    return [hit(rows, "G6", F.when(F.col("crews") > 1, 2).otherwise(1), text("community:", me, ":hs_coordination_documents"), [me, "coordination"], ("community", me), RECORD)]


@rule("G7")
def building_inspection(c):
    rows = _counts(c, ite=("documents", F.col("doc_type") == "ite"), filed=("permits", F.col("kind") == "ite")).where("ite = 0 AND filed = 0")
    rows = views.parameter(rows, c.tables, "building_year", F.lit(c.today)).where("building_year IS NULL OR building_year < 1965")
    me = F.col("community_id")
    return [hit(rows, "G7", 1, text("community:", me, ":ite"), [me, "ite"], ("community", me), RECORD)]


# ---- run


def hits(tables: Tables, today: datetime.date, codes: list[str] | None = None) -> DataFrame:
    """All hits of the rules asked for."""
    c = Context(tables, today)
    frames = [f for code in codes or RULES for f in RULES[code](c)]
    return reduce(DataFrame.unionByName, frames)


def run(tables: Tables, today: datetime.date, codes: list[str] | None = None) -> DataFrame:
    """Findings: hits collapsed by event, scored and tiered, one row an event."""
    found = scoring.scored(scoring.collapse_by_event(hits(tables, today, codes)))
    return found.withColumn("tier", scoring.tier(F.lit(False)))


def upsert(findings: DataFrame, found: DataFrame) -> DataFrame:
    """Stored findings merged with a run's by fingerprint; those that people have decided on stay as they are."""
    return ordered.merge_keeping(findings, found, ["fingerprint"], "status", "open")
