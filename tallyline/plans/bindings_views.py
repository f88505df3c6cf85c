"""The analytical views over the domain tables made from the driver's tables, each beside the same result in DuckDB's SQL."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from tallyline.plans import views
from tallyline.plans.bindings import bound
from tallyline.plans.domain import tables, with_tables


def parameter_sql(row: str, key: str, day: str) -> str:
    """The parameter of row's community as of day: highest version that has begun, latest start first."""
    return f"(SELECT value_num FROM t_parameters p WHERE p.community_id = {row}.community_id AND key = '{key}' AND valid_from <= {day} ORDER BY version DESC, valid_from DESC LIMIT 1)::DECIMAL(20,4)"


_FISCAL = "(year({0}) + CASE WHEN st > 1 AND month({0}) >= st THEN 1 ELSE 0 END)::INTEGER"
_C = ", c AS (SELECT id, coalesce(fy_start_month, 1) AS st FROM t_communities)"
_KEPT = ", kept AS (SELECT i.* FROM t_invoices i WHERE EXISTS (SELECT 1 FROM t_documents d WHERE d.id = i.document_id AND duplicate_of_document_id IS NULL))"


@bound(with_tables("communities", "liquidations", "liquidation_lines", "bank_transactions", "invoices", "documents", "parameters") + _C + _KEPT + f""",
h AS (SELECT community_id, ejercicio AS fiscal_year, max(acreedores_pendientes) AS closing_payables, max(retenciones_pendientes) AS retentions_held, max(basis) AS basis FROM t_liquidations GROUP BY ALL),
s AS (SELECT l.community_id, ejercicio AS fiscal_year, sum(importe) FILTER (WHERE side = 'gasto') AS liq_expenses, sum(importe) FILTER (WHERE side = 'ingreso') AS liq_income FROM t_liquidation_lines x JOIN t_liquidations l ON l.id = x.liquidation_id GROUP BY ALL),
b AS (SELECT community_id, {_FISCAL.format("fecha_operacion")} AS fiscal_year, sum(-importe) FILTER (WHERE importe < 0 AND tx_kind <> 'internal') AS bank_debits, sum(importe) FILTER (WHERE importe > 0 AND tx_kind = 'quota_in') AS owner_credits,
  sum(importe) FILTER (WHERE importe > 0 AND tx_kind IN ('subsidy', 'loan')) AS external_credits FROM t_bank_transactions t JOIN c ON c.id = t.community_id GROUP BY ALL),
i AS (SELECT community_id, {_FISCAL.format("fecha_expedicion")} AS fiscal_year, sum(total) AS invoices_total, count(*) AS invoice_count FROM kept JOIN c ON c.id = kept.community_id GROUP BY ALL),
k AS (SELECT community_id, fiscal_year FROM h UNION SELECT community_id, fiscal_year FROM b UNION SELECT community_id, fiscal_year FROM i),
r AS (SELECT k.community_id, k.fiscal_year, h.basis, h.closing_payables, h.retentions_held, s.liq_expenses, s.liq_income, o.closing_payables AS opening_payables, b.bank_debits, b.owner_credits, b.external_credits, i.invoices_total, i.invoice_count
  FROM k LEFT JOIN h USING (community_id, fiscal_year) LEFT JOIN h o ON o.community_id = k.community_id AND o.fiscal_year = k.fiscal_year - 1 LEFT JOIN s ON s.community_id = k.community_id AND s.fiscal_year = k.fiscal_year AND h.community_id IS NOT NULL
  LEFT JOIN b ON b.community_id = k.community_id AND b.fiscal_year = k.fiscal_year LEFT JOIN i ON i.community_id = k.community_id AND i.fiscal_year = k.fiscal_year)
SELECT *, liq_expenses - coalesce(bank_debits, 0) - coalesce(closing_payables, 0) + coalesce(opening_payables, 0) - coalesce(retentions_held, 0) AS bridged_difference,
  {parameter_sql("r", "pm_ordinary", "make_date(fiscal_year, 12, 31)")} AS pm_ordinary FROM r""",
    double="closing_payables retentions_held liq_expenses liq_income opening_payables bank_debits owner_credits external_credits invoices_total bridged_difference pm_ordinary", number="invoice_count")
def view_control_totals(spark, d):
    return views.control_totals(tables(spark, d)).select(
        "community_id", "fiscal_year", "basis", "closing_payables", "retentions_held", "liq_expenses", "liq_income", "opening_payables", "bank_debits", "owner_credits", "external_credits", "invoices_total", "invoice_count", "bridged_difference", "pm_ordinary"
    )


@bound(with_tables("liquidations", "bank_statements", "parameters") + f""",
b AS (SELECT community_id, periodo_hasta, sum(saldo_final) AS bank_saldo_at_close FROM t_bank_statements GROUP BY ALL)
SELECT l.community_id, l.id AS liquidation_id, l.ejercicio AS fiscal_year, l.saldo_inicial, p.saldo_final AS prev_saldo_final, l.saldo_inicial - p.saldo_final AS opening_gap, b.bank_saldo_at_close, {parameter_sql("l", "pm_ordinary", "l.periodo_hasta")} AS pm_ordinary
FROM t_liquidations l LEFT JOIN t_liquidations p ON p.community_id = l.community_id AND p.ejercicio = l.ejercicio - 1 LEFT JOIN b ON b.community_id = l.community_id AND b.periodo_hasta = l.periodo_hasta""",
    double="saldo_inicial prev_saldo_final opening_gap bank_saldo_at_close pm_ordinary")
def view_year_balance_continuity(spark, d):
    return views.year_balance_continuity(tables(spark, d)).select("community_id", "liquidation_id", "fiscal_year", "saldo_inicial", "prev_saldo_final", "opening_gap", "bank_saldo_at_close", "pm_ordinary")


@bound(with_tables("works_packages", "works_events", "invoices", "documents", "recon_links", "derramas", "derrama_ledger", "subsidies", "loans") + _KEPT + """,
e AS (SELECT works_package_id AS id, sum(amount) AS certified_total FROM t_works_events WHERE event_type IN ('certification', 'final_certification') GROUP BY 1),
i AS (SELECT works_package_id AS id, sum(total) AS invoiced_total, sum(CASE WHEN is_extra THEN total ELSE 0 END) AS extras_total FROM kept GROUP BY 1),
p AS (SELECT works_package_id AS id, sum(amount_matched) AS paid_total FROM t_recon_links r JOIN t_invoices i ON i.id = r.from_id WHERE link_type = 'paid_by' AND r.status = 'accepted' AND from_type = 'invoice' GROUP BY 1),
v AS (SELECT works_package_id AS id, sum(paid) AS derrama_collected, sum(expected) AS derrama_expected FROM t_derrama_ledger g JOIN t_derramas v ON v.id = g.derrama_id GROUP BY 1),
s AS (SELECT works_package_id AS id, sum(CASE WHEN paid_to_is_community THEN import_pagat ELSE 0 END) AS subsidy_received FROM t_subsidies GROUP BY 1),
o AS (SELECT works_package_id AS id, sum(CASE WHEN paid_to_is_community THEN principal ELSE 0 END) AS loan_received FROM t_loans GROUP BY 1),
a AS (SELECT w.id AS works_package_id, w.contract_price, certified_total, invoiced_total, extras_total, paid_total, derrama_collected, derrama_expected, subsidy_received, loan_received
  FROM t_works_packages w LEFT JOIN e USING (id) LEFT JOIN i USING (id) LEFT JOIN p USING (id) LEFT JOIN v USING (id) LEFT JOIN s USING (id) LEFT JOIN o USING (id))
SELECT *, greatest(coalesce(contract_price, 0), coalesce(invoiced_total, 0)) AS committed, coalesce(derrama_collected, 0) + coalesce(subsidy_received, 0) + coalesce(loan_received, 0) AS available,
  greatest(coalesce(contract_price, 0), coalesce(invoiced_total, 0)) - (coalesce(derrama_collected, 0) + coalesce(subsidy_received, 0) + coalesce(loan_received, 0)) AS funding_gap FROM a""",
    double="contract_price certified_total invoiced_total extras_total paid_total derrama_collected derrama_expected subsidy_received loan_received committed available funding_gap")
def view_works_funding(spark, d):
    return views.works_funding(tables(spark, d)).select(
        "works_package_id", "contract_price", "certified_total", "invoiced_total", "extras_total", "paid_total", "derrama_collected", "derrama_expected", "subsidy_received", "loan_received", "committed", "available", "funding_gap"
    )


@bound(with_tables("meetings", "resolutions") + """
SELECT r.id AS resolution_id, m.fecha AS meeting_date, r.kind, (coalesce(fecha_notificacion, fecha) + INTERVAL 3 MONTH)::DATE AS challenge_3m_until, (coalesce(fecha_notificacion, fecha) + INTERVAL 12 MONTH)::DATE AS challenge_12m_until,
 (coalesce(fecha_notificacion, fecha) + INTERVAL 3 MONTH)::DATE >= DATE '1996-08-01' AS open_3m, (coalesce(fecha_notificacion, fecha) + INTERVAL 12 MONTH)::DATE >= DATE '1996-08-01' AS open_12m, fecha_notificacion IS NULL AS notification_date_unknown
FROM t_resolutions r JOIN t_meetings m ON m.id = r.meeting_id""", text="meeting_date challenge_3m_until challenge_12m_until")
def view_challengeable_resolutions(spark, d):
    return views.challengeable_resolutions(tables(spark, d), datetime.date(1996, 8, 1)).drop("community_id", "punto", "importe_aprobado")


@bound(with_tables("findings") + """
SELECT id AS finding_id, (act_date_last + INTERVAL 10 YEAR)::DATE AS civil_general_until, (act_date_last + INTERVAL 3 YEAR)::DATE AS civil_periodic_until, (act_date_last + INTERVAL 5 YEAR)::DATE AS criminal_base_until, (act_date_last + INTERVAL 10 YEAR)::DATE AS criminal_aggravated_until
FROM t_findings WHERE act_date_last IS NOT NULL""", text="civil_general_until civil_periodic_until criminal_base_until criminal_aggravated_until")
def view_limitation_clocks(spark, d):
    return views.limitation_clocks(tables(spark, d)).select("finding_id", "civil_general_until", "civil_periodic_until", "criminal_base_until", "criminal_aggravated_until")


@bound("SELECT concat('n', p_partkey) AS id, p_type AS class, (1990 + p_size % 9)::INTEGER AS fiscal_year, CASE WHEN p_size % 2 = 0 THEN 'received' ELSE 'asked' END AS status, CASE WHEN p_size % 4 = 0 THEN p_size % 3 END::BIGINT AS files_received FROM part", number="files_received")
def view_document_matrix(spark, d):
    t = tables(spark, d)
    sizes = spark.read.parquet(f"{d}/part.parquet").select(F.concat(F.lit("n"), "p_partkey").alias("id"), "p_size")
    files = F.when(F.col("p_size") % 4 == 0, F.array_repeat(F.lit("file"), (F.col("p_size") % 3).cast("int")))
    t["document_requests"] = t["document_requests"].join(sizes, "id").withColumn("received_file_ids", files).drop("p_size")
    return views.document_matrix(t).select("id", "class", "fiscal_year", "status", "files_received")


_COVERED = with_tables("bank_statements") + """,
s AS (SELECT community_id, bank_account_id, min(periodo_desde) AS a, max(periodo_hasta) AS b FROM t_bank_statements GROUP BY ALL),
m AS (SELECT community_id, bank_account_id, unnest(generate_series(date_trunc('month', a), date_trunc('month', b), INTERVAL 1 MONTH))::DATE AS month_start FROM s),
v AS (SELECT m.*, EXISTS (SELECT 1 FROM t_bank_statements x WHERE x.bank_account_id = m.bank_account_id AND x.periodo_desde <= last_day(m.month_start) AND x.periodo_hasta >= m.month_start) AS covered FROM m)
"""


@bound(_COVERED + "SELECT community_id, bank_account_id, month_start, covered FROM v", text="month_start")
def view_statement_coverage(spark, d):
    return views.statement_coverage(tables(spark, d)).select("community_id", "bank_account_id", "month_start", "covered")


@bound(_COVERED + "SELECT community_id, bank_account_id, month_start FROM v WHERE NOT covered", text="month_start")
def view_r7_missing_months(spark, d):
    return views.r7_statement_months_missing(tables(spark, d)).select("community_id", "bank_account_id", "month_start")


@bound(with_tables("works_packages", "works_events", "invoices", "recon_links", "bank_transactions", "contracts", "contract_milestones") + """,
w AS (SELECT id AS w, suspension_date AS cut FROM t_works_packages WHERE suspension_date IS NOT NULL),
e AS (SELECT w, sum(amount) AS certified_at_suspension FROM t_works_events JOIN w ON w = works_package_id WHERE event_type IN ('certification', 'final_certification') AND event_date <= cut GROUP BY 1),
i AS (SELECT w, sum(total) FILTER (WHERE fecha_expedicion <= cut) AS invoiced_at_suspension, count(*) FILTER (WHERE fecha_expedicion > cut) AS after FROM t_invoices JOIN w ON w = works_package_id GROUP BY 1),
p AS (SELECT w, sum(amount_matched) AS paid_at_suspension FROM t_recon_links r JOIN t_invoices i ON i.id = r.from_id JOIN w ON w = i.works_package_id JOIN t_bank_transactions b ON b.id = r.to_id
  WHERE link_type = 'paid_by' AND r.status = 'accepted' AND from_type = 'invoice' AND to_type = 'bank_transaction' AND fecha_operacion <= cut GROUP BY 1),
a AS (SELECT c.works_package_id AS w, sum(importe) AS contractual_advances FROM t_contract_milestones m JOIN t_contracts c ON c.id = m.contract_id WHERE is_advance GROUP BY 1)
SELECT w.w AS works_package_id, certified_at_suspension, invoiced_at_suspension, coalesce(after, 0)::BIGINT AS invoices_after_suspension, paid_at_suspension, contractual_advances FROM w LEFT JOIN e USING (w) LEFT JOIN i USING (w) LEFT JOIN p USING (w) LEFT JOIN a USING (w)""",
    double="certified_at_suspension invoiced_at_suspension paid_at_suspension contractual_advances")
def view_suspension_status(spark, d):
    return views.suspension_status(tables(spark, d)).select("works_package_id", "certified_at_suspension", "invoiced_at_suspension", "invoices_after_suspension", "paid_at_suspension", "contractual_advances")


_R1 = with_tables("invoices", "documents", "recon_links") + _KEPT + "SELECT id AS invoice_id, total FROM kept k WHERE NOT EXISTS (SELECT 1 FROM t_recon_links r WHERE r.from_id = k.id AND from_type = 'invoice' AND link_type = 'paid_by' AND status = 'accepted')"


@bound(_R1, double="total")
def view_r1_invoices_without_payment(spark, d):
    return views.r1_invoices_without_payment(tables(spark, d)).select("invoice_id", "total")


@bound(with_tables("bank_transactions", "recon_links", "parameters") + f""",
t AS (SELECT *, coalesce({parameter_sql("b", "outflow_min", "b.fecha_operacion")}, 300) AS least FROM t_bank_transactions b WHERE importe < 0 AND tx_kind NOT IN ('direct_debit_recurring', 'fee', 'tax', 'internal', 'interest', 'loan', 'returned'))
SELECT id AS bank_transaction_id, importe, least AS outflow_min, false AS person_beneficiary FROM t WHERE -importe > least AND NOT EXISTS (SELECT 1 FROM t_recon_links r WHERE r.to_id = t.id AND to_type = 'bank_transaction' AND link_type IN ('paid_by', 'refunds') AND status = 'accepted')""",
    double="importe outflow_min")
def view_r2_debits_without_invoice(spark, d):
    return views.r2_debits_without_invoice(tables(spark, d)).select("bank_transaction_id", "importe", "outflow_min", "person_beneficiary")


@bound(with_tables("liquidation_lines", "liquidations", "recon_links") + """
SELECT x.id AS liquidation_line_id, l.ejercicio, x.importe FROM t_liquidation_lines x JOIN t_liquidations l ON l.id = x.liquidation_id
WHERE side = 'gasto' AND NOT EXISTS (SELECT 1 FROM t_recon_links r WHERE r.to_id = x.id AND to_type = 'liquidation_line' AND link_type = 'reported_as' AND status = 'accepted')""", double="importe")
def view_r3_lines_unsupported(spark, d):
    return views.r3_lines_unsupported(tables(spark, d)).select("liquidation_line_id", "ejercicio", "importe")


@bound(with_tables("invoices", "documents", "recon_links", "contracts", "parameters") + _KEPT + f""",
i AS (SELECT *, coalesce({parameter_sql("k", "authority_threshold", "k.fecha_expedicion")}, 1000) AS least FROM kept k)
SELECT id AS invoice_id, total, least AS authority_threshold FROM i WHERE total > least AND NOT EXISTS (SELECT 1 FROM t_recon_links r WHERE r.from_id = i.id AND from_type = 'invoice' AND link_type = 'authorised_by' AND status = 'accepted')
AND NOT EXISTS (SELECT 1 FROM t_recon_links r JOIN t_contracts c ON c.id = r.to_id WHERE r.from_id = i.id AND from_type = 'invoice' AND to_type = 'contract' AND link_type = 'under_contract' AND r.status = 'accepted' AND authorised_by_resolution_id IS NOT NULL)""",
    double="total authority_threshold")
def view_r4_spend_without_resolution(spark, d):
    return views.r4_spend_without_resolution(tables(spark, d)).select("invoice_id", "total", "authority_threshold")


@bound(with_tables("contract_milestones") + "SELECT id AS milestone_id, status, importe FROM t_contract_milestones WHERE status = 'paid_without_invoice' OR status = 'overpaid'", double="importe")
def view_r5_milestones(spark, d):
    return views.r5_milestones_paid_without_invoice(tables(spark, d)).select("milestone_id", "status", "importe")


@bound(with_tables("derrama_ledger") + "SELECT id, status, expected - paid AS residual FROM t_derrama_ledger WHERE status <> 'paid'", double="residual")
def view_r6_derrama_residual(spark, d):
    return views.r6_derrama_residual(tables(spark, d)).select("id", "status", "residual")


@bound(f"""
SELECT 'R1' AS residual, (SELECT count(*) FROM ({_R1}))::BIGINT AS n UNION ALL SELECT 'R5', (SELECT count(*) FROM ({with_tables("contract_milestones")} SELECT 1 FROM t_contract_milestones WHERE status IN ('paid_without_invoice', 'overpaid')))
UNION ALL SELECT 'R6', (SELECT count(*) FROM ({with_tables("derrama_ledger")} SELECT 1 FROM t_derrama_ledger WHERE status IN ('missing', 'partial', 'excess')))
UNION ALL SELECT 'R7', (SELECT count(*) FROM ({_COVERED} SELECT 1 FROM v WHERE NOT covered))""")
def view_residual_counts(spark, d):
    return views.residual_counts(tables(spark, d)).where("residual IN ('R1', 'R5', 'R6', 'R7')")
