"""Audit rules and reconciliation steps over the domain tables made from the driver's tables, each beside DuckDB's SQL."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from tallyline.plans import match, rules
from tallyline.plans.bindings import bound
from tallyline.plans.bindings_views import _C, _COVERED, _FISCAL, _KEPT, parameter_sql
from tallyline.plans.domain import tables, with_tables

TODAY = datetime.date(1998, 9, 1)
_TODAY = "DATE '1998-09-01'"


def _hits(spark, d, code, *columns):
    """A rule's hits in the columns that the SQL gives too."""
    return rules.hits(tables(spark, d), TODAY, [code]).select("rule_code", "severity", "event_key", "fingerprint", "entity_id", "amount_at_stake", *columns)


def _sql(*parts: str) -> str:
    """Hits from SELECTs of (rule_code, severity, event_key, marks, entity_id, amount_at_stake)."""
    rows = " UNION ALL ".join(parts)
    return f"SELECT rule_code, severity::INTEGER AS severity, event_key, substr(sha256(rule_code || '|' || marks), 1, 32) AS fingerprint, entity_id, amount_at_stake::DECIMAL(14,2) AS amount_at_stake FROM ({rows})"


def _param(row: str, key: str, default: int) -> str:
    return f"coalesce({parameter_sql(row, key, _TODAY)}, {default})"


_WITH_R1 = ", r1 AS (SELECT * FROM kept k WHERE NOT EXISTS (SELECT 1 FROM t_recon_links r WHERE r.from_id = k.id AND from_type = 'invoice' AND link_type = 'paid_by' AND status = 'accepted'))"


@bound(with_tables("invoices", "documents", "recon_links", "bank_transactions", "liquidation_lines", "liquidations", "parameters") + _KEPT + _WITH_R1 + f""",
r2 AS (SELECT * FROM t_bank_transactions b WHERE importe < 0 AND tx_kind NOT IN ('direct_debit_recurring', 'fee', 'tax', 'internal', 'interest', 'loan', 'returned') AND -importe > coalesce({parameter_sql("b", "outflow_min", "b.fecha_operacion")}, 300)
  AND NOT EXISTS (SELECT 1 FROM t_recon_links r WHERE r.to_id = b.id AND to_type = 'bank_transaction' AND link_type IN ('paid_by', 'refunds') AND status = 'accepted')),
r3 AS (SELECT x.* FROM t_liquidation_lines x JOIN t_liquidations l ON l.id = x.liquidation_id WHERE side = 'gasto' AND NOT EXISTS (SELECT 1 FROM t_recon_links r WHERE r.to_id = x.id AND to_type = 'liquidation_line' AND link_type = 'reported_as' AND status = 'accepted'))
""" + _sql(
    f"SELECT 'D1' AS rule_code, 2 AS severity, 'invoice:' || id || ':unmatched' AS event_key, 'R1|' || id AS marks, id AS entity_id, total AS amount_at_stake FROM r1 WHERE total > {_param('r1', 'outflow_min', 300)}",
    f"SELECT 'D1', 3, 'tx:' || id || ':unmatched', 'R2|' || id, id, -importe FROM r2 WHERE -importe > {_param('r2', 'outflow_min', 300)}",
    f"SELECT 'D1', 3, 'liquidation_line:' || id || ':unsupported', 'R3|' || id, id, importe FROM r3 WHERE importe > {_param('r3', 'outflow_min', 300)}",
), double="amount_at_stake")
def rule_d1_unmatched(spark, d):
    return _hits(spark, d, "D1")


@bound(with_tables("invoices", "documents") + _KEPT + _sql("SELECT 'D2' AS rule_code, 3 AS severity, 'invoice:' || id || ':cash' AS event_key, 'invoice|' || id AS marks, id AS entity_id, total AS amount_at_stake FROM kept WHERE forma_pago = 'cash' AND total >= 2500"), double="amount_at_stake")
def rule_d2_cash(spark, d):
    return _hits(spark, d, "D2")


@bound(with_tables("invoices", "bank_transactions", "recon_links", "resolutions", "meetings", "contracts") + """,
best AS (SELECT from_id, link_type, arg_max(to_id, (score, to_id)) AS to_id FROM t_recon_links WHERE from_type = 'invoice' AND link_type IN ('authorised_by', 'under_contract') GROUP BY ALL),
p AS (SELECT i.id AS i, b.id AS t, b.fecha_operacion AS paid, abs(b.importe) AS amount, i.fecha_expedicion, r.id AS r, m.fecha AS approved, k.id AS k, k.fecha_firma AS signed
  FROM t_recon_links l JOIN t_invoices i ON i.id = l.from_id JOIN t_bank_transactions b ON b.id = l.to_id LEFT JOIN best a ON a.from_id = i.id AND a.link_type = 'authorised_by' LEFT JOIN t_resolutions r ON r.id = a.to_id LEFT JOIN t_meetings m ON m.id = r.meeting_id
  LEFT JOIN best u ON u.from_id = i.id AND u.link_type = 'under_contract' LEFT JOIN t_contracts k ON k.id = u.to_id WHERE l.link_type = 'paid_by' AND l.status = 'accepted' AND l.from_type = 'invoice' AND l.to_type = 'bank_transaction')
""" + _sql(
    "SELECT 'D4' AS rule_code, 2 AS severity, 'payment:' || t || ':before_invoice:' || i AS event_key, 'before_invoice|' || i || '|' || t AS marks, t AS entity_id, amount AS amount_at_stake FROM p WHERE paid < fecha_expedicion",
    "SELECT 'D4', 3, 'resolution:' || r || ':payment_before:' || t, 'before_resolution|' || r || '|' || t, t, amount FROM p WHERE paid < approved",
    "SELECT 'D4', 3, 'contract:' || k || ':payment_before:' || t, 'before_contract|' || k || '|' || t, t, amount FROM p WHERE paid < signed",
), double="amount_at_stake")
def rule_d4_payment_timing(spark, d):
    return _hits(spark, d, "D4")


@bound(with_tables("communities", "liquidations", "liquidation_lines", "bank_transactions", "bank_statements", "invoices", "documents", "parameters") + _C + f""",
h AS (SELECT community_id, ejercicio AS y, max(acreedores_pendientes) AS payables, max(retenciones_pendientes) AS held FROM t_liquidations GROUP BY ALL),
s AS (SELECT l.community_id, ejercicio AS y, sum(importe) AS expenses FROM t_liquidation_lines x JOIN t_liquidations l ON l.id = x.liquidation_id WHERE side = 'gasto' GROUP BY ALL),
b AS (SELECT community_id, {_FISCAL.format("fecha_operacion")} AS y, sum(-importe) AS debits FROM t_bank_transactions t JOIN c ON c.id = t.community_id WHERE importe < 0 AND tx_kind <> 'internal' GROUP BY ALL),
g AS (SELECT h.community_id, h.y, expenses - coalesce(debits, 0) - coalesce(h.payables, 0) + coalesce(o.payables, 0) - coalesce(h.held, 0) AS gap FROM h JOIN s USING (community_id, y) LEFT JOIN b USING (community_id, y) LEFT JOIN h o ON o.community_id = h.community_id AND o.y = h.y - 1),
w AS (SELECT *, {parameter_sql("g", "pm_ordinary", "make_date(g.y, 12, 31)")} AS pm FROM g),
k AS (SELECT community_id, periodo_hasta, sum(saldo_final) AS bank FROM t_bank_statements GROUP BY ALL),
l AS (SELECT l.*, l.saldo_inicial - p.saldo_final AS opening, l.saldo_final - bank AS closing FROM t_liquidations l LEFT JOIN t_liquidations p ON p.community_id = l.community_id AND p.ejercicio = l.ejercicio - 1 LEFT JOIN k ON k.community_id = l.community_id AND k.periodo_hasta = l.periodo_hasta)
""" + _sql(
    "SELECT 'D7' AS rule_code, 3 AS severity, 'liquidation:' || id || ':opening' AS event_key, id || '|opening' AS marks, id AS entity_id, abs(opening) AS amount_at_stake FROM l WHERE abs(opening) > 0.01",
    "SELECT 'D7', 3, 'liquidation:' || id || ':closing_vs_bank', id || '|closing_vs_bank', id, abs(closing) FROM l WHERE abs(closing) > 0.01",
    "SELECT 'D7', 3, 'liquidation:' || id || ':funds_held', id || '|held', id, saldo_en_poder_administrador FROM l WHERE saldo_en_poder_administrador > 0",
    "SELECT 'D7', 3, 'year:' || y || ':control_totals', 'control_totals|' || y, community_id, abs(gap) FROM w WHERE pm > 0 AND abs(gap) > pm",
), double="amount_at_stake")
def rule_d7_continuity(spark, d):
    return _hits(spark, d, "D7")


_ONE_PERCENT = "abs(o.v - x.amount) <= greatest(o.v, x.amount) * 0.01"


@bound(with_tables("subsidies", "liquidation_lines", "bank_transactions") + f""",
x AS (SELECT *, import_pagat AS amount FROM t_subsidies WHERE import_pagat > 0),
o AS (SELECT community_id, importe AS v FROM t_liquidation_lines WHERE side = 'ingreso' AND importe > 0 UNION SELECT community_id, importe FROM t_bank_transactions WHERE importe > 0)
""" + _sql(
    f"SELECT 'D8' AS rule_code, 4 AS severity, 'subsidy:' || id || ':pass_through' AS event_key, id || '|not_in_accounts' AS marks, id AS entity_id, amount AS amount_at_stake FROM x WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.community_id = x.community_id AND {_ONE_PERCENT})",
    "SELECT 'D8', 4, 'subsidy:' || id || ':destination', id || '|destination', id, amount FROM x WHERE NOT paid_to_is_community",
), double="amount_at_stake")
def rule_d8_subsidies(spark, d):
    return _hits(spark, d, "D8")


@bound(with_tables("loans", "bank_transactions") + """,
x AS (SELECT *, principal AS amount FROM t_loans), o AS (SELECT community_id, importe AS v FROM t_bank_transactions WHERE importe > 0)
""" + _sql(f"SELECT 'D11' AS rule_code, 4 AS severity, 'loan:' || id || ':disbursement' AS event_key, id || '|disbursement' AS marks, id AS entity_id, principal AS amount_at_stake FROM x WHERE NOT paid_to_is_community OR NOT EXISTS (SELECT 1 FROM o WHERE o.community_id = x.community_id AND {_ONE_PERCENT})"), double="amount_at_stake")
def rule_d11_loans(spark, d):
    return _hits(spark, d, "D11")


@bound(with_tables("invoices", "documents", "recon_links", "contracts", "parameters") + _KEPT + f""",
i AS (SELECT *, coalesce({parameter_sql("k", "authority_threshold", "k.fecha_expedicion")}, 1000) AS least FROM kept k)
""" + _sql("""SELECT 'E1' AS rule_code, 2 AS severity, 'invoice:' || id || ':authority' AS event_key, 'R4|' || id AS marks, id AS entity_id, total AS amount_at_stake FROM i WHERE total > least
AND NOT EXISTS (SELECT 1 FROM t_recon_links r WHERE r.from_id = i.id AND from_type = 'invoice' AND link_type = 'authorised_by' AND status = 'accepted')
AND NOT EXISTS (SELECT 1 FROM t_recon_links r JOIN t_contracts c ON c.id = r.to_id WHERE r.from_id = i.id AND to_type = 'contract' AND link_type = 'under_contract' AND r.status = 'accepted' AND authorised_by_resolution_id IS NOT NULL)"""), double="amount_at_stake")
def rule_e1_authority(spark, d):
    return _hits(spark, d, "E1")


@bound(with_tables("works_events") + """,
f AS (SELECT works_package_id AS w, event_type AS k, min(event_date) AS day FROM t_works_events GROUP BY ALL)
""" + _sql("SELECT 'E2' AS rule_code, 2 AS severity, 'works_package:' || a.w || ':final_certification:certification:' || a.day AS event_key, a.w || '|final_certification|certification||' || a.day AS marks, a.w AS entity_id, NULL::DECIMAL(14,2) AS amount_at_stake FROM f a JOIN f b ON b.w = a.w WHERE a.k = 'final_certification' AND b.k = 'certification' AND a.day < b.day"), double="amount_at_stake")
def rule_e2_sequence(spark, d):
    return _hits(spark, d, "E2")


@bound(_COVERED + ", g AS (SELECT DISTINCT bank_account_id AS a FROM v WHERE NOT covered) " + _sql("SELECT 'E5' AS rule_code, 2 AS severity, 'bank_account:' || a || ':statements' AS event_key, a || '|statements' AS marks, a AS entity_id, NULL::DECIMAL(14,2) AS amount_at_stake FROM g"), double="amount_at_stake")
def rule_e5_documents_withheld(spark, d):
    return _hits(spark, d, "E5")


@bound(with_tables("meetings", "resolutions") + _sql(f"SELECT 'E7' AS rule_code, 1 AS severity, 'resolution:' || r.id || ':challenge' AS event_key, r.id AS marks, r.id AS entity_id, importe_aprobado AS amount_at_stake FROM t_resolutions r JOIN t_meetings m ON m.id = r.meeting_id WHERE (coalesce(fecha_notificacion, fecha) + INTERVAL 12 MONTH)::DATE >= {_TODAY}"), double="amount_at_stake")
def rule_e7_open_challenges(spark, d):
    return _hits(spark, d, "E7")


@bound(with_tables("invoices", "documents") + _KEPT + """,
s AS (SELECT community_id AS c, vendor_party_id AS p, sum(total) AS v FROM kept WHERE works_package_id IS NULL GROUP BY ALL), t AS (SELECT *, sum(v) OVER (PARTITION BY c) AS a, row_number() OVER (PARTITION BY c ORDER BY v DESC, p DESC) AS n FROM s)
""" + _sql("SELECT 'B8' AS rule_code, 1 AS severity, 'community:' || c || ':vendor_concentration_ordinary' AS event_key, c || '|' || p AS marks, p AS entity_id, v AS amount_at_stake FROM t WHERE n = 1 AND v > a * 0.6"), double="amount_at_stake")
def rule_b8_concentration(spark, d):
    return _hits(spark, d, "B8")


@bound(with_tables("invoices", "documents") + _KEPT + """,
g AS (SELECT community_id, vendor_party_id AS p, year(fecha_expedicion) AS y, count(*) AS k, min(numero::BIGINT) AS a, max(numero::BIGINT) AS b, max(fecha_expedicion) - min(fecha_expedicion) AS d, sum(total) AS t FROM kept GROUP BY ALL)
""" + _sql(
    "SELECT 'B9' AS rule_code, 2 AS severity, 'party:' || p || ':implied_volume:' || y AS event_key, p || '|implied|' || y AS marks, p AS entity_id, t AS amount_at_stake FROM g WHERE k >= 2 AND b > a AND d > 0 AND t > 10000 AND (b - a)::DOUBLE / d * 365 < 30",
    "SELECT 'B9', 1, 'party:' || p || ':first_number:' || y, p || '|first_number|' || y, p, t FROM g WHERE a <= 10",
), double="amount_at_stake")
def rule_b9_implied_volume(spark, d):
    return _hits(spark, d, "B9")


@bound(with_tables("communities") + _sql("SELECT 'G7' AS rule_code, 1 AS severity, 'community:' || id || ':ite' AS event_key, id || '|ite' AS marks, id AS entity_id, NULL::DECIMAL(14,2) AS amount_at_stake FROM t_communities"), double="amount_at_stake")
def rule_g7_building_inspection(spark, d):
    return _hits(spark, d, "G7")


@bound(with_tables("communities", "works_packages", "invoices", "documents", "derramas", "derrama_ledger", "subsidies", "loans", "bank_transactions", "parameters") + _KEPT + """,
i AS (SELECT works_package_id AS id, sum(total) AS v FROM kept GROUP BY 1), v AS (SELECT works_package_id AS id, sum(paid) AS p, sum(expected) AS e FROM t_derrama_ledger g JOIN t_derramas v ON v.id = g.derrama_id GROUP BY 1),
s AS (SELECT works_package_id AS id, sum(import_pagat) AS v FROM t_subsidies WHERE paid_to_is_community GROUP BY 1), o AS (SELECT works_package_id AS id, sum(principal) AS v FROM t_loans WHERE paid_to_is_community GROUP BY 1),
q AS (SELECT DISTINCT community_id FROM t_bank_transactions WHERE tx_kind = 'quota_in'),
w AS (SELECT w.community_id, greatest(coalesce(contract_price, 0), coalesce(i.v, 0)) AS c, CASE WHEN q.community_id IS NOT NULL THEN coalesce(p, 0) ELSE greatest(coalesce(p, 0), coalesce(e, 0)) END + coalesce(s.v, 0) + coalesce(o.v, 0) AS a
  FROM t_works_packages w LEFT JOIN i USING (id) LEFT JOIN v USING (id) LEFT JOIN s USING (id) LEFT JOIN o USING (id) LEFT JOIN q ON q.community_id = w.community_id),
g AS (SELECT community_id, sum(c) AS c, sum(a) AS a FROM w WHERE c > 0 GROUP BY 1)
""" + _sql("SELECT 'D0' AS rule_code, 3 AS severity, 'community:' || community_id || ':funding' AS event_key, community_id || '|overall' AS marks, community_id AS entity_id, c - a AS amount_at_stake FROM g WHERE c - a > greatest(5000, c * 0.1)"), double="amount_at_stake")
def rule_d0_funding_gap(spark, d):
    return _hits(spark, d, "D0")


@bound(with_tables("derrama_ledger") + """, g AS (SELECT derrama_id AS v, unit_id AS u, sum(expected) AS e, abs(sum(expected) - sum(paid)) AS off FROM t_derrama_ledger WHERE basis = 'bank' GROUP BY ALL)
""" + _sql("SELECT 'D5' AS rule_code, 3 AS severity, 'derrama:' || v || ':unit:' || u AS event_key, v || '|' || u AS marks, v AS entity_id, off AS amount_at_stake FROM g WHERE off > greatest(1000, e * 0.05)"), double="amount_at_stake")
def rule_d5_contributions(spark, d):
    return _hits(spark, d, "D5")


@bound(with_tables("liquidations", "meetings", "communities", "bank_accounts") + """,
l AS (SELECT l.*, coalesce((SELECT arg_max(presupuesto_aprobado, fecha) FROM t_meetings m WHERE m.community_id = l.community_id AND year(fecha) - 1 = ejercicio AND presupuesto_aprobado IS NOT NULL), ordinary_budget_default) AS b FROM t_liquidations l JOIN t_communities c ON c.id = l.community_id),
a AS (SELECT community_id AS c FROM t_bank_accounts GROUP BY 1 HAVING count(*) FILTER (WHERE purpose = 'reserve') = 0)
""" + _sql(
    "SELECT 'D6' AS rule_code, 1 AS severity, 'liquidation:' || id || ':reserve' AS event_key, id || '|minimum' AS marks, id AS entity_id, b * 0.05 - fondo_reserva_final AS amount_at_stake FROM l WHERE fondo_reserva_final < b * 0.05",
    "SELECT 'D7', 3, 'liquidation:' || id || ':funds_held', id || '|held', id, saldo_en_poder_administrador FROM l WHERE saldo_en_poder_administrador > 0",
    "SELECT 'D6', 2, 'community:' || c || ':reserve_account', c || '|no_reserve_account', c, NULL FROM a",
), double="amount_at_stake")
def rule_d6_reserve_fund(spark, d):
    return _hits(spark, d, "D6")


@bound(with_tables("meetings", "resolutions") + _sql("""SELECT 'E3' AS rule_code, 2 AS severity, 'meeting:' || id || ':accounts_item' AS event_key, id || '|accounts_item' AS marks, id AS entity_id, NULL::DECIMAL(14,2) AS amount_at_stake FROM t_meetings m
WHERE tipo = 'ordinaria' AND NOT coalesce(cuentas_aprobadas, false) AND NOT EXISTS (SELECT 1 FROM t_resolutions r WHERE r.meeting_id = m.id AND kind = 'accounts')"""), double="amount_at_stake")
def rule_e3_minutes(spark, d):
    return _hits(spark, d, "E3")


@bound(with_tables("meetings", "request_clock") + _sql(
    "SELECT 'E6' AS rule_code, 2 AS severity, 'meeting:' || id || ':notice' AS event_key, id || '|notice' AS marks, id AS entity_id, NULL::DECIMAL(14,2) AS amount_at_stake FROM t_meetings WHERE notice_days < 8",
    "SELECT 'E6', 1, 'meeting:' || id || ':signature', id || '|signed', id, NULL FROM t_meetings WHERE NOT signed_within_5d",
    "SELECT 'E6', 1, 'meeting:' || id || ':notification', id || '|sent', id, NULL FROM t_meetings WHERE NOT sent_within_10d",
    "SELECT 'E6', 1, 'request_clock:' || id || ':convocation', id || '|not_convened', id, NULL FROM t_request_clock WHERE request_date IS NOT NULL AND convocation_date IS NULL",
    "SELECT 'E6', 2, 'request_clock:' || id || ':notice', id || '|notice', id, NULL FROM t_request_clock WHERE request_date IS NOT NULL AND convocation_date IS NOT NULL AND notice_days < 8",
), double="amount_at_stake")
def rule_e6_formal_deadlines(spark, d):
    return _hits(spark, d, "E6")


@bound(with_tables("resolutions") + _sql("SELECT 'E8' AS rule_code, 2 AS severity, 'resolution:' || id || ':majority' AS event_key, id AS marks, id AS entity_id, importe_aprobado AS amount_at_stake FROM t_resolutions WHERE resultado = 'aprobado' AND kind = 'works_approval' AND (coalesce(votes_for * 2 <= owners_total, false) OR coalesce(quotas_for <= 50, false))"), double="amount_at_stake")
def rule_e8_double_majority(spark, d):
    return _hits(spark, d, "E8")


@bound(with_tables("parties", "invoices", "documents") + _KEPT + """,
i AS (SELECT vendor_party_id AS id, min(fecha_expedicion) AS f, sum(total) FILTER (WHERE works_package_id IS NOT NULL) AS w FROM kept GROUP BY 1), v AS (SELECT p.*, f, w, (f - incorporated_on) / 30.4375 AS m FROM t_parties p JOIN i USING (id))
""" + _sql(
    "SELECT 'B1' AS rule_code, CASE WHEN m < 6 THEN 3 ELSE 2 END AS severity, 'party:' || id || ':company_age' AS event_key, id || '|age|' || incorporated_on || '|' || f AS marks, id AS entity_id, NULL::DECIMAL(14,2) AS amount_at_stake FROM v WHERE m >= 0 AND m < 12",
    "SELECT 'B1', 2, 'party:' || id || ':capital_vs_works', id || '|capital|' || capital::VARCHAR, id, w FROM v WHERE capital <= 3000 AND w > 20000",
), double="amount_at_stake")
def rule_b1_company_age(spark, d):
    return _hits(spark, d, "B1")


@bound(with_tables("party_links", "parties", "communities") + """,
a AS (SELECT id, community_id, upper(address) AS k, count(*) OVER (PARTITION BY community_id, address) AS n FROM t_parties)
""" + _sql(
    "SELECT 'B2' AS rule_code, CASE WHEN points >= 80 THEN 3 WHEN points >= 40 THEN 2 ELSE 1 END AS severity, 'party:' || party_id || ':address_link:' || role AS event_key, party_id || '|' || role || '|' || signal AS marks, party_id AS entity_id, NULL::DECIMAL(14,2) AS amount_at_stake FROM t_party_links WHERE status <> 'rejected' AND signal IN ('S5', 'S6')",
    "SELECT 'B2', CASE WHEN n >= 5 THEN 1 ELSE 2 END, 'party:' || id || ':address_shared', id || '|shared|' || k, id, NULL FROM a WHERE n > 1",
), double="amount_at_stake")
def rule_b2_addresses(spark, d):
    return _hits(spark, d, "B2")


@bound(with_tables("party_links") + _sql("""SELECT 'B3' AS rule_code, CASE WHEN signal IN ('S1', 'S2') THEN 4 WHEN signal = 'S4' THEN CASE WHEN points >= 10 THEN 3 ELSE 1 END WHEN points >= 40 THEN 4 WHEN points >= 25 THEN 3 WHEN points >= 10 THEN 2 ELSE 1 END AS severity,
'party:' || party_id || ':name_link:' || role AS event_key, party_id || '|' || role || '|' || signal AS marks, party_id AS entity_id, NULL::DECIMAL(14,2) AS amount_at_stake FROM t_party_links WHERE status <> 'rejected' AND signal IN ('S1', 'S2', 'S3', 'S4')"""), double="amount_at_stake")
def rule_b3_name_links(spark, d):
    return _hits(spark, d, "B3")


@bound(with_tables("external_checks") + """, c AS (SELECT *, row_number() OVER (PARTITION BY community_id, party_id ORDER BY fetched_at DESC, status DESC) AS n FROM t_external_checks WHERE check_type = 'aeat_census')
""" + _sql("SELECT 'B10' AS rule_code, 3 AS severity, 'party:' || party_id || ':aeat_identity' AS event_key, party_id || '|aeat_identity' AS marks, party_id AS entity_id, NULL::DECIMAL(14,2) AS amount_at_stake FROM c WHERE n = 1 AND status = 'ok' AND NOT matched"), double="amount_at_stake")
def rule_b10_census(spark, d):
    return _hits(spark, d, "B10")


@bound(with_tables("quotes") + """,
k AS (SELECT community_id, works_package_id AS w, vendor_party_id AS p, unnest([{'k': 'producer', 'v': producer}, {'k': 'author', 'v': author}, {'k': 'phone', 'v': phone}]) AS x FROM t_quotes),
s AS (SELECT w, x.k AS kind FROM k WHERE x.v IS NOT NULL GROUP BY w, x.k, lower(x.v) HAVING count(DISTINCT p) > 1),
n AS (SELECT a.works_package_id AS w, 'sequential_numbers' AS kind FROM t_quotes a JOIN t_quotes b ON a.works_package_id = b.works_package_id AND a.vendor_party_id < b.vendor_party_id AND abs(a.number - b.number) <= 5),
g AS (SELECT w, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, count(DISTINCT kind) AS c, bool_or(kind = 'sequential_numbers') AS q FROM (SELECT * FROM s UNION ALL SELECT * FROM n) GROUP BY 1)
""" + _sql("SELECT 'A10' AS rule_code, CASE WHEN c >= 2 OR q THEN 3 ELSE 2 END AS severity, 'works_package:' || w || ':quote_fingerprints' AS event_key, w || '|' || kinds AS marks, w AS entity_id, NULL::DECIMAL(14,2) AS amount_at_stake FROM g"), double="amount_at_stake")
def rule_a10_quote_fingerprints(spark, d):
    return _hits(spark, d, "A10")


@bound(with_tables("communities", "invoices", "parties") + """, g AS (SELECT i.community_id AS c FROM t_invoices i JOIN t_parties p ON p.id = i.vendor_party_id GROUP BY 1 HAVING bool_or(nif_kind = 'DNI') OR max(coalesce(retention_amount, 0)) > 0)
""" + _sql("SELECT 'G2' AS rule_code, 1 AS severity, 'community:' || c || ':tax_filings_absent' AS event_key, c || '|filings' AS marks, c AS entity_id, NULL::DECIMAL(14,2) AS amount_at_stake FROM g"), double="amount_at_stake")
def rule_g2_tax_filings(spark, d):
    return _hits(spark, d, "G2")


@bound(with_tables("invoices") + """, g AS (SELECT community_id AS c, bool_or(category_code = 'ELEV_MAINT') AS kept FROM t_invoices WHERE category_code IN ('ELEV_MAINT', 'ELEV_INSTALL') GROUP BY 1)
""" + _sql(
    "SELECT 'G5' AS rule_code, 1 AS severity, 'community:' || c || ':lift_ce_declaration' AS event_key, c || '|ce' AS marks, c AS entity_id, NULL::DECIMAL(14,2) AS amount_at_stake FROM g",
    "SELECT 'G5', 1, 'community:' || c || ':lift_oca_inspection', c || '|oca', c, NULL FROM g WHERE kept",
), double="amount_at_stake")
def rule_g5_lifts(spark, d):
    return _hits(spark, d, "G5")


@bound(with_tables("invoices") + """, g AS (SELECT community_id AS c, count(DISTINCT vendor_party_id) FILTER (WHERE works_package_id IS NOT NULL) AS n, bool_or(category_code = 'CAE_PRL') AS bill FROM t_invoices GROUP BY 1)
""" + _sql("SELECT 'G6' AS rule_code, CASE WHEN n > 1 THEN 2 ELSE 1 END AS severity, 'community:' || c || ':hs_coordination_documents' AS event_key, c || '|coordination' AS marks, c AS entity_id, NULL::DECIMAL(14,2) AS amount_at_stake FROM g WHERE bill"), double="amount_at_stake")
def rule_g6_safety_coordination(spark, d):
    return _hits(spark, d, "G6")


# ---- reconciliation steps


def _links(rows):
    return rows.select("from_type", "from_id", "to_type", "to_id", "link_type", "method", "score", "status", "amount_matched")


@bound(with_tables("invoices", "documents", "contracts") + _KEPT + """,
m AS (SELECT i.id AS i, k.id AS k, CASE WHEN k.works_package_id = i.works_package_id THEN 0.8 WHEN k.works_package_id IS NULL OR i.works_package_id IS NULL THEN 0.6 END AS s FROM kept i JOIN t_contracts k ON k.community_id = i.community_id AND k.vendor_party_id = i.vendor_party_id)
SELECT 'invoice' AS from_type, i AS from_id, 'contract' AS to_type, arg_max(k, (s, k)) AS to_id, 'under_contract' AS link_type, 'vendor' AS method, max(s)::DOUBLE AS score, 'proposed' AS status, NULL::DOUBLE AS amount_matched FROM m WHERE s IS NOT NULL GROUP BY i""", double="amount_matched")
def match_under_contract(spark, d):
    return _links(match.under_contract(tables(spark, d)))


@bound(with_tables("invoices", "documents", "resolutions", "meetings") + _KEPT + """,
m AS (SELECT i.id AS i, r.id AS r, fecha, CASE WHEN r.works_package_id = i.works_package_id THEN 0.9 ELSE 0.7 END AS s FROM kept i JOIN t_resolutions r ON r.community_id = i.community_id JOIN t_meetings g ON g.id = r.meeting_id
 WHERE r.kind IN ('works_approval', 'contractor_choice', 'derrama', 'budget') AND fecha <= fecha_expedicion + 15 AND (r.works_package_id = i.works_package_id OR r.vendor_party_id = i.vendor_party_id)
 AND (r.works_package_id IS NULL OR i.works_package_id IS NULL OR r.works_package_id = i.works_package_id) AND (importe_aprobado IS NULL OR total <= importe_aprobado)),
t AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY s DESC, fecha DESC, r DESC) AS n FROM m)
SELECT 'invoice' AS from_type, i AS from_id, 'resolution' AS to_type, r AS to_id, 'authorised_by' AS link_type, 'date_package' AS method, s::DOUBLE AS score, 'proposed' AS status, NULL::DOUBLE AS amount_matched FROM t WHERE n = 1""", double="amount_matched")
def match_authorisations(spark, d):
    return _links(match.authorisations(tables(spark, d)))


@bound(with_tables("bank_transactions", "payer_keys") + "SELECT b.id, k.unit_id FROM t_bank_transactions b JOIN t_payer_keys k ON k.iban_hmac = b.counterparty_iban_hmac WHERE importe > 0")
def match_attributed_credits(spark, d):
    return match.attributed_credits(tables(spark, d)).select("id", "unit_id")


_LEDGER = with_tables("bank_transactions", "payer_keys", "derrama_ledger") + """,
c AS (SELECT b.id, k.unit_id AS u, date_trunc('month', fecha_operacion)::DATE AS m, importe FROM t_bank_transactions b JOIN t_payer_keys k ON k.iban_hmac = b.counterparty_iban_hmac WHERE importe > 0),
n AS (SELECT c.id, c.importe, g.id AS g, row_number() OVER (PARTITION BY c.id ORDER BY abs(g.expected - c.importe), g.id) AS n FROM c JOIN t_derrama_ledger g ON g.unit_id = c.u AND g.period = c.m),
p AS (SELECT g, sum(importe) AS paid FROM n WHERE n = 1 GROUP BY 1), k AS (SELECT DISTINCT u FROM c),
r AS (SELECT l.id, l.basis, l.unit_id, l.expected, l.paid AS was, l.status AS state, coalesce(p.paid, 0) AS paid, k.u IS NOT NULL AS known FROM t_derrama_ledger l LEFT JOIN p ON p.g = l.id LEFT JOIN k ON k.u = l.unit_id)
"""


@bound(_LEDGER + """SELECT id, CASE WHEN known THEN paid ELSE was END AS paid, CASE WHEN NOT known THEN state WHEN paid <= 0 THEN CASE WHEN expected > 0 THEN 'missing' ELSE 'paid' END WHEN abs(paid - expected) <= 0.01 THEN 'paid' WHEN paid > expected THEN 'excess' ELSE 'partial' END AS status,
 CASE WHEN known THEN 'bank' ELSE basis END AS basis FROM r""", double="paid")
def match_ledger(spark, d):
    return match.ledger(tables(spark, d)).select("id", "paid", "status", "basis")


@bound(with_tables("subsidies", "loans", "bank_transactions") + """,
o AS (SELECT 'subsidy' AS kind, community_id AS c, id, import_pagat AS v FROM t_subsidies UNION ALL SELECT 'loan', community_id, id, principal FROM t_loans),
m AS (SELECT kind, o.id, b.id AS t, importe, row_number() OVER (PARTITION BY kind, o.id ORDER BY fecha_operacion, b.id) AS n FROM o JOIN t_bank_transactions b ON b.community_id = o.c AND importe > 0 WHERE v > 0 AND abs(v - importe) <= greatest(v, importe) * 0.01)
SELECT kind AS from_type, id AS from_id, 'bank_transaction' AS to_type, t AS to_id, 'funds' AS link_type, 'amount' AS method, 0.8::DOUBLE AS score, 'proposed' AS status, importe AS amount_matched FROM m WHERE n = 1""", double="amount_matched")
def match_external_funds(spark, d):
    return _links(match.external_funds(tables(spark, d)))


@bound(with_tables("bank_transactions") + """,
m AS (SELECT a.id AS t, b.id AS z, b.importe AS v FROM t_bank_transactions a JOIN t_bank_transactions b ON a.community_id = b.community_id AND a.counterparty_iban_hmac = b.counterparty_iban_hmac AND a.importe = -b.importe AND a.importe < 0 WHERE b.fecha_operacion - a.fecha_operacion BETWEEN 0 AND 90)
SELECT 'bank_transaction' AS from_type, z AS from_id, 'bank_transaction' AS to_type, t AS to_id, 'refunds' AS link_type, 'account_amount' AS method, 0.95::DOUBLE AS score, 'accepted' AS status, v AS amount_matched FROM m""", double="amount_matched")
def match_refunds(spark, d):
    return _links(match.refunds(tables(spark, d)))


@bound(with_tables("invoices", "documents", "bank_transactions") + _KEPT + """,
u AS (SELECT i.*, unnest(list_distinct(list_filter([total, total - CASE WHEN retention_amount > 0 THEN retention_amount END], lambda x: x IS NOT NULL))) AS due FROM kept i)
SELECT u.id AS invoice_id, b.id AS tx_id, due, coalesce(b.counterparty_iban_hmac = 'h' || substr(u.vendor_party_id, 2), false) AS iban_match, contains(upper(replace(b.concepto_text, ' ', '')), serie || numero) OR contains(b.concepto_text, numero) AS reference_match,
 abs(b.fecha_operacion - u.fecha_expedicion)::INTEGER AS days FROM u JOIN t_bank_transactions b ON b.community_id = u.community_id AND b.importe < 0 AND b.tx_kind <> 'internal' AND abs(due + b.importe) <= 0.01 AND b.fecha_operacion - u.fecha_expedicion BETWEEN -5 AND 120""", double="due")
def match_payment_candidates(spark, d):
    return match.payment_candidates(tables(spark, d)).select("invoice_id", "tx_id", "due", "iban_match", "reference_match", "days")


@bound(with_tables("resolutions", "meetings", "contracts", "permits", "invoices", "documents", "subsidies", "loans", "works_packages", "works_events", "recon_links", "bank_transactions") + _KEPT + """,
e AS (SELECT works_package_id AS w, 'acta_approval' AS k, fecha AS day, importe_aprobado AS v, r.id FROM t_resolutions r JOIN t_meetings m ON m.id = r.meeting_id WHERE kind = 'works_approval'
 UNION ALL SELECT works_package_id, 'contract_signed', fecha_firma, precio_con_iva, id FROM t_contracts UNION ALL SELECT works_package_id, 'permit_filed', filed_on, NULL, id FROM t_permits UNION ALL SELECT works_package_id, 'permit_granted', granted_on, NULL, id FROM t_permits
 UNION ALL SELECT works_package_id, 'invoice', fecha_expedicion, total, id FROM kept UNION ALL SELECT works_package_id, 'subsidy_payment', paid_on, import_pagat, id FROM t_subsidies UNION ALL SELECT works_package_id, 'loan_disbursement', signed_on, principal, id FROM t_loans
 UNION ALL SELECT id, 'suspension', suspension_date, NULL, id FROM t_works_packages UNION ALL SELECT works_package_id, event_type, event_date, amount, NULL FROM t_works_events WHERE event_type IN ('quote_received', 'certification', 'final_certification')
 UNION ALL SELECT i.works_package_id, 'payment', b.fecha_operacion, -b.importe, b.id FROM t_recon_links l JOIN t_invoices i ON i.id = l.from_id JOIN t_bank_transactions b ON b.id = l.to_id WHERE link_type = 'paid_by' AND from_type = 'invoice')
SELECT w AS works_package_id, k AS event_type, day AS event_date, v AS amount, id AS ref_id FROM e WHERE w IS NOT NULL AND day IS NOT NULL""", double="amount", text="event_date")
def match_timeline(spark, d):
    return match.timeline(tables(spark, d)).select("works_package_id", "event_type", "event_date", "amount", "ref_id")


@bound(with_tables("contract_milestones", "recon_links", "invoices") + """,
p AS (SELECT from_id AS i, sum(amount_matched) AS p FROM t_recon_links WHERE link_type = 'paid_by' GROUP BY 1),
s AS (SELECT m.id, max(i.total) AS t, max(p.p) AS p FROM t_contract_milestones m JOIN t_recon_links l ON l.to_id = m.contract_id AND l.link_type = 'under_contract' JOIN t_invoices i ON i.id = l.from_id LEFT JOIN p ON p.i = i.id WHERE abs(m.importe - i.total) <= greatest(abs(m.importe), abs(i.total)) * 0.01 GROUP BY 1)
SELECT m.id, CASE WHEN importe > 0 AND p > importe * 1.01 THEN 'overpaid' WHEN p > 0 THEN 'paid' WHEN t > 0 THEN 'invoiced' ELSE status END AS status FROM t_contract_milestones m LEFT JOIN s USING (id)""")
def match_milestones(spark, d):
    t = tables(spark, d)
    links = t["recon_links"]
    return match.milestone_status(t, links.where("link_type = 'paid_by'"), links.where("link_type = 'under_contract'")).select("id", "status")


@bound(with_tables("bank_transactions") + """,
g AS (SELECT community_id AS c, concepto_text AS k FROM t_bank_transactions WHERE tx_kind = 'direct_debit' AND importe < 0 GROUP BY ALL HAVING count(*) >= 3 AND min(abs(importe)) >= median(abs(importe)) * 0.7 AND max(abs(importe)) <= median(abs(importe)) * 1.3)
SELECT id, CASE WHEN tx_kind = 'direct_debit' AND importe < 0 AND EXISTS (SELECT 1 FROM g WHERE g.c = b.community_id AND g.k = b.concepto_text) THEN 'direct_debit_recurring' ELSE tx_kind END AS tx_kind FROM t_bank_transactions b""")
def match_promote_recurring(spark, d):
    return match.promote_recurring(tables(spark, d)).select("id", "tx_kind")


@bound("SELECT concat('s', s_suppkey) AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'municipal_payee' ELSE '' END AS flags FROM supplier")
def match_municipal_payees(spark, d):
    names = F.when(F.expr("int(substr(id, 2)) % 3 = 0"), F.concat(F.lit("Ajuntament de "), "display_name")).otherwise(F.col("display_name"))
    rows = tables(spark, d)["parties"].select("id", names.alias("counterparty_name"), F.lit("pago").alias("concepto_text"), F.lit(None).cast("array<string>").alias("flags"))
    return match.flag_municipal(rows).select("id", F.array_join("flags", ",").alias("flags"))
