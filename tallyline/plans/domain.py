"""The domain tables made from the driver's tables, in SQL that Spark and DuckDB read alike.

Nations are communities, suppliers are vendors with a works package, a contract and a resolution each, orders are invoices
with their documents and payments, line items are lines of the yearly accounts, customers are units.
TABLES holds one SELECT a table; columns of the schema that it doesn't name are null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.plans.schemas import SCHEMAS, Tables

#: An order with its nation and its first supplier.
_ORDER = (
    "(SELECT o_orderkey AS k, o_custkey AS u, c_nationkey AS n, coalesce(s, 1) AS s, CAST(o_orderdate AS DATE) AS d, CAST(o_totalprice AS DECIMAL(14,2)) AS v"
    " FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN (SELECT l_orderkey, min(l_suppkey) AS s FROM lineitem GROUP BY l_orderkey) f ON l_orderkey = o_orderkey) o"
)
_YEARS = f"(SELECT DISTINCT n, year(d) AS y FROM {_ORDER}) y"

TABLES = {
    "communities": "SELECT concat('c', n_nationkey) AS id, n_name AS name, CASE WHEN n_nationkey % 5 = 0 THEN 4 ELSE 1 END AS fy_start_month, CAST(100000 AS DECIMAL(14,2)) AS ordinary_budget_default FROM nation",
    "parameters": "SELECT concat('c', n_nationkey) AS community_id, key, CAST(value_num + n_nationkey * 10 AS DECIMAL(38,10)) AS value_num, version, CAST(valid_from AS DATE) AS valid_from FROM nation CROSS JOIN"
    " (SELECT 'outflow_min' AS key, 60000 AS value_num, 1 AS version, '1990-01-01' AS valid_from UNION ALL SELECT 'outflow_min', 120000, 2, '1996-01-01' UNION ALL SELECT 'outflow_min', 90000, 2, '1997-06-01'"
    " UNION ALL SELECT 'authority_threshold', 150000, 1, '1994-01-01' UNION ALL SELECT 'pm_ordinary', 500, 1, '1993-01-01') p WHERE n_nationkey % 4 <> 3",
    "units": "SELECT concat('u', c_custkey) AS id, concat('c', c_nationkey) AS community_id, c_name AS label, CAST(c_custkey % 7 + 1 AS DECIMAL(7,4)) AS quota FROM customer",
    "parties": "SELECT concat('s', s_suppkey) AS id, concat('c', s_nationkey) AS community_id, 'vendor' AS kind, s_name AS display_name, concat('B', lpad(concat('', s_suppkey), 8, '0')) AS nif, concat('street ', s_suppkey % 7) AS address, CASE WHEN s_suppkey % 5 = 0 THEN 'DNI' ELSE 'CIF' END AS nif_kind, CAST(s_suppkey % 40 * 200 AS DECIMAL(14,2)) AS capital, CAST(DATE '1992-01-01' - CAST(s_suppkey % 11 * 60 AS INT) AS DATE) AS incorporated_on FROM supplier",
    "party_ibans": "SELECT concat('s', s_suppkey) AS party_id, concat('h', s_suppkey) AS iban_hmac FROM supplier",
    "documents": f"SELECT concat('d', k) AS id, concat('c', n) AS community_id, 'factura' AS doc_type, d AS doc_date, CASE WHEN k % 19 = 0 THEN concat('d', k - 1) END AS duplicate_of_document_id FROM {_ORDER}",
    "invoices": f"SELECT concat('i', k) AS id, concat('c', n) AS community_id, concat('d', k) AS document_id, concat('s', s) AS vendor_party_id, concat('F', k % 10) AS serie, concat('', 1000 + k) AS numero, d AS fecha_expedicion, v AS total,"
    f" CASE WHEN k % 4 = 0 THEN CAST(100 + u % 50 AS DECIMAL(14,2)) END AS retention_amount, CASE WHEN k % 2 = 0 THEN concat('w', s) END AS works_package_id, k % 10 = 0 AS is_extra, CASE WHEN k % 23 = 0 THEN 'cash' ELSE 'transfer' END AS forma_pago, CASE (k + n) % 400 WHEN 0 THEN 'ELEV_MAINT' WHEN 1 THEN 'ELEV_INSTALL' WHEN 2 THEN 'CAE_PRL' END AS category_code FROM {_ORDER}",
    "bank_transactions": f"SELECT concat('t', k) AS id, concat('c', n) AS community_id, concat('a', n) AS bank_account_id, CAST(d + CAST(k % 60 AS INT) AS DATE) AS fecha_operacion,"
    " CASE WHEN k % 4 = 0 AND k % 8 <> 0 THEN CAST(100 + u % 50 AS DECIMAL(14,2)) - v ELSE -v END AS importe, concat('pago F', k % 10, 1000 + k) AS concepto_text, concat('h', CASE WHEN k % 2 = 0 THEN s ELSE s + 1 END) AS counterparty_iban_hmac,"
    f" CASE k % 7 WHEN 0 THEN 'direct_debit' WHEN 1 THEN 'fee' WHEN 2 THEN 'internal' ELSE 'transfer_out' END AS tx_kind FROM {_ORDER} WHERE k % 3 <> 0"
    " UNION ALL SELECT concat('q', k), concat('c', n), concat('a', n), CAST(d + CAST(k % 9 AS INT) AS DATE), CAST(u % 500 + 50 AS DECIMAL(14,2)), 'cuota', concat('p', u),"
    f" CASE k % 3 WHEN 0 THEN 'quota_in' WHEN 1 THEN 'subsidy' ELSE 'loan' END FROM {_ORDER} WHERE k % 5 = 0"
    " UNION ALL SELECT concat('z', k), concat('c', n), concat('a', n), CAST(d + CAST(k % 60 + k % 120 AS INT) AS DATE), CAST(v AS DECIMAL(14,2)), 'devolucion', concat('h', CASE WHEN k % 2 = 0 THEN s ELSE s + 1 END), 'refund'"
    f" FROM {_ORDER} WHERE k % 31 = 1 AND k % 3 <> 0",
    "bank_statements": f"SELECT concat('b', n, '-', y, '-', m) AS id, concat('c', n) AS community_id, concat('a', n) AS bank_account_id, 'csv' AS source, make_date(y, m, 1) AS periodo_desde, last_day(make_date(y, m, 1)) AS periodo_hasta, CAST(y + m AS DECIMAL(14,2)) AS saldo_final"
    f" FROM (SELECT DISTINCT n, CAST(year(d) AS INT) AS y, CAST(month(d) AS INT) AS m FROM {_ORDER}) x WHERE (n + m) % 4 <> 0 OR m = 12",
    "liquidations": f"SELECT concat('l', n, '-', y) AS id, concat('c', n) AS community_id, CAST(y AS INT) AS ejercicio, CASE WHEN n % 2 = 0 THEN 'cash' ELSE 'accrual' END AS basis, make_date(CAST(y AS INT), 12, 31) AS periodo_hasta, CAST(n * 1000 + y AS DECIMAL(14,2)) AS saldo_inicial,"
    f" CAST(n * 1000 + y + y % 3 AS DECIMAL(14,2)) AS saldo_final, CASE WHEN y % 3 <> 0 THEN CAST(n * 7 + y AS DECIMAL(14,2)) END AS acreedores_pendientes, CAST(n AS DECIMAL(14,2)) AS retenciones_pendientes, CAST(n * 300 + y - 1990 AS DECIMAL(14,2)) AS fondo_reserva_final, CASE WHEN n % 7 = 0 THEN CAST(10 AS DECIMAL(14,2)) END AS saldo_en_poder_administrador FROM {_YEARS} WHERE n % 6 <> 5",
    "liquidation_lines": "SELECT concat('x', l_orderkey, '-', l_linenumber) AS id, concat('c', s_nationkey) AS community_id, concat('l', s_nationkey, '-', year(l_shipdate)) AS liquidation_id, CASE WHEN l_returnflag = 'R' THEN 'ingreso' ELSE 'gasto' END AS side, 'line' AS concepto,"
    " s_name AS proveedor_text, concat('s', l_suppkey) AS party_id, CAST(l_extendedprice AS DECIMAL(14,2)) AS importe FROM lineitem JOIN supplier ON l_suppkey = s_suppkey",
    "meetings": f"SELECT concat('m', n, '-', y) AS id, concat('c', n) AS community_id, make_date(CAST(y AS INT), 6, 15) AS fecha, CASE WHEN (n + y) % 2 = 0 THEN make_date(CAST(y AS INT), 7, 31) END AS fecha_notificacion, CASE WHEN y % 2 = 0 THEN 'ordinaria' ELSE 'extraordinaria' END AS tipo, CAST(5 + (n + y) % 7 AS INT) AS notice_days, n % 3 <> 0 AS signed_within_5d, CASE WHEN n % 4 <> 1 THEN n % 4 <> 0 END AS sent_within_10d,"
    f" CASE WHEN n % 2 = 0 THEN CAST(60000 + y AS DECIMAL(14,2)) END AS presupuesto_aprobado, CASE WHEN n % 5 <> 1 THEN n % 5 = 0 END AS cuentas_aprobadas FROM {_YEARS}",
    "resolutions": "SELECT concat('r', s_suppkey) AS id, concat('c', s_nationkey) AS community_id, concat('m', s_nationkey, '-', 1993 + s_suppkey % 6) AS meeting_id, 'p' AS punto, CASE s_suppkey % 4 WHEN 0 THEN 'works_approval' WHEN 1 THEN 'contractor_choice' WHEN 2 THEN 'budget' ELSE 'election' END AS kind,"
    " CASE WHEN s_suppkey % 3 = 0 THEN concat('w', s_suppkey) END AS works_package_id, CASE WHEN s_suppkey % 3 <> 1 THEN concat('s', s_suppkey) END AS vendor_party_id, CASE WHEN s_suppkey % 5 <> 0 THEN CAST(200000 AS DECIMAL(14,2)) END AS importe_aprobado, CASE WHEN s_suppkey % 7 <> 0 THEN 'aprobado' ELSE 'rechazado' END AS resultado, CAST(s_suppkey % 9 AS INT) AS votes_for, CASE WHEN s_suppkey % 3 <> 0 THEN 10 END AS owners_total, CASE WHEN s_suppkey % 4 <> 3 THEN 40.0 + s_suppkey % 30 END AS quotas_for FROM supplier",
    "contracts": "SELECT concat('k', s_suppkey) AS id, concat('c', s_nationkey) AS community_id, 'works' AS kind, concat('s', s_suppkey) AS vendor_party_id, CASE WHEN s_suppkey % 2 = 0 THEN concat('w', s_suppkey) END AS works_package_id, DATE '1995-03-01' AS fecha_firma,"
    " CAST(50000 AS DECIMAL(14,2)) AS precio_con_iva, CASE WHEN s_suppkey % 4 = 1 THEN concat('r', s_suppkey) END AS authorised_by_resolution_id FROM supplier",
    "contract_milestones": "SELECT concat('g', s_suppkey, '-', m) AS id, concat('c', s_nationkey) AS community_id, concat('k', s_suppkey) AS contract_id, 'start' AS hito, CAST(m * 1000 AS DECIMAL(14,2)) AS importe, m = 1 AS is_advance,"
    " CASE (s_suppkey + m) % 4 WHEN 0 THEN 'paid_without_invoice' WHEN 1 THEN 'overpaid' WHEN 2 THEN 'paid' ELSE 'pending' END AS status FROM supplier CROSS JOIN (SELECT 1 AS m UNION ALL SELECT 2 UNION ALL SELECT 3) x",
    "works_packages": "SELECT concat('w', s_suppkey) AS id, concat('c', s_nationkey) AS community_id, concat('P', s_suppkey) AS code, 'open' AS status, CASE WHEN s_suppkey % 4 <> 0 THEN CAST(300000 + s_suppkey AS DECIMAL(14,2)) END AS contract_price, CASE WHEN s_suppkey % 3 = 0 THEN DATE '1996-06-01' END AS suspension_date FROM supplier",
    "works_events": "SELECT concat('e', l_orderkey, '-', l_linenumber) AS id, concat('w', l_suppkey) AS works_package_id, concat('c', s_nationkey) AS community_id, CASE l_linenumber WHEN 1 THEN 'certification' WHEN 2 THEN 'final_certification' WHEN 3 THEN 'quote_received' ELSE 'other' END AS event_type,"
    " CAST(l_shipdate AS DATE) AS event_date, CAST(l_extendedprice AS DECIMAL(14,2)) AS amount FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_orderkey % 3 = 0",
    "derramas": "SELECT concat('v', s_suppkey) AS id, concat('c', s_nationkey) AS community_id, concat('w', s_suppkey) AS works_package_id, CAST(12000 AS DECIMAL(14,2)) AS total FROM supplier",
    "derrama_ledger": "SELECT concat('y', c_custkey, '-', m) AS id, concat('c', c_nationkey) AS community_id, concat('v', c_custkey % 10 + 1) AS derrama_id, concat('u', c_custkey) AS unit_id, make_date(1995, m, 1) AS period, CAST(60 + c_custkey % 40 * 20 AS DECIMAL(14,2)) AS expected, CASE WHEN c_custkey % 3 = 0 THEN CAST(0 AS DECIMAL(14,2)) ELSE CAST(60 + c_custkey % 41 AS DECIMAL(14,2)) END AS paid,"
    " CASE c_custkey % 4 WHEN 0 THEN 'missing' WHEN 1 THEN 'partial' WHEN 2 THEN 'paid' ELSE 'excess' END AS status, CASE WHEN c_custkey % 2 = 0 THEN 'bank' ELSE 'assertion' END AS basis FROM customer CROSS JOIN (SELECT 1 AS m UNION ALL SELECT 2 UNION ALL SELECT 5) x",
    "loans": "SELECT concat('o', s_suppkey) AS id, concat('c', s_nationkey) AS community_id, concat('w', s_suppkey) AS works_package_id, CAST(s_suppkey % 500 + 50 AS DECIMAL(14,2)) AS principal, DATE '1995-05-05' AS signed_on, s_suppkey % 2 = 0 AS paid_to_is_community FROM supplier WHERE s_suppkey % 3 = 1",
    "subsidies": "SELECT concat('j', s_suppkey) AS id, concat('c', s_nationkey) AS community_id, concat('w', s_suppkey) AS works_package_id, CAST(s_suppkey % 450 + 60 AS DECIMAL(14,2)) AS import_pagat, DATE '1996-05-05' AS paid_on, s_suppkey % 3 = 0 AS paid_to_is_community FROM supplier WHERE s_suppkey % 2 = 1",
    "permits": "SELECT concat('f', s_suppkey) AS id, concat('c', s_nationkey) AS community_id, concat('w', s_suppkey) AS works_package_id, 'works' AS kind, DATE '1995-02-01' AS filed_on, CASE WHEN s_suppkey % 2 = 0 THEN DATE '1995-04-01' END AS granted_on FROM supplier WHERE s_suppkey % 5 <> 0",
    "recon_links": f"SELECT concat('c', n) AS community_id, 'invoice' AS from_type, concat('i', k) AS from_id, 'bank_transaction' AS to_type, concat('t', k) AS to_id, 'paid_by' AS link_type, 'iban' AS method, 1.0 AS score, CASE WHEN k % 11 = 0 THEN 'proposed' ELSE 'accepted' END AS status, v AS amount_matched FROM {_ORDER} WHERE k % 6 IN (1, 2)"
    f" UNION ALL SELECT concat('c', n), 'invoice', concat('i', k), 'resolution', concat('r', s), 'authorised_by', 'x', 0.9, CASE WHEN k % 5 = 0 THEN 'proposed' ELSE 'accepted' END, v FROM {_ORDER} WHERE k % 8 = 1"
    f" UNION ALL SELECT concat('c', n), 'invoice', concat('i', k), 'contract', concat('k', s), 'under_contract', 'x', 0.8, 'accepted', v FROM {_ORDER} WHERE k % 8 = 2"
    " UNION ALL SELECT concat('c', s_nationkey), 'invoice', concat('i', l_orderkey), 'liquidation_line', concat('x', l_orderkey, '-', l_linenumber), 'reported_as', 'x', 0.7, 'accepted', CAST(l_extendedprice AS DECIMAL(14,2)) FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_orderkey % 7 = 0",
    "document_requests": "SELECT concat('n', p_partkey) AS id, concat('c', p_partkey % 25) AS community_id, p_type AS class, CAST(1990 + p_size % 9 AS INT) AS fiscal_year, CASE WHEN p_size % 2 = 0 THEN 'received' ELSE 'asked' END AS status FROM part",
    "findings": f"SELECT concat('fi', k) AS id, concat('c', n) AS community_id, 'D1' AS rule_code, d AS act_date_first, CASE WHEN k % 4 <> 0 THEN d END AS act_date_last, concat('fp', k) AS fingerprint, v AS amount_at_stake FROM {_ORDER}",
    "bank_accounts": "SELECT concat('a', n_nationkey) AS id, concat('c', n_nationkey) AS community_id, CASE WHEN n_nationkey % 2 = 0 THEN 'reserve' ELSE 'operating' END AS purpose FROM nation WHERE n_nationkey % 9 <> 8",
    "request_clock": "SELECT concat('rc', p_partkey) AS id, concat('c', p_partkey % 25) AS community_id, CASE WHEN p_size % 5 <> 0 THEN DATE '1996-02-01' END AS request_date, CASE WHEN p_size % 3 <> 0 THEN DATE '1996-03-01' END AS convocation_date, CAST(p_size % 12 AS INT) AS notice_days FROM part",
    "quotes": "SELECT concat('qt', s_suppkey, '-', j) AS id, concat('c', s_nationkey) AS community_id, concat('w', s_suppkey) AS works_package_id, concat('s', s_suppkey + j) AS vendor_party_id, CAST(1000 * (j + 1) AS DECIMAL(14,2)) AS total, CAST(100 + j * (s_suppkey % 9) AS BIGINT) AS number,"
    " CASE WHEN s_suppkey % 3 = 0 THEN 'Writer' ELSE concat('tool ', j) END AS producer, CASE WHEN s_suppkey % 4 = 0 THEN 'J. Pou' END AS author, concat('93', j) AS phone FROM supplier CROSS JOIN (SELECT 0 AS j UNION ALL SELECT 1 UNION ALL SELECT 2) x WHERE s_suppkey % 5 <> 4",
    "external_checks": "SELECT concat('c', s_nationkey) AS community_id, concat('s', s_suppkey) AS party_id, CASE WHEN j = 2 THEN 'company_profile' ELSE 'aeat_census' END AS check_type, CASE WHEN s_suppkey % 5 = 4 THEN 'not_found' ELSE 'ok' END AS status, (s_suppkey + j) % 3 <> 0 AS matched, s_suppkey % 2 = 0 AS archived,"
    " CAST(CAST(DATE '1997-01-01' + CAST(j AS INT) AS DATE) AS TIMESTAMP) AS fetched_at FROM supplier CROSS JOIN (SELECT 0 AS j UNION ALL SELECT 1 UNION ALL SELECT 2) x",
    "party_links": "SELECT concat('c', s_nationkey) AS community_id, concat('s', s_suppkey) AS party_id, CASE WHEN j % 2 = 0 THEN 'president' ELSE 'administrator' END AS role, concat('S', j) AS signal, CAST(s_suppkey * j * 7 % 100 AS INT) AS points, CASE WHEN (s_suppkey + j) % 6 = 0 THEN 'rejected' ELSE 'proposed' END AS status"
    " FROM supplier CROSS JOIN (SELECT 1 AS j UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 8) x WHERE (s_suppkey + j) % 3 <> 0",
    "payer_keys": "SELECT concat('c', c_nationkey) AS community_id, concat('u', c_custkey) AS unit_id, concat('p', c_custkey) AS iban_hmac, 'unit' AS role FROM customer",
}


class DriverTables(Tables):
    """Domain tables as plans over the driver's tables, in the columns and types of their schemas, each made when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__(spark)
        self.sf_dir = sf_dir

    def __missing__(self, name: str) -> DataFrame:
        if name not in TABLES:
            return super().__missing__(name)
        sql, used = TABLES[name], {}
        for source in ("nation", "supplier", "customer", "orders", "lineitem", "part"):
            if source in sql:
                used[source] = self.spark.read.parquet(f"{self.sf_dir}/{source}.parquet")
                sql = sql.replace(f"FROM {source}", f"FROM {{{source}}}").replace(f"JOIN {source} ", f"JOIN {{{source}}} ")
        made = self.spark.sql(sql, **used)
        kinds = self.spark.createDataFrame([], SCHEMAS[name]).schema
        self[name] = made.select(*((F.col(f.name) if f.name in made.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds))
        return self[name]


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    return DriverTables(spark, sf_dir)


def with_tables(*names: str) -> str:
    """WITH clauses of the named tables for DuckDB, under the names t_<table>."""
    return "WITH " + ", ".join(f"t_{n} AS ({TABLES[n]})" for n in names)
