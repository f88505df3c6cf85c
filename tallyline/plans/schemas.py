"""Schemas of the domain tables that views, matching and rules read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

M = "decimal(14,2)"
SCHEMAS = {
    "communities": f"id string, name string, address string, fy_start_month int, ordinary_budget_default {M}",
    "parameters": "community_id string, key string, value_num decimal(38,10), version int, valid_from date",
    "units": "id string, community_id string, label string, quota decimal(7,4)",
    "parties": f"id string, community_id string, kind string, display_name string, legal_name_norm string, nif string, nif_kind string, address string, capital {M}, incorporated_on date, cnae string, trades array<string>",
    "party_ibans": "party_id string, iban_hmac string",
    "bank_accounts": "id string, community_id string, label string, purpose string",
    "bank_statements": f"id string, community_id string, bank_account_id string, source string, periodo_desde date, periodo_hasta date, saldo_inicial {M}, saldo_final {M}",
    "bank_transactions": f"id string, community_id string, bank_account_id string, statement_id string, fecha_operacion date, importe {M}, concepto_text string, counterparty_name string, counterparty_iban_hmac string, counterparty_country string, mandate_ref string, counterparty_party_id string, tx_kind string, flags array<string>",
    "documents": "id string, community_id string, doc_type string, doc_date date, works_package_id string, duplicate_of_document_id string",
    "invoices": f"id string, community_id string, document_id string, vendor_party_id string, serie string, numero string, fecha_expedicion date, total {M}, retention_amount {M}, retention_pct decimal(5,2), works_package_id string, category_code string, forma_pago string, is_extra boolean",
    "liquidations": f"id string, community_id string, ejercicio int, basis string, periodo_hasta date, saldo_inicial {M}, saldo_final {M}, fondo_reserva_final {M}, saldo_en_poder_administrador {M}, acreedores_pendientes {M}, retenciones_pendientes {M}",
    "liquidation_lines": f"id string, community_id string, liquidation_id string, side string, concepto string, proveedor_text string, party_id string, importe {M}",
    "meetings": f"id string, community_id string, tipo string, fecha date, fecha_notificacion date, notice_days int, signed_within_5d boolean, sent_within_10d boolean, presupuesto_aprobado {M}, cuentas_aprobadas boolean, attendees array<struct<unit:string,quota:double>>",
    "resolutions": f"id string, community_id string, meeting_id string, punto string, kind string, resultado string, works_package_id string, vendor_party_id string, importe_aprobado {M}, votes_for int, owners_total int, quotas_for double",
    "request_clock": "id string, community_id string, request_date date, convocation_date date, notice_days int",
    "document_requests": "id string, community_id string, class string, fiscal_year int, status string, requested_on date, received_on date, received_file_ids array<string>",
    "derramas": f"id string, community_id string, works_package_id string, total {M}, starts_on date, months int",
    "derrama_ledger": f"id string, community_id string, derrama_id string, unit_id string, period date, expected {M}, paid {M}, basis string, status string",
    "contracts": f"id string, community_id string, kind string, vendor_party_id string, works_package_id string, fecha_firma date, precio_con_iva {M}, authorised_by_resolution_id string",
    "contract_milestones": f"id string, community_id string, contract_id string, hito string, importe {M}, is_advance boolean, status string",
    "loans": f"id string, community_id string, works_package_id string, principal {M}, signed_on date, paid_to_is_community boolean, has_schedule boolean",
    "subsidies": f"id string, community_id string, works_package_id string, import_atorgat {M}, import_pagat {M}, paid_on date, paid_to_is_community boolean",
    "works_packages": f"id string, community_id string, code string, label string, status string, contract_price {M}, suspension_date date",
    "works_events": f"id string, community_id string, works_package_id string, event_type string, event_date date, amount {M}, ref_id string",
    "recon_links": f"community_id string, from_type string, from_id string, to_type string, to_id string, link_type string, method string, score double, status string, amount_matched {M}",
    "quotes": f"id string, community_id string, works_package_id string, vendor_party_id string, total {M}, number bigint, producer string, author string, phone string",
    "permits": "id string, community_id string, works_package_id string, kind string, filed_on date, granted_on date",
    "external_checks": "community_id string, party_id string, check_type string, status string, matched boolean, archived boolean, fetched_at timestamp",
    "party_links": "community_id string, party_id string, role string, signal string, points int, status string",
    "findings": f"id string, community_id string, rule_code string, act_date_first date, act_date_last date, fingerprint string, amount_at_stake {M}",
    "payer_keys": "community_id string, unit_id string, iban_hmac string, mandate_ref string, role string, valid_from date, valid_to date",
}


class Tables(dict):
    """Domain tables by name; one that isn't given is empty."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame] | None = None):
        super().__init__(tables or {})
        self.spark = spark

    def __missing__(self, name: str) -> DataFrame:
        self[name] = self.spark.createDataFrame([], SCHEMAS[name])
        return self[name]

    @classmethod
    def read(cls, spark: SparkSession, folder: str, names: list[str] | None = None) -> Tables:
        return cls(spark, {n: spark.read.schema(SCHEMAS[n]).parquet(f"{folder}/{n}.parquet") for n in names or SCHEMAS})

    @classmethod
    def of(cls, spark: SparkSession, **rows: list[dict]) -> Tables:
        """Tables from Python rows, for fixtures; columns that a row leaves out are null."""
        made = {}
        for name, items in rows.items():
            schema = spark.createDataFrame([], SCHEMAS[name]).schema
            made[name] = spark.createDataFrame([[item.get(f.name) for f in schema] for item in items], schema)
        return cls(spark, made)
