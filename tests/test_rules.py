import datetime
from datetime import date
from decimal import Decimal as D

import pytest

from tallyline.plans import rules, views
from tallyline.plans.schemas import Tables

TODAY = date(2026, 9, 4)


@pytest.fixture(scope="module")
def tables(spark):
    c = {"community_id": "c"}
    link = {**c, "from_type": "invoice", "score": 1.0}
    return Tables.of(
        spark,
        communities=[{"id": "c", "fy_start_month": 1, "ordinary_budget_default": D("6700.00"), "address": "Carrer Major 1"}],
        parameters=[{**c, "key": k, "value_num": D(v), "version": 1, "valid_from": d} for k, v, d in [("outflow_min", "300", date(1900, 1, 1)), ("authority_threshold", "1000", date(1900, 1, 1)), ("pm_ordinary", "335", date(1900, 1, 1)), ("cash_limit", "2500", date(1900, 1, 1)), ("cash_limit", "1000", date(2021, 7, 11))]],
        bank_statements=[{**c, "id": "s", "bank_account_id": "a", "source": "csv", "periodo_desde": date(2024, 1, 1), "periodo_hasta": date(2024, 3, 31), "saldo_final": D("500.00")}, {**c, "id": "s2", "bank_account_id": "a", "source": "csv", "periodo_desde": date(2024, 5, 1), "periodo_hasta": date(2024, 6, 30)}],
        bank_accounts=[{**c, "id": "a", "purpose": "ordinary"}],
        bank_transactions=[
            {**c, "id": "t1", "statement_id": "s", "fecha_operacion": date(2024, 3, 12), "importe": D("-1210.00"), "tx_kind": "transfer_out"},
            {**c, "id": "t2", "statement_id": "s", "fecha_operacion": date(2024, 5, 1), "importe": D("-500.00"), "tx_kind": "transfer_out"},
            {**c, "id": "t3", "statement_id": "s", "fecha_operacion": date(2024, 6, 1), "importe": D("-900.00"), "tx_kind": "transfer_out", "flags": ["person_beneficiary"]},
            {**c, "id": "t4", "statement_id": "s", "fecha_operacion": date(2024, 6, 2), "importe": D("-1000.00"), "tx_kind": "cash", "flags": ["cash"]},
        ],
        documents=[{**c, "id": "d1"}, {**c, "id": "d2"}, {**c, "id": "d3", "duplicate_of_document_id": "d1"}],
        invoices=[
            {**c, "id": "i1", "document_id": "d1", "vendor_party_id": "v", "numero": "118", "fecha_expedicion": date(2024, 3, 10), "total": D("1210.00"), "works_package_id": "w"},
            {**c, "id": "i2", "document_id": "d2", "vendor_party_id": "v", "numero": "119", "fecha_expedicion": date(2024, 5, 6), "total": D("500.00")},
            {**c, "id": "i3", "document_id": "d3", "vendor_party_id": "v", "numero": "118", "fecha_expedicion": date(2024, 3, 10), "total": D("1210.00")},
        ],
        parties=[{**c, "id": "v", "kind": "vendor", "nif_kind": "CIF", "address": "Carrer  MAJOR, 1", "incorporated_on": date(2024, 1, 1)}],
        recon_links=[
            {**link, "from_id": "i1", "to_type": "bank_transaction", "to_id": "t1", "link_type": "paid_by", "status": "accepted", "amount_matched": D("1210.00")},
            {**link, "from_id": "i2", "to_type": "bank_transaction", "to_id": "t2", "link_type": "paid_by", "status": "accepted", "amount_matched": D("500.00")},
            {**link, "from_id": "i1", "to_type": "resolution", "to_id": "r", "link_type": "authorised_by", "status": "proposed"},
        ],
        meetings=[{**c, "id": "m", "tipo": "extraordinaria", "fecha": date(2024, 3, 20), "notice_days": 5, "attendees": [("1A", 60.0), ("9Z", 41.0)]}],
        units=[{**c, "id": "u", "label": "1a", "quota": D("60.0000")}],
        resolutions=[{**c, "id": "r", "meeting_id": "m", "kind": "works_approval", "resultado": "aprobado", "votes_for": 3, "owners_total": 10, "quotas_for": 55.0}],
        works_packages=[{**c, "id": "w", "code": "ELEVATOR", "contract_price": D("48000.00"), "suspension_date": date(2024, 3, 15)}],
        works_events=[{**c, "works_package_id": "w", "event_type": "acta_approval", "event_date": date(2024, 3, 20), "ref_id": "r"}, {**c, "works_package_id": "w", "event_type": "payment", "event_date": date(2024, 3, 12), "ref_id": "t1"}],
        liquidations=[{**c, "id": "l", "ejercicio": 2024, "periodo_hasta": date(2024, 3, 31), "saldo_inicial": D("100.00"), "saldo_final": D("700.00"), "fondo_reserva_final": D("100.00"), "acreedores_pendientes": D("50.00")}],
        liquidation_lines=[{**c, "id": "x", "liquidation_id": "l", "side": "gasto", "importe": D("1000.00")}],
        subsidies=[{**c, "id": "z", "import_pagat": D("900.00"), "paid_to_is_community": False}],
    )


def test_views(tables):
    counts = {r.residual: r.n for r in views.residual_counts(tables).collect()}
    assert counts == {"R1": 0, "R2": 2, "R3": 1, "R4": 1, "R5": 0, "R6": 0, "R7": 1}
    t = views.control_totals(tables).first()
    assert (t.liq_expenses, t.bank_debits, t.invoices_total, t.bridged_difference, t.pm_ordinary) == (D("1000.00"), D("3610.00"), D("1710.00"), D("-2660.00"), D("335.0000"))
    f = views.works_funding(tables).first()
    assert (f.committed, f.available, f.paid_total) == (D("48000.00"), D("0.00"), D("1210.00"))
    s = views.suspension_status(tables).first()
    assert (s.invoiced_at_suspension, s.paid_at_suspension, s.invoices_after_suspension) == (D("1210.00"), D("1210.00"), 0)
    y = views.year_balance_continuity(tables).first()
    assert y.bank_saldo_at_close == D("500.00") and y.opening_gap is None
    w = views.challengeable_resolutions(tables, date(2024, 7, 1)).first()
    assert not w.open_3m and w.open_12m and w.notification_date_unknown


def test_rules(tables):
    found = {(r.rule_code, r.event_key): r.severity for r in rules.hits(tables, TODAY).collect()}
    expected = {
        ("D0", "community:c:funding"): 3, ("D1", "tx:t3:unmatched"): 4, ("D1", "tx:t4:unmatched"): 3, ("D1", "liquidation_line:x:unsupported"): 3, ("D2", "tx:t4:instrument"): 3,
        ("D4", "resolution:r:payment_before:t1"): 3, ("D4", "payment:t2:before_invoice:i2"): 2, ("D6", "liquidation:l:reserve"): 1, ("D6", "community:c:reserve_account"): 2,
        ("D7", "liquidation:l:closing_vs_bank"): 3, ("D7", "year:2024:control_totals"): 3, ("D8", "subsidy:z:destination"): 4, ("E1", "invoice:i1:authority"): 2,
        ("E2", "resolution:r:payment_before:t1"): 3, ("E3", "meeting:m:quotas"): 2, ("E3", "meeting:m:unit_labels"): 2, ("E5", "bank_account:a:statements"): 2,
        ("E6", "meeting:m:notice"): 2, ("E8", "resolution:r:majority"): 2, ("B1", "party:v:company_age"): 3, ("B2", "party:v:address_building"): 3, ("G5", "community:c:lift_ce_declaration"): 1,
        ("G7", "community:c:ite"): 1, ("B8", "community:c:vendor_concentration_ordinary"): 1,
    }
    for key, severity in expected.items():
        assert found.get(key) == severity, key
    assert ("D1", "invoice:i1:unmatched") not in found and ("D2", "tx:t1:instrument") not in found
    assert set(rules.RULES) >= {"D0", "D1", "D2", "D3", "D4", "D5", "D6", "D7", "D8", "D11", "E1", "E2", "E3", "E5", "E6", "E7", "E8", "B1", "B2", "B3", "B7", "B8", "B9", "B10", "A10", "G2", "G5", "G6", "G7"}


def test_findings_are_one_an_event(tables):
    found = rules.run(tables, TODAY, ["D1", "D2", "D4", "E2"]).collect()
    keys = [r.event_key for r in found]
    assert len(keys) == len(set(keys)) and all(r.tier in ("T1", "T2", "T3") for r in found)
    assert rules.hits(Tables(tables.spark), datetime.date(2026, 1, 1)).count() == 0
