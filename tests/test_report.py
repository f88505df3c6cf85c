from datetime import date
from decimal import Decimal as D

from pyspark.sql import functions as F

from tallyline.plans import report
from tallyline.plans.schemas import Tables


def test_reports(spark):
    c = {"community_id": "c"}
    inv = [("1", 5, "900.00"), ("2", 7, "900.00"), ("3", 9, "905.00"), ("4", 1, "50.00"), ("5", 12, "100.00")]
    t = Tables.of(
        spark,
        documents=[{**c, "id": f"d{i}"} for i, *_ in inv],
        invoices=[{**c, "id": f"i{i}", "document_id": f"d{i}", "vendor_party_id": "v", "numero": i, "fecha_expedicion": date(2024, 1, day), "total": D(v)} for i, day, v in inv],
        bank_transactions=[{**c, "id": "t", "importe": D("-900.00"), "tx_kind": "transfer_out"}, {**c, "id": "u", "importe": D("-50.00"), "tx_kind": "fee"}],
        recon_links=[{**c, "from_type": "invoice", "from_id": "i1", "to_type": "bank_transaction", "to_id": "t", "link_type": "paid_by", "status": "accepted", "amount_matched": D("900.00")}],
        parties=[{**c, "id": "v", "kind": "vendor"}],
        parameters=[{**c, "key": "k", "value_num": D(1), "version": 2, "valid_from": date(2020, 1, 1)}, {**c, "key": "k", "value_num": D(2), "version": 1, "valid_from": date(2021, 1, 1)}],
        works_packages=[{**c, "id": "w", "contract_price": D("5000.00")}],
        quotes=[{**c, "works_package_id": "w", "vendor_party_id": v, "total": D(p)} for v, p in (("v", "5000.00"), ("x", "4000.00"))],
    )
    s = report.supported_spend(t).first()
    assert (s.outflows, s.with_invoice, s.with_resolution, s.n) == (D("950.00"), D("900.00"), D("0.00"), 2)
    assert {(r.invoice_id, r.twin_id, r.severity) for r in report.duplicate_invoices(t).collect()} == {("i1", "i2", 3), ("i1", "i3", 2), ("i2", "i3", 2)}
    assert {r.invoice_id for r in report.split_invoices(t).collect()} == {"i2", "i3", "i5"}
    assert {r.invoice_id for r in report.number_order(t).collect()} == {"i4"}
    assert report.round_totals(t).count() == 1 and {r.invoice_id for r in report.weekend_invoices(t).collect()} == {"i2"}
    assert report.few_quotes(t).first().severity == 3
    assert report.parameters_in_force(t, date(2024, 1, 1)).first().value_num == 2
    v = report.vendor_sheet(t).first()
    assert (v.invoices, v.paid, v.first) == (5, D("900.00"), date(2024, 1, 1))
    members = spark.createDataFrame([("c", "me", "owner"), ("c", "you", "guest")], "community_id string, user_id string, role string")
    assert report.secured(t["invoices"], members, "me").count() == 5 and report.secured(t["invoices"], members, "you").count() == 0
    assert {(r.table, r.n) for r in report.counters(t, "invoices", "quotes").collect()} == {("invoices", 5), ("quotes", 2)}


def test_review_and_drift(spark):
    f = spark.createDataFrame([("a", "open"), ("b", "open")], "id string, status string")
    r = spark.createDataFrame([(1, "a", "confirmed", 5), (2, "a", "closed", 7)], "id int, finding_id string, to_status string, at int")
    got = {x.id: (x.status, x.confirmed_at) for x in report.review_state(f, r).collect()}
    assert got == {"a": ("closed", 5), "b": ("open", None)}
    then = spark.createDataFrame([("c", "k", 1), ("c", "l", 1)], "community_id string, key string, value_num int")
    assert {(x.parameter, x.state) for x in report.drift(then, then.withColumn("value_num", F.when(F.col("key") == "k", 2).otherwise(1))).collect()} == {("c|k", "changed")}
