from datetime import date

from pyspark.sql import functions as F

from tallyline.plans import validators, vendor_links


def results(spark, kind, **doc):
    schema = spark.createDataFrame([], validators.DOCUMENTS[kind]).schema
    rows = spark.createDataFrame([[doc.get(f.name) for f in schema]], schema)
    return {r.code.split(".")[1]: (r.passed if r.checked else None) for r in validators.validate(rows, kind).collect()}


def test_invoice(spark):
    line = (2.0, 50.0, 0.0, 100.0, 21.0, 21.0, 121.0, False)
    doc = dict(document_id="d", doc_type="factura", fecha_expedicion=date(2024, 5, 1), vencimiento=date(2024, 6, 1), emisor=("B12345674",), base_imponible_total=100.0, iva_total=21.0, total_factura=121.0, lineas=[line], resumen_iva=[(100.0, 21.0, 21.0)], iban_mostrado="ES9121000418450200051332")
    got = results(spark, "invoice", **doc)
    assert all(v in (True, None) for v in got.values()) and got["total"] and got["issuer_nif"] and got["recipient_nif"] is None and got["simplified_up_to_400"] is None
    bad = results(spark, "invoice", **{**doc, "total_factura": 131.0, "lineas": [(2.0, 50.0, 0.0, 110.0, 7.0, 21.0, 131.0, False)], "vencimiento": date(2024, 4, 1), "iban_mostrado": "ES9121000418450200051333"})
    assert not any(bad[k] for k in ("total", "lines_sum_to_base", "rate_times_base", "vat_rate_exists", "line_arithmetic", "dates", "iban"))
    assert len(got) == 11


def test_other_documents(spark):
    moves = [(date(2024, 1, 2), -10.0, 90.0, None), (date(2024, 1, 3), 5.0, 96.0, None), (date(2024, 2, 3), 1.0, 97.0, None)]
    s = results(spark, "statement", document_id="s", periodo_desde=date(2024, 1, 1), periodo_hasta=date(2024, 1, 31), saldo_inicial=100.0, saldo_final=97.0, movimientos=moves)
    assert (s["balance"], s["running_balance"], s["movements_in_period"], s["dates"], s["iban"]) == (False, False, False, True, None)
    m = results(spark, "minutes", document_id="m", fecha=date(2024, 1, 1), quorum=80.0, asistentes=[("1A", 60.0), ("1B", 20.0)], acuerdos=[(3, 0, 0, 90.0)])
    assert (m["quorum_is_sum"], m["in_favour_up_to_quorum"], m["votes_up_to_attendees"], m["quotas_up_to_100"]) == (True, False, False, True)
    b = results(spark, "budget", document_id="b", pem=100.0, gastos_generales_pct=13.0, beneficio=6.0, contrata=119.0, iva_pct=10.0, iva=11.9, total=130.9, capitulos=[(60.0, [(30.0,), (30.0,)]), (None, [(40.0,)])])
    assert all(b[k] for k in ("items_sum_to_chapter", "chapters_sum_to_pem", "contract_price", "total_with_vat", "vat_rate_exists"))
    a = results(spark, "accounts", document_id="a", ingresos=[(10.0,)], gastos=[(4.0,)], total_ingresos=10.0, total_gastos=4.0, resultado=6.0, saldo_inicial=1.0, saldo_final=7.0, fondo=(5.0, 1.0, 2.0, 4.0), comunidad=("B12345674",))
    assert a["result"] and a["closing"] and a["reserve"] and a["income_sums"] and a["community_nif"] is False
    c = results(spark, "contract", document_id="c", precio=100.0, iva_pct=21.0, precio_con_iva=121.0, calendario=[(40.0, None), (60.0, None)])
    assert c["price_with_vat"] and c["schedule_sums"]
    k = results(spark, "contribution", document_id="k", total=100.0, cuotas=[(50.0, 50.0, [(25.0,), (25.0,)]), (50.0, 50.0, [])])
    assert k["quotas_sum_to_total"] and k["instalments_sum_to_quota"] and k["quotas_up_to_100"]
    x = results(spark, "certification", document_id="x", total_origen=110.0, total_anterior=50.0, total_actual=60.0, contrato_total=100.0, partidas=[(110.0, 50.0, 60.0)], base=60.0, iva=6.0, retencion=3.0, total=63.0)
    assert x["current_is_difference"] and x["items_sum_to_totals"] and not x["within_contract"] and x["base_vat_total"]
    assert sum(len(f()) for f in validators.CHECKS.values()) == 53


def test_links(spark):
    officers = spark.createDataFrame([("v", "Anna", "PUIG", "MORA", None), ("w", "Pere", "MORA", "PUIG", None), ("x", "Joan", "PUIG", "VALL", None), ("y", "Pau", "GARCIA", "X", "h")], "party_id string, given string, surname1 string, surname2 string, nif_hmac string")
    reference = spark.createDataFrame([("president", "Anna", "PUIG", "MORA", "h", "Carrer Major 1")], "role string, given string, surname1 string, surname2 string, nif_hmac string, address string")
    surnames = spark.createDataFrame([("PUIG", 0.5), ("MORA", 2.0)], "surname string, per_mille double")
    got = {(r.party_id, r.signal, r.points) for r in vendor_links.names(officers, reference, surnames).collect()}
    assert got == {("v", "S2", 90), ("w", "S3", 23), ("x", "S4", 8)}
    vendors = spark.createDataFrame([("v", None, "Carrer major, 1", "i1", "600 111 222", "a@x.es", 3000.0, date(2024, 1, 1), False), ("w", None, "C/ Sol 2", "i1", None, "b@x.es", 9000.0, None, None), ("z", None, "c/ sol, 2", None, None, None, None, None, None)], "party_id string, nif_hmac string, address string, iban_hmac string, phone string, email string, capital double, incorporated_on date, trade_related boolean")
    assert {(r.party_id, r.points) for r in vendor_links.identity(vendors, officers, reference).collect()} == {("y", 100)}
    buildings = spark.createDataFrame([("CARRER MAJOR 1",)], "address string")
    a = {(r.party_id, r.signal, r.points) for r in vendor_links.addresses(vendors, buildings, reference).collect()}
    assert a == {("v", "S5", 80), ("w", "S6", 40), ("z", "S6", 40)}
    keys = spark.createDataFrame([("president", "i1")], "role string, iban_hmac string")
    s = {(r.party_id, r.points) for r in vendor_links.shared(vendors, keys).collect()}
    assert s == {("v", 90), ("w", 90), ("v", 100), ("w", 100)}
    first = spark.createDataFrame([("v", date(2024, 2, 1))], "party_id string, first date")
    s8 = vendor_links.company(vendors, first)
    assert sorted(r.points for r in s8.collect()) == [10, 25, 45]
    q = {(r.party_id, r.role): (r.points, r.tier) for r in vendor_links.queue(s8.unionByName(vendor_links.shared(vendors, keys))).collect()}
    assert q[("v", "")] == (170, "priority") and q[("w", "president")] == (100, "priority")
    assert vendor_links.rarity(F.lit(1.0)) is not None
