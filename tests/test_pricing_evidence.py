from datetime import date
from decimal import Decimal as D

from pyspark.sql import functions as F

from tallyline.plans import evidence, pricing


def test_expected_price(spark):
    targets = spark.createDataFrame([("a", 2.0), ("b", 1.0)], "target_id string, qty double")
    contracts = spark.createDataFrame([("a", 50.0, True, False)], "target_id string, unit_price double, fixed_price boolean, change_order boolean")
    budgets = spark.createDataFrame([("a", 120.0, 0.1)], "target_id string, approved double, tolerance_pct double")
    bench = spark.createDataFrame([], "target_id string, median double, low double, high double, index_factor double, source_tier string")
    history = spark.createDataFrame([("b", 100.0, 0.02, True)], "target_id string, prior double, ipc double, recurring boolean")
    p = {r.target_id: r for r in pricing.expected(pricing.layers(targets, contracts, budgets, bench, history)).collect()}
    assert abs(p["a"].expected - (100 * 0.45 + 120 * 0.25) / 0.7) < 1e-9 and (p["a"].low, round(p["a"].high, 6), p["a"].confidence) == (100.0, 132.0, "high")
    assert abs(p["b"].expected - 102) < 1e-9 and p["b"].confidence == "medium" and abs(p["b"].low - 102 * 0.95) < 1e-9
    actual = spark.createDataFrame([("a", 200.0), ("b", 103.0)], "target_id string, actual double")
    got = {r.target_id: r.grade for r in pricing.judged(pricing.expected(pricing.layers(targets, contracts, budgets, bench, history)), actual).collect()}
    assert got == {"a": "material", "b": "within"}


def test_quotas(spark):
    units = spark.createDataFrame([("u", 10.0, 1200.0, "quota", 600.0, 3), ("v", 5.0, 1200.0, None, None, None)], "unit_id string, quota_pct double, budget double, rule string, rule_amount double, rule_months int")
    s = pricing.quota_schedule(units, "2024-01-15")
    u = [r.expected for r in s.where("unit_id = 'u'").orderBy("period").collect()]
    assert u == [D("30.00")] * 3 + [D("10.00")] * 9 and s.count() == 24
    seen = spark.createDataFrame([("u", date(2024, 1, 1), D("30.00")), ("u", date(2024, 2, 1), D("24.00"))], "unit_id string, period date, observed decimal(18,2)")
    dev = {r.period.month: (r.delta, r.reportable) for r in pricing.quota_deviations(s, seen).where("unit_id = 'u'").collect()}
    assert dev[1] == (D("0.00"), False) and dev[2] == (D("-6.00"), True) and dev[4] == (D("-10.00"), True)


def test_index(spark):
    rows = [("s", date(2024, m, 1), "a" if m < 3 else "b", v) for m, v in ((1, 100.0), (2, 110.0), (3, 55.0), (4, 66.0))]
    r = pricing.index_factor(spark.createDataFrame(rows, "series string, period date, base string, value double"), "2024-01-15", "2024-04-30").first()
    assert abs(r.factor - 66 / 50) < 1e-9


def test_quotes(spark):
    words = [("p", i, w, 10.0 * i, 0.0, 10.0 * i + 8, 10.0) for i, w in enumerate("Total factura 1.210,00 EUR gracias".split())]
    pages = spark.createDataFrame(words, "page_id string, idx int, text string, x0 double, y0 double, x1 double, y1 double")
    fields = spark.createDataFrame([("a", "p", "Total Factura", [0.0, 0.0, 20.0, 10.0]), ("b", "p", "totl factura", None), ("c", "p", "nothing alike", None), ("d", "q", "x", None)], "field_id string, page_id string, quote string, bbox array<double>")
    got = {r.field_id: (r.found, r.scope, r.crop_status) for r in evidence.locate_quotes(fields, pages).collect()}
    assert got["a"] == ("total factura", "bbox", "anchored") and got["b"] == ("total factura", "page", "approximate")
    assert got["c"] == got["d"] == (None, None, "page_only")


def test_fields(spark):
    docs = spark.createDataFrame([("d", '{"a": {"b": [1, {"c": "x"}]}, "n": null, "t": 2.5}')], "id string, j string")
    assert {(r.path, r.value) for r in evidence.flatten_json(docs, "id", "j").collect()} == {("a.b[0]", "1"), ("a.b[1].c", "x"), ("t", "2.5")}
    readings = spark.createDataFrame([("f", "m1", "amount", "1.210,00 €"), ("f", "m2", "amount", "1210"), ("g", "m1", "date", "3 de març de 2023"), ("g", "m2", "date", "04/03/2023"), ("g", "m3", "date", "2023-03-03")], "field_id string, source string, kind string, raw string")
    assert {(r.field_id, r.value, r.status) for r in evidence.two_sources(readings).collect()} == {("f", "1210.00", "agreed"), ("g", "2023-03-03", "demoted")}
    mentions = spark.createDataFrame([(1, None, "B12345674", 1), (2, "Lift SL", "b-12345674", 2), (3, "Àgua  X", None, 1), (4, "agua x", "bad", 3)], "mention_id int, name string, nif string, at int")
    assert {(r.party_key, r.name, r.mentions) for r in evidence.resolve_parties(mentions).collect()} == {("B12345674", "Lift SL", 2), ("agua x", "Àgua  X", 2)}
    revs = spark.createDataFrame([(1, "d", "t", "10", "amount", "model", None, 1), (2, "d", "t", "12", "amount", "human", None, 2)], "id int, document_id string, field_path string, value string, kind string, author string, reason string, created_at int")
    r = evidence.current_values(revs).first()
    assert r.value == "12" and r.needs_reason
    lines = spark.createDataFrame([(1, "Manteniment d'ascensor mensual", "v"), (2, "pintura de façana", "v"), (3, "res", "v")], "line_id int, text string, vendor string")
    keys = spark.createDataFrame([("LIFT", "manteniment ascensor"), ("LIFT", "ascensor"), ("FACADE", "pintura"), ("FACADE", "facana")], "code string, keyword string")
    assert {(r.line_id, r.code) for r in evidence.classify_lines(lines, keys).collect()} == {(1, "LIFT"), (2, "FACADE")}
    hints = spark.createDataFrame([("v", "LIFT")], "vendor string, code string")
    assert {(r.line_id, r.code) for r in evidence.classify_lines(lines, keys, hints).select("line_id", F.col("code")).collect()} == {(1, "LIFT"), (2, "FACADE"), (3, "LIFT")}
