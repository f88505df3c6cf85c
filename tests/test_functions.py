import datetime
from decimal import Decimal

from pyspark.sql import functions as F

from tallyline.functions import amounts, dates, hashing, ids, similarity, text


def one(spark, values, fn, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(fn(F.col("v"))).collect()]


def test_amounts(spark):
    cases = {
        "1.234,56": "1234.56", "1,234.56": "1234.56", "-1.234,56": "-1234.56", "1.234,56-": "-1234.56", "(1.234,56)": "-1234.56",
        "1.234": "1234", "1,234": "1.234", "1.23": "1.23", "1234": "1234", "12 €": "12", "EUR 3,5": "3.5", "+7": "7", "1.23.4": None,
        "abc": None, "": None, "1,2,3": None, "-": None, ",5": "0.5", "1.234.567": "1234567", None: None, "(-5)": "5",
    }
    got = one(spark, cases, amounts.parse_amount)
    assert got == [None if v is None else Decimal(v) for v in cases.values()]
    assert one(spark, ["1.234"], lambda c: amounts.parse_amount(c, legacy=True)) == [Decimal("1.234")]
    assert one(spark, [1234567.5], amounts.format_amount, "double") == ["1.234.567,50"]
    assert one(spark, [500.0, 499.0, -1200.0, 550.0], amounts.is_round, "double") == [True, False, True, False]


def test_dates(spark):
    cases = {
        "2024-02-29": (2024, 2, 29), "03/05/2024": (2024, 5, 3), "3.5.69": (2069, 5, 3), "3-5-71": (1971, 5, 3), "Barcelona, 3 de març de 2023": (2023, 3, 3),
        "1 d'abril del 2023": (2023, 4, 1), "31/02/2024": None, "no date": None, "12 dic 2020": (2020, 12, 12), "": None,
    }
    assert one(spark, cases, dates.parse_date) == [v and datetime.date(*v) for v in cases.values()]
    assert one(spark, ["2024-06-30", "2024-07-01"], lambda c: dates.fiscal_year(c.cast("date"), 7)) == [2024, 2025]
    got = one(spark, ["CUOTA 03/2023", "cuota enero", "Derrama febrer 2022", "otra"], lambda c: dates.period_for_credit(F.lit("2024-05-17").cast("date"), c))
    assert [str(x) for x in got] == ["2023-03-01", "2024-01-01", "2022-02-01", "2024-05-01"]


def test_identifiers(spark):
    cases = {
        "12345678Z": (True, "DNI"), "12345678-z": (True, "DNI"), "12345678A": (False, "INVALID"), "X1234567L": (True, "NIE"), "B12345674": (True, "CIF"),
        "B1234567D": (False, "INVALID"), "": (False, "INVALID"), "ES12345678Z": (True, "DNI"), "hello": (False, "INVALID"),
    }
    got = one(spark, cases, ids.check_nif)
    assert [(r.valid, r.kind) for r in got] == list(cases.values())
    assert got[5].reason == "control_type" and got[6].reason == "empty" and got[8].reason == "format"
    ibans = ["ES91 2100 0418 4502 0005 1332", "ES9121000418450200051333", "GB82WEST12345698765432", "GB82", "XX82WEST12345698765432", ""]
    got = one(spark, ibans, ids.check_iban)
    assert [r.reason for r in got] == [None, "checksum", None, "format", "country", "empty"]
    assert one(spark, ["21000418450200051332"], ids.ccc_to_iban) == ["ES9121000418450200051332"]
    assert ids.bank_successors({"a": "b", "b": "c"}) == {"a": "c", "b": "c"}


def test_text(spark):
    assert one(spark, ["José  d'Almeida de la Cruz", None, "Col·lell i Puig"], text.norm_name) == ["JOSE ALMEIDA CRUZ", "", "COLLELL PUIG"]
    names = ["Ascensors Puig, S.L.U.", "Grup Obres S.A.", "Instal·lacions Mora Sociedad Limitada", "L'Empresa & Fills SL en liquidación"]
    assert one(spark, names, text.norm_company) == ["PUIG", "GRUP OBRES", "MORA", "EMPRESA FILLS"]
    got = one(spark, ["F-2023/001", "F 2023/0001 A", "sin numero"], text.invoice_number)
    assert [r.canonical for r in got] == ["F2023-1", "F2023-1-A", "SINNUMERO"]
    assert one(spark, ["IMG_2", "img_10", "img_002"], text.natural_key) == ["img_000000000002", "img_000000000010", "img_000000000002"]
    assert one(spark, ["pay ES9121000418450200051332 to 12345678Z at a@b.es or 600 123 456"], text.redact) == ["pay [IBAN] to [NIF] at [EMAIL] or [PHONE]"]
    assert one(spark, ["  Àlex·Ç  x ", " "], text.norm_text) == ["alex c x", None]
    assert one(spark, ["pago FRA. A-118/24"], lambda c: text.reference_in_text(F.lit("A"), F.lit("118"), c)) == [True]
    flags = spark.createDataFrame([(True, True, None), (True, None, None), (False, False, None)], "a boolean, b boolean, c boolean")
    assert [r[0] for r in flags.select(text.majority([F.col(c) for c in "abc"])).collect()] == [True, None, False]


def test_hashing(spark):
    import hashlib

    row = spark.range(1).select(hashing.fingerprint(F.lit("a"), F.lit(None), F.lit(3)).alias("f"), hashing.keyed_digest(F.lit("x"), "k").alias("h")).first()
    assert row.f == hashlib.sha256(b"a||3").hexdigest()[:32] and len(row.h) == 64
    key = hashing.document_key(F.lit("b-12345674"), F.lit("A"), F.lit("0118"), F.lit("1.210,00"), F.lit("10/03/2024"))
    assert spark.range(1).select(key).first()[0] == "B12345674|A|118|1210.00|2024-03-10"


def test_similarity(spark):
    assert round(similarity.jaro_winkler("MARTHA", "MARHTA"), 4) == 0.9611 and round(similarity.jaro_winkler("DIXON", "DICKSONX"), 4) == 0.8133
    assert similarity.jaro_winkler("", "A") == 0 and similarity.token_set("A B", "B A") == 1
    rows = spark.createDataFrame([("Ascensores Puig SL", "PUIG ASCENSORS, S.L."), ("Mora", "Kruger"), (None, "x")], "a string, b string")
    got = [r[0] for r in rows.select(similarity.payees_match(F.col("a"), F.col("b"))).collect()]
    assert got == [True, False, False]
