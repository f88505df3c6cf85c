import pytest

from tallyline.plans import setup


def test_seed(spark):
    text = """
units:
  - {label: 1r 1a, quota_pct: 12.5}
  - {label: Baixos}
derramas:
  - {objeto: ascensor, criterio: coeficiente, importe_total: 1200, starts_on: 2024-03-01, months: 3}
"""
    made = setup.read_seed(spark, text)
    assert [tuple(r) for r in made["units"].collect()] == [("1r 1a", 12.5), ("Baixos", None)]
    assert made["derramas"].first().starts_on == "2024-03-01"
    assert setup.read_seed(spark, "") == {}
    for bad in ("cars: []", "units: [{size: 3}]", "units: [{quota_pct: many}]"):
        with pytest.raises(ValueError):
            setup.read_seed(spark, bad)


def test_store_keeps_places(spark):
    docs = spark.createDataFrame([("d", [{"subtotal": 3.0, "partidas": [{"importe": 1.0}, {"importe": 2.0}]}]), ("e", [])], "document_id string, capitulos array<struct<subtotal:double,partidas:array<struct<importe:double>>>>")
    made = setup.store(docs, "budget")
    assert sorted(made) == ["budget", "budget.capitulos", "budget.capitulos.partidas"]
    assert [tuple(r) for r in made["budget.capitulos"].collect()] == [("d", 0, 3.0)]
    assert sorted(tuple(r) for r in made["budget.capitulos.partidas"].collect()) == [("d", 0, 0, 1.0), ("d", 0, 1, 2.0)]
    assert made["budget"].count() == 2
