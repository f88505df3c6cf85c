import json
from datetime import date

from tallyline.sources import markup, registry


def answers(spark, bodies, **more):
    rows = [(str(i), b if isinstance(b, str) or b is None else json.dumps(b), *(v[i] for v in more.values())) for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, "key string, body string" + "".join(f", {c} string" for c in more))


def by_key(df):
    return {r.key: r for r in df.collect()}


def test_company_profiles(spark):
    wrapped = {"company": {"nombre": "Obres Vila, S.L.", "cif": "b-1234567 4", "domicilio": "Carrer Nou 1", "capital_social": "3.000,50", "fecha_constitucion": "08/11/2021", "cnae": 4399,
               "cargos": [{"persona": "Puig Roca, Maria", "cargo": "Administradora", "desde": "2021-11-08"}, {"cargo": "sense nom"}], "actos": [{"fecha": "2022-03-01", "tipo": "Nombramiento"}, {"fecha": "2021-11-22", "texto": "Constitución"}, {}]}}
    out = by_key(registry.company_profiles(answers(spark, [wrapped, {"name": "Bare Ltd", "capital": 10}, "no json", None, "[]"])))
    one = out["0"]
    assert (one.name, one.nif, one.capital, one.incorporated_on, one.activity_code) == ("Obres Vila, S.L.", "B12345674", 3000.5, date(2021, 11, 8), "4399")
    assert [(o.name_norm, o.since) for o in one.officers] == [("PUIG ROCA MARIA", date(2021, 11, 8))]
    assert [(e.day, e.text) for e in one.events] == [(date(2021, 11, 22), "Constitución"), (date(2022, 3, 1), None)] and one.unread == []
    assert out["1"].name == "Bare Ltd" and out["1"].capital == 10 and out["1"].unread == ["address", "incorporated_on", "activity_code", "officers", "events"]
    assert "2" not in out and "3" not in out


def test_search_results(spark):
    out = registry.search_results(answers(spark, [{"hits": [{"slug": "a", "title": "A"}, {"other": 1}, {"nombre": "B", "nif": "x 1"}]}, [{"id": 7}]])).collect()
    assert sorted((r.key, r.at, r.id, r.name, r.nif) for r in out) == [("0", 0, "a", "A", None), ("0", 2, None, "B", "X1"), ("1", 0, "7", None, None)]


def test_grants(spark):
    content = [{"id": 5, "beneficiario": "B12345674  Obres Vila SL", "importe": "1.234,50", "fechaConcesion": "2023-02-01", "nivel1": "LOCAL", "nivel3": "Consorci"}, {"beneficiario": "***3410** Maria Vila", "importe": 9.5}, {"beneficiario": "Associació Sense Número"}, {}]
    out = {r.at: r for r in registry.grants(answers(spark, [{"content": content}])).collect()}
    assert (out[0].reference, out[0].beneficiary, out[0].beneficiary_nif, out[0].granted, out[0].grantor) == ("5", "Obres Vila SL", "B12345674", 1234.5, "Consorci")
    assert (out[1].beneficiary, out[1].beneficiary_nif) == ("Maria Vila", None) and out[2].beneficiary == "Associació Sense Número" and 3 not in out


def test_contractors_keep_a_person_private(spark):
    rows = [{"n_mero_de_rasic": "1/08", "nom_titular_actual": "Obres Vila", "nif": "B12345674", "activitats": ["Obra", {"nom": "Aigua"}]}, {"n_mero_de_rasic": "2/08", "nom_titular_actual": "Maria Vila", "nif": "12345678Z", "adre_a": "Nou 1"}]
    out = {r.at: r for r in registry.contractors(answers(spark, [rows])).collect()}
    assert out[0].name == "Obres Vila" and out[0].activities == ["Obra", "Aigua"]
    assert out[1].number == "2/08" and out[1].name is None and out[1].nif is None and out[1].address is None


def test_cadastre_units(spark):
    rc = {"pc1": "9999999", "pc2": "ZZ9999Z", "car": "0001", "cc1": "A", "cc2": "B"}
    many = {"consulta_dnprcResult": {"lrcdnp": {"rcdnp": [{"rc": rc, "dt": {"locs": {"lous": {"lourb": {"loint": {"es": "1", "pt": "02", "pu": "A"}}}}}, "debi": {"luso": "Residencial", "sfc": "70", "cpt": "7,320000", "ant": "1932"}}]}}}
    one = {"consulta_dnp": {"bico": {"bi": {"idbi": {"rc": rc}, "debi": {"sfc": 55}, "dt": {"lourb": {"loint": {"pt": "BJ"}}}}}}}
    wrong = {"consulta_dnp": {"lerr": [{"cod": "17", "des": "NO EXISTE"}]}}
    out = by_key(registry.cadastre_units(answers(spark, [many, one, wrong])))
    assert (out["0"].reference, out["0"].floor, out["0"].door, float(out["0"].coefficient), out["0"].year_built) == ("9999999ZZ9999Z0001AB", "02", "A", 7.32, 1932)
    assert (out["1"].reference, out["1"].floor, out["1"].surface, out["1"].envelope) == ("9999999ZZ9999Z0001AB", "BJ", 55, "bico")
    assert out["2"].error == "NO EXISTE" and out["2"].reference is None


def test_census(spark):
    def reply(*people):
        rows = "".join(f"<v:Contribuyente><v:Nif>{n}</v:Nif><v:Nombre>X</v:Nombre><v:Resultado>{r}</v:Resultado></v:Contribuyente>" for n, r in people)
        return f'<?xml version="1.0"?><env:Envelope xmlns:env="e"><env:Body><v:VNifV2Sal xmlns:v="u">{rows}</v:VNifV2Sal></env:Body></env:Envelope>'

    fault = '<env:Envelope xmlns:env="e"><env:Body><env:Fault><faultcode>c</faultcode><faultstring>Mal</faultstring></env:Fault></env:Body></env:Envelope>'
    bodies = [reply(("B12345674", "identificado")), reply(("B12345674", "NO IDENTIFICADO"), ("B12345674", "Identificado")), reply(("A1", "IDENTIFICADO")), reply(("b-12345674", "Identificado - Baja")), fault, "<broken", None]
    out = by_key(registry.census(answers(spark, bodies, nif=["B12345674"] * 7)))
    assert [out[str(i)].matched for i in range(7)] == [True, True, False, False, False, False, False]
    assert out["1"].rows == 2 and out["2"].rows == 0 and out["2"].other_rows == 1 and out["3"].result == "IDENTIFICADO-BAJA" and out["4"].fault == "Mal" and out["5"].fault is None


def test_surnames(spark):
    ff = {"onomastica": {"ff": [{"cognom": "Pou", "per_mil": 0.07, "nombre": 553, "ordre": 9}, {"cognom": "VILÀ", "nombre": "16000"}]}}
    out = by_key(registry.surnames(answers(spark, [ff, ff, {"x": 1}], surname=["pou", "Vila", "Pou"])))
    assert (float(out["0"].per_mille), out["0"].basis, out["0"].rank) == (0.07, "published_rate", 9)
    assert (float(out["1"].per_mille), out["1"].basis) == (2.0, "count_over_population") and out["2"].basis == "not_read"


PAGE = """<html><head><title>no <td>cell</td></title><style>td {}</style></head><body><p>Consulta p&uacute;blica&#44; a &lt;b&gt; &#x1F600;</p>
<table id="tabla-consulta" class=x><thead><tr><th>N&ordm; REA<th>Raz&oacute;n social</th><th>NIF/CIF</th><th>Comunidad Aut&oacute;noma</th><th>Fecha de inscripci&oacute;n</th><th>Fecha de vencimiento</th><th>Estado</th></tr></thead>
<tr><td>09/08/0004567</td><td>Obres <b>Vila</b><br>S.L.</td><td>b 12345674</td><td>Catalu&ntilde;a</td><td>12/05/2022</td><td>12-05-2025</td><td>Inscrita</td></tr>
<tr><td><table><tr><td>inner</td></tr></table>outer</td><td></td></tr></table><script>x = "<td>y</td>";</script><!-- <td>z</td> --></body></html>"""


def test_table_cells(spark):
    out = {(r.table_no, r.row_no, r.column_no): r for r in markup.table_cells(answers(spark, [PAGE, "", None, "<td>stray</td>"]), "key", "body").collect()}
    assert out[1, 1, 1].text == "Nº REA" and out[1, 1, 2].text == "Razón social" and out[1, 1, 1].header and out[1, 1, 1].table_id == "tabla-consulta"
    assert out[1, 2, 2].text == "Obres Vila S.L." and out[2, 1, 1].text == "inner" and out[1, 3, 1].text == "outer" and out[1, 3, 2].text == ""
    assert len(out) == 7 + 7 + 2 + 1


def test_text_and_lists(spark):
    page = '<div><h1>T</h1><ul><li>one<li><a href="/x?a=1&amp;b=2">two</a> &amp;lt;<ul><li>inner</ul>tail</li></ul><dl><dt>k<dd>v</dl>after'
    df = answers(spark, [page, PAGE])
    items = {(r.list_no, r.item_no): (r.kind, r.text, r.href) for r in markup.list_items(df.where("key = '0'"), "key", "body").collect()}
    assert items == {(1, 1): ("li", "one", None), (1, 2): ("li", "two &lt; tail", "/x?a=1&b=2"), (2, 1): ("li", "inner", None), (3, 1): ("dt", "k", None), (3, 2): ("dd", "v", None)}
    text = df.where("key = '1'").select(markup.visible_text(df["body"]).alias("t")).first().t
    assert "Consulta pública, a <b> 😀" in text and "z" not in text.split() and "Obres Vila" in text


def test_builders(spark):
    pairs = '<table id="tabla-consulta"><tr><td>Raz&oacute;n social</td><td>Vila</td></tr><tr><td>N&uacute;m. REA</td><td>01/02/0000003</td></tr><tr><td>Estado</td><td>Acreditada</td></tr></table>'
    bodies = [PAGE, pairs, "<p>No existe ning&uacute;n registro para ese n&uacute;mero. Fin.</p>", "<form>buscar</form>", "<p>La empresa 09/08/0000001 est&aacute; inscrita en Galicia desde 1/2/2020.</p>"]
    out = by_key(registry.builders(answers(spark, bodies)))
    a, b, c, d, e = (out[str(i)] for i in range(5))
    assert (a.registered, a.number, a.name, a.nif, a.community, a.valid_from, a.valid_to, a.status, a.unread) == (True, "09/08/0004567", "Obres Vila S.L.", "B12345674", "Cataluña", date(2022, 5, 12), date(2025, 5, 12), "Inscrita", [])
    assert (b.registered, b.number, b.name, b.status, b.entries) == (True, "01/02/0000003", "Vila", "Acreditada", 1) and "community" in b.unread
    assert (c.registered, c.status, c.unread) == (False, "No existe ningún registro para ese número.", ["table"])
    assert d.registered is None and d.unread == ["table", "verdict"]
    assert (e.registered, e.number, e.community, e.valid_from, e.table_found) == (True, "09/08/0000001", "Galicia", date(2020, 2, 1), False)
