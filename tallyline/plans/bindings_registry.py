"""Readers of markup and of registers' answers, over pages and over answers made of the driver's rows in each provider's form, beside DuckDB's SQL.

The SQL never reads the answers: it computes from the rows they were made of what a right reader must find.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyline.plans.bindings import bound, table
from tallyline.sources import markup, registry


def _bodies(spark, d, name: str, key: str, body: str, *more: str):
    """(key, body, ...) of a driver table's rows, in SQL expressions."""
    return table(spark, d, name).selectExpr(f"{key} AS key", f"{body} AS body", *more)


@bound("""
SELECT page_id, 1 AS list_no, i AS item_no, regexp_extract(item, '>([^<]*)</a>', 1) AS text, regexp_extract(item, 'href="([^"]*)"', 1) AS href
FROM (SELECT page_id, unnest(items) AS item, unnest(range(1, len(items) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '<li><a href="[^"]*">[^<]*</a></li>') AS items FROM pages))""")
def page_list_items(spark, d):
    """Items of every page's lists, by the markup's state machine."""
    items = markup.list_items(table(spark, d, "pages"), "page_id", "html")
    return items.select("page_id", F.col("list_no").cast("int").alias("list_no"), F.col("item_no").alias("item_no"), "text", "href")


#: A table a nation and segment, a row a customer: with and without closing tags, nested tables, entities.
_CELL = "CASE c_custkey % 3 WHEN 0 THEN concat('<td>', c_name, '</td>') WHEN 1 THEN concat('<td class=\"x\"><b>', c_name, '</b><br> &amp; co') ELSE concat('<th>', c_name, '<table><tr><td>in ', c_custkey, '</td></tr></table></th>') END"


@bound("""
WITH r AS (SELECT c_nationkey AS k, c_custkey, c_name, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i, sum((c_custkey % 3 = 2)::INT) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS t FROM customer)
SELECT k AS key, 1 AS table_no, i AS row_no, 1 AS column_no, CASE c_custkey % 3 WHEN 1 THEN c_name || ' & co' ELSE c_name END AS text, c_custkey % 3 = 2 AS header FROM r
UNION ALL SELECT k, 1, i, 2, lower(c_mktsegment) || ' €', false FROM r UNION ALL SELECT k, t + 1, 1, 1, 'in ' || c_custkey, false FROM r WHERE c_custkey % 3 = 2""")
def page_table_cells(spark, d):
    """Cells of a page a nation, by table, row and column."""
    rows = table(spark, d, "customer").selectExpr("c_nationkey AS key", "c_custkey", f"concat('<tr>', {_CELL}, '<td>', lower(c_mktsegment), ' &#8364;</td>') AS line")
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "line"))), lambda x: x["line"]), "\n")
    pages = rows.groupBy("key").agg(F.concat(F.lit("<html><body><p>before</p><table id='t'>"), lines, F.lit("</table><p>after<td>stray")).alias("html"))
    cells = markup.table_cells(pages, "key", "html")
    return cells.select("key", *(F.col(c).cast("int").alias(c) for c in ("table_no", "row_no", "column_no")), "text", "header")


#: A number in letters, for names hold no digits.
_LETTERS = "translate(CAST({} AS STRING), '0123456789', 'bcfgjkmpqz')"
_MONEY = "CAST(s_acctbal AS DECIMAL(18,2))"
_SPANISH = f"replace(CAST({_MONEY} AS STRING), '.', ',')"
_OFFICERS = f"array_join(transform(sequence(0, CAST(s_suppkey % 3 AS INT)), i -> concat('{{\"', IF(i = 0, 'nombre', 'persona'), '\": \"Vila ', {_LETTERS.format('s_suppkey')}, ', Anna ', {_LETTERS.format('i')}, '\", \"cargo\": \"r', i, '\", \"desde\": \"', 2000 + i, '-0', i + 1, '-15\"}}')), ', ')"
_PROFILE = (
    "concat('{\"', CASE s_suppkey % 3 WHEN 0 THEN 'name' WHEN 1 THEN 'denominacion_social' ELSE 'razon_social' END, '\": \"Obres ', s_name, ', S.L.\", \"', IF(s_suppkey % 2 = 0, 'nif', 'cif'), '\": \"b-', lpad(s_suppkey, 7, '0'), ' 1\"',"
    f" CASE s_suppkey % 4 WHEN 0 THEN concat(', \"capital\": ', CAST({_MONEY} AS STRING)) WHEN 1 THEN concat(', \"capital_social\": \"', {_SPANISH}, '\"') WHEN 2 THEN ', \"capital\": \"none\"' ELSE '' END,"
    " IF(s_suppkey % 5 <> 0, concat(', \"fecha_constitucion\": \"', lpad(s_suppkey % 28 + 1, 2, '0'), '/03/', 1990 + s_suppkey % 30, '\"'), ''),"
    f" IF(s_suppkey % 6 <> 0, concat(', \"cargos\": [', {_OFFICERS}, ', {{}}]'), ''), IF(s_suppkey % 7 <> 0, ', \"actos\": [{{\"fecha\": \"2020-05-05\", \"tipo\": \"b\"}}, {{\"fecha\": \"2019-05-05\", \"texto\": \"a\"}}]', ''), '}}')"
).replace("{{", "{").replace("}}", "}")


@bound(f"""
SELECT s_suppkey AS key, 'Obres ' || s_name || ', S.L.' AS name, 'B' || lpad(s_suppkey::VARCHAR, 7, '0') || '1' AS nif, CASE WHEN s_suppkey % 4 < 2 THEN s_acctbal::DECIMAL(18,2) END AS capital,
 CASE WHEN s_suppkey % 5 <> 0 THEN make_date(1990 + s_suppkey % 30, 3, s_suppkey % 28 + 1) END AS incorporated_on, CASE WHEN s_suppkey % 6 <> 0 THEN s_suppkey % 3 + 1 ELSE 0 END AS officers,
 CASE WHEN s_suppkey % 6 <> 0 THEN 'VILA ' || upper(translate(s_suppkey::VARCHAR, '0123456789', 'bcfgjkmpqz')) || ' ANNA ' || upper(translate((s_suppkey % 3)::VARCHAR, '0123456789', 'bcfgjkmpqz')) || ' ' || (2000 + s_suppkey % 3) || '-0' || (s_suppkey % 3 + 1) || '-15' END AS last_officer, CASE WHEN s_suppkey % 7 <> 0 THEN '2019-05-05 a' END AS first_event,
 concat_ws(',', 'address', CASE WHEN s_suppkey % 5 = 0 THEN 'incorporated_on' END, CASE WHEN s_suppkey % 4 > 1 THEN 'capital' END, 'activity_code', CASE WHEN s_suppkey % 6 = 0 THEN 'officers' END, CASE WHEN s_suppkey % 7 = 0 THEN 'events' END) AS unread
FROM supplier""", double="capital", text="incorporated_on")
def registry_company_profiles(spark, d):
    body = f"IF(s_suppkey % 2 = 0, concat('{{\"company\": ', {_PROFILE}, '}}'), {_PROFILE})"
    p = registry.company_profiles(_bodies(spark, d, "supplier", "s_suppkey", body))
    last, first = F.try_element_at("officers", F.lit(-1)), F.try_element_at("events", F.lit(1))
    return p.select(
        "key", "name", "nif", "capital", "incorporated_on", F.size("officers").alias("officers"), F.concat_ws(" ", last["name_norm"], last["since"].cast("string")).alias("last"), F.concat_ws(" ", first["day"].cast("string"), first["text"]).alias("f"), F.concat_ws(",", "unread").alias("unread")
    ).select("key", "name", "nif", "capital", "incorporated_on", "officers", F.nullif("last", F.lit("")).alias("last_officer"), F.nullif("f", F.lit("")).alias("first_event"), "unread")


#: Orders of a customer as grants; 00000000T and A00000000 pass their checks.
_GRANT = (
    "concat('{\"id\": ', o_orderkey, ', \"beneficiario\": \"', CASE o_orderkey % 4 WHEN 0 THEN 'A00000000  Obres ' WHEN 1 THEN '***1234** ' WHEN 2 THEN '00000000T ' ELSE 'Associacio ' END, o_custkey, '\", ', IF(o_orderkey % 3 = 0, '\"nivel3\": \"Consorci\", \"nivel1\": \"LOCAL\", ', '\"organo\": \"Ajuntament\", '),"
    " IF(o_orderkey % 2 = 0, concat('\"importe\": ', CAST(o_totalprice AS DECIMAL(18,2))), concat('\"importeConcedido\": \"', replace(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING), '.', ','), '\"')), ', \"fechaConcesion\": \"', date_format(o_orderdate, IF(o_orderkey % 5 = 0, 'yyyy-MM-dd', 'dd/MM/yyyy')), '\"}')"
)


@bound("""
SELECT o_custkey AS key, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS at, o_orderkey::VARCHAR AS reference, CASE o_orderkey % 4 WHEN 0 THEN 'Obres ' WHEN 3 THEN 'Associacio ' ELSE '' END || o_custkey AS beneficiary,
 CASE o_orderkey % 4 WHEN 0 THEN 'A00000000' WHEN 2 THEN '00000000T' END AS nif, CASE WHEN o_orderkey % 3 = 0 THEN 'Consorci' ELSE 'Ajuntament' END AS grantor, o_totalprice::DECIMAL(18,2) AS granted, o_orderdate::DATE AS day FROM orders""", double="granted", text="day")
def registry_grants(spark, d):
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "one"))), lambda x: x["one"]), ", ")
    answers = table(spark, d, "orders").selectExpr("o_custkey AS key", "o_orderkey", f"{_GRANT} AS one").groupBy("key").agg(F.concat(F.lit('{"content": ['), listed, F.lit("]}")).alias("body"))
    return registry.grants(answers).select("key", "at", "reference", "beneficiary", F.col("beneficiary_nif").alias("nif"), "grantor", "granted", "day")


@bound("""
SELECT s_nationkey AS key, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS at, 'R' || s_suppkey AS number, CASE WHEN s_suppkey % 3 <> 1 THEN s_name END AS name, CASE s_suppkey % 3 WHEN 0 THEN 'A00000000' END AS nif,
 CASE WHEN s_suppkey % 2 = 0 THEN 'Obra,Aigua ' || s_suppkey ELSE '' END AS activities, CASE WHEN s_suppkey % 4 = 0 THEN 'alta' END AS status FROM supplier""")
def registry_contractors(spark, d):
    one = (
        "concat('{\"n_mero_de_rasic\": \"R', s_suppkey, '\", \"nom_titular_actual\": \"', s_name, '\"', CASE s_suppkey % 3 WHEN 0 THEN ', \"nif\": \"a-00000000\"' WHEN 1 THEN ', \"nif\": \"00000000T\"' ELSE '' END,"
        " IF(s_suppkey % 2 = 0, concat(', \"activitats\": [\"Obra\", {\"nom\": \"Aigua ', s_suppkey, '\"}]'), ''), IF(s_suppkey % 4 = 0, ', \"estat\": \"alta\"', ''), '}')"
    )
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "one"))), lambda x: x["one"]), ", ")
    answers = table(spark, d, "supplier").selectExpr("s_nationkey AS key", "s_suppkey", f"{one} AS one").groupBy("key").agg(F.concat(F.lit("["), listed, F.lit("]")).alias("body"))
    return registry.contractors(answers).select("key", "at", "number", "name", "nif", F.concat_ws(",", "activities").alias("activities"), "status")


@bound("""
SELECT c_custkey AS key, CASE c_custkey % 4 WHEN 0 THEN 'lrcdnp' WHEN 1 THEN 'bico' WHEN 2 THEN 'bi' ELSE 'unknown' END AS envelope, CASE WHEN c_custkey % 4 <> 3 THEN lpad(c_custkey::VARCHAR, 7, '0') || 'ZZ0000Z0001AB' END AS reference,
 CASE WHEN c_custkey % 4 <> 3 THEN 'P' || (c_custkey % 9) END AS floor, CASE WHEN c_custkey % 4 <> 3 THEN c_custkey / 8 END AS coefficient, CASE WHEN c_custkey % 4 <> 3 THEN (1900 + c_custkey % 120)::INT END AS year_built, CASE WHEN c_custkey % 4 = 3 THEN 'no ' || c_custkey END AS error FROM customer""")
def registry_cadastre_units(spark, d):
    """A unit a customer: in a list, alone in each envelope, or an error."""
    rc = "concat('\"rc\": {\"pc1\": \"', lpad(c_custkey, 7, '0'), '\", \"pc2\": \"ZZ0000Z\", \"car\": \"0001\", \"cc1\": \"A\", \"cc2\": \"B\"}')"
    facts = "concat('\"debi\": {\"cpt\": \"', replace(CAST(CAST(c_custkey / 8 AS DECIMAL(18,3)) AS STRING), '.', ','), '\", \"ant\": \"', 1900 + c_custkey % 120, '\"}')"
    floor = "concat('{\"lourb\": {\"loint\": {\"pt\": \"P', c_custkey % 9, '\"}}}')"
    body = (
        f"CASE c_custkey % 4 WHEN 0 THEN concat('{{\"consulta_dnprcResult\": {{\"lrcdnp\": {{\"rcdnp\": [{{', {rc}, ', ', {facts}, ', \"dt\": {{\"locs\": {{\"lous\": ', {floor}, '}}}}}}]}}}}}}')"
        f" WHEN 1 THEN concat('{{\"consulta_dnp\": {{\"bico\": {{\"bi\": {{\"idbi\": {{', {rc}, '}}, ', {facts}, ', \"dt\": ', {floor}, '}}}}}}}}') WHEN 2 THEN concat('{{\"bi\": {{', {rc}, ', ', {facts}, ', \"dt\": ', {floor}, '}}}}')"
        " ELSE concat('{\"consulta\": {\"lerr\": [{\"cod\": \"1\", \"des\": \"no ', c_custkey, '\"}]}}') END"
    )
    out = registry.cadastre_units(_bodies(spark, d, "customer", "c_custkey", body))
    return out.select("key", "envelope", "reference", "floor", F.col("coefficient").cast("double").alias("coefficient"), "year_built", "error")


@bound("""
SELECT c_custkey AS key, c_custkey % 5 IN (0, 1) AS matched, CASE c_custkey % 5 WHEN 0 THEN 'IDENTIFICADO' WHEN 1 THEN 'IDENTIFICADO' WHEN 2 THEN 'NO IDENTIFICADO-SIMILAR' END AS result,
 CASE c_custkey % 5 WHEN 1 THEN 2 WHEN 0 THEN 1 WHEN 2 THEN 1 ELSE 0 END AS own_rows, CASE WHEN c_custkey % 5 = 3 THEN 1 ELSE 0 END AS other_rows, CASE WHEN c_custkey % 5 = 4 THEN 'bad ' || c_custkey END AS fault FROM customer""")
def registry_census(spark, d):
    def person(number, result):
        return f"'<Contribuyente><Nif>', {number}, '</Nif><Nombre>x</Nombre><Resultado>{result}</Resultado></Contribuyente>'"

    own = "concat('b-', lpad(c_custkey, 8, '0'))"
    body = (
        f"concat('<?xml version=\"1.0\"?><e:Envelope xmlns:e=\"u\"><e:Body>', IF(c_custkey % 5 = 4, concat('<e:Fault><faultstring>bad ', c_custkey, '</faultstring></e:Fault>'), concat('<VNifV2Sal xmlns=\"v\">', CASE c_custkey % 5 WHEN 0 THEN concat({person(own, 'Identificado')})"
        f" WHEN 1 THEN concat({person(own, 'NO IDENTIFICADO')}, {person(own, 'IDENTIFICADO')}) WHEN 2 THEN concat({person(own, 'No identificado - similar')}) ELSE concat({person(repr('Z1'), 'IDENTIFICADO')}) END, '</VNifV2Sal>')), '</e:Body></e:Envelope>')"
    )
    out = registry.census(_bodies(spark, d, "customer", "c_custkey", body, "concat('B', lpad(c_custkey, 8, '0')) AS nif"))
    return out.select("key", "matched", "result", F.col("rows").alias("own_rows"), "other_rows", "fault")


@bound("""
SELECT c_custkey AS key, 'POU ' || upper(translate(c_custkey::VARCHAR, '0123456789', 'bcfgjkmpqz')) AS surname, CASE c_custkey % 3 WHEN 0 THEN (c_custkey + 1) / 100 WHEN 1 THEN c_custkey / 8000 END AS per_mille, CASE c_custkey % 3 WHEN 0 THEN 'published_rate' WHEN 1 THEN 'count_over_population' ELSE 'not_read' END AS basis FROM customer""")
def registry_surnames(spark, d):
    own = f"concat('{{\"cognom\": \"Pou  ', {_LETTERS.format('c_custkey')}, '\", ', CASE c_custkey % 3 WHEN 0 THEN concat('\"per_mil\": ', CAST((c_custkey + 1) / 100 AS DECIMAL(18,2))) WHEN 1 THEN concat('\"nombre\": \"', c_custkey, '\"') ELSE '\"x\": 1' END, '}}')"
    body = f"concat('{{\"onomastica\": {{\"ff\": [{{\"cognom\": \"Altre\", \"per_mil\": 9.5}}, ', {own}, ']}}}}')"
    out = registry.surnames(_bodies(spark, d, "customer", "c_custkey", body, f"concat('pou ', {_LETTERS.format('c_custkey')}) AS surname"))
    return out.select("key", "surname", F.col("per_mille").cast("double").alias("per_mille"), "basis")


@bound("""
SELECT s_suppkey AS key, CASE WHEN s_suppkey % 5 < 3 THEN true WHEN s_suppkey % 5 = 3 THEN false END AS registered, CASE WHEN s_suppkey % 5 < 3 THEN '09/08/' || lpad(s_suppkey::VARCHAR, 7, '0') END AS number, CASE WHEN s_suppkey % 5 < 2 THEN s_name END AS name,
 CASE WHEN s_suppkey % 5 < 3 THEN 'Cataluña' END AS community, CASE WHEN s_suppkey % 5 < 3 THEN make_date(2000 + s_suppkey % 20, 5, s_suppkey % 28 + 1) END AS valid_from, CASE s_suppkey % 5 WHEN 0 THEN 'Inscrita' WHEN 1 THEN 'Acreditada' WHEN 2 THEN 'La empresa está inscrita en el registro.' WHEN 3 THEN 'No existe ningún registro.' END AS status,
 CASE WHEN s_suppkey % 5 = 0 THEN s_suppkey % 3 + 1 WHEN s_suppkey % 5 < 3 THEN 1 ELSE 0 END AS entries FROM supplier""", text="valid_from")
def registry_builders(spark, d):
    """A page a supplier: a table with headings and one to three rows, pairs, prose, not found, and a page that says nothing."""
    number, day = "concat('09/08/', lpad(s_suppkey, 7, '0'))", "concat(s_suppkey % 28 + 1, '/05/', 2000 + s_suppkey % 20)"
    heads = "<tr><th>N&ordm; REA</th><th>Raz&oacute;n social<th>NIF</th><th>Comunidad Aut&oacute;noma</th><th>Fecha de alta</th><th>Estado</th></tr>"
    row = f"concat('<tr><td>', {number}, '</td><td><b>', s_name, '</b></td><td>a 1</td><td>Catalu&ntilde;a</td><td>', {day}, '<td>Inscrita</td></tr>', repeat('<tr><td>2</td><td>other</td></tr>', CAST(s_suppkey % 3 AS INT)))"
    pairs = f"concat('<tr><td>N&uacute;m. REA</td><td>', {number}, '</td></tr><tr><td>Empresa</td><td>', s_name, '</td></tr><tr><td>CCAA</td><td>Catalunya</td></tr><tr><td>Desde</td><td>', {day}, '</td></tr><tr><td>Estado</td><td>Acreditada</td></tr>')"
    body = (
        f"concat('<html><script>var a = \"<td>\";</script><p>Consulta</p>', CASE s_suppkey % 5 WHEN 0 THEN concat('<table class=\"c\" id=\"tabla-consulta\">{heads}', {row}, '</table>') WHEN 1 THEN concat('<table id=tabla-consulta>', {pairs}, '</table>')"
        f" WHEN 2 THEN concat('<p>La empresa est&aacute; inscrita en el registro. N&uacute;mero ', {number}, ', Catalunya, ', {day}, '.</p>') WHEN 3 THEN '<p>No existe ning&uacute;n registro.</p>' ELSE '<form>x</form>' END, '</html>')"
    )
    out = registry.builders(_bodies(spark, d, "supplier", "s_suppkey", body))
    return out.select("key", "registered", "number", "name", "community", "valid_from", "status", "entries")
