"""Names, places, parameters, ledgers, merged readings, stored documents and facts of parties, each beside DuckDB's SQL."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from tallyline.functions import persons, places
from tallyline.plans import custody, evidence, setup
from tallyline.plans.bindings import MONEY, bound, lines, orders, table
from tallyline.plans.bindings_functions import _invoices, pick, pick_sql
from tallyline.plans.domain import tables, with_tables

#: (name as written, given, first surname, second surname, order)
_NAMES = [
    ("Puig Soler, Maria dels Àngels", "MARIA ANGELS", "PUIG", "SOLER", "surnames_first"), ("Josep Maria Vila de la Roca", "JOSEP MARIA", "VILA", "ROCA", "given_first"), ("Ferrer Mas Jordi", "JORDI", "FERRER", "MAS", "surnames_first"),
    ("Kim Lee Park Choi", "KIM LEE", "PARK", "CHOI", "given_first"), ("Kim Park", "KIM", "PARK", "", "given_first"), ("Anna", "ANNA", "", "", "given_first"), ("", "", "", "", "given_first"), ("Font i Pla Joan Carles", "JOAN CARLES", "FONT", "PLA", "surnames_first"),
]
_GIVEN = [("Pep", "JOSE"), ("  Núria", "NURIA"), ("Xavi", "JAVIER"), ("Zoltan", "ZOLTAN"), ("Anna", "ANA")]
_BUSINESS = [("Obres Vila S.L.", True), ("Maria Vila", False), ("Ajuntament de Vic", True), ("Fontaneria Pou", True), ("Salvador Coll", False), ("Electricitat Riu", True), (None, False)]


@bound(f"""
SELECT c_custkey, {pick_sql("c_custkey", [n[1] for n in _NAMES])} AS given, {pick_sql("c_custkey", [n[2] for n in _NAMES])} AS surname1, {pick_sql("c_custkey", [n[3] for n in _NAMES])} AS surname2, {pick_sql("c_custkey", [n[4] for n in _NAMES])} AS reading,
 {pick_sql("c_custkey", [g[1] for g in _GIVEN])} AS canonical FROM customer""")
def fn_person_names(spark, d):
    """Names by construction: each order of given names and surnames."""
    n = persons.split_name(pick("c_custkey", [x[0] for x in _NAMES]))
    return table(spark, d, "customer").select("c_custkey", n["given"].alias("given"), n["surname1"].alias("surname1"), n["surname2"].alias("surname2"), n["order"].alias("reading"), persons.canonical_given(pick("c_custkey", [g[0] for g in _GIVEN])).alias("canonical"))


@bound(f"""
WITH b AS (SELECT s_suppkey, ([{", ".join(str(b[1]).lower() for b in _BUSINESS)}])[(s_suppkey % {len(_BUSINESS)}) + 1] AS business, s_suppkey % {len(_BUSINESS)} = 6 AS nameless FROM supplier)
SELECT s_suppkey, business, NOT nameless AND (s_suppkey % 4 = 1 OR NOT (business OR s_suppkey % 4 = 2)) AS person FROM b""")
def fn_businesses(spark, d):
    name = pick("s_suppkey", [b[0] for b in _BUSINESS])
    flags, kind = F.when(F.col("s_suppkey") % 4 == 1, F.array(F.lit("person_beneficiary"))), F.when(F.col("s_suppkey") % 4 == 2, "vendor")
    return table(spark, d, "supplier").select("s_suppkey", persons.looks_like_business(name).alias("business"), persons.is_person(name, kind, flags).alias("person"))


#: (label, floor, door), the last two in one spelling
_UNITS = [("Pral. 1a", "PR", "1"), ("Baixos", "BJ", None), ("4t 1a (esc. B)", "4", "1"), ("Esc. A 2n Dreta", "2", "DR"), ("Pis 03, porta 02", "3", "2"), ("Àtic izq.", "AT", "IZ"), ("Sòt. C", "ST", "C"), ("00/A", "BJ", "A"), ("", None, None)]


@bound(f"SELECT c_custkey, {pick_sql('c_custkey', [u[1] for u in _UNITS])} AS floor, {pick_sql('c_custkey', [u[2] for u in _UNITS])} AS door FROM customer")
def fn_floors_and_doors(spark, d):
    u = places.split_label(pick("c_custkey", [x[0] for x in _UNITS]))
    return table(spark, d, "customer").select("c_custkey", places.floor(u["floor"]).alias("floor"), places.door(u["door"]).alias("door"))


#: (path, type in JSON, path in one form, kind)
_PATHS = [
    ("lineas.0.base", "number", "lineas[0].base", "amount"), (" lineas[ 12 ].orden", "number", "lineas[12].orden", "int"), ("emisor.nif", "string", "emisor.nif", "nif"), ("iban_mostrado", "string", "iban_mostrado", "iban"),
    ("fecha_expedicion", "string", "fecha_expedicion", "date"), ("hasta", "string", "hasta", "date"), ("es_partida_alzada", "boolean", "es_partida_alzada", "bool"), ("total_factura", "null", "total_factura", "amount"), ("concepto", "null", "concepto", "text"), ("plazo_meses", "number", "plazo_meses", "int"),
]


@bound(f"SELECT p_partkey, {pick_sql('p_partkey', [p[2] for p in _PATHS])} AS path, {pick_sql('p_partkey', [p[3] for p in _PATHS])} AS kind, p_partkey % {len(_PATHS)} = 0 AS is_base FROM part")
def fn_field_paths(spark, d):
    path = places.field_path(pick("p_partkey", [p[0] for p in _PATHS]))
    return table(spark, d, "part").select("p_partkey", path.alias("path"), places.field_kind(path, pick("p_partkey", [p[1] for p in _PATHS])).alias("kind"), places.path_matches("lineas[*].base", path).alias("is_base"))


@bound("""
WITH l AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN -l_extendedprice ELSE l_extendedprice END::DECIMAL(18,2) AS v FROM lineitem), t AS (SELECT l_orderkey, v, row_number() OVER (PARTITION BY l_orderkey ORDER BY abs(v) DESC, l_linenumber) AS n FROM l)
SELECT l_orderkey, v AS approved, CASE WHEN l_orderkey % 8 < 6 THEN (abs(v) * 4 / 100)::DECIMAL(18,2) END AS tax FROM t WHERE n = 1""", double="approved tax")
def fn_approved_amounts(spark, d):
    signed = F.when(F.col("l_linenumber") % 2 == 0, -F.col("amount")).otherwise(F.col("amount"))
    x = lines(spark, d).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", signed.alias("v")))).alias("a"))
    best = setup.approved_amount(F.transform("a", lambda s: s["v"]))
    return x.select("l_orderkey", best.alias("approved"), setup.expected_works_tax(F.abs(best), 2021 + F.col("l_orderkey") % 8).alias("tax"))


@bound("""
WITH i AS (SELECT n_nationkey AS n, sum(CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice::DECIMAL(18,2) ELSE 0 END) AS w, sum(CASE WHEN o_orderkey % 2 = 1 THEN o_totalprice::DECIMAL(18,2) ELSE 0 END) AS o FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1),
p AS (SELECT n, w, o, (w * 0.01)::DECIMAL(18,2) AS pm FROM i)
SELECT n AS community_id, k.key, CASE k.key WHEN 'pm_works' THEN pm WHEN 'pm_ordinary' THEN (o * 0.05)::DECIMAL(18,2) WHEN 'trivial_floor' THEN greatest((pm * 0.1)::DECIMAL(18,2), 200) WHEN 'funding_gap_min' THEN greatest(5000, (w * 0.1)::DECIMAL(18,2)) ELSE k.v END AS value_num, k.day AS valid_from, k.version
FROM p CROSS JOIN (VALUES ('pm_works', 0, '1900-01-01', 1), ('pm_ordinary', 0, '1900-01-01', 1), ('trivial_floor', 0, '1900-01-01', 1), ('outflow_min', 300, '1900-01-01', 1), ('authority_threshold', 1000, '1900-01-01', 1), ('funding_gap_min', 0, '1900-01-01', 1),
 ('upfront_max_pct_obra', 40, '1900-01-01', 1), ('upfront_max_pct_ascensor', 60, '1900-01-01', 1), ('cash_limit', 2500, '1900-01-01', 1), ('cash_limit', 1000, '2021-07-11', 2), ('convene_days', 30, '1900-01-01', 1), ('ocr_min', 1000, '1900-01-01', 1)) k(key, v, day, version)""",
    double="value_num", text="valid_from")
def default_parameters(spark, d):
    o = orders(spark, d).join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    even = F.col("o_orderkey") % 2 == 0
    sums = o.groupBy(F.col("n_nationkey").alias("community_id")).agg(F.sum(F.when(even, F.col("amount")).otherwise(0)).alias("works_spend"), F.sum(F.when(~even, F.col("amount")).otherwise(0)).alias("ordinary_budget"))
    return setup.default_parameters(sums)


@bound("""
WITH u AS (SELECT c_custkey AS u, c_nationkey AS n, (c_custkey % 7 + 1)::DECIMAL(7,4) AS q FROM customer), a AS (SELECT n, sum(q) AS t FROM u GROUP BY 1),
r AS (SELECT s_suppkey AS d, s_nationkey AS n, s_suppkey % 3 AS c, s_suppkey % 4 + 1 AS m FROM supplier WHERE s_suppkey % 3 <> 2), e AS (SELECT *, unnest(range(m)) AS i FROM r)
SELECT d AS derrama_id, u AS unit_id, (DATE '1995-03-01' + to_months(i::INTEGER))::DATE AS period, CASE WHEN c = 0 THEN 25 ELSE round((1200.00 * q / t / m)::DECIMAL(28,8), 2) END AS expected FROM e JOIN u ON u.n = e.n JOIN a ON a.n = e.n""", double="expected", text="period")
def contribution_ledger(spark, d):
    k = F.col("s_suppkey")
    rules = table(spark, d, "supplier").select(
        k.alias("derrama_id"), F.col("s_nationkey").alias("community_id"), F.when(k % 3 == 0, "partes_iguales").when(k % 3 == 1, "coeficiente").alias("criterion"), F.lit("1200.00").cast(MONEY).alias("total"), F.when(k % 3 == 0, 25).alias("per_unit"),
        F.lit("1995-03-01").cast("date").alias("starts_on"), (k % 4 + 1).cast("int").alias("months"),
    )
    units = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("community_id"), (F.col("c_custkey") % 7 + 1).cast("decimal(7,4)").alias("quota"))
    classes = setup.contribution_classes(rules, units).withColumns({"period": F.col("period").cast("string"), "expected": F.col("expected").cast("double")})  # once for many rows
    return classes.select("derrama_id", F.inline("unit_ids"), "period", "expected")


@bound("""
WITH c AS (SELECT l_orderkey AS o, l_linenumber AS n, l_partkey AS p, l_suppkey AS q, CASE WHEN l_linenumber % 3 <> 0 THEN l_partkey || ',' || l_suppkey END AS a, CASE WHEN l_linenumber > 1 THEN l_linenumber || '/' || l_partkey END AS s FROM lineitem)
SELECT o AS l_orderkey, coalesce(string_agg(a, ',' ORDER BY n, p, q) FILTER (WHERE a IS NOT NULL), '') AS items, arg_min(s, (n, p, q)) FILTER (WHERE s IS NOT NULL) AS mode FROM c GROUP BY 1""")
def merge_chunks(spark, d):
    x = table(spark, d, "lineitem").select(
        "l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("at"), F.when(F.col("l_linenumber") % 3 != 0, F.array("l_partkey", "l_suppkey")).alias("items"),
        F.when(F.col("l_linenumber") > 1, F.concat_ws("/", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"))).alias("mode"),
    )
    return setup.merge_chunks(x, "l_orderkey", "at", ["items"]).select("l_orderkey", F.array_join("items", ",").alias("items"), "mode")


@bound("""
WITH x AS (SELECT l_orderkey AS k, l_extendedprice::DECIMAL(18,2) AS b, ([0, 4, 10, 21, 7])[(l_linenumber % 5) + 1] AS r FROM lineitem)
SELECT k::VARCHAR AS document_id, count(*)::BIGINT AS n, sum(b)::DECIMAL(18,2) AS base, sum((b * r * 0.01)::DECIMAL(18,2))::DECIMAL(18,2) AS vat, sum(b)::DECIMAL(18,2) + CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS stated FROM x GROUP BY k""", double="base vat stated")
def store_documents(spark, d):
    made = setup.store(_invoices(spark, d), "invoice")
    rows = made["invoice.lineas"].groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base").cast(MONEY)).cast(MONEY).alias("base"), F.sum(F.col("cuota_iva").cast(MONEY)).cast(MONEY).alias("vat"))
    return rows.join(made["invoice"].select("document_id", F.col("base_imponible_total").cast(MONEY).alias("stated")), "document_id")


@bound(with_tables("parties", "party_ibans", "invoices") + """,
i AS (SELECT community_id, vendor_party_id AS id, min(fecha_expedicion) AS first_invoice, count(*) AS n, sum(total) AS t, sum(total) FILTER (WHERE works_package_id IS NOT NULL) AS w, sum(total) FILTER (WHERE works_package_id IS NULL) AS o, count(DISTINCT numero::BIGINT) AS k FROM t_invoices GROUP BY ALL)
SELECT p.id, first_invoice, coalesce(n, 0)::BIGINT AS invoice_count, coalesce(t, 0) AS invoice_total, coalesce(w, 0) AS works_total, coalesce(o, 0) AS ordinary_total, coalesce(k, 0)::INTEGER AS numbers, iban_hmac AS accounts FROM t_parties p LEFT JOIN i USING (community_id, id) JOIN t_party_ibans b ON b.party_id = p.id""",
    double="invoice_total works_total ordinary_total", text="first_invoice")
def party_facts(spark, d):
    f = setup.party_facts(tables(spark, d))
    return f.select("id", "first_invoice", "invoice_count", "invoice_total", "works_total", "ordinary_total", F.size("numbers").alias("numbers"), F.array_join("iban_hmacs", ",").alias("accounts"))


@bound(with_tables("communities", "parameters", "bank_transactions", "documents", "invoices", "liquidation_lines", "recon_links") + """,
p AS (SELECT community_id AS c, key, arg_max(value_num, (version, valid_from)) AS v FROM t_parameters WHERE valid_from <= DATE '1998-09-01' GROUP BY ALL),
j AS (SELECT c, '[' || string_agg('{"key":"' || key || '","value":' || v::DECIMAL(20,4)::VARCHAR || '}', ',' ORDER BY key) || ']' AS parameters FROM p GROUP BY 1),
s AS (SELECT community_id AS c, 'bank_transactions' AS name, count(*) AS n FROM t_bank_transactions GROUP BY ALL UNION ALL SELECT community_id, 'documents', count(*) FROM t_documents GROUP BY ALL UNION ALL SELECT community_id, 'invoices', count(*) FROM t_invoices GROUP BY ALL
 UNION ALL SELECT community_id, 'liquidation_lines', count(*) FROM t_liquidation_lines GROUP BY ALL UNION ALL SELECT community_id, 'recon_links', count(*) FROM t_recon_links GROUP BY ALL),
h AS (SELECT c, sha256(string_agg(name || '=' || n, ',' ORDER BY name)) AS inputs_hash FROM s GROUP BY 1), f AS (SELECT community_id AS c, count(*) AS n, count(*) FILTER (WHERE right(id, 1) = '1') AS t1, count(*) FILTER (WHERE right(id, 1) <> '1') AS t2 FROM t_documents GROUP BY ALL)
SELECT id AS community_id, 'D1:2,E1:1' AS rule_versions, parameters, inputs_hash, coalesce(f.n, 0)::BIGINT AS findings, coalesce(t1, 0)::BIGINT AS t1, coalesce(t2, 0)::BIGINT AS t2, 0::BIGINT AS t3 FROM t_communities LEFT JOIN j ON j.c = id LEFT JOIN h ON h.c = id LEFT JOIN f ON f.c = id""")
def run_metadata(spark, d):
    t = tables(spark, d)
    found = t["documents"].select("community_id", F.when(F.right("id", F.lit(1)) == "1", "T1").otherwise("T2").alias("tier"))
    return setup.run_metadata(t, found, [("E1", "1"), ("D1", "2")], datetime.date(1998, 9, 1))


#: (marker, page, of, carry)
_MARKERS = [("Pàg. 1/3", 1, 3, False), ("2 de 3", 2, 3, False), ("Suma i segueix", None, None, True), ("full 4", 4, None, False), (None, None, None, False)]


@bound(f"""
WITH c AS (SELECT conv_id AS b, turn AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r, turn // 4 AS f, turn % 6 = 4 AS first, turn % 7 IN (2, 3) AS cont, CASE WHEN turn % 7 = 2 THEN 0.95 ELSE 0.5 END AS cc, turn % 5 AS m, CASE WHEN turn % 9 < 2 THEN 'a1' ELSE '' END AS h FROM conversations),
k AS (SELECT *, ([1, 2, NULL, 4, NULL])[m + 1] AS page, ([3, 3, NULL, NULL, NULL])[m + 1] AS tot, m = 2 AS carry FROM c),
p AS (SELECT *, lag(f) OVER w AS pf, lag(page) OVER w AS pp, lag(tot) OVER w AS pt, lag(carry) OVER w AS pc, lag(h) OVER w AS ph FROM k WINDOW w AS (PARTITION BY b ORDER BY n)),
s AS (SELECT *, coalesce(pf = f AND b % 2 = 0, false) AS same, cont AND cc >= 0.8 AS told, coalesce(h <> '' AND h = ph, false) AS num, coalesce(page = pp + 1 AND (pt IS NULL OR tot IS NULL OR pt = tot), false) OR coalesce(pc, false) AS chain FROM p)
SELECT b AS conv_id, n AS turn, CASE WHEN r = 1 THEN 'false' WHEN same AND first THEN 'open' ELSE (same OR told OR num OR chain)::VARCHAR END AS link,
 CASE WHEN r = 1 THEN 0 ELSE greatest(CASE WHEN same THEN 0.9 ELSE 0 END, CASE WHEN told THEN cc ELSE 0 END, CASE WHEN num THEN 0.85 ELSE 0 END, CASE WHEN chain THEN 0.9 ELSE 0 END) END::DOUBLE AS confidence FROM s""")
def page_links(spark, d):
    n = F.col("turn")
    c = table(spark, d, "conversations").select(
        F.col("conv_id").alias("batch"), n.alias("page_no"), F.floor(n / 4).alias("file_id"), (F.col("conv_id") % 2 == 0).alias("is_pdf"), F.when(n % 6 == 4, "first").otherwise("inner").alias("role"), (n % 7).isin(2, 3).alias("continues"),
        F.when(n % 7 == 2, 0.95).otherwise(0.5).alias("continues_confidence"), F.when(n % 9 < 2, "A-1").alias("number_hint"), F.lit("Obres, SL").alias("issuer_hint"), pick("turn", [m[0] for m in _MARKERS]).alias("marker"),
    )
    out = evidence.page_links(c)
    return out.select(F.col("batch").alias("conv_id"), F.col("page_no").alias("turn"), F.coalesce(F.col("link").cast("string"), F.lit("open")).alias("link"), "confidence")


_TREE = "{0}(lvl, i, n, h) AS (SELECT 0, row_number() OVER (ORDER BY place, id NULLS FIRST, h) - 1, count(*) OVER (), h FROM {1} UNION ALL SELECT lvl + 1, i // 2, any_value((n + 1) // 2), sha256(unhex(arg_min(h, i)) || unhex(arg_max(h, i))) FROM {0} WHERE n > 1 GROUP BY lvl, i // 2)"


@bound(f"""
WITH RECURSIVE f AS (SELECT 0 AS place, doc_id::VARCHAR AS id, sha256('files:' || sha256(coalesce(text, ''))) AS h FROM documents), g AS (SELECT 2 AS place, event_id::VARCHAR AS id, sha256('field_revisions:' || sha256(event_type || '|' || coalesce(props, ''))) AS h FROM events),
{_TREE.format("a", "f")}, l AS (SELECT -1 AS place, NULL AS id, sha256('previous_root:' || h) AS h FROM a WHERE n = 1 UNION ALL SELECT * FROM f UNION ALL SELECT * FROM g), {_TREE.format("b", "l")}
SELECT 'files' AS source, id, (SELECT h FROM a WHERE n = 1) AS first_root, (SELECT h FROM b WHERE n = 1) AS root, true AS verified FROM f""")
def custody_chain(spark, d):
    """Two anchors, the second chained to the first, and the proof of each document in the second, folded again."""
    files = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("row_hash"))
    revisions = table(spark, d, "events").select(F.col("event_id").cast("string").alias("id"), F.sha2(F.concat_ws("|", "event_type", F.coalesce("props", F.lit(""))), 256).alias("row_hash"))
    first = custody.anchor({"files": files})
    second = custody.anchor({"files": files, "field_revisions": revisions}, first.root)
    found = custody.proofs(second, files.select(F.lit("files").alias("source"), "id"))
    return found.select("source", "id", F.lit(first.root).alias("first_root"), custody.folded(F.col("h"), F.col("path")).alias("root"), (custody.folded(F.col("h"), F.col("path")) == second.root).alias("verified"))


_VARIANTS = [(name, group[0]) for group in persons.GIVEN_NAMES for name in group]
#: A text for each pattern: its endings left out, its dots and middle dots kept.
_SAMPLES = [p.replace(r"\w*", "").replace(r"\.?", ".").replace(r"\s?", "").replace("·?", "·") for p in persons.BUSINESS_PATTERNS]
_WORD = "upper(translate(CAST(c_custkey AS VARCHAR(20)), '0123456789', 'bcfgjkmpqz'))"


def _pick(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


@bound(f"""
WITH x AS (SELECT c_custkey, ({_pick(v for v, _ in _VARIANTS)})[c_custkey % {len(_VARIANTS)} + 1] AS given, ({_pick(c for _, c in _VARIANTS)})[c_custkey % {len(_VARIANTS)} + 1] AS canonical, c_mktsegment AS surname1, 'XQ' || {_WORD} AS surname2, c_custkey % 7 % 3 AS f FROM customer)
SELECT c_custkey, given, surname1, surname2, CASE f WHEN 0 THEN 'given_first' ELSE 'surnames_first' END AS reading, canonical FROM x""")
def fn_given_names(spark, d):
    """Every variant of every given name, before and behind two surnames made of a customer's row."""
    c = table(spark, d, "customer")
    given = F.initcap(F.get(F.array(*(F.lit(v) for v, _ in _VARIANTS)), (F.col("c_custkey") % len(_VARIANTS)).cast("int")))
    surnames = F.concat(F.initcap("c_mktsegment"), F.lit("  Xq"), F.lower(F.expr(_WORD)))
    form = F.col("c_custkey") % 7 % 3
    name = F.when(form == 0, F.concat(given, F.lit(" "), surnames)).when(form == 1, F.concat(surnames, F.lit(", "), given)).otherwise(F.concat(surnames, F.lit(" de "), given))
    rows = c.select("c_custkey", persons.split_name(name).alias("n"))
    return rows.select("c_custkey", "n.given", "n.surname1", "n.surname2", F.col("n.order").alias("reading"), persons.canonical_given(F.col("n.given")).alias("canonical"))


@bound(f"""
WITH x AS (SELECT c_custkey, ({_pick(_SAMPLES)})[c_custkey % {len(_SAMPLES)} + 1] AS s, c_custkey % 3 AS f FROM customer)
SELECT c_custkey, CASE f WHEN 0 THEN true WHEN 1 THEN true ELSE s NOT SIMILAR TO '[a-z·]*' END AS business FROM x""")
def fn_business_words(spark, d):
    """Every pattern that tells a business, first, last, and grown together with letters, which makes a word of it no more."""
    c = table(spark, d, "customer")
    s = F.get(F.array(*map(F.lit, _SAMPLES)), (F.col("c_custkey") % len(_SAMPLES)).cast("int"))
    word = F.lower(F.expr(_WORD))
    dotted = ~s.rlike("^[a-z·]*$")
    name = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("Xq"), word, F.lit(" "), F.upper(s))).when(F.col("c_custkey") % 3 == 1, F.concat(F.initcap(s), F.lit(" Xq"), word)).when(dotted, F.concat(word, F.lit(", "), s)).otherwise(F.concat(F.lit("xq"), s, word))
    return c.select("c_custkey", persons.looks_like_business(name).alias("business"))
