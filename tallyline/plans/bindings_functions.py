"""The function library, document checks, evidence and vendor signals over the driver's tables, each beside DuckDB's SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from tallyline.functions import amounts, classify, dates, hashing, ids, similarity, text
from tallyline.operators import ordered, scoring
from tallyline.plans import evidence, pricing, validators, vendor_links
from tallyline.plans.bindings import bound, lines, orders, table


def pick(key: str, options: list[str]):
    """The option whose place is key modulo their number."""
    return F.element_at(F.array(*map(F.lit, options)), (F.col(key) % len(options) + 1).cast("int"))


def pick_sql(key: str, options: list) -> str:
    cells = ", ".join("NULL" if o is None else "'" + str(o).replace("'", "''") + "'" for o in options)
    return f"([{cells}])[({key} % {len(options)}) + 1]"


# ---- text


@bound("""
WITH t AS (SELECT doc_id, replace(text, 'ß', 's') AS text FROM documents)
SELECT doc_id, md5(strip_accents(text)) AS plain, md5(regexp_replace(upper(strip_accents(coalesce(text, ''))), '[^A-Z0-9]', '', 'g')) AS ref, md5(trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g'))) AS folded FROM t""")
def fn_text_folding(spark, d):
    """Whole texts, but for a letter whose capital the two engines write differently."""
    t = table(spark, d, "documents").withColumn("text", F.replace("text", F.lit("ß"), F.lit("s")))
    return t.select("doc_id", F.md5(text.strip_diacritics(F.col("text"))).alias("plain"), F.md5(text.norm_ref(F.col("text"))).alias("ref"), F.md5(text.fold(F.col("text"), "lower", "a-z0-9")).alias("folded"))


_PEOPLE = ["  José  de la Peña i Vidal", "Mª. Àngels d'Ors", "PAU GAL·LES VON BRAUN", "Núria del Río", "o'neill, john"]
_PEOPLE_OUT = ["JOSE PENA VIDAL", "M ANGELS ORS", "PAU GALLES BRAUN", "NURIA RIO", "O NEILL JOHN"]
_FIRMS = ["Obres i Reformes Núñez, S.L.", "Ascensors Prat S.A.U.", "Grup Serveis S.L.", "Fontaneria d'Urgell SCP", "R. & J. Instal·lacions, Societat Limitada"]
_FIRMS_OUT = ["NUNEZ", "PRAT", "GRUP SERVEIS", "FONTANERIA URGELL", "RJ"]


@bound(f"SELECT c_custkey, {pick_sql('c_custkey', _PEOPLE_OUT)} AS person, {pick_sql('c_custkey', _FIRMS_OUT[:4])} AS firm, c_custkey % 5 IN (0, 1, 3) AS looks FROM customer")
def fn_names(spark, d):
    """Names by construction: each form beside what the specification makes of it."""
    c = table(spark, d, "customer")
    looks = classify.person_name(pick("c_custkey", ["Maria Pujol Serra", "ANNA O'NEILL", "Ascensors Prat", "Jordi Vila-Roca Mas", "Vila 23 Bis"]))
    return c.select("c_custkey", text.norm_name(pick("c_custkey", _PEOPLE)).alias("person"), text.norm_company(pick("c_custkey", _FIRMS[:4])).alias("firm"), looks.alias("looks"))


@bound("""
SELECT o_orderkey, 'F' AS series, o_orderkey::DECIMAL(38,0)::VARCHAR AS number, CASE WHEN o_orderkey % 2 = 0 THEN 'A' ELSE '' END AS suffix, 'F-' || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN '-A' ELSE '' END AS canonical,
 'B' || lpad(o_custkey::VARCHAR, 8, '0') || '|SF|' || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN 'A' ELSE '' END || '|' || (o_totalprice::DECIMAL(18,2))::VARCHAR || '|' || (o_orderdate::DATE)::VARCHAR AS twin_key,
 'fra ' || lpad(o_orderkey::VARCHAR, 12, '0') || ' de ' || lpad(o_custkey::VARCHAR, 12, '0') AS sort_key, o_orderkey::BIGINT AS trailing FROM orders""")
def fn_invoice_numbers(spark, d):
    o = orders(spark, d)
    number = F.concat(F.lit(" f - "), F.lpad(F.col("o_orderkey").cast("string"), 10, "0"), F.when(F.col("o_orderkey") % 2 == 0, "/a").otherwise(""))
    n = text.invoice_number(number)
    twin = hashing.document_key(F.concat(F.lit("b-"), F.lpad(F.col("o_custkey").cast("string"), 8, "0")), F.lit("s"), number, amounts.format_amount(F.col("amount")), F.date_format("day", "dd/MM/yyyy"))
    trailing = F.regexp_extract(F.concat(F.lit("N "), "o_orderkey", F.lit(" ")), r"(\d+)\s*$", 1).cast("bigint")
    key = text.natural_key(F.concat(F.lit("Fra "), "o_orderkey", F.lit(" de "), "o_custkey"))
    return o.select("o_orderkey", n["series"].alias("series"), n["number"].cast("string").alias("number"), n["suffix"].alias("suffix"), n["canonical"].alias("canonical"), twin.alias("twin_key"), key.alias("sort_key"), trailing.alias("trailing"))


_STEM = "list_transform(list_filter(string_split(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: CASE WHEN length({1}) > 4 THEN regexp_replace({1}, '[ao]$', '') ELSE {1} END)"
_CUT = "(CASE WHEN length(w) > 5 AND ends_with(w, 'es') THEN left(w, -2) WHEN length(w) > 4 THEN regexp_replace(w, 's$', '') ELSE w END)"


@bound(f"""
WITH p AS (SELECT p_partkey, p_name, p_type, {_STEM.format("p_name || ' baldosas canales'", _CUT)} AS t FROM part)
SELECT p_partkey, array_to_string(t, ' ') AS stems, contains(' ' || array_to_string(t, ' ') || ' ', ' baldos canal ') AS hit, round(1 - levenshtein(p_name, p_type)::DOUBLE / greatest(length(p_name), length(p_type)), 9) AS edits,
 round(jaro_winkler_similarity(p_name, left(p_name, length(p_name) - 2) || 'zz'), 9) AS jaro FROM part JOIN p USING (p_partkey, p_name, p_type)""")
def fn_matching(spark, d):
    p = table(spark, d, "part").withColumn("t", text.tokens(F.concat("p_name", F.lit(" Baldosas  Canales"))))
    near = F.concat(F.expr("left(p_name, length(p_name) - 2)"), F.lit("zz"))
    return p.select(
        "p_partkey", F.array_join("t", " ").alias("stems"), text.keyword_hits(F.col("t"), text.tokens(F.lit("baldosa canal"))).alias("hit"), F.round(text.levenshtein_similarity(F.col("p_name"), F.col("p_type")), 9).alias("edits"),
        F.round(similarity.jaro_winkler_similarity(F.col("p_name"), near), 9).alias("jaro"),
    )


@bound("SELECT o_orderkey, 'vist [citation withheld] i ' || o_orderkey AS cited, contains(o_orderpriority || ' fra F' || o_orderkey, 'F' || o_orderkey) AND length('F' || o_orderkey) >= 3 OR length(o_orderkey::VARCHAR) >= 3 AS named FROM orders")
def fn_citations_and_references(spark, d):
    o = orders(spark, d)
    cited = text.withhold_citations(F.concat(F.lit("vist Article 553.2 de la Llei i "), "o_orderkey"))
    named = text.reference_in_text(F.lit("F"), F.col("o_orderkey").cast("string"), F.concat("o_orderpriority", F.lit(" fra. f-"), "o_orderkey"))
    return o.select("o_orderkey", cited.alias("cited"), named.alias("named"))


# ---- amounts and dates


@bound("""
WITH o AS (SELECT *, o_totalprice::DECIMAL(18,2) AS v, o_custkey % 50 AS r FROM orders)
SELECT o_orderkey, replace(replace(replace(format('{:,}', (v * 100)::BIGINT // 100), ',', '.') || ',' || lpad(((v * 100)::BIGINT % 100)::VARCHAR, 2, '0'), ' ', ''), ' ', '') AS printed, v AS parsed, CASE WHEN o_orderkey % 2 = 0 THEN -v ELSE v END AS signed,
 CASE WHEN o_orderkey % 3 = 0 THEN 1.234 ELSE v END AS legacy, CASE WHEN o_orderkey % 3 = 0 THEN 1234 ELSE v END AS current, (v * 100)::BIGINT AS cents, o_custkey * 50 >= 500 AND o_custkey % 2 = 0 AS is_round,
 abs(v - (v + (o_orderkey % 4) / 100.0)::DECIMAL(18,2)) <= 0.02 AS close, r * 1.0 / greatest(100, 100 + r) * 100 <= 20 AS close_pct, v - CASE WHEN r > 0 THEN r WHEN o_orderkey % 5 = 0 THEN 0 ELSE (v * 15 / 100)::DECIMAL(18,2) END AS net,
 (o_orderkey * 3.0 + o_custkey * 15.0 + 10 * 0.3) / 1000000 AS cost FROM o""", double="parsed signed legacy current net cost")
def fn_amounts(spark, d):
    o = orders(spark, d).withColumn("r", F.col("o_custkey") % 50)
    v, third = F.col("amount"), F.col("o_orderkey") % 3 == 0
    printed = amounts.format_amount(v)
    due = amounts.payable(v, F.col("r").cast("decimal(18,2)"), F.when(F.col("o_orderkey") % 5 != 0, 15))
    return o.select(
        "o_orderkey", printed.alias("printed"), amounts.parse_amount(F.concat(printed, F.lit(" €"))).alias("parsed"),
        amounts.parse_amount(F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("("), printed, F.lit(")"))).when(F.col("o_orderkey") % 2 == 0, F.concat(printed, F.lit("-"))).otherwise(F.concat(F.lit("EUR "), printed))).alias("signed"),
        amounts.parse_amount(F.when(third, "1.234").otherwise(printed), legacy=True).alias("legacy"), amounts.parse_amount(F.when(third, "1.234").otherwise(printed)).alias("current"),
        amounts.cents(v).alias("cents"), amounts.is_round(F.col("o_custkey") * 50).alias("is_round"), amounts.within(v, v + (F.col("o_orderkey") % 4 / 100).cast("decimal(18,2)"), 0.02).alias("close"),
        amounts.within_pct(F.lit(100), 100 + F.col("r"), 20).alias("close_pct"), F.element_at(due, -1).alias("net"), amounts.token_cost(F.col("o_orderkey"), F.col("o_custkey"), F.lit(10), 3.0, 15.0, 0.3).alias("cost"),
    )


_MONTHS = ["gener", "febrer", "marc", "abril", "maig", "juny", "juliol", "agost", "setembre", "octubre", "novembre", "desembre"]


@bound(f"""
WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE d END AS parsed, CASE WHEN month(d) >= 4 THEN year(d) + 1 ELSE year(d) END::INTEGER AS fiscal, year(d)::INTEGER AS plain_year,
 CASE o_orderkey % 3 WHEN 0 THEN make_date(2021, month(d), 1) WHEN 1 THEN make_date(year(d), month(d), 1) ELSE date_trunc('month', d)::DATE END AS period, round((DATE '2000-01-01' - d) / 30.4375, 6) AS months,
 CASE WHEN o_orderkey % 31 < 28 THEN make_date(1990, 2, (o_orderkey % 31 + 1)::INTEGER) END AS calendar, CASE WHEN o_orderkey % 100 < 70 THEN 2000 ELSE 1900 END::INTEGER + (o_orderkey % 100)::INTEGER AS full_year,
 (DATE '1998-01-01' - d) BETWEEN -5 AND 120 AS in_window, (d + INTERVAL 3 MONTH)::DATE AS short, (d + INTERVAL 12 MONTH)::DATE AS long FROM o""", text="parsed period calendar short long")
def fn_dates(spark, d):
    o = orders(spark, d)
    k, day = F.col("o_orderkey"), F.col("day")
    month = F.element_at(F.array(*map(F.lit, _MONTHS)), F.month("day"))
    written = F.when(k % 4 == 0, F.date_format("day", "dd/MM/yyyy")).when(k % 4 == 1, day.cast("string")).when(k % 4 == 2, F.concat(F.dayofmonth("day"), F.lit(" de "), month, F.lit(" del "), F.year("day"))).otherwise("30/02/2020")
    concept = F.when(k % 3 == 0, F.concat(F.lit("quota "), F.date_format("day", "MM"), F.lit("/2021"))).when(k % 3 == 1, F.concat(F.lit("quota "), month)).otherwise("transferencia")
    w = dates.challenge_windows(F.when(k % 2 == 0, day), day)
    return o.select(
        "o_orderkey", dates.parse_date(written).alias("parsed"), dates.fiscal_year(day, 4).alias("fiscal"), dates.fiscal_year(day).alias("plain_year"), dates.period_for_credit(day, concept).alias("period"),
        F.round(dates.months_between(day, F.lit("2000-01-01").cast("date")), 6).alias("months"), dates.calendar_date(F.lit(1990), F.lit(2), k % 31 + 1).alias("calendar"), dates.full_year(F.lpad((k % 100).cast("string"), 2, "0")).alias("full_year"),
        dates.in_payment_window(day, F.lit("1998-01-01").cast("date")).alias("in_window"), w["short"].alias("short"), w["long"].alias("long"),
    )


# ---- identifiers and hashes


def _ccc_sql(digits: str) -> str:
    total = " + ".join(f"substr({digits}, {i + 1}, 1)::INTEGER * {2**i % 11}" for i in range(10))
    return f"(CASE 11 - ({total}) % 11 WHEN 11 THEN 0 WHEN 10 THEN 1 ELSE 11 - ({total}) % 11 END)::VARCHAR"


_IBAN = "bank || c1 || c2 || acc"


@bound(f"""
WITH b AS (SELECT c_custkey, lpad((c_custkey * 7919 % 100000000)::VARCHAR, 8, '0') AS bank, lpad((c_custkey * 104729 % 10000000000)::VARCHAR, 10, '0') AS acc FROM customer),
k AS (SELECT *, {_ccc_sql("('00' || bank)")} AS c1, {_ccc_sql("acc")} AS c2 FROM b),
n AS (SELECT *, 'ES' || lpad((98 - (({_IBAN} || '142800')::HUGEINT % 97))::VARCHAR, 2, '0') || {_IBAN} AS iban FROM k)
SELECT c_custkey, iban, CASE c_custkey % 5 WHEN 1 THEN 'checksum' WHEN 2 THEN 'length' WHEN 3 THEN 'empty' WHEN 4 THEN 'country' END AS reason, c_custkey % 5 = 0 AS valid, right(iban, 4) AS last4 FROM n""")
def fn_accounts(spark, d):
    k = F.col("c_custkey")
    bank, acc = F.lpad((k * 7919 % 100000000).cast("string"), 8, "0"), F.lpad((k * 104729 % 10000000000).cast("string"), 10, "0")
    c = table(spark, d, "customer").withColumn("iban", ids.ccc_to_iban(F.concat(bank, ids.ccc_digits(bank, acc), acc)))
    i = F.col("iban")
    swapped = F.concat(F.substring(i, 1, 2), F.lpad(((F.substring(i, 3, 2).cast("int") + 1) % 100).cast("string"), 2, "0"), F.substring(i, 5, 30))
    given = F.when(k % 5 == 0, F.concat_ws(" ", F.substring(F.lower("iban"), 1, 4), F.substring(i, 5, 30))).when(k % 5 == 1, swapped).when(k % 5 == 2, F.substring(i, 1, 22)).when(k % 5 == 3, " ").otherwise(F.concat(F.lit("ZZ"), F.substring(i, 3, 30)))
    checked = ids.check_iban(given)
    return c.select("c_custkey", "iban", checked["reason"].alias("reason"), checked["valid"].alias("valid"), F.replace(text.mask_iban(i), F.lit("*"), F.lit("")).alias("last4"))


_CIF = "(10 - (" + " + ".join(f"(CASE WHEN {c} > 4 THEN 2 * {c} - 9 ELSE 2 * {c} END)" if i % 2 == 0 else c for i, c in enumerate(f"substr(s, {j}, 1)::INTEGER" for j in range(1, 8))) + ") % 10) % 10"


@bound(f"""
WITH n AS (SELECT c_custkey AS k, lpad((c_custkey * 7919 % 10000000)::VARCHAR, 7, '0') AS s FROM customer), d AS (SELECT *, {_CIF} AS c FROM n)
SELECT k AS c_custkey, CASE k % 4 WHEN 0 THEN 'B' || s || c WHEN 1 THEN 'Q' || s || substr('JABCDEFGHI', c + 1, 1) WHEN 2 THEN 'X' || s || substr('TRWAGMYFPDXBNJZSQVHLCKE', (s::BIGINT % 23)::INTEGER + 1, 1) ELSE 'B' || s || (c + 1) % 10 END AS nif,
 k % 4 <> 3 AS valid, CASE k % 4 WHEN 0 THEN 'CIF' WHEN 1 THEN 'CIF' WHEN 2 THEN 'NIE' ELSE 'INVALID' END AS kind, CASE k % 4 WHEN 2 THEN NULL WHEN 1 THEN 'Q' ELSE 'B' END AS entity, CASE k % 4 WHEN 3 THEN 'checksum' END AS reason, k % 4 = 2 AS person FROM d""")
def fn_tax_numbers(spark, d):
    k, s = F.col("c_custkey"), F.lpad((F.col("c_custkey") * 7919 % 10000000).cast("string"), 7, "0")
    digit = ids.entity_digit(s)
    letter = F.substr(F.lit(ids.PERSON_LETTERS), (s.cast("bigint") % 23).cast("int") + 1, F.lit(1))
    made = F.when(k % 4 == 0, F.concat(F.lit("es-b "), s, digit)).when(k % 4 == 1, F.concat(F.lit("q."), s, F.substr(F.lit(ids.ENTITY_LETTERS), digit + 1, F.lit(1)))).when(k % 4 == 2, F.concat(F.lit("x"), F.regexp_replace(s, "^0+(?=.)", ""), letter)).otherwise(F.concat(F.lit("B"), s, (digit + 1) % 10))
    c = ids.check_nif(made)
    return table(spark, d, "customer").select("c_custkey", c["nif"].alias("nif"), c["valid"].alias("valid"), c["kind"].alias("kind"), c["entity"].alias("entity"), c["reason"].alias("reason"), ids.is_person_nif(made).alias("person"))


_KEY = b"pepper".ljust(64, b"\0")
_INNER, _OUTER = ("".join(f"\\x{b ^ pad:02X}" for b in _KEY) for pad in (0x36, 0x5C))


@bound(f"""
SELECT o_orderkey, sha256('{_OUTER}'::BLOB || unhex(sha256('{_INNER}'::BLOB || encode('ES' || o_orderkey)))) AS keyed, sha256('{{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}}') AS row_hash,
 bit_count(xor(o_orderkey::BIGINT, o_custkey::BIGINT))::INTEGER AS bits FROM orders""")
def fn_hashes(spark, d):
    o = orders(spark, d)
    return o.select("o_orderkey", hashing.keyed_digest(F.concat(F.lit("ES"), "o_orderkey"), "pepper").alias("keyed"), hashing.row_hash("o_orderkey", "o_custkey", "o_orderstatus").alias("row_hash"), hashing.hamming(F.col("o_orderkey"), F.col("o_custkey")).alias("bits"))


@bound("""
SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN (c_custkey * 1.0)::DECIMAL(18,2)::VARCHAR WHEN 1 THEN '2024-03-05' WHEN 2 THEN lpad((c_custkey % 100)::VARCHAR, 8, '0') || 'X' WHEN 3 THEN 'ES' || c_custkey ELSE 'carrer ' || c_custkey END AS value FROM customer""")
def fn_canonical_values(spark, d):
    k = F.col("c_custkey")
    kind = pick("c_custkey", ["amount", "date", "nif", "iban", "text"])
    raw = F.when(k % 5 == 0, F.concat(k.cast("string"), F.lit(",00 EUR"))).when(k % 5 == 1, "5 de març de 2024").when(k % 5 == 2, F.concat((k % 100).cast("string"), F.lit("-x"))).when(k % 5 == 3, F.concat(F.lit("iban es "), k)).otherwise(F.concat(F.lit(" Càrrer  "), k))
    return table(spark, d, "customer").select("c_custkey", evidence.canonical(kind, raw).alias("value"))


# ---- classification


#: (text, counterparty, code) of a movement and what it is as a debit and as a credit.
_MOVES = [
    ("BIZUM A MARIA", "", "", "bizum", "bizum"), ("Reintegro cajero", "", "", "cash", "cash"), ("xec núm. 3", "", "", "cheque", "cheque"), ("Comisión mantenimiento", "", "", "fee", "fee"),
    ("Liquidacion intereses", "", "", "interest", "interest"), ("Impost Ajuntament", "", "", "tax", "tax"), ("Préstamo hipoteca", "", "", "loan", "loan"), ("Subvenció Generalitat", "", "", "other", "subsidy"),
    ("Devolución recibo", "", "", "returned", "refund"), ("Compra en ferreteria", "", "", "card", "card"), ("Traspàs", "", "", "internal", "internal"), ("Quota comunitat", "", "", "other", "quota_in"),
    ("Transferencia emitida", "", "", "transfer_out", "transfer_in"), ("Rebut aigua", "", "", "direct_debit", "quota_in"), ("Ingreso efectivamente hecho", "", "", "other", "other"), ("sense text", "", "04", "transfer_out", "transfer_in"),
    ("res", "", "", "other", "other"),
]


@bound(f"""
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN {pick_sql("(o_orderkey // 2)", [m[3] for m in _MOVES])} ELSE {pick_sql("(o_orderkey // 2)", [m[4] for m in _MOVES])} END AS kind, o_custkey % 2 = 1 AND (o_custkey + 1) * 50 >= 500 AS is_round FROM orders""")
def tx_classification(spark, d):
    """Movements by construction: texts of each kind as debits and credits."""
    o = orders(spark, d).withColumn("half", F.floor(F.col("o_orderkey") / 2))
    amount = F.when(F.col("o_orderkey") % 2 == 0, -(F.col("o_custkey") + 1) * 50).otherwise((F.col("o_custkey") + 1) * 50)
    c = classify.classify_transaction(amount, *(pick("half", [m[i] for m in _MOVES]) for i in range(3)), F.lit("ES"))
    return o.select("o_orderkey", c["kind"].alias("kind"), F.array_contains(c["flags"], "round_amount").alias("is_round"))


_FLAGS = [("Transferencia", "Anna Vila", "04", "ES12", "person_beneficiary"), ("Transferencia", "Obres Vila SL", "04", "FR76", "foreign_iban"), ("res", "", "98", "", "reversal"), ("Bizum", "", "", "", "bizum"), ("Targeta", "", "", "", "card"), ("res", "Joan", "", "", "")]


@bound(f"SELECT c_custkey, {pick_sql('c_custkey', [f[4] for f in _FLAGS])} AS flags FROM customer")
def classify_movement_flags(spark, d):
    c = classify.classify_transaction(F.lit(-123), *(pick("c_custkey", [f[i] for f in _FLAGS]) for i in range(4)))
    return table(spark, d, "customer").select("c_custkey", F.array_join(c["flags"], ",").alias("flags"))


_RESOLUTIONS = [("S'aprova la derrama de 12", "derrama"), ("Contractar un préstec", "loan"), ("Demanar la subvenció", "subsidy"), ("Adjudicar a Obres SL", "contractor_choice"), ("Obra de l'ascensor", "works_approval"), ("Pressupost anual", "budget"), ("Aprovar els comptes", "accounts"), ("Es nomena president", "election"), ("S'autoritza la junta", "delegation"), ("Torn obert", "other")]
_UNITS = [("12,5 m2 de rajola", "12.5", "m2"), ("3 hores peó", "3", "hores"), ("partida alzada", "1", "pa"), ("sense quantitat", None, None), ("40 ml barana", "40", "ml")]


@bound(f"SELECT c_custkey, {pick_sql('c_custkey', [r[1] for r in _RESOLUTIONS])} AS kind, {pick_sql('c_custkey', [u[1] for u in _UNITS])}::DOUBLE AS quantity, {pick_sql('c_custkey', [u[2] for u in _UNITS])} AS unit FROM customer", double="quantity")
def classify_minutes_and_units(spark, d):
    q = classify.quantity_unit(pick("c_custkey", [u[0] for u in _UNITS]))
    return table(spark, d, "customer").select("c_custkey", classify.resolution_kind(pick("c_custkey", [r[0] for r in _RESOLUTIONS])).alias("kind"), q["quantity"].alias("quantity"), q["unit"].alias("unit"))


@bound("""
WITH k(code, word) AS (VALUES ('works', 'ring'), ('works', 'bolt'), ('metal', 'gear'), ('metal', 'ring'), ('soft', 'small'), ('soft', 'red')), s AS (SELECT p_partkey, code, count(*) AS score FROM part JOIN k ON contains(' ' || lower(p_name || ' ' || p_type) || ' ', ' ' || word || ' ') GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, code) AS n, lead(score) OVER (PARTITION BY p_partkey ORDER BY score DESC, code) AS runner FROM s)
SELECT p_partkey, code, score::BIGINT AS score, least(0.95, 0.5 + 0.1 * score + 0.1 * greatest(score - coalesce(runner, 0), 0))::DECIMAL(6,3) AS confidence FROM r WHERE n = 1""", double="confidence")
def line_classification(spark, d):
    words = spark.createDataFrame([("works", "ring"), ("works", "bolt"), ("metal", "gear"), ("metal", "ring"), ("soft", "small"), ("soft", "red")], "code string, keyword string")
    p = table(spark, d, "part").select(F.col("p_partkey").alias("line_id"), F.concat_ws(" ", "p_name", "p_type").alias("text"), F.lit("v").alias("vendor"))
    return evidence.classify_lines(p, words).select(F.col("line_id").alias("p_partkey"), "code", "score", F.col("confidence").cast("decimal(6,3)").alias("confidence"))


# ---- documents


def _invoices(spark, d):
    """Invoices as nested documents: an order with its lines; gross is exact, the order's own total is not."""
    x = lines(spark, d).withColumns({"base": F.col("amount"), "rate": F.element_at(F.array(*map(F.lit, (0.0, 4.0, 10.0, 21.0, 7.0))), (F.col("l_linenumber") % 5 + 1).cast("int"))})
    vat = (F.col("base") * F.col("rate").cast("decimal(4,1)") / 100).cast("decimal(18,2)")
    x = x.withColumn("vat", vat).withColumn("qty", F.col("l_quantity").cast("double"))
    item = F.struct(
        F.col("qty").alias("cantidad"), F.lit(None).cast("double").alias("precio_unitario"), F.lit(None).cast("double").alias("descuento_pct"), F.col("base").cast("double").alias("base"), F.col("rate").alias("tipo_iva_pct"),
        F.col("vat").cast("double").alias("cuota_iva"), (F.col("base") + F.col("vat")).cast("double").alias("total_linea"), F.lit(False).alias("es_partida_alzada"),
    )
    docs = x.groupBy("l_orderkey").agg(F.collect_list(item).alias("lineas"), F.sum("base").alias("b"), F.sum("vat").alias("v"))
    off = F.when(F.col("l_orderkey") % 3 == 0, 1).otherwise(0)
    shaped = docs.select(
        F.col("l_orderkey").cast("string").alias("document_id"), F.lit("factura").alias("doc_type"), F.lit("2024-03-01").cast("date").alias("fecha_expedicion"), F.when(F.col("l_orderkey") % 4 == 0, F.lit("2024-02-01").cast("date")).alias("vencimiento"), "lineas",
        (F.col("b") + off).cast("double").alias("base_imponible_total"), F.col("v").cast("double").alias("iva_total"), (F.col("b") + F.col("v") + off).cast("double").alias("total_factura"),
    )
    schema = spark.createDataFrame([], validators.DOCUMENTS["invoice"]).schema
    return shaped.select(*((F.col(f.name) if f.name in shaped.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))


_CHECKS = """
WITH x AS (SELECT l_orderkey AS k, l_extendedprice::DECIMAL(18,2) AS b, ([0, 4, 10, 21, 7])[(l_linenumber % 5) + 1] AS r FROM lineitem),
s AS (SELECT k, sum(b) AS b, count(*) AS n, bool_and(r <> 7) AS rates FROM x GROUP BY 1),
c AS (SELECT k, 'invoice.lines_sum_to_base' AS code, CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END <= 0.02 * n AS passed, true AS checked FROM s UNION ALL SELECT k, 'invoice.summary_sums_to_totals', true, false FROM s UNION ALL SELECT k, 'invoice.rate_times_base', true, true FROM s
 UNION ALL SELECT k, 'invoice.total', true, true FROM s UNION ALL SELECT k, 'invoice.vat_rate_exists', rates, true FROM s UNION ALL SELECT k, 'invoice.simplified_up_to_400', true, false FROM s UNION ALL SELECT k, 'invoice.line_arithmetic', true, true FROM s
 UNION ALL SELECT k, 'invoice.dates', k % 4 <> 0, true FROM s UNION ALL SELECT k, 'invoice.issuer_nif', true, false FROM s UNION ALL SELECT k, 'invoice.recipient_nif', true, false FROM s UNION ALL SELECT k, 'invoice.iban', true, false FROM s)
"""


@bound(_CHECKS + "SELECT k::VARCHAR AS document_id, code, passed, checked FROM c")
def validators_long_form(spark, d):
    return validators.validate(_invoices(spark, d), "invoice").select("document_id", "code", "passed", "checked")


@bound(_CHECKS + "SELECT k::VARCHAR AS document_id, bool_and(passed) AS accepted, coalesce(string_agg(code, ',' ORDER BY code) FILTER (WHERE NOT passed), '') AS failed FROM c GROUP BY 1")
def validators_accepted(spark, d):
    out = validators.accepted(validators.validate(_invoices(spark, d), "invoice"))
    return out.select("document_id", "accepted", F.array_join("failed", ",").alias("failed"))


@bound("""
WITH e AS (SELECT user_id, event_id, value::DECIMAL(18,2) AS v, ts::DATE AS day, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), g AS (SELECT user_id, sum(v) AS total, bool_or(n = 5) AS long FROM e GROUP BY 1)
SELECT user_id::VARCHAR AS document_id, c.code, CASE c.code WHEN 'statement.balance' THEN user_id % 3 <> 0 WHEN 'statement.running_balance' THEN NOT (user_id % 2 = 0 AND long) ELSE true END AS passed,
 c.code IN ('statement.balance', 'statement.running_balance') AS checked FROM g CROSS JOIN (VALUES ('statement.balance'), ('statement.running_balance'), ('statement.dates'), ('statement.movements_in_period'), ('statement.iban'), ('statement.counterparty_iban')) c(code)""")
def validators_statement(spark, d):
    from pyspark.sql import Window

    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumns({"v": F.col("value").cast("decimal(18,2)"), "n": F.row_number().over(by)})
    e = e.withColumn("s", F.sum("v").over(by.rowsBetween(Window.unboundedPreceding, 0)) + F.when((F.col("user_id") % 2 == 0) & (F.col("n") == 5), 7).otherwise(0))
    move = F.struct("n", F.lit(None).cast("date").alias("fecha"), F.col("v").cast("double").alias("importe"), F.col("s").cast("double").alias("saldo"), F.lit(None).cast("string").alias("contraparte_iban"))
    docs = e.groupBy("user_id").agg(F.array_sort(F.collect_list(move)).alias("m"), F.sum("v").alias("t"))
    shaped = docs.select(
        F.col("user_id").cast("string").alias("document_id"), F.lit(0.0).alias("saldo_inicial"), (F.col("t") + F.when(F.col("user_id") % 3 == 0, 1).otherwise(0)).cast("double").alias("saldo_final"),
        F.transform("m", lambda m: F.struct(m["fecha"].alias("fecha"), m["importe"].alias("importe"), m["saldo"].alias("saldo"), m["contraparte_iban"].alias("contraparte_iban"))).alias("movimientos"),
    )
    schema = spark.createDataFrame([], validators.DOCUMENTS["statement"]).schema
    shaped = shaped.select(*((F.col(f.name) if f.name in shaped.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))
    return validators.validate(shaped, "statement").select("document_id", "code", "passed", "checked")


@bound("SELECT p_partkey AS field_id, CASE p_partkey % 3 WHEN 2 THEN NULL ELSE lower(p_name) END AS found, CASE p_partkey % 3 WHEN 0 THEN 'bbox' WHEN 1 THEN 'page' END AS scope, CASE p_partkey % 3 WHEN 0 THEN 'anchored' WHEN 1 THEN 'approximate' ELSE 'page_only' END AS crop_status FROM part")
def quote_locate_windows(spark, d):
    """Each part's name stands on its own page behind three other words; a third of the quotes come with a box, a third nowhere."""
    p = table(spark, d, "part").select("p_partkey", F.split(F.concat(F.lit("alpha beta gamma "), F.col("p_name"), F.lit(" omega")), " ").alias("w"))
    words = p.select(F.col("p_partkey").alias("page_id"), F.posexplode("w").alias("idx", "text")).withColumns({"x0": F.col("idx") * 10.0, "y0": F.lit(0.0), "x1": F.col("idx") * 10.0 + 9, "y1": F.lit(10.0)})
    box = F.when(F.col("p_partkey") % 3 == 0, F.array(F.lit(30.0), F.lit(0.0), (F.size("w") - 1) * 10.0 - 1, F.lit(10.0)))
    quote = F.when(F.col("p_partkey") % 3 == 2, "quatre paraules ben diferents").otherwise(F.upper(F.array_join(F.expr("slice(w, 4, size(w) - 4)"), " ")))
    fields = p.select(F.col("p_partkey").alias("field_id"), F.col("p_partkey").alias("page_id"), quote.alias("quote"), box.alias("bbox"))
    return evidence.locate_quotes(fields, words).select("field_id", "found", "scope", "crop_status")


@bound("""
WITH e AS (SELECT event_id, unnest(map_entries(props::JSON::MAP(VARCHAR, VARCHAR))) AS p FROM events WHERE props IS NOT NULL) SELECT event_id, p.key AS path, p.value AS value FROM e WHERE p.value IS NOT NULL""")
def json_props_flatten(spark, d):
    return evidence.flatten_json(table(spark, d, "events").select("event_id", "props"), "event_id", "props")


@bound("""
WITH m AS (SELECT o_orderkey, lower(trim(c_name)) AS t, c_name, o_orderdate FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT t AS party_key, arg_min(c_name, (o_orderdate, o_orderkey)) AS name, NULL::VARCHAR AS nif, count(*)::BIGINT AS mentions FROM m GROUP BY 1""")
def resolve_parties(spark, d):
    m = orders(spark, d).join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return evidence.resolve_parties(m.select(F.col("o_orderkey").alias("mention_id"), F.col("c_name").alias("name"), F.lit("?").alias("nif"), F.col("o_orderdate").alias("at")))


@bound("""
WITH e AS (SELECT *, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS was, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events)
SELECT user_id AS document_id, event_type AS field_path, event_id AS id, coalesce(event_id % 2 = 0 AND event_id % 3 <> 0 AND abs(value::DECIMAL(18,4) - was::DECIMAL(18,4)) > 1, false) AS needs_reason FROM e WHERE n = 1""")
def current_values(spark, d):
    e = table(spark, d, "events").select(
        F.col("user_id").alias("document_id"), F.col("event_type").alias("field_path"), F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.when(F.col("event_id") % 2 == 0, "human").otherwise("reader").alias("author"),
        F.lit("amount").alias("kind"), F.col("value").cast("decimal(18,2)").cast("string").alias("value"), F.when(F.col("event_id") % 3 == 0, "typo").alias("reason"),
    )
    return evidence.current_values(e).select("document_id", "field_path", "id", "needs_reason")


@bound("""
WITH r AS (SELECT l_orderkey AS f, l_returnflag AS s, l_quantity::DECIMAL(18,2) AS v FROM lineitem), c AS (SELECT f, v, count(DISTINCT s) AS n FROM r GROUP BY ALL), t AS (SELECT f, max(n) AS n, count(*) AS k, arg_max(v::VARCHAR, (n, v::VARCHAR)) AS value FROM c GROUP BY 1)
SELECT f AS field_id, value, CASE WHEN n >= 2 AND k = 1 THEN 'agreed' WHEN n >= 2 THEN 'demoted' ELSE 'single' END AS status FROM t""")
def two_sources(spark, d):
    x = table(spark, d, "lineitem")
    return evidence.two_sources(x.select(F.col("l_orderkey").alias("field_id"), F.col("l_returnflag").alias("source"), F.lit("amount").alias("kind"), F.col("l_quantity").cast("decimal(18,2)").cast("string").alias("raw")))


# ---- vendors, prices, scores


@bound("""
WITH v AS (SELECT s_suppkey AS p, s_nationkey AS a, s_suppkey % 9 AS ph FROM supplier), n AS (SELECT a, count(*) AS n FROM v GROUP BY 1), s AS (
 SELECT p, 'S6' AS signal, CASE WHEN n >= 5 THEN 15 ELSE 40 END AS points FROM v JOIN n USING (a) WHERE n > 1 UNION ALL SELECT p, 'S5', 80 FROM v WHERE a = 3)
SELECT p AS party_id, signal, points::INTEGER AS points FROM s""")
def vendor_addresses(spark, d):
    v = table(spark, d, "supplier").select(F.col("s_suppkey").alias("party_id"), F.concat(F.lit("C/ Major, "), "s_nationkey").alias("address"))
    site = spark.createDataFrame([("c major 3",)], "address string")
    nobody = spark.createDataFrame([], "address string, role string")
    return vendor_links.addresses(v, site, nobody).select("party_id", "signal", "points")


@bound("""
SELECT s_suppkey AS party_id, 'S8' AS signal, points::INTEGER AS points, basis FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 12 * 30 / 30.4375 < 3 THEN 45 ELSE 25 END AS points, 'age' AS basis FROM supplier WHERE s_suppkey % 15 * 30 / 30.4375 < 12 AND s_suppkey % 15 = s_suppkey % 12
 UNION ALL SELECT s_suppkey, CASE WHEN s_suppkey % 15 * 30 / 30.4375 < 3 THEN 45 ELSE 25 END, 'age' FROM supplier WHERE s_suppkey % 15 * 30 / 30.4375 < 12 AND s_suppkey % 15 <> s_suppkey % 12
 UNION ALL SELECT s_suppkey, 10, 'capital' FROM supplier WHERE s_acctbal <= 3000 UNION ALL SELECT s_suppkey, 25, 'activity' FROM supplier WHERE s_suppkey % 4 = 0)""")
def vendor_company(spark, d):
    v = table(spark, d, "supplier").select(F.col("s_suppkey").alias("party_id"), F.lit("2020-01-01").cast("date").alias("incorporated_on"), F.col("s_acctbal").alias("capital"), (F.col("s_suppkey") % 4 != 0).alias("trade_related"))
    first = v.select("party_id", F.date_add("incorporated_on", (F.col("party_id") % 15 * 30).cast("int")).alias("first"))
    return vendor_links.company(v, first).select("party_id", "signal", "points", "basis")


@bound("""
WITH s AS (SELECT l_suppkey AS p, CASE l_linenumber WHEN 1 THEN 'S8' WHEN 2 THEN 'S6' ELSE 'S10' END AS g, l_quantity::INTEGER AS v FROM lineitem), g AS (SELECT p, g, CASE WHEN g = 'S8' THEN sum(v) ELSE max(v) END AS v FROM s GROUP BY p, g)
SELECT p AS party_id, sum(v)::BIGINT AS points, CASE WHEN sum(v) >= 80 THEN 'priority' WHEN sum(v) >= 40 THEN 'review' ELSE 'note' END AS tier FROM g GROUP BY 1""")
def vendor_queue(spark, d):
    s = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("party_id"), F.lit(None).cast("string").alias("role"), F.when(F.col("l_linenumber") == 1, "S8").when(F.col("l_linenumber") == 2, "S6").otherwise("S10").alias("signal"), F.col("l_quantity").cast("int").alias("points"))
    return vendor_links.queue(s).select("party_id", F.col("points").cast("bigint").alias("points"), "tier")


@bound("""
SELECT p_partkey, CASE WHEN p_size IS NULL THEN 0.6 WHEN p_size / 4.0 < 0.1 THEN 1.3 WHEN p_size / 4.0 <= 1 THEN 1.0 WHEN p_size / 4.0 <= 10 THEN 0.6 ELSE 0.3 END::DOUBLE AS weight, round(1600000.0 * (p_size / 4.0) / 1000 * (p_size / 4.0) / 1000, 2)::DOUBLE AS namesakes FROM part""", double="weight namesakes")
def surname_weights(spark, d):
    f = F.col("p_size") / 4.0
    return table(spark, d, "part").select("p_partkey", vendor_links.rarity(f).alias("weight"), vendor_links.homonyms(f, f).alias("namesakes"))


@bound("""
WITH u AS (SELECT c_custkey AS k, (c_custkey % 7 + 1)::DECIMAL(9,4) AS q FROM customer), m AS (SELECT k, q, unnest(range(3)) AS i FROM u),
e AS (SELECT k, (DATE '2024-01-01' + to_months(i::INTEGER))::DATE AS period, ((12000 * q / 100)::DECIMAL(18,2) / 3)::DECIMAL(18,2) AS ordinary, CASE k % 3 WHEN 0 THEN CASE WHEN i < 2 THEN 25 ELSE 0 END WHEN 1 THEN CASE WHEN i < 1 THEN (600 * q / 100)::DECIMAL(18,2) ELSE 0 END ELSE 0 END::DECIMAL(18,2) AS extra FROM m)
SELECT k AS unit_id, period, ordinary, extra AS extraordinary, ordinary + extra AS expected FROM e""", double="ordinary extraordinary expected", text="period")
def quota_rules(spark, d):
    k = F.col("c_custkey")
    rule = F.when(k % 3 == 0, "flat_per_unit").when(k % 3 == 1, "quota")
    u = table(spark, d, "customer").select(k.alias("unit_id"), (k % 7 + 1).alias("quota_pct"), F.lit(12000).alias("budget"), rule.alias("rule"), F.when(k % 3 == 0, 25).when(k % 3 == 1, 600).alias("rule_amount"), F.when(k % 3 == 0, 2).when(k % 3 == 1, 1).alias("rule_months"))
    return pricing.quota_schedule(u, "2024-01-15", 3)


@bound("SELECT p_partkey, CASE WHEN p_size = 0 THEN NULL ELSE round((k / n + (1.959964 * 1.959964) / (2 * n) - 1.959964 * sqrt((k / n * (1 - k / n) + (1.959964 * 1.959964) / (4 * n)) / n)) / (1 + (1.959964 * 1.959964) / n), 6) END AS bound FROM (SELECT p_partkey, p_size, greatest(p_size, 1)::DOUBLE AS n, (greatest(p_size, 1) // 2)::DOUBLE AS k FROM part)")
def wilson_lower_bound(spark, d):
    n = F.greatest("p_size", F.lit(1))
    return table(spark, d, "part").select("p_partkey", F.round(scoring.wilson_lower(F.floor(n / 2), n), 6).alias("bound"))


@bound("SELECT conv_id, turn, string_agg(role, '>' ORDER BY t) AS around FROM (SELECT a.conv_id, a.turn, b.role, b.turn AS t FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) a JOIN (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) b ON a.conv_id = b.conv_id AND b.n BETWEEN a.n - 2 AND a.n + 1) GROUP BY 1, 2")
def context_windows(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "role")
    return ordered.context(c, "conv_id", "turn", "role").select("conv_id", "turn", F.array_join("context", ">").alias("around"))
