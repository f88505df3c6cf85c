"""Answers of public registers as typed rows: company profiles, grants, accredited builders, contractors' registers, cadastre units, census of tax numbers, surnames.

A response is a row (key, body). JSON bodies become variants, whose fields are looked for under the names that providers use; XML is read by XPath; pages by
the table cells of sources/markup.py. A body that isn't what it should be gives no rows, or a row that says what could not be read; nothing
raises. Values are parsed as printed in Spain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.functions import amounts, dates, ids
from tallyline.functions.text import norm_company, norm_name, strip_diacritics
from tallyline.sources import markup

# The names under which providers give a field, in the order in which they are looked for.
NAME = ("name", "nombre", "denominacion", "denominacion_social", "razon_social", "company_name", "title")
NIF = ("nif", "cif", "nif_cif", "tax_id", "identificador")
ADDRESS = ("address", "domicilio", "domicilio_social", "direccion", "registered_address", "adreca")
POSTCODE = ("postcode", "postal_code", "codigo_postal", "cp")
CITY = ("municipality", "municipio", "city", "localidad", "poblacion")
INCORPORATED = ("incorporation_date", "fecha_constitucion", "constitucion", "date_incorporated", "fecha_alta", "founded")
CAPITAL = ("capital", "capital_social", "share_capital", "capital_eur")
ACTIVITY_CODE = ("cnae", "cnae_code", "codigo_cnae", "actividad_cnae", "sic")
ACTIVITY = ("cnae_label", "cnae_descripcion", "actividad", "objeto_social", "activity")
STATUS = ("status", "situacion", "estado", "situacion_registral")
OFFICERS = ("officers", "cargos", "administradores", "directors", "organos", "appointments")
EVENTS = ("events", "acts", "actos", "borme", "anuncios", "timeline", "historial")
ROLE = ("role", "cargo", "position", "tipo_cargo")
FROM = ("from", "date_from", "fecha_nombramiento", "fecha_inicio", "desde", "fecha")
TO = ("to", "date_to", "fecha_cese", "fecha_fin", "hasta")
RESULTS = ("results", "data", "items", "companies", "empresas", "hits", "content", "concesiones", "records", "rows")
# Words that name an autonomous community, without accents, and its name.
COMMUNITIES = (
    ("andalucia", "Andalucía"), ("aragon", "Aragón"), ("asturias", "Asturias"), ("illes balears", "Illes Balears"), ("islas baleares", "Illes Balears"), ("baleares", "Illes Balears"), ("canarias", "Canarias"), ("cantabria", "Cantabria"),
    ("castilla y leon", "Castilla y León"), ("castilla-la mancha", "Castilla-La Mancha"), ("castilla la mancha", "Castilla-La Mancha"), ("cataluna", "Cataluña"), ("catalunya", "Cataluña"), ("comunitat valenciana", "Comunitat Valenciana"), ("comunidad valenciana", "Comunitat Valenciana"),
    ("extremadura", "Extremadura"), ("galicia", "Galicia"), ("madrid", "Madrid"), ("murcia", "Murcia"), ("navarra", "Navarra"), ("pais vasco", "País Vasco"), ("euskadi", "País Vasco"), ("la rioja", "La Rioja"), ("ceuta", "Ceuta"), ("melilla", "Melilla"),
)
# What a column of a builders' table is called, without accents, in the order of the tests.
HEADERS = (
    ("number", r"(^|\W)(n(um(ero)?)?\.?\s*(de\s*)?(inscripcion|rea|registro)|codigo\s*rea|rea)(\W|$)"), ("community", r"comunidad|autonom|autoridad laboral|ccaa"), ("valid_to", r"vencimiento|caducidad|hasta|fin\b|expira|renovac"),
    ("valid_from", r"fecha|desde|alta|inicio|efectos|validez"), ("status", r"estado|situacion"), ("nif", r"\b(nif|cif|nie|dni)\b|identificac|documento"), ("name", r"razon social|nombre|denominacion|empresa|titular"),
)
POPULATION = 8_000_000


def text_of(node: Column, *names: str) -> Column:
    """The first of the named fields that holds a value that isn't blank, as text."""
    values = F.array(*(F.trim(F.try_variant_get(node, f"$.{n}", "string")) for n in names))
    return F.try_element_at(F.filter(values, lambda v: v != ""), F.lit(1))


def node_of(node: Column, *names: str) -> Column:
    return F.coalesce(*(F.try_variant_get(node, f"$.{n}", "variant") for n in names))


def list_of(node: Column, *names: str) -> Column:
    """The first of the named fields as a list of nodes; one that isn't a list counts as a list of one. Without names, the node itself."""
    at = node_of(node, *names) if names else node
    several, one = F.try_variant_get(at, "$", "array<variant>"), F.try_variant_get(at, "$", "map<string, variant>")
    return F.coalesce(several, F.when(one.isNotNull(), F.array(at)), F.array().cast("array<variant>"))


def results(body: Column) -> Column:
    """The rows of an answer: a bare list, or the first list under a usual name."""
    return F.coalesce(F.try_variant_get(body, "$", "array<variant>"), list_of(body, *RESULTS))


def nif_of(text: Column) -> Column:
    return F.regexp_replace(F.upper(text), r"[\s-]", "")


def _day(text: Column) -> Column:
    return F.coalesce(F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})", 1).try_cast("date"), dates.parse_date(text))


def _number(text: Column) -> Column:
    return F.coalesce(F.when(text.rlike(r"^-?\d+(\.\d+)?$"), text.try_cast("decimal(18,6)")), amounts.parse_amount(text).cast("decimal(18,6)"))


def _parsed(responses: DataFrame, key: str, body: str) -> DataFrame:
    return responses.select(key, F.try_parse_json(F.col(body)).alias("v")).where("v IS NOT NULL")


def company_profiles(responses: DataFrame, key: str = "key", body: str = "body") -> DataFrame:
    """(key, name, name_norm, nif, address, postcode, municipality, incorporated_on, capital, activity_code, activity, status, officers, events, unread) of each profile.

    officers are structs (name, name_norm, role, since, until), events (day, kind, text), by day. unread lists what a profile lacks.
    """
    rows = _parsed(responses, key, body).select(key, F.coalesce(node_of(F.col("v"), "company", "empresa", "result", "data"), F.col("v")).alias("b"))
    b = F.col("b")

    def officer(o):
        name = F.coalesce(text_of(o, *NAME), text_of(o, "persona", "person", "full_name"))
        return F.struct(name.alias("name"), norm_name(name).alias("name_norm"), text_of(o, *ROLE).alias("role"), _day(text_of(o, *FROM)).alias("since"), _day(text_of(o, *TO)).alias("until"))

    def event(o):
        day = _day(text_of(o, "date", "fecha", "fecha_publicacion", "published_at"))
        return F.struct(day.alias("day"), text_of(o, "type", "tipo", "acto", "act", "concepto").alias("kind"), text_of(o, "text", "texto", "descripcion", "description", "detalle").alias("text"))

    found = rows.select(
        key, text_of(b, *NAME).alias("name"), nif_of(text_of(b, *NIF)).alias("nif"), text_of(b, *ADDRESS).alias("address"), text_of(b, *POSTCODE).alias("postcode"), text_of(b, *CITY).alias("municipality"),
        _day(text_of(b, *INCORPORATED)).alias("incorporated_on"), _number(text_of(b, *CAPITAL)).alias("capital"), text_of(b, *ACTIVITY_CODE).alias("activity_code"), text_of(b, *ACTIVITY).alias("activity"), text_of(b, *STATUS).alias("status"),
        F.filter(F.transform(list_of(b, *OFFICERS), officer), lambda o: o["name"].isNotNull()).alias("officers"),
        F.array_sort(F.filter(F.transform(list_of(b, *EVENTS), event), lambda e: e["day"].isNotNull() | e["kind"].isNotNull() | e["text"].isNotNull())).alias("events"),
    )
    lacks = [F.when(F.col(c).isNull(), F.lit(c)) for c in ("address", "incorporated_on", "capital", "activity_code")] + [F.when(F.size(c) == 0, F.lit(c)) for c in ("officers", "events")]
    return found.withColumns({"name_norm": norm_company(F.col("name")), "unread": F.array_compact(F.array(*lacks))})


def search_results(responses: DataFrame, key: str = "key", body: str = "body") -> DataFrame:
    """(key, at, id, name, nif): candidates of a search, in the answer's order."""
    each = _parsed(responses, key, body).select(key, F.posexplode(results(F.col("v"))).alias("at", "o"))
    o = F.col("o")
    return each.select(key, "at", text_of(o, "slug", "id", "company_id", "uid", "ref").alias("id"), text_of(o, *NAME).alias("name"), nif_of(text_of(o, *NIF)).alias("nif")).where("id IS NOT NULL OR name IS NOT NULL")


def _beneficiary(text: Column) -> Column:
    """struct(nif, name) of `NIF name`; a masked number is dropped, one that fails its check stays part of the name."""
    whole = F.regexp_replace(F.trim(text), r"\s+", " ")
    first, rest = F.regexp_extract(whole, r"^(\S{9})(?: .*)?$", 1), F.trim(F.regexp_extract(whole, r"^\S{9} (.*)$", 1))
    named = F.when(rest != "", rest)
    checked = ids.check_nif(first)
    valid, masked = (first != "") & F.coalesce(checked["valid"], F.lit(False)), F.contains(first, F.lit("*"))
    return F.struct(F.when(valid & ~masked, ids.norm_nif(first)).alias("nif"), F.when(masked | valid, named).otherwise(F.when(whole != "", whole)).alias("name"))


def grants(responses: DataFrame, key: str = "key", body: str = "body") -> DataFrame:
    """(key, at, reference, call_number, beneficiary, beneficiary_nif, grantor, level, programme, instrument, day, granted, aid_equivalent, paid, url) of each grant."""
    each = _parsed(responses, key, body).select(key, F.posexplode(results(F.col("v"))).alias("at", "o"))
    o = F.col("o")
    each = each.withColumn("who", _beneficiary(text_of(o, "beneficiario", "nombreBeneficiario", "beneficiary", "denominacion")))
    own = text_of(o, "nifBeneficiario", "nifCif", "nif", "idBeneficiario")
    own = F.when(F.coalesce(ids.check_nif(own)["valid"], F.lit(False)), ids.norm_nif(own))
    out = each.select(
        key, "at", text_of(o, "id", "idConcesion", "codigoBDNS", "referencia").alias("reference"), text_of(o, "numeroConvocatoria", "codigoConvocatoria", "idConvocatoria").alias("call_number"), F.col("who.name").alias("beneficiary"), F.coalesce("who.nif", own).alias("beneficiary_nif"),
        text_of(o, "nivel3", "nivel2", "organo", "organoConcedente", "administracion", "grantor").alias("grantor"), text_of(o, "nivel1", "nivel", "ambito").alias("level"), text_of(o, "convocatoria", "tituloConvocatoria", "programa", "descripcion").alias("programme"),
        text_of(o, "instrumento", "tipoInstrumento").alias("instrument"), _day(text_of(o, "fechaConcesion", "fecha", "fechaPago", "date")).alias("day"), _number(text_of(o, "importe", "importeConcedido", "amount")).alias("granted"),
        _number(text_of(o, "ayudaEquivalente", "importeAyudaEquivalente")).alias("aid_equivalent"), _number(text_of(o, "importePagado", "pagado", "amount_paid")).alias("paid"), text_of(o, "urlBR", "url", "enlace").alias("url"),
    )
    return out.where("reference IS NOT NULL OR beneficiary IS NOT NULL OR granted IS NOT NULL")


def contractors(responses: DataFrame, key: str = "key", body: str = "body") -> DataFrame:
    """(key, at, number, name, nif, address, municipality, postcode, province, activities, valid_from, valid_to, status) of a register of contractors; of a natural person only the registration's own facts."""
    each = _parsed(responses, key, body).select(key, F.posexplode(results(F.col("v"))).alias("at", "o"))
    o = F.col("o")
    kinds = F.transform(list_of(o, "activities", "activitats", "actividades"), lambda a: F.coalesce(text_of(a, "nom", "name", "descripcio"), F.try_variant_get(a, "$", "string")))
    out = each.select(
        key, "at", text_of(o, "n_mero_de_rasic", "numero", "num_rasic", "registration_number").alias("number"), text_of(o, "nom_titular_actual", "nom", "titular", *NAME).alias("name"), nif_of(text_of(o, *NIF)).alias("nif"), text_of(o, "adre_a", *ADDRESS).alias("address"),
        text_of(o, "poblaci_", *CITY).alias("municipality"), text_of(o, "codi_postal", *POSTCODE).alias("postcode"), text_of(o, "prov_ncia", "provincia", "province").alias("province"), F.filter(kinds, lambda k: k.isNotNull() & (k != "")).alias("activities"),
        _day(text_of(o, "data_alta", *FROM)).alias("valid_from"), _day(text_of(o, "data_baixa", *TO)).alias("valid_to"), text_of(o, "estat", *STATUS).alias("status"),
    ).where("number IS NOT NULL OR name IS NOT NULL OR nif IS NOT NULL")
    person = F.coalesce(ids.is_person_nif(F.col("nif")), F.lit(False))
    return out.withColumns({c: F.when(~person, F.col(c)) for c in ("name", "nif", "address", "municipality", "postcode", "province")})


def cadastre_units(responses: DataFrame, key: str = "key", body: str = "body") -> DataFrame:
    """(key, at, envelope, reference, staircase, floor, door, use, surface, coefficient, year_built, error) of each unit; an answer without units is one row with its first error."""
    roots = ("consulta_dnprcResult", "consulta_dnplocResult", "consulta_dnppResult", "consulta_dnp", "consulta_dnprc", "consulta_dnploc", "consulta")
    rows = _parsed(responses, key, body).select(key, F.coalesce(node_of(F.col("v"), *roots), F.col("v")).alias("c"))
    c = F.col("c")
    many, one = node_of(c, "lrcdnp.rcdnp"), F.coalesce(node_of(c, "bico.bi"), node_of(c, "bico"), node_of(c, "bi"))
    envelope = F.when(many.isNotNull(), "lrcdnp").when(node_of(c, "bico").isNotNull(), "bico").when(node_of(c, "bi").isNotNull(), "bi").otherwise("unknown")
    units = F.when(many.isNotNull(), list_of(many)).otherwise(list_of(one))
    error = F.coalesce(text_of(c, "lerr[0].des"), text_of(c, "lerr.err[0].des"), text_of(c, "lerr.err.des"))
    each = rows.select(key, envelope.alias("envelope"), error.alias("error"), F.posexplode_outer(units).alias("at", "o"))
    o = F.col("o")

    def decimal(*names):
        return F.regexp_replace(text_of(o, *names), ",", ".").try_cast("decimal(18,6)")

    # `rc` is an object of parts, in newer envelopes inside `idbi`
    parts = [F.coalesce(text_of(o, f"rc.{p}", f"idbi.rc.{p}"), F.lit("")) for p in ("pc1", "pc2", "car", "cc1", "cc2")]
    reference = F.coalesce(F.nullif(F.concat(*parts), F.lit("")), text_of(o, "rc", "refcat", "referencia_catastral"))
    inside = ("dt.locs.lous.lourb.loint", "dt.lourb.loint", "dt.loint", "loint")
    out = each.select(
        key, "at", "envelope", reference.alias("reference"), *(text_of(o, *(f"{i}.{f}" for i in inside)).alias(n) for f, n in (("es", "staircase"), ("pt", "floor"), ("pu", "door"))), text_of(o, "debi.luso", "debi.uso", "bi.debi.luso").alias("use"),
        decimal("debi.sfc", "debi.superficie", "bi.debi.sfc").alias("surface"), decimal("debi.cpt", "debi.coeficiente", "bi.debi.cpt").alias("coefficient"), decimal("debi.ant", "debi.antiguedad", "bi.debi.ant").cast("int").alias("year_built"), "error",
    )
    return out.where("reference IS NOT NULL OR floor IS NOT NULL OR door IS NOT NULL OR surface IS NOT NULL OR at IS NULL")


def census(responses: DataFrame, key: str = "key", body: str = "body", asked: str = "nif") -> DataFrame:
    """(key, matched, result, rows, other_rows, fault) of each XML answer about the number in column asked.

    Rows that name another number are never the party's; if no row names one, all are. matched is true only for IDENTIFICADO.
    """
    xml = F.regexp_replace(F.regexp_replace(F.col(body), r"^\s*<\?xml[^>]*\?>", ""), r"<(/?)[A-Za-z0-9_]+:", "<$1")
    plain = F.regexp_replace(xml, r"\sxmlns(:\w+)?\s*=\s*(\"[^\"]*\"|'[^']*')", "")
    sound = F.when(plain.rlike(r"(?s)<Envelope\b.*</Envelope>|<VNifV2Sal\b.*</VNifV2Sal>"), plain)
    rows = responses.select(key, asked, sound.alias("x"))
    rows = rows.withColumn("n", F.expr("coalesce(try_cast(xpath_int(x, 'count(//Contribuyente)') AS INT), 0)"))
    people = rows.select(
        key, asked, "n", F.expr("xpath(x, '//Contribuyente/Nif/text()')").alias("nifs"), F.expr("xpath(x, '//Contribuyente/Resultado/text()')").alias("results"),
        F.expr("nullif(coalesce(nullif(xpath_string(x, '//Fault/faultstring'), ''), xpath_string(x, '//Fault/Reason/Text')), '')").alias("fault"),
    )
    tidy = F.transform("results", lambda r: F.regexp_replace(F.regexp_replace(F.trim(F.upper(strip_diacritics(r))), r"\s*-\s*", "-"), r"\s+", " "))
    named = F.size("nifs") == F.size("results")  # each row names a number
    paired = F.when(named, F.arrays_zip(F.transform("nifs", lambda n: ids.norm_nif(n)).alias("nif"), tidy.alias("result"))).otherwise(F.transform(tidy, lambda r: F.struct(F.lit(None).cast("string").alias("nif"), r.alias("result"))))
    people = people.withColumn("p", paired).withColumn("own", F.filter("p", lambda x: x["nif"].isNull() | (x["nif"] == ids.norm_nif(F.col(asked)))))
    matched = F.exists("own", lambda x: x["result"] == "IDENTIFICADO")
    result = F.when(matched, F.lit("IDENTIFICADO")).otherwise(F.try_element_at("own", F.lit(1))["result"])
    return people.select(key, F.coalesce(matched, F.lit(False)).alias("matched"), result.alias("result"), F.coalesce(F.size("own"), F.lit(0)).alias("rows"), (F.col("n") - F.coalesce(F.size("own"), F.lit(0))).alias("other_rows"), "fault")


def surnames(responses: DataFrame, key: str = "key", body: str = "body", asked: str = "surname", population: int = POPULATION) -> DataFrame:
    """(key, surname, per_mille, count, basis, rank) of the surname asked for: a published rate, or a count over the population."""
    rows = responses.select(key, norm_name(F.col(asked)).alias("surname"), F.try_parse_json(F.col(body)).alias("v"))
    box = F.coalesce(node_of(F.col("v"), "onomastica", "dades", "data", "result"), F.col("v"))
    listed = list_of(F.coalesce(node_of(box, "ff", "f", "rows", "items", "cognoms", "list"), box))
    rows = rows.withColumn("l", listed)
    own = F.filter("l", lambda o: norm_name(text_of(o, "cognom", "apellido", "surname", "nom", "name", "c")) == F.col("surname"))
    o = F.coalesce(F.try_element_at(own, F.lit(1)), F.try_element_at("l", F.lit(1)))
    rows = rows.select(key, "surname", o.alias("o"))
    o = F.col("o")
    rate, count = _number(text_of(o, "per_mil", "permil", "per_mille", "taxa", "frequencia")), _number(text_of(o, "nombre", "count", "total", "frecuencia", "n"))
    rows = rows.withColumns({"rate": F.when(rate > 0, rate), "count": F.when(count > 0, count.cast("bigint")), "rank": _number(text_of(o, "ordre", "orden", "rank", "posicio", "posicion")).cast("bigint")})
    basis = F.when(F.col("rate").isNotNull(), "published_rate").when(F.col("count").isNotNull(), "count_over_population").otherwise("not_read")
    per_mille = F.coalesce("rate", F.round(F.col("count") * 1000 / population, 6).cast("decimal(18,6)"))
    return rows.select(key, "surname", per_mille.alias("per_mille"), "count", basis.alias("basis"), "rank")


def _folded(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(strip_diacritics(text)), r"\s+", " "))


def column_of(header: Column) -> Column:
    """Which column of a builders' table a heading names, null if none."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(HEADERS):
        out = F.when(_folded(header).rlike(pattern), name).otherwise(out)
    return out


def community_in(text: Column) -> Column:
    out = F.lit(None).cast("string")
    for word, name in reversed(COMMUNITIES):
        out = F.when(F.contains(_folded(text), F.lit(word)), name).otherwise(out)
    return out


def builders(responses: DataFrame, key: str = "key", body: str = "body", table_id: str = "tabla-consulta") -> DataFrame:
    """(key, registered, number, name, nif, community, valid_from, valid_to, status, table_found, entries, unread) of each page of the register of accredited builders.

    The first row with two or more known headings names the columns, and each row below is an entry; else pairs of a heading and a value are one. What a
    table doesn't have is looked for in the page's text. registered is null where the page says neither.
    """
    pages = responses.select(key, body)
    cells = markup.table_cells(pages, key, body).where(F.col("table_id") == table_id).withColumn("column", column_of(F.col("text")))
    rows = cells.groupBy(key, "row_no").agg(
        F.array_sort(F.collect_list(F.struct("column_no", "text", "column", "header"))).alias("c"), F.count("column").alias("known"), F.count(F.lit(1)).alias("width"), F.bool_and("header").alias("heading")
    )
    heads = rows.where("known >= 2 AND width >= 3").groupBy(key).agg(F.min_by(F.struct("row_no", "c"), "row_no").alias("head"))
    rows = rows.join(heads, key, "left")
    names = ("number", "name", "nif", "community", "valid_from", "valid_to", "status")

    def in_column(name):
        at = F.try_element_at(F.filter("head.c", lambda h: h["column"] == name), F.lit(-1))["column_no"]
        return F.nullif(F.trim(F.try_element_at(F.filter("c", lambda x: x["column_no"] == at), F.lit(1))["text"]), F.lit(""))

    below = rows.where("head IS NOT NULL AND row_no > head.row_no AND width >= 2 AND NOT heading").select(key, "row_no", *(in_column(n).alias(n) for n in names)).where(" OR ".join(f"{n} IS NOT NULL" for n in names))
    pairs = rows.where("width = 2 AND c[0].column IS NOT NULL").join(below.select(key).distinct(), key, "left_anti")
    pairs = pairs.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("row_no").alias("row_no"), *(F.min_by(F.when((F.col("c")[0]["column"] == n) & (F.trim(F.col("c")[1]["text"]) != ""), F.trim(F.col("c")[1]["text"])), F.when((F.col("c")[0]["column"] == n) & (F.trim(F.col("c")[1]["text"]) != ""), F.col("row_no"))).alias(n) for n in names))
    entries = below.unionByName(pairs.where("n >= 2").drop("n"))
    first = entries.groupBy(key).agg(F.min_by(F.struct(*names), "row_no").alias("e"), F.count(F.lit(1)).alias("entries"))
    text = markup.visible_text(F.col(body))
    # the table's own text speaks for a page that has one
    table_text = cells.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "column_no", "text"))), lambda x: x["text"]), "\n").alias("cells"))
    out = pages.withColumn("page", text).join(table_text, key, "left").join(first, key, "left").withColumn("text", F.coalesce("cells", "page"))
    said = _folded(F.col("text"))
    registered = F.when(F.contains(said, F.lit("no existe ningun registro")), False).when(said.rlike(r"\b(inscrita|acreditada)\b"), True)
    out = out.withColumn("registered", registered)
    days = F.regexp_extract_all("text", F.lit(r"\b\d{1,2}[/.-]\d{1,2}[/.-]\d{4}\b"), F.lit(0))
    number = F.nullif(F.regexp_extract("text", r"\b\d{2}/\d{2}/\d{7}\b", 0), F.lit(""))
    marker = r"\b(inscrita|acreditada)\b"
    sentence = F.try_element_at(F.filter(F.split("text", r"(?<=\.)\s+|\n"), lambda s: F.when(F.col("registered"), _folded(s).rlike(marker)).otherwise(F.contains(_folded(s), F.lit("no existe ningun registro")))), F.lit(1))
    yes = F.col("registered")
    fields = {
        "number": F.coalesce("e.number", number), "name": F.col("e.name"), "nif": nif_of(F.col("e.nif")), "community": F.coalesce(community_in(F.col("e.community")), F.col("e.community"), community_in(F.col("text"))),
        "valid_from": F.coalesce(_day(F.col("e.valid_from")), _day(F.try_element_at(days, F.lit(1)))), "valid_to": F.coalesce(_day(F.col("e.valid_to")), _day(F.try_element_at(days, F.lit(2)))),
    }
    out = out.select(
        key, "registered", *(F.when(yes, c).alias(n) for n, c in fields.items()), F.coalesce(F.when(yes, F.col("e.status")), F.when(yes.isNotNull(), F.substring(F.trim(sentence), 1, 200))).alias("status"), F.col("cells").isNotNull().alias("table_found"),
        F.when(yes, F.coalesce("entries", F.lit(1))).otherwise(0).alias("entries"),
    )
    unread = [F.when(F.col("registered") & F.col(c).isNull(), F.lit(c)) for c in ("number", "community", "valid_from", "valid_to")]
    unread += [F.when(~F.col("table_found") & ~F.coalesce("registered", F.lit(False)), F.lit("table")), F.when(F.col("registered").isNull(), F.lit("verdict"))]
    return out.withColumn("unread", F.array_compact(F.array(*unread)))
