"""Checks of extracted documents: arithmetic, dates, identifiers. One row a document and check.

A document is one nested row, so every check is an expression over its arrays and nothing is shuffled. A check whose
inputs are missing counts as passed with checked = false. Sums are decimals; n parts may be off by n tolerances.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.functions.ids import check_iban, check_nif

D = "decimal(20,4)"
#: Tolerances in euros, and the VAT rates that exist.
LINE, TOTAL, STATEMENT, QUOTA = "0.02", "0.05", "0.01", "0.05"
VAT = (0, 4, 10, 21)

DOCUMENTS = {
    "invoice": """document_id string, doc_type string, fecha_expedicion date, fecha_operacion date, vencimiento date, emisor struct<nif:string>, destinatario struct<nif:string>, base_imponible_total double, iva_total double,
        retencion_irpf struct<pct:double,importe:double>, suplidos double, total_factura double, iban_mostrado string,
        lineas array<struct<cantidad:double,precio_unitario:double,descuento_pct:double,base:double,tipo_iva_pct:double,cuota_iva:double,total_linea:double,es_partida_alzada:boolean>>, resumen_iva array<struct<base:double,tipo_pct:double,cuota:double>>""",
    "statement": "document_id string, iban string, periodo_desde date, periodo_hasta date, saldo_inicial double, saldo_final double, movimientos array<struct<fecha:date,importe:double,saldo:double,contraparte_iban:string>>",
    "certification": """document_id string, fecha date, contratista struct<nif:string>, contrato_total double, total_origen double, total_anterior double, total_actual double, base double, iva double, retencion double, total double,
        partidas array<struct<origen:double,anterior:double,actual:double>>""",
    "minutes": "document_id string, convocatoria date, fecha date, firma date, quorum double, asistentes array<struct<unidad:string,coeficiente:double>>, acuerdos array<struct<votos_favor:int,votos_contra:int,abstenciones:int,coeficiente_favor:double>>",
    "budget": """document_id string, fecha date, validez date, emisor struct<nif:string>, pem double, gastos_generales double, gastos_generales_pct double, beneficio double, beneficio_pct double, contrata double, iva_pct double, iva double, total double,
        capitulos array<struct<subtotal:double,partidas:array<struct<importe:double>>>>""",
    "accounts": """document_id string, desde date, hasta date, comunidad struct<nif:string>, ingresos array<struct<importe:double>>, gastos array<struct<importe:double>>, total_ingresos double, total_gastos double, resultado double,
        saldo_inicial double, saldo_final double, fondo struct<inicial:double,dotacion:double,uso:double,final:double>, unidades array<struct<coeficiente:double>>""",
    "contract": "document_id string, firma date, inicio date, fin date, partes array<struct<nif:string>>, iban_prestamo string, precio double, iva_pct double, precio_con_iva double, calendario array<struct<pct:double,importe:double>>",
    "contribution": "document_id string, acuerdo date, inicio date, iban string, total double, cuotas array<struct<coeficiente:double,cuota:double,plazos:array<struct<importe:double>>>>",
}


def d(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast(D)


def total(items: str, field: str) -> Column:
    """Sum of an array's field; null if the array is empty or a value is missing."""
    values = F.transform(items, lambda x: x[field].cast(D))
    known = (F.size(items) > 0) & F.forall(values, lambda v: v.isNotNull())
    return F.when(known, F.aggregate(values, F.lit(0).cast(D), lambda a, v: (a + v).cast(D)))


def near(a: Column, b: Column, tolerance: str, n: Column | int = 1) -> Column:
    """Null if a side is unknown."""
    return F.abs(a - b) <= F.lit(tolerance).cast(D) * n


def each(items: str, test: Callable[[Column], Column]) -> Column:
    """True if test holds for all elements that it applies to; null if it applies to none."""
    known = F.filter(F.transform(items, test), lambda t: t.isNotNull())
    return F.when(F.size(known) > 0, F.forall(known, lambda t: t))


def ordered(*days: str) -> Column:
    """Dates in order, each from 2019 to a year ahead of the first known one's decade; null if fewer than one is known."""
    known = F.array_compact(F.array(*days))
    sane = F.forall(known, lambda x: (F.year(x) >= 2019) & (F.year(x) <= 2100))
    return F.when(F.size(known) > 0, sane & (known == F.array_sort(known)))


def nif(c: str, entity: str | None = None) -> Column:
    checked = check_nif(F.col(c))
    good = checked["valid"] if entity is None else checked["valid"] & (checked["entity"] == entity)
    return F.when(F.trim(c) != "", F.coalesce(good, F.lit(False)))


def iban(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when((F.trim(c) != "") & ~F.contains(c, F.lit("*")), check_iban(c)["valid"])


def rates(items: str, field: str) -> Column:
    return each(items, lambda x: x[field].cast(D).isin(*(F.lit(v).cast(D) for v in VAT)))


def invoice() -> dict[str, Column]:
    lines, rows = "lineas", "resumen_iva"
    per_rate = each(rows, lambda r: near(r["base"].cast(D) * r["tipo_pct"].cast(D) / 100, r["cuota"].cast(D), LINE))
    line_rate = each(lines, lambda x: near(x["base"].cast(D) * x["tipo_iva_pct"].cast(D) / 100, x["cuota_iva"].cast(D), LINE))

    def arithmetic(x):
        net = x["cantidad"].cast(D) * x["precio_unitario"].cast(D) * (1 - F.coalesce(x["descuento_pct"].cast(D), F.lit(0)) / 100)
        own = F.when(F.coalesce(x["es_partida_alzada"], F.lit(False)), F.lit(None)).otherwise(near(net, x["base"].cast(D), LINE))
        gross = near(x["base"].cast(D) + x["cuota_iva"].cast(D), x["total_linea"].cast(D), LINE)
        return F.when(own.isNull() & gross.isNull(), F.lit(None)).otherwise(F.coalesce(own, F.lit(True)) & F.coalesce(gross, F.lit(True)))

    held = F.coalesce(d("retencion_irpf.importe"), F.lit(0).cast(D))
    due = d("base_imponible_total") + d("iva_total") - held + F.coalesce(d("suplidos"), F.lit(0).cast(D))
    sums = near(total(rows, "base"), d("base_imponible_total"), TOTAL) & near(total(rows, "cuota"), d("iva_total"), TOTAL)
    both = F.when(per_rate.isNull() & line_rate.isNull(), F.lit(None)).otherwise(F.coalesce(per_rate, F.lit(True)) & F.coalesce(line_rate, F.lit(True)))
    return {
        "lines_sum_to_base": near(total(lines, "base"), d("base_imponible_total"), LINE, F.size(lines)),
        "summary_sums_to_totals": sums,
        "rate_times_base": both,
        "total": near(due, d("total_factura"), TOTAL),
        "vat_rate_exists": F.coalesce(rates(lines, "tipo_iva_pct") & F.coalesce(rates(rows, "tipo_pct"), F.lit(True)), rates(rows, "tipo_pct")),
        "simplified_up_to_400": F.when(F.col("doc_type") == "factura_simplificada", d("total_factura") <= 400),
        "line_arithmetic": each(lines, arithmetic),
        "dates": ordered("fecha_operacion", "fecha_expedicion", "vencimiento"),
        "issuer_nif": nif("emisor.nif"),
        "recipient_nif": nif("destinatario.nif"),
        "iban": iban("iban_mostrado"),
    }


def statement() -> dict[str, Column]:
    m = "movimientos"
    value = F.transform(m, lambda x: F.struct(x["importe"].cast(D).alias("v"), x["saldo"].cast(D).alias("s")))
    start = F.struct(d("saldo_inicial").alias("run"), F.lit(0).alias("bad"))

    def step(a, x):
        run = (a["run"] + x["v"]).cast(D)
        off = F.coalesce(F.abs(run - x["s"]) > F.lit(STATEMENT).cast(D), F.lit(False))
        return F.struct(F.coalesce(x["s"], run).alias("run"), (a["bad"] + off.cast("int")).alias("bad"))

    printed = F.exists(m, lambda x: x["saldo"].isNotNull()) & F.col("saldo_inicial").isNotNull()
    return {
        "balance": near(d("saldo_inicial") + total(m, "importe"), d("saldo_final"), STATEMENT),
        "running_balance": F.when(printed, F.aggregate(value, start, step)["bad"] == 0),
        "dates": ordered("periodo_desde", "periodo_hasta"),
        "movements_in_period": each(m, lambda x: x["fecha"].between(F.col("periodo_desde"), F.col("periodo_hasta"))),
        "iban": iban("iban"),
        "counterparty_iban": each(m, lambda x: iban(x["contraparte_iban"])),
    }


def certification() -> dict[str, Column]:
    p = "partidas"
    rows = each(p, lambda x: near(x["origen"].cast(D) - x["anterior"].cast(D), x["actual"].cast(D), LINE))
    whole = near(d("total_origen") - d("total_anterior"), d("total_actual"), LINE)
    net = d("base") + d("iva")
    return {
        "current_is_difference": F.when(rows.isNull() & whole.isNull(), F.lit(None)).otherwise(F.coalesce(rows, F.lit(True)) & F.coalesce(whole, F.lit(True))),
        "items_sum_to_totals": near(total(p, "origen"), d("total_origen"), LINE, F.size(p)) & near(total(p, "actual"), d("total_actual"), LINE, F.size(p)),
        "within_contract": d("total_origen") <= d("contrato_total") + F.lit(LINE).cast(D),
        "base_vat_total": near(net, d("total"), TOTAL) | near(net - F.coalesce(d("retencion"), F.lit(0).cast(D)), d("total"), TOTAL),
        "dates": ordered("fecha"),
        "contractor_nif": nif("contratista.nif"),
    }


def minutes() -> dict[str, Column]:
    quotas = total("asistentes", "coeficiente")
    limit = F.coalesce(d("quorum"), quotas, F.lit(100).cast(D)) + F.lit(QUOTA).cast(D)
    zero = F.lit(0)
    return {
        "quotas_up_to_100": quotas <= F.lit("100.05").cast(D),
        "quorum_is_sum": near(d("quorum"), quotas, QUOTA),
        "in_favour_up_to_quorum": each("acuerdos", lambda a: a["coeficiente_favor"].cast(D) <= limit),
        "votes_up_to_attendees": F.when(F.size("asistentes") > 0, each("acuerdos", lambda a: F.coalesce(a["votos_favor"], zero) + F.coalesce(a["votos_contra"], zero) + F.coalesce(a["abstenciones"], zero) <= F.size("asistentes"))),
        "dates": ordered("convocatoria", "fecha", "firma"),
    }


def budget() -> dict[str, Column]:
    def items(c):
        return F.when(F.size(c["partidas"]) > 0, F.aggregate(c["partidas"], F.lit(0).cast(D), lambda a, x: (a + x["importe"].cast(D)).cast(D)))

    chapters = F.transform("capitulos", lambda c: F.coalesce(c["subtotal"].cast(D), items(c)))
    summed = F.when(F.size("capitulos") > 0, F.aggregate(chapters, F.lit(0).cast(D), lambda a, v: (a + v).cast(D)))

    def share(amount, pct):
        return F.coalesce(d(amount), d("pem") * d(pct) / 100, F.lit(0).cast(D))

    net = F.coalesce(d("contrata"), d("pem"))
    return {
        "items_sum_to_chapter": each("capitulos", lambda c: near(items(c), c["subtotal"].cast(D), LINE, F.size(c["partidas"]))),
        "chapters_sum_to_pem": near(summed, d("pem"), LINE, F.size("capitulos")),
        "contract_price": near(d("pem") + share("gastos_generales", "gastos_generales_pct") + share("beneficio", "beneficio_pct"), d("contrata"), TOTAL),
        "total_with_vat": near(net + d("iva"), d("total"), TOTAL) & F.coalesce(near(net * d("iva_pct") / 100, d("iva"), LINE), F.lit(True)),
        "vat_rate_exists": F.when(F.col("iva_pct").isNotNull(), d("iva_pct").isin(*(F.lit(v).cast(D) for v in VAT))),
        "dates": ordered("fecha", "validez"),
        "issuer_nif": nif("emisor.nif"),
    }


def accounts() -> dict[str, Column]:
    fund = d("fondo.inicial") + F.coalesce(d("fondo.dotacion"), F.lit(0).cast(D)) - F.coalesce(d("fondo.uso"), F.lit(0).cast(D))
    return {
        "income_sums": near(total("ingresos", "importe"), d("total_ingresos"), LINE, F.size("ingresos")),
        "expense_sums": near(total("gastos", "importe"), d("total_gastos"), LINE, F.size("gastos")),
        "result": near(d("total_ingresos") - d("total_gastos"), d("resultado"), TOTAL),
        "closing": near(d("saldo_inicial") + d("resultado"), d("saldo_final"), TOTAL),
        "reserve": near(fund, d("fondo.final"), TOTAL),
        "quotas_up_to_100": total("unidades", "coeficiente") <= F.lit("100.05").cast(D),
        "dates": ordered("desde", "hasta"),
        "community_nif": nif("comunidad.nif", "H"),
    }


def contract() -> dict[str, Column]:
    pct, sums = total("calendario", "pct"), total("calendario", "importe")
    by_amount = near(sums, d("precio"), TOTAL) | near(sums, d("precio_con_iva"), TOTAL)
    return {
        "price_with_vat": near(d("precio") * (1 + d("iva_pct") / 100), d("precio_con_iva"), TOTAL),
        "schedule_sums": F.coalesce(near(pct, F.lit(100).cast(D), QUOTA), by_amount),
        "dates": ordered("firma", "inicio", "fin"),
        "party_nifs": each("partes", lambda p: F.when(F.trim(p["nif"]) != "", check_nif(p["nif"])["valid"])),
        "loan_iban": iban("iban_prestamo"),
    }


def contribution() -> dict[str, Column]:
    return {
        "quotas_sum_to_total": near(total("cuotas", "cuota"), d("total"), LINE, F.size("cuotas")),
        "instalments_sum_to_quota": each("cuotas", lambda c: F.when(F.size(c["plazos"]) > 0, near(F.aggregate(c["plazos"], F.lit(0).cast(D), lambda a, x: (a + x["importe"].cast(D)).cast(D)), c["cuota"].cast(D), LINE, F.size(c["plazos"])))),
        "quotas_up_to_100": total("cuotas", "coeficiente") <= F.lit("100.05").cast(D),
        "iban": iban("iban"),
        "dates": ordered("acuerdo", "inicio"),
    }


CHECKS = {"invoice": invoice, "statement": statement, "certification": certification, "minutes": minutes, "budget": budget, "accounts": accounts, "contract": contract, "contribution": contribution}


def validate(docs: DataFrame, kind: str, version: str = "1") -> DataFrame:
    """(document_id, code, version, passed, checked) for every check of a kind of document."""
    checks = CHECKS[kind]()
    named = F.array(*(F.struct(F.lit(f"{kind}.{code}").alias("code"), test.alias("test")) for code, test in checks.items()))
    rows = docs.select("document_id", F.explode(named).alias("c"))
    return rows.select("document_id", "c.code", F.lit(version).alias("version"), F.coalesce("c.test", F.lit(True)).alias("passed"), F.col("c.test").isNotNull().alias("checked"))


def accepted(results: DataFrame) -> DataFrame:
    """(document_id, accepted, failed): a document is accepted if no check that could be made failed."""
    bad = F.when(~F.col("passed"), F.col("code"))
    return results.groupBy("document_id").agg(F.bool_and("passed").alias("accepted"), F.array_sort(F.collect_set(bad)).alias("failed"))
