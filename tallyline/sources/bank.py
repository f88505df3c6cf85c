"""Bank exports as DataFrames: Norma 43, camt.053 and CSV, with one shape for their movements.

A file is one bank statement, so a file is the unit of order: its lines are numbered inside a row, and
many files are read in parallel. Movements have the columns of MOVEMENT; source and file tell where they come from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyline.functions.amounts import parse_amount
from tallyline.functions.dates import calendar_date, full_year, parse_date
from tallyline.functions.hashing import transaction_key
from tallyline.functions.text import fold

MOVEMENT = (
    "source", "file", "account", "line", "op_date", "value_date", "common_code", "own_code", "amount", "document", "ref1", "ref2",
    "extra", "counterparty", "counterparty_iban", "bank_code", "foreign_currency", "foreign_amount", "balance",
)
MONEY = "decimal(14,2)"
#: Currency names of the numeric codes.
CURRENCIES = {"978": "EUR", "840": "USD", "826": "GBP", "756": "CHF", "392": "JPY", "752": "SEK", "578": "NOK", "208": "DKK", "985": "PLN"}
#: Header names of CSV exports by field, folded to lower case without accents.
HEADERS = {
    "day": ("fecha", "fecha operacion", "f. operacion", "data", "data operacio", "date", "fecha contable", "fecha_operacion"),
    "value": ("fecha valor", "f. valor", "valor", "data valor", "value date", "fecha_valor"),
    "concept": ("concepto", "concepte", "descripcion", "descripcio", "description", "detalle", "detall", "observaciones"),
    "amount": ("importe", "import", "amount", "importe eur", "cantidad", "quantitat"),
    "debit": ("debe", "cargo", "deure", "debit"),
    "credit": ("haber", "abono", "haver", "credit"),
    "balance": ("saldo", "saldo eur", "balance", "saldo posterior"),
}
CONFIDENCE = {"norma43": 1.0, "camt053": 1.0, "csv": 0.95}


def _lines(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """(file, line, text) of the lines that aren't blank, numbered from 1."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.decode("content", encoding).alias("all"))
    each = files.select("file", F.posexplode(F.split(F.regexp_replace("all", "^﻿", ""), "\r\n|\r|\n")).alias("line", "text"))
    return each.select("file", (F.col("line") + 1).alias("line"), "text").where(F.trim("text") != "")


def _n43_date(c: Column) -> Column:
    y, m, d = (F.substring(c, i, 2) for i in (1, 3, 5))
    return calendar_date(full_year(y), m.try_cast("int"), d.try_cast("int"))


def _signed(sign: Column, digits: Column) -> Column:
    """Cents with a sign: 1 is debit, 2 is credit; null if unreadable."""
    value = (F.when(digits.rlike(r"^\d+$"), digits).try_cast("decimal(14,0)") / 100).cast(MONEY)
    return F.when(sign == "1", -value).when(sign == "2", value)


def norma43_records(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """Lines as records: file, line, type, text padded to 80, and account and movement numbers that they belong to."""
    rows = _lines(spark, path, encoding).withColumn("text", F.rpad(F.substring("text", 1, 80), 80, " ")).withColumn("type", F.substring("text", 1, 2))
    order = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("account_no", F.sum((F.col("type") == "11").cast("int")).over(order))
    # a movement counts only with a readable amount; what follows an unreadable one still belongs to the last readable
    good = (F.col("type") == "22") & (F.col("account_no") > 0) & _signed(F.substring("text", 28, 1), F.substring("text", 29, 14)).isNotNull()
    inside = Window.partitionBy("file", "account_no").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("movement_no", F.sum(good.cast("int")).over(inside)).withColumn("good", good)


def _part(a: int, b: int) -> Column:
    return F.substring("text", a, b - a + 1)


def norma43_movements(records: DataFrame) -> DataFrame:
    """MOVEMENT rows of norma43_records()."""
    tidy = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    key = ["file", "account_no", "movement_no"]
    accounts = records.where("type = '11'").select("file", "account_no", F.concat(_part(3, 6), _part(7, 10), _part(11, 20)).alias("account"))
    moves = records.where("good").select(
        *key, "line", _n43_date(_part(11, 16)).alias("op_date"), _n43_date(_part(17, 22)).alias("v"), _part(23, 24).alias("common_code"), _part(25, 27).alias("own_code"),
        _signed(_part(28, 28), _part(29, 42)).alias("amount"), F.trim(_part(43, 52)).alias("document"), F.trim(_part(53, 64)).alias("ref1"), F.trim(_part(65, 80)).alias("ref2"),
    )
    texts = records.where("type = '23' AND movement_no > 0").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("line", tidy(_part(5, 42)).alias("a"), tidy(_part(43, 80)).alias("b")))).alias("t"))
    texts = texts.select(*key, F.filter(F.flatten(F.transform("t", lambda x: F.array(x["a"], x["b"]))), lambda x: x != "").alias("extra"))
    code = F.create_map(*(F.lit(x) for p in CURRENCIES.items() for x in p))
    foreign = records.where("type = '24' AND movement_no > 0").groupBy(*key).agg(F.max_by(F.struct(F.coalesce(code[_part(5, 7)], _part(5, 7)).alias("c"), _signed(F.lit("2"), _part(8, 21)).alias("a")), "line").alias("f"))
    out = moves.join(accounts, ["file", "account_no"]).join(texts, key, "left").join(foreign, key, "left")
    none = F.lit(None).cast("string")
    return out.select(
        F.lit("norma43").alias("source"), "file", "account", "line", "op_date", F.coalesce("v", "op_date").alias("value_date"), "common_code", "own_code", "amount", "document", "ref1", "ref2",
        F.coalesce("extra", F.array().cast("array<string>")).alias("extra"), tidy(F.array_join(F.coalesce("extra", F.array().cast("array<string>")), " ")).alias("counterparty"),
        none.alias("counterparty_iban"), none.alias("bank_code"), F.col("f.c").alias("foreign_currency"), F.col("f.a").alias("foreign_amount"), F.lit(None).cast(MONEY).alias("balance"),
    )


def norma43_accounts(records: DataFrame) -> DataFrame:
    """One row an account with its period, balances, the sums of its movements, and whether its trailer agrees with them."""
    head = records.where("type = '11'").select(
        "file", "account_no", F.concat(_part(3, 6), _part(7, 10), _part(11, 20)).alias("account"), _n43_date(_part(21, 26)).alias("period_from"), _n43_date(_part(27, 32)).alias("period_to"),
        F.coalesce(_signed(_part(33, 33), _part(34, 47)), F.lit(0).cast(MONEY)).alias("opening"), F.trim(F.regexp_replace(_part(52, 77), r"\s+", " ")).alias("holder"),
    )
    v = _signed(_part(28, 28), _part(29, 42))
    zero = F.lit(0).cast("decimal(20,2)")
    sums = records.where("good").groupBy("file", "account_no").agg(
        F.count_if(v < 0).alias("debits"), F.coalesce(F.sum(F.when(v < 0, -v)), zero).alias("debit_total"), F.count_if(v > 0).alias("credits"), F.coalesce(F.sum(F.when(v > 0, v)), zero).alias("credit_total")
    )
    tail = records.where("type = '33'").groupBy("file", "account_no").agg(F.max_by("text", "line").alias("text"))
    tail = tail.select(
        "file", "account_no", _part(21, 25).try_cast("bigint").alias("n_d"), _signed(F.lit("2"), _part(26, 39)).alias("t_d"), _part(40, 44).try_cast("bigint").alias("n_c"),
        _signed(F.lit("2"), _part(45, 58)).alias("t_c"), _signed(_part(59, 59), _part(60, 73)).alias("closing"),
    )
    out = head.join(sums, ["file", "account_no"], "left").join(tail, ["file", "account_no"], "left")
    out = out.fillna(0, ["debits", "credits"]).withColumns({c: F.coalesce(c, zero) for c in ("debit_total", "credit_total")})
    agrees = (
        (F.col("n_d") == F.col("debits")) & (F.col("n_c") == F.col("credits")) & (F.col("t_d") == F.col("debit_total")) & (F.col("t_c") == F.col("credit_total"))
        & (F.col("opening") + F.col("credit_total") - F.col("debit_total") == F.col("closing"))
    )
    computed = (F.col("opening") + F.col("credit_total") - F.col("debit_total")).cast(MONEY)
    return out.withColumn("self_check", F.coalesce(agrees, F.lit(False))).withColumn("closing", F.coalesce("closing", computed)).drop("n_d", "n_c", "t_d", "t_c")


_PARTY = "struct<Nm:string,Pty:struct<Nm:string>>"
_ACCT = "struct<Id:struct<IBAN:string,Othr:struct<Id:string>>>"
_CAMT = f"""
Acct {_ACCT}, FrToDt struct<FrDtTm:string,ToDtTm:string>,
Bal array<struct<Tp:struct<CdOrPrtry:struct<Cd:string>>,Amt:string,CdtDbtInd:string,Dt:struct<Dt:string,DtTm:string>>>,
Ntry array<struct<NtryRef:string,Amt:string,CdtDbtInd:string,BookgDt:struct<Dt:string,DtTm:string>,ValDt:struct<Dt:string,DtTm:string>,AcctSvcrRef:string,
BkTxCd:struct<Domn:struct<Cd:string,Fmly:struct<Cd:string,SubFmlyCd:string>>,Prtry:struct<Cd:string>>,AddtlNtryInf:string,
NtryDtls:array<struct<TxDtls:array<struct<Refs:struct<EndToEndId:string>,RltdPties:struct<Dbtr:{_PARTY},Cdtr:{_PARTY},UltmtDbtr:{_PARTY},UltmtCdtr:{_PARTY},DbtrAcct:{_ACCT},CdtrAcct:{_ACCT}>,RmtInf:struct<Ustrd:array<string>>>>>>>>
"""


def camt053_statements(spark: SparkSession, path: str) -> DataFrame:
    """Statements of camt.053 files: file, account, opening (OPBD, else PRCD), closing (CLBD), entries."""
    rows = spark.read.format("xml").option("rowTag", "Stmt").option("valueTag", "_VALUE").schema(_CAMT).load(path).select("*", F.col("_metadata.file_path").alias("file"))

    def balance(code):
        own = F.get(F.filter("Bal", lambda b: b["Tp"]["CdOrPrtry"]["Cd"] == code), F.lit(0))
        value = own["Amt"].try_cast(MONEY)
        return F.when(own["CdtDbtInd"] == "DBIT", -value).otherwise(value)

    account = F.coalesce(F.col("Acct.Id.IBAN"), F.col("Acct.Id.Othr.Id"))
    return rows.select("file", account.alias("account"), F.coalesce(balance("OPBD"), balance("PRCD")).alias("opening"), balance("CLBD").alias("closing"), F.col("Ntry").alias("entries"))


def camt053_movements(statements: DataFrame) -> DataFrame:
    """MOVEMENT rows of camt053_statements(); entries without a readable amount are left out."""
    e = statements.select("file", "account", F.posexplode("entries").alias("line", "e"))
    debit = F.col("e.CdtDbtInd") == "DBIT"
    value = F.col("e.Amt").try_cast(MONEY)
    tx = F.flatten(F.transform("e.NtryDtls", lambda d: F.coalesce(d["TxDtls"], F.expr("array()").cast(statements.schema["entries"].dataType.elementType["NtryDtls"].dataType.elementType["TxDtls"].dataType))))

    def name(p):
        return F.coalesce(p["Nm"], p["Pty"]["Nm"])

    def first(fn):
        return F.get(F.filter(F.transform(tx, fn), lambda x: x.isNotNull()), F.lit(0))

    def other(own, others):
        return F.when(debit, first(lambda t: F.coalesce(*(own(t["RltdPties"][n]) for n in others[0])))).otherwise(first(lambda t: F.coalesce(*(own(t["RltdPties"][n]) for n in others[1]))))

    notes = F.flatten(F.filter(F.transform(tx, lambda t: t["RmtInf"]["Ustrd"]), lambda u: u.isNotNull()))
    extra = F.array_distinct(F.array_compact(F.concat(F.coalesce(notes, F.array().cast("array<string>")), F.array("e.AddtlNtryInf"))))
    day = lambda c: F.coalesce(F.try_to_date(F.col(f"{c}.Dt")), F.try_to_date(F.left(F.col(f"{c}.DtTm"), F.lit(10))))
    who = other(name, (("Cdtr", "UltmtCdtr"), ("Dbtr", "UltmtDbtr")))
    iban = F.upper(F.regexp_replace(other(lambda a: a["Id"]["IBAN"], (("CdtrAcct",), ("DbtrAcct",))), r"\s", ""))
    domain = F.nullif(F.concat_ws("/", "e.BkTxCd.Domn.Cd", "e.BkTxCd.Domn.Fmly.Cd", "e.BkTxCd.Domn.Fmly.SubFmlyCd"), F.lit(""))
    empty = F.lit("")
    return e.where(value.isNotNull()).select(
        F.lit("camt053").alias("source"), "file", "account", (F.col("line") + 1).alias("line"), day("e.BookgDt").alias("op_date"), F.coalesce(day("e.ValDt"), day("e.BookgDt")).alias("value_date"),
        empty.alias("common_code"), F.coalesce("e.BkTxCd.Prtry.Cd", empty).alias("own_code"), F.when(debit, -value).otherwise(value).cast(MONEY).alias("amount"),
        F.coalesce(first(lambda t: t["Refs"]["EndToEndId"]), empty).alias("document"), F.coalesce("e.NtryRef", empty).alias("ref1"), F.coalesce("e.AcctSvcrRef", empty).alias("ref2"),
        extra.alias("extra"), F.coalesce(who, F.array_join(extra, " ")).alias("counterparty"), iban.alias("counterparty_iban"), domain.alias("bank_code"),
        F.lit(None).cast("string").alias("foreign_currency"), F.lit(None).cast(MONEY).alias("foreign_amount"), F.lit(None).cast(MONEY).alias("balance"),
    )


def csv_movements(spark: SparkSession, path: str, account: str = "", encoding: str = "UTF-8", look: int = 15) -> DataFrame:
    """MOVEMENT rows of CSV files, each with its own separator and header within its first lines.

    Rows without a readable date or amount are left out. Amounts come from one signed column, or from a debit
    and a credit column.
    """
    rows = _lines(spark, path, encoding)
    # the separator of a file is the commonest of three in its first lines
    head = rows.where(F.col("line") <= look).groupBy("file").agg(*(F.sum(F.length("text") - F.length(F.replace("text", F.lit(s), F.lit("")))).alias(n) for s, n in ((";", "semi"), ("\t", "tab"), (",", "comma"))))
    sep = F.when((F.col("semi") >= F.col("tab")) & (F.col("semi") > 0), ";").when(F.col("tab") > 0, "\t").otherwise(",")
    rows = rows.join(head.select("file", sep.alias("sep")), "file")

    def cells(s):
        found = F.regexp_extract_all(F.concat(F.lit(s), "text"), F.lit(rf'{s}("(?:[^"]|"")*"|[^{s}]*)'), F.lit(1))
        return F.transform(found, lambda c: F.trim(F.when(F.startswith(c, F.lit('"')), F.replace(F.regexp_replace(c, '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(c)))

    rows = rows.withColumn("cells", F.when(F.col("sep") == ";", cells(";")).when(F.col("sep") == "\t", cells("\t")).otherwise(cells(",")))
    names = rows.withColumn("names", F.transform("cells", lambda c: fold(c, "lower")))

    def place(field):
        at = [F.nullif(F.array_position("names", F.lit(n)), F.lit(0)) for n in HEADERS[field]]
        return F.coalesce(*at)

    head = names.where(F.col("line") <= look).select("file", F.col("line").alias("header"), *(place(f).alias(f"_{f}") for f in HEADERS))
    head = head.where("_day IS NOT NULL AND (_amount IS NOT NULL OR (_debit IS NOT NULL AND _credit IS NOT NULL))")
    first = head.groupBy("file").agg(F.min_by(F.struct(*[c for c in head.columns if c != "file"]), "header").alias("h"))
    body = rows.join(first, "file").where(F.col("line") > F.col("h.header"))

    def cell(field):
        return F.when(F.col(f"h._{field}").isNotNull(), F.get("cells", (F.col(f"h._{field}") - 1).cast("int")))

    debit, credit = parse_amount(cell("debit")), parse_amount(cell("credit"))
    amount = F.coalesce(parse_amount(cell("amount")), F.when(F.coalesce(debit, F.lit(0)) != 0, -F.abs(debit)), credit).cast(MONEY)
    none = F.lit(None).cast("string")
    out = body.select(
        F.lit("csv").alias("source"), "file", F.lit(account).alias("account"), "line", parse_date(cell("day")).alias("op_date"), parse_date(cell("value")).alias("v"), F.lit("").alias("common_code"),
        F.lit("").alias("own_code"), amount.alias("amount"), F.lit("").alias("document"), F.lit("").alias("ref1"), F.lit("").alias("ref2"), F.array_compact(F.array(cell("concept"))).alias("extra"),
        F.coalesce(cell("concept"), F.lit("")).alias("counterparty"), none.alias("counterparty_iban"), none.alias("bank_code"), none.alias("foreign_currency"),
        F.lit(None).cast(MONEY).alias("foreign_amount"), parse_amount(cell("balance")).cast(MONEY).alias("balance"),
    ).where("op_date IS NOT NULL AND amount IS NOT NULL")
    return out.withColumn("value_date", F.coalesce("v", "op_date")).drop("v").select(*MOVEMENT)


def detect(name: str, head: str) -> str:
    """camt053, norma43 or csv, by a file's name and first characters."""
    start = head.lstrip("﻿ \r\n\t")
    if start.startswith("<") or name.lower().endswith(".xml"):
        return "camt053"
    first = start.splitlines()[0] if start else ""
    return "norma43" if name.lower().endswith((".n43", ".q43")) or (first[:2] == "11" and first[2:20].isdigit()) else "csv"


def movements(spark: SparkSession, path: str, source: str, **options) -> DataFrame:
    if source == "norma43":
        return norma43_movements(norma43_records(spark, path, **options)).select(*MOVEMENT)
    if source == "camt053":
        return camt053_movements(camt053_statements(spark, path)).select(*MOVEMENT)
    return csv_movements(spark, path, **options)


def merged(*exports: DataFrame) -> DataFrame:
    """Movements of overlapping exports, each once: the first of those with one account, date, amount and text stays.

    Equal movements of one file are told apart by their number among their equals, so a repeated import adds none.
    """
    out = exports[0]
    for more in exports[1:]:
        out = out.unionByName(more)
    key = transaction_key(F.col("account"), F.col("op_date"), F.col("amount"), F.col("counterparty"))
    again = Window.partitionBy("file", "_key").orderBy("line")
    out = out.withColumn("_key", key).withColumn("dedupe_key", F.sha2(F.concat_ws("|", "_key", F.dense_rank().over(again)), 256)).drop("_key")
    best = out.groupBy("dedupe_key").agg(F.min_by(F.struct(*MOVEMENT), F.struct("file", "line")).alias("m"))
    confidence = F.create_map(*(F.lit(x) for p in CONFIDENCE.items() for x in p))
    return best.select("dedupe_key", "m.*").withColumn("confidence", confidence[F.col("source")])
