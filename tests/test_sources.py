import datetime
from decimal import Decimal

from tallyline.sources import bank


def n43(kind, **at):
    line = list(kind.ljust(80))
    for start, value in at.values():
        line[start - 1 : start - 1 + len(value)] = value
    return "".join(line)[:80]


def statement():
    head = n43("11", a=(3, "01820001"), b=(11, "0000001234"), f=(21, "240501"), t=(27, "240531"), s=(33, "2"), o=(34, "00000000100000"), c=(48, "978"), h=(52, "OWNERS  OF 5"))

    def move(day, sign, cents, **k):
        return n43("22", d=(11, day), v=(17, day), c=(23, "02"), s=(28, sign), a=(29, f"{cents:014d}"), **k)

    lines = [
        head,
        move("240502", "1", 12550, r=(43, "DOC1      ")),
        n43("23", n=(3, "01"), a=(5, "PAGO  LIFT"), b=(43, "SERVICE")),
        n43("24", n=(3, "01"), c=(5, "840"), a=(8, "00000000013000")),
        move("240510", "2", 6000),
        n43("33", a=(3, "01820001"), b=(11, "0000001234"), nd=(21, "00001"), td=(26, "00000000012550"), nc=(40, "00001"), tc=(45, "00000000006000"), s=(59, "2"), c=(60, "00000000093450")),
        n43("88", n=(21, "000006")),
    ]
    return "\r\n".join(lines)


def test_norma43(spark, tmp_path):
    (tmp_path / "a.n43").write_text(statement(), encoding="latin-1")
    records = bank.norma43_records(spark, f"{tmp_path}/a.n43")
    rows = bank.norma43_movements(records).orderBy("line").collect()
    assert [(r.op_date, r.amount, r.document, list(r.extra), r.foreign_currency, r.foreign_amount) for r in rows] == [
        (datetime.date(2024, 5, 2), Decimal("-125.50"), "DOC1", ["PAGO LIFT", "SERVICE"], "USD", Decimal("130.00")),
        (datetime.date(2024, 5, 10), Decimal("60.00"), "", [], None, None),
    ]
    account = bank.norma43_accounts(records).first()
    assert account.self_check and account.closing == Decimal("934.50") and account.holder == "OWNERS OF 5"
    (tmp_path / "b.n43").write_text(statement().replace("00000000093450", "00000000093451"), encoding="latin-1")
    assert not bank.norma43_accounts(bank.norma43_records(spark, f"{tmp_path}/b.n43")).first().self_check


CAMT = """<?xml version="1.0"?><Document><BkToCstmrStmt><Stmt><Acct><Id><IBAN>ES9121000418450200051332</IBAN></Id></Acct>
<Bal><Tp><CdOrPrtry><Cd>OPBD</Cd></CdOrPrtry></Tp><Amt Ccy="EUR">100.00</Amt><CdtDbtInd>CRDT</CdtDbtInd></Bal>
<Bal><Tp><CdOrPrtry><Cd>CLBD</Cd></CdOrPrtry></Tp><Amt Ccy="EUR">60.00</Amt><CdtDbtInd>CRDT</CdtDbtInd></Bal>
<Ntry><Amt Ccy="EUR">40.00</Amt><CdtDbtInd>DBIT</CdtDbtInd><BookgDt><Dt>2024-05-03</Dt></BookgDt><NtryDtls><TxDtls><Refs><EndToEndId>E1</EndToEndId></Refs>
<RltdPties><Cdtr><Nm>Lift SL</Nm></Cdtr><CdtrAcct><Id><IBAN>ES76 2077</IBAN></Id></CdtrAcct></RltdPties><RmtInf><Ustrd>invoice 7</Ustrd></RmtInf></TxDtls></NtryDtls></Ntry></Stmt></BkToCstmrStmt></Document>"""


def test_camt053(spark, tmp_path):
    (tmp_path / "a.xml").write_text(CAMT)
    statements = bank.camt053_statements(spark, f"{tmp_path}/a.xml")
    s = statements.first()
    assert (s.opening, s.closing) == (Decimal("100.00"), Decimal("60.00"))
    (m,) = bank.camt053_movements(statements).collect()
    assert (m.amount, m.counterparty, m.counterparty_iban, m.document, list(m.extra), str(m.op_date)) == (Decimal("-40.00"), "Lift SL", "ES762077", "E1", ["invoice 7"], "2024-05-03")


def test_csv_and_merge(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Extracte\nCompte;x\n\nData;Data valor;Concepte;Import;Saldo\n03/05/2024;04/05/2024;"Lift; SL";-3.253,80;9.306,60\nbad;;;;\n05/05/2024;;Quota;60,00;9.366,60\n')
    (tmp_path / "b.csv").write_text("Fecha,Concepto,Debe,Haber,Saldo\n03/05/2024,Agua,\"12,50\",,\"1,00\"\n04/05/2024,Quota,,\"60,00\",\n")
    a, b = bank.csv_movements(spark, f"{tmp_path}/a.csv"), bank.csv_movements(spark, f"{tmp_path}/b.csv")
    assert [(str(r.value_date), r.amount, r.counterparty, r.balance) for r in a.orderBy("line").collect()] == [
        ("2024-05-04", Decimal("-3253.80"), "Lift; SL", Decimal("9306.60")),
        ("2024-05-05", Decimal("60.00"), "Quota", Decimal("9366.60")),
    ]
    assert [r.amount for r in b.orderBy("line").collect()] == [Decimal("-12.50"), Decimal("60.00")]
    assert bank.merged(a, b, a).count() == 4
    assert [bank.detect(*x) for x in (("a.xml", ""), ("x", "11" + "0" * 18), ("x", "Fecha;Importe"))] == ["camt053", "norma43", "csv"]
