"""Classification of bank movements, minutes and people's names, as ordered conditions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyline.functions.amounts import is_round
from tallyline.functions.bind import let
from tallyline.functions.text import fold

#: Words of bank texts by kind, in the order in which kinds are tried; side: debit, credit or both.
KINDS = (
    ("bizum", "both", r"\bBIZUM\b"),
    ("cash", "both", r"\bREINTEGR|\bEFECTIU\b|\bEFECTIVO\b|\bDISP\.? ?EFECTIVO|\bCAJERO\b|\bCAIXER\b|\bRETIRADA\b|\bINGRESO (EN )?EFECTIVO|\bINGRES (EN )?EFECTIU"),
    ("cheque", "both", r"\bCHEQUE|\bTALON\b|\bXEC\b|\bPAGARE\b"),
    ("fee", "both", r"\bCOMISION|\bCOMISSIO|\bGASTOS DE (MANTENIMIENTO|ADMINISTRACION)|\bCUOTA (DE )?MANTENIMIENTO|\bQUOTA (DE )?MANTENIMENT|\bLIQ\.? ?COMISION|\bSERVICIO DE CUENTA"),
    ("interest", "both", r"\bINTERES(ES)?\b|\bINTERESSOS\b|\bLIQ(UIDACION)? ?INT(ERESES)?\b"),
    ("tax", "both", r"\bIMPUEST|\bIMPOST|\bAEAT\b|\bHACIENDA\b|\bAGENCIA TRIBUTARIA|\bAJUNTAMENT\b|\bAYUNTAMIENTO\b|\bIBI\b|\bTRIBUT|\bTGSS\b|\bSEGURIDAD SOCIAL|\bSEGURETAT SOCIAL|\bMODELO \d{3}\b|\bTAXA\b|\bTASA\b"),
    ("loan", "both", r"\bPRESTAMO|\bPRESTEC\b|\bAMORTIZACION|\bAMORTITZACIO|\bHIPOTECA|\bCUOTA PRESTAMO|\bQUOTA PRESTEC"),
    ("subsidy", "credit", r"\bSUBVENCIO|\bCONSORCI\b|\bGENERALITAT\b|\bAJUT\b|\bAYUDA\b|\bINSTITUT MUNICIPAL|\bFONDOS NEXT|\bNEXT GENERATION"),
    ("returned", "debit", r"\bDEVOL|\bIMPAGAD|\bRETORN|\bDEVUELT|\bRECHAZ|\bREBUT RETORNAT|\bRECIBO DEVUELTO"),
    ("refund", "credit", r"\bDEVOL|\bRETROCES|\bREEMBOLS|\bREINTEGRO DE\b"),
    ("card", "both", r"\bTARJETA|\bTARGETA|\bCARD\b|\bTPV\b|\bCOMPRA (EN|A)\b|\bPAGO CON TARJETA|\bVISA\b|\bMASTERCARD\b"),
    ("internal", "both", r"\bTRASPAS|\bTRANSFERENCIA INTERNA|\bCUENTA PROPIA|\bENTRE CUENTAS|\bCOMPTE PROPI|\bENTRE COMPTES"),
    ("quota_in", "credit", r"\bCUOTA|\bQUOTA|\bCOMUNIDAD|\bCOMUNITAT|\bDERRAMA|\bREMESA|\bPROPIETARI|\bVECINO|\bVEI\b"),
    ("transfer", "both", r"\bTRANSF|\bORDEN DE PAGO|\bORDRE DE PAGAMENT|\bSEPA CREDIT|\bABONO POR TRANSF|\bEMITIDA\b"),
    ("direct_debit", "both", r"\bRECIBO|\bREBUT|\bADEUDO|\bDOMICILIAC|\bSEPA DIRECT|\bSDD\b|\bCORE\b|\bCARREC\b|\bDOMICILIAT"),
)
#: Kinds by the common concept code of Norma 43: (debit, credit).
CODES = {
    "01": ("cash", "cash"), "03": ("direct_debit", "quota_in"), "04": ("transfer_out", "transfer_in"), "13": ("transfer_out", "transfer_in"), "05": ("loan", "loan"),
    "10": ("cheque", "cheque"), "12": ("card", "card"), "14": ("returned", "refund"), "16": ("tax", "tax"), "17": ("fee", "interest"), "08": ("interest", "interest"),
}
PERSON_KINDS = ("transfer_out", "direct_debit", "bizum", "card", "cheque", "other", "loan", "returned")
#: Legal forms and words that name no person.
LEGAL_FORM = r"\b(S\.?L\.?U?\.?|S\.?A\.?U?\.?|S\.?C\.?P\.?|S\.?C\.?C\.?L\.?P?\.?|C\.?B\.?|S\.?L\.?L\.?|S\.?COOP\.?|COOP|AIE|UTE|SRL|LTD|GMBH|INC|PLC|BV|NV|SARL)\b"
ORGANISATION = (
    "BANCO BANK BANCA CAIXA CAJA AJUNTAMENT AYUNTAMIENTO AEAT AGENCIA GENERALITAT CONSORCI DIPUTACIO MINISTERIO SEGUROS ASSEGURANCES MUTUA COMPANYIA COMPANIA COMUNIDAD COMUNITAT "
    "ASCENSOR ASCENSORS ASCENSORES INSTALACION INSTALLACIONS INSTALACIONES SERVICIOS SERVEIS FUNDACIO FUNDACION ASSOCIACIO ASOCIACION COOPERATIVA ENERGIA ELECTRICA GAS AIGUES AGUAS "
    "TELEFONICA ADMINISTRACION ADMINISTRADOR ADMINISTRADORES FINQUES FINCAS CONSTRUCCIONS CONSTRUCCIONES OBRES OBRAS REFORMES REFORMAS NETEJA LIMPIEZA LIMPIEZAS MANTENIMENT MANTENIMIENTO "
    "SUMINISTROS SUBMINISTRAMENTS TECNIC TECNICO GRUP GRUPO COMERCIAL INDUSTRIAL EMPRESA COMPANY BIZUM"
).split()


def person_name(text: Column) -> Column:
    """True for two to six words of letters without a legal form or an organisation's word."""

    def looks(t):
        words = F.split(t, " ")
        named = F.size(words).between(2, 6) & F.forall(words, lambda w: w.rlike("^[A-Z][A-Z'-]*$"))
        return named & ~t.rlike(LEGAL_FORM) & ~t.rlike(rf"\b({'|'.join(ORGANISATION)})\b")

    return let(fold(F.coalesce(text, F.lit(""))), looks)


def classify_transaction(amount: Column, text: Column, counterparty: Column, code: Column, iban: Column) -> Column:
    """struct(kind, flags) of a bank movement; its text decides first, then its common concept code."""
    debit, credit = amount < 0, amount > 0

    def kind_of(t):
        out = F.when(F.lit(False), "")
        for name, side, pattern in KINDS:
            hit = t.rlike(pattern)
            if side != "both":
                hit = hit & (debit if side == "debit" else credit)
            if name == "cash":
                hit = hit & ~t.rlike(dict((k, p) for k, _, p in KINDS)["refund"])
            value = {"transfer": F.when(debit, "transfer_out").otherwise("transfer_in"), "direct_debit": F.when(debit, "direct_debit").otherwise("quota_in")}.get(name, F.lit(name))
            out = out.when(hit, value)
        for c, (out_kind, in_kind) in CODES.items():
            out = out.when(code == c, F.when(debit, out_kind).otherwise(in_kind))
        return out.otherwise("other")

    def flagged(kind):
        foreign = F.upper(F.regexp_replace(F.coalesce(iban, F.lit("")), r"\s", ""))
        flags = F.array(
            *(F.when(kind == k, k) for k in ("cash", "bizum", "card")),
            F.when(code == "98", "reversal"),
            F.when(debit & kind.isin(*PERSON_KINDS) & person_name(counterparty), "person_beneficiary"),
            F.when((foreign != "") & ~F.startswith(foreign, F.lit("ES")), "foreign_iban"),
            F.when(is_round(amount), "round_amount"),
        )
        return F.struct(kind.alias("kind"), F.array_compact(flags).alias("flags"))

    return let(let(fold(F.concat_ws(" ", text, counterparty)), kind_of), flagged)


#: What minutes say, by kind of resolution, in the order in which they are tried.
RESOLUTIONS = (
    ("derrama", r"derrama|quota extraordinaria|cuota extraordinaria"),
    ("loan", r"prestec|prestamo|credit bancari|poliza de credito|hipotec"),
    ("subsidy", r"subvenci"),
    ("audit", r"auditor"),
    ("contractor_choice", r"adjudic|escollir (l'|la |el )?empresa|seleccionar (la |el )?empresa|triar (l'|la |el )?empresa|elegir (la |el )?empresa"),
    ("works_approval", r"obra|ascensor|reforma|rehabilitaci|instal.?laci|instalaci|façana|fachada|bastida|andami"),
    ("budget", r"pressupost|presupuesto"),
    ("accounts", r"comptes|cuentas|liquidaci|balanc|balance"),
    ("delegation", None),  # the minutes hold a block on what is delegated
    ("election", r"elecci|es nomena|se nombra|nomenament|nombramiento|es designa|se designa|renovacio? de"),
    ("delegation", r"delega|faculta|autoritza|autoriza|apodera"),
)


def resolution_kind(text: Column, delegates: Column | None = None) -> Column:
    """Kind of a resolution by its text; delegates says that the minutes hold a structured delegation."""

    def kind(t):
        out = F.when(F.lit(False), "")
        for name, pattern in RESOLUTIONS:
            if pattern is not None:
                out = out.when(t.rlike(pattern), name)
            elif delegates is not None:
                out = out.when(F.coalesce(delegates, F.lit(False)), name)
        return out.otherwise("other")

    return let(fold(F.coalesce(text, F.lit("")), "lower"), kind)


def quantity_unit(text: Column) -> Column:
    """struct(quantity, unit) of the first number with a unit in a line's text; lump sums have quantity 1."""
    pattern = r"(\d+(?:[.,]\d+)?)\s*(m2|m3|ml|m|ud|uts?|unit(?:at|ad|s)?|h|hores|horas|kg|%)\b"

    def read(t):
        lump = t.rlike(r"partida alzada|partida alcada|\bpa\b")
        number = F.replace(F.regexp_extract(t, pattern, 1), F.lit(","), F.lit(".")).try_cast("decimal(14,4)")
        return F.struct(F.when(lump, F.lit(1).cast("decimal(14,4)")).otherwise(number).alias("quantity"), F.when(lump, "pa").otherwise(F.nullif(F.regexp_extract(t, pattern, 2), F.lit(""))).alias("unit"))

    return let(fold(F.coalesce(text, F.lit("")), "lower"), read)
