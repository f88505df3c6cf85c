"""Text normalisation and redaction as column expressions."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyline.functions.bind import let


def _accents() -> tuple[str, str]:
    """Letters of the Latin blocks that decompose into a base letter and marks, and their base letters."""
    pairs = {}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(code))
        if len(base) > 1 and all(unicodedata.combining(c) for c in base[1:]):
            pairs[chr(code)] = base[0]
    return "".join(pairs), "".join(pairs.values())


ACCENTED, PLAIN = _accents()


def strip_diacritics(c: Column) -> Column:
    """Latin letters without their marks; combining marks go."""
    return F.regexp_replace(F.translate(c, ACCENTED, PLAIN), "[\\u0300-\\u036f]", "")


def fold(c: Column, case: str = "upper", keep: str | None = None, joiner: str = " ") -> Column:
    """Accent-free text in one case; runs outside keep (a character class) become joiner; outer blanks go."""
    c = strip_diacritics(c)
    c = F.upper(c) if case == "upper" else F.lower(c)
    return F.trim(F.regexp_replace(c, f"[^{keep}]+" if keep else r"\s+", joiner))


def norm_text(c: Column) -> Column:
    """Lower case, accent-free, single-spaced; blank is null."""
    return F.nullif(fold(F.translate(c, "·", " "), "lower"), F.lit(""))


def norm_ref(c: Column) -> Column:
    """Letters and digits only, upper case, for finding a reference inside a text."""
    return F.regexp_replace(F.upper(strip_diacritics(F.coalesce(c, F.lit("")))), "[^A-Z0-9]", "")


def reference_in_text(serie: Column, number: Column, text: Column) -> Column:
    """True if the number, with or without its series, of three characters or more stands in text."""

    def inside(ref):
        return let(ref, lambda r: (F.length(r) >= 3) & F.contains(norm_ref(text), r))

    return inside(norm_ref(F.concat(F.coalesce(serie, F.lit("")), F.coalesce(number, F.lit(""))))) | inside(norm_ref(number))


#: Words dropped from person names, and articles that go together with DE.
PARTICLES = ("DE", "DEL", "DELS", "D", "I", "Y", "VAN", "VON", "DA", "DO", "DOS", "DAS")
ARTICLES = ("LA", "LAS", "LOS", "LES", "EL", "L")


def norm_name(c: Column) -> Column:
    """Person name for comparison: upper case, accent-free, no punctuation, no particles."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?i)l[·.\-]l", "ll")
    c = F.regexp_replace(F.upper(strip_diacritics(c)), "[’`´]", "'")
    c = F.regexp_replace(c, "[^A-Z' ]+", " ")
    c = F.regexp_replace(F.regexp_replace(c, r"\b([A-Z])'\s*", "$1 "), "'", "")
    c = F.regexp_replace(c, r"\bDE\s+(" + "|".join(ARTICLES) + r")\b", " ")
    words = F.filter(F.split(c, r"\s+"), lambda w: (w != "") & ~w.isin(*PARTICLES))
    return F.array_join(words, " ")


#: Legal forms as a last or inner word, words and phrases ignored in company names.
LEGAL_WORDS = ("SL", "SLU", "SLL", "SLP", "SLNE", "SA", "SAU", "SAL", "SCP", "SCCL", "SCCLP", "SCOOP", "COOP", "CB", "SC", "SRL", "AIE", "UTE")
LAST_ONLY = ("SA", "SC")
CONNECTORS = ("DE", "DEL", "DELS", "LA", "EL", "LES", "LOS", "LAS", "I", "Y", "AND")
TRADE_WORDS = (
    "OBRES", "OBRAS", "REFORMES", "REFORMAS", "CONSTRUCCIONS", "CONSTRUCCIONES", "INSTALLACIONS", "INSTALACIONS",
    "INSTALACIONES", "SERVEIS", "SERVICIOS", "ASCENSORS", "ASCENSORES", "GRUP", "GRUPO",
)
LEGAL_PHRASES = (
    r"SOCIE(DAD|TAT) (DE RESPONSABILI(DAD|TAT) )?LIMITADA( UNIPERSONAL| LABORAL| PROFES+IONAL| NUEVA EMPRESA)?",
    r"SOCIE(DAD|TAT) ANONIMA( UNIPERSONAL| LABORAL)?",
    r"SOCIE(DAD|TAT) CIVIL( PROFES+IONAL| PARTICULAR)?",
    r"SOCIE(DAD|TAT) COOPERATIVA( CATALANA)?( LIMITADA)?",
    r"COMUNIDAD DE BIENES|COMUNITAT DE BENS|UNION TEMPORAL DE EMPRESAS|UNIO TEMPORAL D ?EMPRESES|AGRUPACION DE INTERES ECONOMICO",
)
QUALIFIERS = r" (UNIPERSONAL|EN LIQUIDACION?|EN CONSTITUCION?|PROFES+IONAL)$"


def norm_company_basic(c: Column) -> Column:
    """Company name in upper case, accent-free, dotted abbreviations joined."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?i)l[·.\-]l", "ll")
    c = F.replace(F.upper(strip_diacritics(c)), F.lit("&"), F.lit(" AND "))
    c = F.regexp_replace(F.regexp_replace(c, "[’`´]", "'"), r"\b[DL]'", " ")
    c = F.regexp_replace(c, r"\b([A-Z])\.\s?(?=[A-Z]\.|[A-Z](?:\s|$|,))", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(c, "[^A-Z0-9 ]+", " "), r"\s+", " "))


def norm_company(c: Column) -> Column:
    """Company name without legal forms, connectors and trade words; the trade words stay if nothing else would."""
    c = norm_company_basic(c)
    for phrase in LEGAL_PHRASES:
        c = F.trim(F.regexp_replace(F.regexp_replace(c, rf"\b({phrase})\b", " "), r"\s+", " "))
    last = r" (" + "|".join(LEGAL_WORDS) + r")$"
    for _ in range(4):
        c = F.regexp_replace(F.regexp_replace(c, QUALIFIERS, ""), last, "")
    inner = [w for w in LEGAL_WORDS if w not in LAST_ONLY]
    words = F.filter(F.split(c, " "), lambda w: (w != "") & ~w.isin(*inner, *CONNECTORS))

    def told(kept):
        telling = F.filter(kept, lambda w: ~w.isin(*TRADE_WORDS))
        return F.array_join(F.when(F.size(telling) > 0, telling).otherwise(kept), " ")

    return let(words, told)


def invoice_number(c: Column) -> Column:
    """struct(series, number, suffix, canonical): the last run of digits is the number."""
    return let(F.trim(F.regexp_replace(F.upper(strip_diacritics(F.coalesce(c, F.lit("")))), r"\s+", " ")), _number_parts)


def _number_parts(text: Column) -> Column:
    shape = r"^(.*?)(\d+)[\s\-/._:]*([A-Z]*)[\s\-/._:]*$"
    there = text.rlike(shape)
    series = F.regexp_replace(F.when(there, F.regexp_extract(text, shape, 1)).otherwise(text), r"[\s\-/._:]+", "")
    number = F.when(there, F.regexp_extract(text, shape, 2).try_cast("decimal(38,0)"))
    suffix = F.when(there, F.regexp_extract(text, shape, 3)).otherwise("")
    parts = F.array(F.nullif(series, F.lit("")), number.cast("string"), F.nullif(suffix, F.lit("")))
    canonical = F.array_join(F.array_compact(parts), "-")
    return F.struct(series.alias("series"), number.alias("number"), suffix.alias("suffix"), canonical.alias("canonical"))


def natural_key(c: Column, width: int = 12) -> Column:
    """A key under which names sort with their numbers as numbers."""
    pieces = F.regexp_extract_all(F.lower(c), F.lit(r"(\d+|\D+)"), 1)
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(r"^\d"), F.lpad(F.regexp_replace(p, "^0+(?=.)", ""), width, "0")).otherwise(p)), "")


def mask_iban(c: Column) -> Column:
    """Only the last four characters of an account number stay."""
    bare = F.regexp_replace(F.upper(c), r"\s", "")
    return F.concat(F.repeat(F.lit("*"), F.greatest(F.length(bare) - 4, F.lit(0))), F.right(bare, F.lit(4)))


IBAN_IN_TEXT = r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"
NIF_IN_TEXT = r"\b(?:\d{8}[A-Z]|[XYZ]\d{7}[A-Z]|[A-W]\d{7}[0-9A-J])\b"
EMAIL_IN_TEXT = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
PHONE_IN_TEXT = r"(?<!\d)(?:\+34 ?)?[6789]\d{2}[ .]?\d{3}[ .]?\d{3}(?!\d)"


def redact(c: Column) -> Column:
    """Accounts, tax numbers, addresses and phones in free text, each replaced by its kind."""
    for pattern, mark in ((IBAN_IN_TEXT, "[IBAN]"), (NIF_IN_TEXT, "[NIF]"), (EMAIL_IN_TEXT, "[EMAIL]"), (PHONE_IN_TEXT, "[PHONE]")):
        c = F.regexp_replace(c, pattern, mark)
    return c


def withhold_citations(c: Column) -> Column:
    """Articles of law cited in a text, replaced by a note."""
    return F.regexp_replace(c, r"(?i)\b(art(?:icle|ículo|iculo|\.)?s?\s+\d+(?:[.,]\d+)*(?:\s*(?:de la|del|of the)\s+\w+)?)", "[citation withheld]")


def stem(w: Column) -> Column:
    """A word without its plural and gender endings, in Spanish and Catalan; short words stay."""
    long_, plural = F.length(w) > 5, F.regexp_replace(w, "s$", "")
    one = F.when(long_ & w.rlike("es$"), F.regexp_replace(w, "es$", "")).when(F.length(w) > 4, plural).otherwise(w)
    return let(one, lambda x: F.when(F.length(x) > 4, F.regexp_replace(x, "[ao]$", "")).otherwise(x))


def tokens(c: Column) -> Column:
    """Stemmed lower-case words."""
    return F.transform(F.filter(F.split(fold(c, "lower", "a-z0-9"), " "), lambda w: w != ""), stem)


def keyword_hits(words: Column, keyword: Column) -> Column:
    """True if the keyword's words stand in words in one run."""
    return F.contains(F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")), F.concat(F.lit(" "), F.array_join(keyword, " "), F.lit(" ")))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def majority(flags: list[Column]) -> Column:
    """True if most of some nullable conditions hold, null if the unknown ones could decide."""
    yes = reduce(lambda a, b: a + b, (F.coalesce(f.cast("int"), F.lit(0)) for f in flags))
    open_ = reduce(lambda a, b: a + b, (f.isNull().cast("int") for f in flags))
    return F.when(yes * 2 > len(flags), True).when((yes + open_) * 2 <= len(flags), False)
