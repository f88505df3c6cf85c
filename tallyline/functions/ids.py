"""Tax numbers and bank accounts: canonical forms and checks, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyline.functions.bind import let

#: Check letters of personal numbers by remainder modulo 23, and of entities by check digit.
PERSON_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
ENTITY_LETTERS = "JABCDEFGHI"
#: Entity letters whose check is a digit, and those whose check is a letter; others take either.
DIGIT_CHECK, LETTER_CHECK = "ABEHJUV", "KNPQRSW"
#: Lengths of account numbers by country.
IBAN_LENGTHS = {
    "AD": 24, "AT": 20, "BE": 16, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27,
    "GB": 22, "GI": 23, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21,
    "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27,
}


def _letter(letters: str, at: Column) -> Column:
    return F.substring(F.lit(letters), 1, 1) if at is None else F.substr(F.lit(letters), at + 1, F.lit(1))


def norm_nif(c: Column) -> Column:
    """Upper case without separators and ES prefix; personal numbers padded to nine characters."""
    bare = F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), r"[\s.\-_/]", "")
    return let(F.regexp_replace(bare, "^ES(?=.{9}$)", ""), _padded)


def _padded(s: Column) -> Column:
    person, foreign = r"^(\d{1,8})([A-Z])$", r"^([XYZ])(\d{1,7})([A-Z])$"
    return (
        F.when(s.rlike(person), F.concat(F.lpad(F.regexp_extract(s, person, 1), 8, "0"), F.regexp_extract(s, person, 2)))
        .when(s.rlike(foreign), F.concat(F.regexp_extract(s, foreign, 1), F.lpad(F.regexp_extract(s, foreign, 2), 7, "0"), F.regexp_extract(s, foreign, 3)))
        .otherwise(s)
    )


def entity_digit(digits: Column) -> Column:
    """Check digit of an entity's seven digits: every other digit doubled and cross-summed."""

    def digit(i):
        return F.coalesce(F.substring(digits, i, 1).try_cast("int"), F.lit(0))

    total = F.lit(0)
    for i in range(1, 8):
        d = digit(i)
        total = total + (F.when(d > 4, 2 * d - 9).otherwise(2 * d) if i % 2 else d)
    return (10 - total % 10) % 10


def check_nif(c: Column) -> Column:
    """struct(valid, kind, nif, entity, reason) of a tax number."""
    return let(norm_nif(c), lambda n: let(entity_digit(F.substring(n, 2, 7)), lambda check: _checked(n, check)))


def _checked(n: Column, check: Column) -> Column:
    body, last, first = F.substring(n, 2, 7), F.right(n, F.lit(1)), F.left(n, F.lit(1))

    def person(digits):
        return last == _letter(PERSON_LETTERS, F.coalesce(digits.try_cast("bigint"), F.lit(0)).cast("int") % 23)

    as_digit, as_letter = last == check.cast("string"), last == _letter(ENTITY_LETTERS, check)
    digit_ok, letter_ok = ~first.isin(*LETTER_CHECK), ~first.isin(*DIGIT_CHECK)
    entity_ok = (as_digit & digit_ok) | (as_letter & letter_ok)
    dni, nie, special = n.rlike(r"^\d{8}[A-Z]$"), n.rlike(r"^[XYZ]\d{7}[A-Z]$"), n.rlike(r"^[KLM]\d{7}[A-Z]$")
    cif = n.rlike(r"^[ABCDEFGHJNPQRSUVW]\d{7}[0-9A-J]$")
    legacy = special & (first == "K") & as_letter
    good = (
        F.when(dni, person(F.substring(n, 1, 8)))
        .when(nie, person(F.concat(F.translate(first, "XYZ", "012"), body)))
        .when(special, person(body) | legacy)
        .when(cif, entity_ok)
        .otherwise(False)
    )
    shape = F.when(dni, "DNI").when(nie, "NIE").when(special & ~person(body) & legacy, "CIF").when(special, "SPECIAL").when(cif, "CIF")
    reason = F.when(good, F.lit(None).cast("string")).when(n == "", "empty").when(cif & (as_digit | as_letter), "control_type").when(dni | nie | special | cif, "checksum").otherwise("format")
    return F.struct(
        good.alias("valid"), F.when(good, shape).otherwise("INVALID").alias("kind"), n.alias("nif"), F.when(shape == "CIF", first).alias("entity"), reason.alias("reason")
    )


def is_person_nif(c: Column) -> Column:
    checked = check_nif(c)
    return checked["valid"] & checked["kind"].isin("DNI", "NIE", "SPECIAL")


def norm_iban(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), r"[\s.\-]", ""), "^IBAN", "")


def mod97(c: Column) -> Column:
    """Remainder modulo 97 of a text of digits and capitals (letters count 10 to 35), folded from the left."""

    def step(acc, ch):
        code = F.ascii(ch)
        return F.when(code >= 65, (acc * 100 + code - 55) % 97).otherwise((acc * 10 + code - 48) % 97)

    return F.aggregate(F.filter(F.split(c, ""), lambda ch: ch != ""), F.lit(0), step)


def iban_check_digits(country: Column, account: Column) -> Column:
    return F.lpad((98 - mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0")


def ccc_digits(bank_office: Column, account: Column) -> Column:
    """Both check digits of a domestic account: bank and office (8 digits), account (10 digits)."""

    def one(digits10):
        total = F.lit(0)
        for i in range(10):
            total = total + F.coalesce(F.substring(digits10, i + 1, 1).try_cast("int"), F.lit(0)) * F.lit(2**i % 11)
        d = 11 - total % 11
        return F.when(d == 11, 0).when(d == 10, 1).otherwise(d)

    return F.concat(one(F.concat(F.lit("00"), bank_office)).cast("string"), one(account).cast("string"))


def ccc_to_iban(ccc: Column) -> Column:
    return F.concat(F.lit("ES"), iban_check_digits(F.lit("ES"), ccc), ccc)


def check_iban(c: Column) -> Column:
    """struct(valid, iban, country, reason); Spanish accounts need their domestic check digits too."""
    return let(norm_iban(c), _checked_iban)


def _checked_iban(s: Column) -> Column:
    country = F.left(s, F.lit(2))
    length = F.coalesce(*(F.when(country == k, v) for k, v in IBAN_LENGTHS.items()))
    shaped = s.rlike(r"^[A-Z]{2}\d{2}[A-Z0-9]{8,30}$")
    rest = F.concat(F.substring(s, 5, 40), F.left(s, F.lit(4)))
    ok97 = mod97(F.when(shaped, rest).otherwise("")) == 1
    domestic = (country != "ES") | (ccc_digits(F.substring(s, 5, 8), F.substring(s, 15, 10)) == F.substring(s, 13, 2))
    reason = (
        F.when(s == "", "empty").when(~shaped, "format").when(length.isNull(), "country").when(F.length(s) != length, "length").when(~ok97, "checksum").when(~domestic, "domestic")
    )
    return F.struct(reason.isNull().alias("valid"), s.alias("iban"), F.when(shaped, country).alias("country"), reason.alias("reason"))


def bank_successors(pairs: dict[str, str]) -> dict[str, str]:
    """Each bank code with the code that its chain of takeovers ends at; a cycle ends where it closes."""
    out = {}
    for code in pairs:
        seen, at = {code}, code
        while at in pairs and pairs[at] not in seen:
            at = pairs[at]
            seen.add(at)
        out[code] = at
    return out
