"""Dates: parsing, fiscal years, periods and windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyline.functions.bind import let
from tallyline.functions.text import strip_diacritics

#: Month names in Spanish, Catalan and English, accent-free, January first.
MONTHS = (
    ("enero", "gener", "january"),
    ("febrero", "febrer", "february"),
    ("marzo", "marc", "march"),
    ("abril", "april"),
    ("mayo", "maig", "may"),
    ("junio", "juny", "june"),
    ("julio", "juliol", "july"),
    ("agosto", "agost", "august"),
    ("septiembre", "setembre", "september", "setiembre"),
    ("octubre", "october"),
    ("noviembre", "novembre", "november"),
    ("diciembre", "desembre", "december"),
)
SHORT = ("ene", "feb", "mar", "abr", "may", "jun", "jul", "ago", "sep", "oct", "nov", "dic")


def full_year(y: Column) -> Column:
    """Two digits under 70 are of this century, others of the last; four digits stay."""
    n = y.try_cast("int")
    return n + F.when(F.length(y) == 2, F.when(n < 70, 2000).otherwise(1900)).otherwise(0)


def calendar_date(year: Column, month: Column, day: Column) -> Column:
    """The date if it exists between 1900 and 2100, else null."""
    text = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))
    return F.when(year.between(1900, 2100), F.try_to_date(text, "yyyy-MM-dd"))


def _month(name: Column) -> Column:
    out = F.when(F.lit(False), 0)
    for i, names in enumerate(MONTHS):
        out = out.when(name.isin(*names, SHORT[i]), i + 1)
    return out


def parse_date(c: Column) -> Column:
    """ISO, day/month/year, or day, month name and year in a short text; null if there is none."""
    return let(F.trim(F.lower(strip_diacritics(c))), _first_date)


def _first_date(s: Column) -> Column:
    iso, numeric = r"(?<!\d)(\d{4})-(\d{2})-(\d{2})(?!\d)", r"(?<!\d)(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4}|\d{2})(?!\d)"
    worded = r"(?<!\d)(\d{1,2})(?:r|n|er|e|a|st|nd|rd|th)?[\s\-/.]*(?:de\s+|d')?([a-z]{2,10})\.?[\s\-/.]*(?:del?\s+|de\s+l')?(\d{4}|\d{2})(?!\d)"

    def part(pattern, i):
        return F.regexp_extract(s, pattern, i)

    def number(pattern, i):
        return part(pattern, i).try_cast("int")

    return F.coalesce(
        calendar_date(number(iso, 1), number(iso, 2), number(iso, 3)),
        calendar_date(full_year(part(numeric, 3)), number(numeric, 2), number(numeric, 1)),
        calendar_date(full_year(part(worded, 3)), let(part(worded, 2), _month), number(worded, 1)),
    )


def fiscal_year(d: Column, start_month: int = 1) -> Column:
    """The year in which a fiscal year that begins in start_month ends."""
    return F.year(d) + (F.month(d) >= start_month).cast("int") if start_month > 1 else F.year(d)


def period_for_credit(operation: Column, concept: Column) -> Column:
    """First day of the month that a credit is for: mm/yyyy in its text, else the first month named, else its own."""
    return let(F.lower(strip_diacritics(F.coalesce(concept, F.lit("")))), lambda s: _period(operation, s))


def _period(operation: Column, s: Column) -> Column:
    numeric = r"(?:^|[^0-9])(0[1-9]|1[0-2])[/\-.](20\d{2})(?:[^0-9]|$)"
    out = F.when(s.rlike(numeric), F.try_to_date(F.concat(F.regexp_extract(s, numeric, 2), F.lit("-"), F.regexp_extract(s, numeric, 1), F.lit("-01"))))
    for i, names in enumerate(MONTHS):
        any_name = "|".join(names)
        dated = rf"(?:{any_name})[^0-9]{{0,10}}(20\d{{2}})"
        year = F.coalesce(F.regexp_extract(s, dated, 1).try_cast("int"), F.year(operation))
        out = out.when(s.rlike(any_name), F.make_date(year, F.lit(i + 1), F.lit(1)))
    return out.otherwise(F.trunc(operation, "MM"))


def months_between(a: Column, b: Column) -> Column:
    return F.datediff(b, a) / 30.4375


def in_payment_window(invoice: Column, paid: Column, before: int = 5, after: int = 120) -> Column:
    return F.datediff(paid, invoice).between(-before, after)


def challenge_windows(notified: Column, meeting: Column) -> Column:
    """struct(short, long): three and twelve months from the notice, else from the meeting."""
    start = F.coalesce(notified, meeting)
    return F.struct(F.add_months(start, 3).alias("short"), F.add_months(start, 12).alias("long"))
