"""Amounts: parsing and printing in Spanish and international notation, rounding, tolerances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyline.functions.bind import let

MONEY = "decimal(18,2)"


def parse_amount(c: Column, legacy: bool = False) -> Column:
    """decimal(18,4) of a written amount, null if it isn't one.

    The rightmost of both separators is the decimal one. A lone comma is always decimal; a lone dot
    before exactly three digits separates thousands (not in legacy mode, which leaves it decimal and
    doesn't check groups). Brackets, a leading and a trailing minus each change the sign.
    """
    s = F.regexp_replace(c.cast("string"), r"(?i)€|\$|£|\b(EUR|EUROS?|USD|GBP)\b", "")
    return let(F.regexp_replace(s, r"[\s  ]+", ""), lambda bare: _signed(bare, legacy))


def _signed(s: Column, legacy: bool) -> Column:
    bracket = s.rlike(r"^\(.*\)$")
    inner = F.when(bracket, F.regexp_extract(s, r"^\((.*)\)$", 1)).otherwise(s)

    def value(t):
        minus = F.when(t.rlike("^[-−]"), 1).otherwise(0) + F.when(t.rlike("-$") & (F.length(t) > 1), 1).otherwise(0) + bracket.cast("int")
        return let(_number(F.regexp_replace(F.regexp_replace(t, "^[-−+]", ""), "-$", ""), legacy), lambda v: F.when(minus % 2 == 1, -v).otherwise(v))

    return let(inner, value)


def _number(text: Column, legacy: bool) -> Column:
    return let(text, lambda s: _parsed(s, legacy))


def _parsed(s: Column, legacy: bool) -> Column:
    spanish = s.rlike(r"^\d{1,3}(\.\d{3})+,\d*$") | s.rlike(r"^\d*,\d*$")
    english = s.rlike(r"^\d{1,3}(,\d{3})+\.\d*$") | s.rlike(r"^\d*\.\d*$")
    dots, commas = s.rlike(r"^\d{1,3}(\.\d{3})+$"), s.rlike(r"^\d{1,3}(,\d{3}){2,}$")
    plain = F.when(s.rlike(r"^\d+$"), s)
    if legacy:
        loose = F.when(F.instr(s, ",") > 0, F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(s)
        number = F.when(s.rlike(r"^[\d.,]*\d[\d.,]*$"), loose)
    else:
        number = (
            F.when(dots, F.replace(s, F.lit("."), F.lit("")))
            .when(commas, F.replace(s, F.lit(","), F.lit("")))
            .when(spanish, F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
            .when(english, F.replace(s, F.lit(","), F.lit("")))
            .otherwise(plain)
        )
    return let(number, lambda n: F.when(n.rlike(r"\d"), F.regexp_replace(n, r"\.$", "")).try_cast("decimal(18,4)"))


def format_amount(c: Column, decimals: int = 2) -> Column:
    """1234.5 as 1.234,50."""
    return F.translate(F.format_number(c, decimals), ",.", ".,")


def cents(c: Column) -> Column:
    return F.round(c.cast("decimal(20,4)") * 100, 0).cast("bigint")


def is_round(c: Column) -> Column:
    """At least 500 and a multiple of 100, in absolute value."""
    a = F.abs(c.cast(MONEY))
    return (a >= 500) & (a % 100 == 0)


def within(a: Column, b: Column, tolerance: float) -> Column:
    return F.abs(a.cast(MONEY) - b.cast(MONEY)) <= F.lit(f"{tolerance}").cast(MONEY)


def within_pct(a: Column, b: Column, pct: float) -> Column:
    """Apart by at most pct percent of the larger magnitude; two zeros are equal."""
    return F.abs(a - b) <= F.greatest(F.abs(a), F.abs(b)) * pct / 100


def payable(total: Column, retention: Column, retention_pct: Column) -> Column:
    """array of what may be paid: the total, and the total less what is withheld."""
    total = total.cast(MONEY)
    held = F.when(retention > 0, retention.cast(MONEY)).when(retention_pct > 0, (total * retention_pct / 100).cast(MONEY))
    return F.array_compact(F.array(total, (total - held).cast(MONEY)))


def token_cost(tokens_in: Column, tokens_out: Column, tokens_cached: Column, price_in: float, price_out: float, price_cached: float) -> Column:
    """Cost of a model call from its usage and prices a million tokens."""
    return (tokens_in * price_in + tokens_out * price_out + tokens_cached * price_cached) / 1_000_000
