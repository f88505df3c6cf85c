"""Fingerprints and keys."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyline.functions.amounts import parse_amount
from tallyline.functions.bind import let
from tallyline.functions.dates import parse_date
from tallyline.functions.ids import norm_nif
from tallyline.functions.text import invoice_number


def _joined(parts) -> Column:
    return F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def fingerprint(*parts: Column) -> Column:
    """First 32 hex digits of the SHA-256 of the parts, joined by bars; null counts as empty."""
    return F.substring(F.sha2(_joined(parts), 256), 1, 32)


def transaction_key(account: Column, day: Column, amount: Column, text: Column) -> Column:
    return F.sha2(_joined([account, F.date_format(day, "yyyy-MM-dd"), amount.cast("decimal(18,2)"), text]), 256)


def row_hash(*columns: str) -> Column:
    """SHA-256 of a row as JSON with its columns in order of their names."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def document_key(nif: Column, serie: Column, number: Column, total: Column, day: Column) -> Column:
    """NIF|SERIES|NUMBER|TOTAL|DATE of an invoice, for finding its twins."""
    return let(invoice_number(number), lambda own: _document_key(nif, serie, own, total, day))


def _document_key(nif: Column, serie: Column, own: Column, total: Column, day: Column) -> Column:
    series = F.concat(F.replace(invoice_number(serie)["canonical"], F.lit("-"), F.lit("")), own["series"])
    # a number without digits is its own series too
    count = F.when(own["number"].isNull(), own["canonical"]).otherwise(F.concat(own["number"].cast("string"), own["suffix"]))
    amount = F.coalesce(parse_amount(total).cast("decimal(18,2)").cast("string"), F.trim(F.coalesce(total.cast("string"), F.lit(""))))
    date = F.coalesce(parse_date(day.cast("string")).cast("string"), F.trim(F.coalesce(day.cast("string"), F.lit(""))))
    return F.concat_ws("|", norm_nif(nif), series, count, amount, date)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def keyed_digest(c: Column, secret: str) -> Column:
    """HMAC-SHA-256 in hex of canonical account or tax numbers: two hashes around the padded key."""
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (bytes(b ^ pad for b in key) for pad in (0x36, 0x5C))
    first = F.sha2(F.concat(F.lit(bytearray(inner)), F.encode(c, "UTF-8")), 256)
    return F.sha2(F.concat(F.lit(bytearray(outer)), F.unhex(first)), 256)
