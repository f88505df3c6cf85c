"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust a score.

Kinds, in their fixed order: email, ip, card (Luhn), phone, and two that the method adds: iban
(mod-97) and national (an eight-digit identity number with its check letter). Spans of a kind never
overlap and are found leftmost first; one that fails its check is dropped and its text is not
tried again. Spans that start together come in the order of kinds. Offsets are code points, ends exclusive.

Null texts count as empty and have no spans, and stay null when masked; repeated rows each get their own; ids may be
null; an empty table gives no rows; columns beside id and text are not looked at by detect() and kept as they are by mask(). Whole texts
are read, one pass a kind: runs of digits or of local-part characters are not tried again from each of their positions.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "iban", "national")
BASE = 4

#: Score of a span without context; words that raise or lower it, within CONTEXT characters before it.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "national": 0.6}
CONTEXT = 48
RAISE = {
    "email": ("mail", "contact", "correo"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "tarjeta", "pay"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "konto", "cuenta"),
    "national": ("dni", "nif", "identity", "passport", "id"),
}
LOWER = ("version", "example", "sample", "test", "isbn", "order", "serial")
#: Added kinds count as found from this score on; the first four kinds always do.
ACCEPT = 0.5

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_LOCAL_RUN = re.compile(r"[A-Za-z0-9._%+-]*")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_NATIONAL = re.compile(r"(?<![A-Za-z0-9])[0-9]{8}-?[A-Z](?![A-Za-z0-9])")
_WORD = re.compile(r"[a-z]+")
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(_DOUBLED[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """True for a whole IBAN without spaces whose check digits hold."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _emails(text: str):
    """As the pattern finds them leftmost first, but in one pass: every match ends its local part at an @."""
    last = 0
    at = text.find("@")
    while at >= 0:
        if domain := _DOMAIN.match(text, at + 1):
            start = at
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                yield start, domain.end()
                last = domain.end()
        at = text.find("@", max(at + 1, last))


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def find(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score), by start, then in the order of KINDS."""
    found = []

    def add(kind: str, start: int, end: int) -> None:
        score = PRIOR[kind]
        words = set(_WORD.findall(text[max(0, start - CONTEXT) : start].lower()))
        score += 0.2 * any(w in words for w in RAISE[kind]) - 0.3 * any(w in words for w in LOWER)
        score = min(1.0, max(0.0, score))
        if kind in KINDS[:BASE] or score >= ACCEPT:
            found.append((kind, start, end, score))

    for start, end in _emails(text):
        add("email", start, end)
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in m[0].split(".")):
                add("ip", *m.span())
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            add("card", *m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                add("phone", *m.span())
    for m in _IBAN.finditer(text):
        if 15 <= len(s := m[0].replace(" ", "")) <= 34 and mod97(s):
            add("iban", *m.span())
    for m in _NATIONAL.finditer(text):
        #: The check letters of the identity number by its remainder modulo 23.
        if "TRWAGMYFPDXBNJZSQVHLCKE"[int(m[0][:8]) % 23] == m[0][-1]:
            add("national", *m.span())
    found.sort(key=lambda x: (x[1], KINDS.index(x[0])))
    return found


def redact(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """text with each span, and spans that overlap it, replaced by the first one's kind in brackets."""
    out, at = [], 0
    for kind, start, end, _ in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    out.append(text[at:])
    return "".join(out)


_SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"
_SPAN_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", redacted: bool = False) -> DataFrame:
    """id_col and spans of every whole text; with redacted, also the text with the spans masked. No shuffle."""

    def run(batches):
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            spans = [find(x) for x in texts]
            columns = [batch.column(0), pa.array([[dict(zip(("kind", "start", "end", "score"), s)) for s in row] for row in spans], _SPAN_ARROW)]
            names = ["id", "spans"]
            if redacted:
                columns.append(pa.array([redact(t, s) for t, s in zip(texts, spans)], pa.string()))
                names.append("redacted")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, spans {_SPAN}" + ", redacted string" * redacted
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the first four kinds, a digest of their spans, and all spans as text."""

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind))

    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS[:BASE]))
    return found.select(
        id_col,
        *(count(k).cast("bigint").alias(f"n_{k}") for k in KINDS[:BASE]),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def mask(docs: DataFrame) -> DataFrame:
    """documents with personal data masked in text; n_chars follows the new text. Null texts stay null."""

    def run(batches):
        for batch in batches:
            at = batch.schema.names.index("text")
            texts = [None if t is None else redact(t, find(t)) for t in batch.column(at).to_pylist()]
            batch = batch.set_column(at, "text", pa.array(texts, batch.schema.field(at).type))
            if "n_chars" in batch.schema.names:
                at = batch.schema.names.index("n_chars")
                kind = batch.schema.field(at).type
                old = batch.column(at).to_pylist()
                batch = batch.set_column(at, "n_chars", pa.array([o if t is None else len(t) for t, o in zip(texts, old)], kind))
            yield batch

    return docs.mapInArrow(run, docs.schema)


def sha256(spans: list[tuple]) -> str:
    """The digest of base spans, for tests."""
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b, *_ in spans if k in KINDS[:BASE]).encode()).hexdigest()
