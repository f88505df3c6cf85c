"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over the last seven bytes ends a chunk wherever it is -1 modulo the block size; each
chunk gives one character of the signature. The block size is the least of 3 * 2^k under which
about 64 chunks are expected, halved while a signature stays under 32 characters. A fingerprint
`size:signature:signature at twice the size` is compared with others at an equal or a neighbouring
block size by the edit distance of their signatures.

Null texts count as empty; the empty text's fingerprint is `3::`. Equal texts have equal
fingerprints and a likeness of 1.
"""

from __future__ import annotations

import bisect
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 7
LENGTH = 64
#: Bytes that are hashed at a time; a longer text takes time, not memory.
PIECE = 1 << 20
#: Signatures with no common run of so many characters count as unlike; shorter signatures need all of it.
COMMON = 5
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"

_ODD = 0x9E3779B97F4A7C15
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _tables(n: int):
    """Powers of the chunk hash's base, and of its inverse modulo 2^64."""
    global _powers
    if len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        made = []
        for base in (_ODD, pow(_ODD, -1, 1 << 64)):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            made.append(np.cumprod(factors))
        _powers = tuple(made)
    return _powers


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _rolled(data: np.ndarray, start: int, stop: int) -> np.ndarray:
    """The rolling hash that ends at each byte from start to stop."""
    padded = np.zeros(stop - start + WINDOW - 1, np.uint32)
    held = data[max(0, start - WINDOW + 1) : stop]
    padded[len(padded) - len(held) :] = held
    roll = padded[WINDOW - 1 :].copy()
    for k in range(1, WINDOW):
        roll = roll + padded[WINDOW - 1 - k : len(padded) - k] * np.uint32(pow(0x01000193, k, 1 << 32))
    roll = (roll ^ (roll >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    return roll ^ (roll >> np.uint32(13))


def fingerprint(raw: bytes) -> str:
    """The fingerprint of some bytes; all of them count, PIECE of them are hashed at a time."""
    n = len(raw)
    if not n:
        return "3::"
    data = np.frombuffer(raw, np.uint8)
    powers, inverse = _tables(min(n, PIECE) + 1)

    def signature(size: int) -> str:
        out, carried = [], 0  # carried: the hash of the chunk that the last piece left open, and its length
        length = 0
        for start in range(0, n, PIECE):
            stop = min(n, start + PIECE)
            m = stop - start
            ends = np.flatnonzero(_rolled(data, start, stop) % np.uint32(size) == size - 1) + 1
            sums = np.zeros(m + 1, np.uint64)
            np.cumsum((data[start:stop].astype(np.uint64) + np.uint64(1)) * powers[:m], out=sums[1:])
            bounds = np.unique(np.concatenate([[0], ends, [m]]))
            chunk = (sums[bounds[1:]] - sums[bounds[:-1]]) * inverse[bounds[:-1]]
            chunk[0] = np.uint64((carried + int(chunk[0]) * pow(_ODD, length, 1 << 64)) % (1 << 64))
            open_ = stop < n and not (len(ends) and ends[-1] == m)
            length, carried = (int(bounds[-1] - bounds[-2]) + (length if len(chunk) == 1 else 0), int(chunk[-1])) if open_ else (0, 0)
            out += map(ALPHABET.__getitem__, (_mix(chunk[: len(chunk) - open_]) >> np.uint64(58)).tolist())
        return "".join(out)

    size = 3
    while size * LENGTH < n:
        size *= 2
    first = signature(size)
    while size > 3 and len(first) < LENGTH // 2:
        size //= 2
        first = signature(size)
    return f"{size}:{first}:{signature(2 * size)}"


def _shared_run(a: str, b: str) -> bool:
    k = min(COMMON, len(a), len(b))
    if not k:
        return False
    runs = {a[i : i + k] for i in range(len(a) - k + 1)}
    return any(b[i : i + k] in runs for i in range(len(b) - k + 1))


def edit_distance(a: str, b: str) -> int:
    """Insertions and deletions from a to b; a replaced character counts twice. Bit-parallel by columns."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) + len(b) - 2 * (len(a) - row.bit_count())


def likeness(one: str, other: str) -> float:
    """0 to 1 for two fingerprints; 0 at incompatible block sizes, 1 if they are equal."""
    if one == other:
        return 1.0
    (a, a1, a2), (b, b1, b2) = one.split(":"), other.split(":")
    pairs = {0: [(a1, b1), (a2, b2)], 1: [(a2, b1)], -1: [(a1, b2)]}
    a, b = int(a), int(b)
    step = 0 if a == b else 1 if b == 2 * a else -1 if a == 2 * b else None
    best = 0.0
    for x, y in pairs.get(step, []):
        if _shared_run(x, y):
            best = max(best, 1 - edit_distance(x, y) / (len(x) + len(y)))
    return best


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and fingerprint of every whole text. No shuffle."""

    def run(batches):
        for batch in batches:
            found = [fingerprint((x or "").encode()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["id", "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, fingerprint string").withColumnRenamed("id", id_col)


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """Fingerprint each text, and its edit by the next document in descending id_col (after the last: the first).

    The edited text ends with the next text's beginning in place of its own last third. Returns
    id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next.

    Rows are cut into ranges of (id, text hash), whose bounds range partitioning samples; texts are shuffled once, and
    the first row of each range also goes to the range before it, so every range is worked
    through on its own in a sorted stream, however many rows share an id or lack one. Only one key a range passes through
    the driver. Rows without an id come last; rows of one id follow each other by the hash of their text, equal rows one
    after the other (they are one range); a single row is followed by itself. Null texts count as empty, very long ones are taken whole.
    An empty table gives no rows; other columns are not looked at.
    """
    spark = docs.sparkSession
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = docs.select(docs[id_col].cast("bigint").alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    # ascending: rows with an id first, the largest id first (~id falls as id grows), then the text's hash
    order = ["none", "turned", "h"]
    rows = rows.withColumns({"none": F.col("id").isNull().cast("int"), "turned": F.bitwise_not(F.coalesce("id", F.lit(0))), "h": F.xxhash64("text")})
    keys = rows.select(*order).repartitionByRange(n, *order).withColumn("part", F.spark_partition_id())
    firsts = [tuple(r.first) for r in keys.groupBy("part").agg(F.min(F.struct(*order)).alias("first")).orderBy("part").collect()]  # at most n
    shared = spark.sparkContext.broadcast(firsts)

    @F.pandas_udf("int")
    def range_of(none: pd.Series, turned: pd.Series, h: pd.Series) -> pd.Series:
        found = (bisect.bisect_right(shared.value, key) - 1 for key in zip(none.tolist(), turned.tolist(), h.tolist()))
        return pd.Series(found, dtype="int32")

    ranged = rows.withColumn("part", range_of(*order))
    into = [(*first, (i or len(firsts)) - 1) for i, first in enumerate(firsts)]
    starts = spark.createDataFrame(into, "none int, turned long, h long, into int")
    guests = (
        rows.join(F.broadcast(starts), order)  # at most n rows
        .select("id", "text", *order, F.col("into").alias("part"), F.lit(1).alias("guest"))
    )
    sent = (
        ranged.select("id", "text", *order, "part", F.lit(0).alias("guest"))
        .unionByName(guests)
        .repartitionById(n, F.col("part"))
        .sortWithinPartitions("part", "guest", *order, "text")
        .select("part", "guest", "id", "text")
    )

    def edit(text: str, following: str) -> str:
        k = len(text) // 3
        return text[: len(text) - k] + following[:k] if k else text

    def run(batches):
        held = None  # (part, id, text, fingerprint)
        out: list = []

        def close(text: str, mark: str) -> None:
            _, key, own, own_mark = held
            edited = edit(own, text).encode()
            edited_mark = own_mark if edited == own.encode() else fingerprint(edited)
            out.append((key, len(own), hashlib.sha256(edited).hexdigest(), own_mark, edited_mark, likeness(own_mark, edited_mark), likeness(own_mark, mark)))

        names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        for batch in batches:
            for part, guest, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if guest and (held is None or held[0] != part):
                    continue  # a further row with the first one's id
                mark = fingerprint(text.encode())
                if held is not None and held[0] == part:
                    close(text, mark)
                held = None if guest else (part, key, text, mark)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                out = []

    schema = "id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return sent.mapInArrow(run, schema).withColumnRenamed("id", id_col)
