import hashlib
import math
import random
import re
import time
from collections import Counter

import duckdb
import pyarrow as pa

from pyspark.sql import functions as F

from tallyline.llm import secrets


def brute(text):
    text = text or ""
    out = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append(("assign", *m.span()))
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def test_base_spans_match_brute_force(spark):
    rng = random.Random(8)
    bits = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", '"', "'", " ", ":", "=", "abc", "abcdef123", "é日", "AKIA", "A1B2C3D4E5F6G7H8", "0123456789abcdef", "\n", "/+"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(25)))) for i in range(600)] + [(None, None), (7, ""), (900, "a" * 30_000)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, base int")
    out = secrets.find(docs).withColumn("d", F.lit(1))
    got = Counter((r.doc_id, tuple((s.kind, s.start, s.end) for s in r.spans if s.kind != "entropy")) for r in out.collect())
    assert got == Counter((k, tuple(brute(t))) for k, t in rows)
    row = secrets.digest(secrets.find(docs.where("doc_id = 900"))).first()
    want = brute(rows[-1][1])
    assert row.n_hex == 1 and row.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
    assert secrets.find(docs.limit(0)).count() == 0


def test_entropy_by_increments(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdef0123456789XYZ") for _ in range(rng.randrange(20, 60))) for _ in range(40)] + ["a" * 25, "abcdefghijklmnopqrst"]

    def slow(w):
        best = 0
        for i in range(len(w) - 19):
            best = max(best, -sum(c / 20 * math.log2(c / 20) for c in Counter(w[i : i + 20]).values()))
        return best

    df = spark.createDataFrame([(w,) for w in words], "w string")
    for r in df.select("w", secrets.max_entropy(F.col("w")).alias("h")).collect():
        assert abs(r.h - slow(r.w)) < 1e-9


def test_added_spans_and_allow_list(spark):
    texts = ["key dGhpc0lzQTFTZWNyZXQ5OFp3Ow", "see 123e4567-e89b-12d3-a456-426614174000", "a verylongidentifierwithoutdigits", "AbCd1AbCd1AbCd1AbCd1AbCd1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: [s.kind for s in r.spans] for r in secrets.find(docs).collect()}
    assert got == {0: ["entropy"], 1: [], 2: [], 3: []}


def test_random_keys_are_found_whatever_they_hold(spark):
    rng = random.Random(10)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["".join(rng.choice(letters + more) for _ in range(n)) for more in ("+/", "-_") for n in (40, 64) for _ in range(300)]
    keys += ["wJalrXUtnFEMI/K7MDENG/bPxRfiCYzK3vQ8mT2n", "/services/T0A1B2C3D/B9Z8Y7X6W/q8Zr2LmX0vTn4KsYb7Pd1WcE", "-aB3dE5gH7jK9mN1pQ4sT6vX8zC2", "Qx7testZk29vBn40000LmPw83RtY", "files/3f786850e387550fdab836ed7e6dc881"]
    keys = [k for k in keys if re.search("[0-9]", k)]
    harmless = ["usr/share/annual-reports/2023/summary-of-costs", "your-api-key-example-1234567890", "XXXXXXXXXXXXXXXXXXXXXXXX0000", "docs/projectPlans/versionTwo2/readMe"]
    docs = spark.createDataFrame([(i, f"see {k} here") for i, k in enumerate(keys + harmless)], "doc_id int, text string")
    found = {r.doc_id for r in secrets.find(docs).collect() if r.spans}
    assert [k for i, k in enumerate(keys) if i not in found] == []
    assert found == set(range(len(keys)))


def test_very_long_texts_take_time_in_proportion(spark):
    rng = random.Random(11)
    base64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    m, n = 1_000_000, 200_000
    texts = [
        "a/" * (m // 2) + "1",
        "0" * m,
        "".join(rng.choices(base64, k=m)),
        "".join(rng.choices("0123456789", k=m)),
        "Aa" * (n // 2) + "1/",
        "test" * (n // 4) + "1",
        "a-" * (n // 2) + "/9",
        "0" * (n - 1) + "z",
        "9é" * (n // 2),
        "A" * (n // 2) + "".join(rng.choices(base64, k=40)) + "A" * (n // 2) + "1",
        " ".join("".join(rng.choices("0123456789abcdef", k=24)) for _ in range(n // 25)),
        " ".join("".join(rng.choices(base64, k=22)) for _ in range(n // 23)),
        "password" + " " * n + "= abcdef1",
        "AKIA" * (n // 4),
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(len(texts))
    started = time.monotonic()
    got = {r.doc_id: r.spans for r in secrets.find(docs).collect()}
    assert time.monotonic() - started < 120
    for i, text in enumerate(texts):
        assert [(s.kind, s.start, s.end) for s in got[i] if s.kind != "entropy"] == brute(text), i
        assert [(s.start, s.end) for s in got[i] if s.kind == "entropy"] == brute_entropy(text), i


def brute_entropy(text):
    """Entropy spans by a plain reading: recounts each window; the allow-list in other words."""
    base, out = brute(text), []
    stand_ins = "your my this is not real an example sample dummy placeholder changeme test secret token api key password value x+ 0+ 123456789?0?"
    stand_in = f"(?:{'|'.join(stand_ins.split())})"
    ends = [m for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", text)]
    taken = bytearray(len(text))
    for _, a, b in base:
        taken[a:b] = b"\1" * (b - a)

    def word_like(part):
        return bool(re.fullmatch("(?:[A-Z]++|[a-z]*+(?:[A-Z][a-z]++)*+)[0-9]{0,4}", part))

    def stands_in(w):
        left = re.sub(f"(?i)[-_/+=]?{stand_in}", "\0", w)
        return not left.strip("\0") and re.match(f"(?i){stand_in}", w)

    def known(w):
        return bool(
            not re.search("[0-9]", w) or not re.search("[A-Za-z]", w) or re.fullmatch("[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", w) or stands_in(w)
            or ("/" in w and all(map(word_like, re.split("[-_/]", w)))) or any(len(w) % k == 0 and len(w) > k and w == w[:k] * (len(w) // k) for k in range(1, 9)) or "===" in w
        )

    def entropy(w):
        best = 0
        for i in range(len(w) - 19):
            best = max(best, -sum(c / 20 * math.log2(c / 20) for c in Counter(w[i : i + 20]).values()))
            if best > 3.8:
                break  # above each threshold
        return best

    def rich(w):
        limit = 3.0 if re.fullmatch("[0-9a-fA-F]+", w) else 3.6 if re.fullmatch("[A-Za-z0-9]+", w) else 3.7
        return not known(w) and entropy(w) >= limit

    for m in ends:
        if not any(taken[m.start() : m.end()]):
            if rich(m[0]) or ("/" in m[0] and any(len(p) >= 20 and rich(p) for p in m[0].split("/"))):
                out.append(m.span())
    return out


def test_entropy_spans_match_brute_force(spark, sf_dir):
    rng = random.Random(12)
    bits = ["test", "KEY", "your", "Abc", "XYZ", "abc", "x", "0", "00", "12345", "123456789", "/", "-", "_", "+", "=", "==", "dGhpc0lz", "9f3A", "Qx7", "deadbeef0123", "é", " ", "secret="]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(40)))) for i in range(1500)]
    rows += [(10_000 + r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {r.doc_id: [(s.start, s.end) for s in r.spans if s.kind == "entropy"] for r in secrets.find(docs).collect()}
    for i, text in rows:
        assert got[i] == brute_entropy(text), text
    assert sum(map(len, got.values())) > 50
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]}))
    theirs = {r[0]: r[1:] for r in con.sql(secrets.DIGEST_SQL).fetchall()}
    assert {r.doc_id: tuple(r)[1:] for r in secrets.digest(secrets.find(docs)).collect()} == theirs
