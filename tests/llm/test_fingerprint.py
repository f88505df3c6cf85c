import hashlib
import random
import tracemalloc

from tallyline.llm import fingerprint as fp


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_edit_distance_matches_dynamic_programming():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randrange(30))) for _ in range(2))
        assert fp.edit_distance(a, b) == len(a) + len(b) - 2 * slow_lcs(a, b)


def test_likeness():
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefg hij") for _ in range(6000)).encode()
    one = fp.fingerprint(text)
    assert one == fp.fingerprint(bytes(text)) and fp.likeness(one, one) == 1
    near = fp.likeness(one, fp.fingerprint(text[:3000] + b"XX" + text[3000:]))
    far = fp.likeness(one, fp.fingerprint(bytes(rng.choice(b"abcdefg hij") for _ in range(6000))))
    assert near > 0.8 and far < 0.3
    assert fp.fingerprint(b"") == "3::"


def slow_fingerprint(raw):
    """Byte by byte: chunks end where the rolling hash of the last seven bytes is -1 modulo the size."""
    if not raw:
        return "3::"

    def roll(i):
        h = sum(pow(0x01000193, k, 1 << 32) * (raw[i - k] if i >= k else 0) for k in range(7)) % (1 << 32)
        h = (h ^ h >> 15) * 0x85EBCA6B % (1 << 32)
        return h ^ h >> 13

    rolls = [roll(i) for i in range(len(raw))]

    def letter(chunk):
        x = sum((c + 1) * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, c in enumerate(chunk)) % (1 << 64)
        x = (x ^ x >> 29) * 0xBF58476D1CE4E5B9 % (1 << 64)
        x = (x ^ x >> 32) * 0x94D049BB133111EB % (1 << 64)
        return "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"[(x ^ x >> 31) >> 58]

    def signature(size):
        out, chunk = "", []
        for c, r in zip(raw, rolls):
            chunk.append(c)
            if r % size == size - 1:
                out, chunk = out + letter(chunk), []
        return out + letter(chunk) if chunk else out

    size = 3
    while size * 64 < len(raw):
        size *= 2
    while size > 3 and len(signature(size)) < 32:
        size //= 2
    return f"{size}:{signature(size)}:{signature(2 * size)}"


def test_fingerprint_against_brute_force(monkeypatch):
    rng = random.Random(7)
    texts = [bytes(rng.choice(b"ab c") for _ in range(n)) for n in (1, 2, 7, 8, 63, 200, 1000, 3000)]
    texts += [b"a" * 2000, rng.randbytes(2500), "é日" .encode() * 300]
    for text in texts:
        want = slow_fingerprint(text)
        for piece in (1 << 20, 64, 7, 1):
            monkeypatch.setattr(fp, "PIECE", piece)
            assert fp.fingerprint(text) == want, (len(text), piece)


def test_long_text_needs_memory_for_a_piece():
    text = random.Random(8).randbytes(30 << 20)
    tracemalloc.start()
    try:
        assert fp.fingerprint(text).count(":") == 2
        assert tracemalloc.get_traced_memory()[1] < 120 << 20
    finally:
        tracemalloc.stop()


def expected(rows):
    """rows: (id, text), no equal ids."""
    order = sorted(((k, t or "") for k, t in rows), key=lambda r: -r[0])
    for (k, t), (_, u) in zip(order, order[1:] + order[:1]):
        cut = len(t) // 3
        e = t[: len(t) - cut] + u[:cut]
        a, b, c = (fp.fingerprint(x.encode()) for x in (t, e, u))
        yield (k, len(t), hashlib.sha256(e.encode()).hexdigest(), a, b, fp.likeness(a, b), fp.likeness(a, c))


def test_compare_with_next(spark):
    rng = random.Random(4)
    for n in (1, 2, 3, 40):
        rows = [(i * 7 - 20, rng.choice([None, "", "é", "ab" * rng.randrange(900), "x y z " * rng.randrange(50)])) for i in range(n)]
        docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, key string")
        for parts in (1, 5):
            got = {tuple(r) for r in fp.compare_with_next(docs, partitions=parts).collect()}
            assert got == set(expected(rows))


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "d"), (2, None)], "doc_id long, text string")
    out = fp.compare_with_next(docs).collect()
    assert sorted(str(r.doc_id) for r in out) == ["1", "1", "2", "None"]
    assert fp.compare_with_next(docs.limit(0)).count() == 0
    many = spark.createDataFrame([(None, f"text {i} " * 40) for i in range(200)], "doc_id long, text string")
    out = fp.compare_with_next(many, partitions=4).collect()
    assert len(out) == 200 and len({r.fingerprint for r in out}) == 200
    assert fp.fingerprints(docs).count() == 4
