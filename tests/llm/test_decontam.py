import hashlib
import random
import re
from collections import Counter

import pytest

from tallyline.llm import decontam


def words(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def brute(docs, items):
    wins = {}
    for k, t in items:
        w = words(t)
        for i in range(max(1, len(w) - 9)):
            if w:
                wins.setdefault(tuple(w[i : i + 10]), set()).add(str(k))
    for k, t in docs:
        w, hit, met = words(t), set(), set()
        for i in range(len(w)):
            for n in range(1, 11):
                if i + n <= len(w) and tuple(w[i : i + n]) in wins:
                    hit.update(range(i, i + n))
                    met |= wins[tuple(w[i : i + n])]
        yield k, len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("limit", [400_000, -1])
def test_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", limit)
    monkeypatch.setattr(decontam, "DOCUMENT_ROWS", limit)
    rng = random.Random(21)
    vocab = ["The", "cat", "É", "été", "ünd", "x1", "2", "rare%d"]

    def text(n):
        return rng.choice(["", " ", "..."]) + " ".join(v % rng.randrange(20) if "%" in v else v for v in rng.choices(vocab, k=n)) + rng.choice(["", "!", "\n"])

    items = [(i, text(rng.choice([0, 1, 3, 9, 10, 11, 25]))) for i in range(30)] + [(2, None), (99, "zzz only here and nowhere else in all of the docs ok")]
    docs = []
    for i in range(60):
        t = text(rng.randrange(30))
        if rng.random() < 0.6:
            t += " " + (rng.choice(items)[1] or "").upper() + ", " + text(5)
        docs.append((i, t))
    docs += [(3, docs[3][1]), (None, docs[4][1]), (None, None), (70, "")]
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, key int, item string")
    b = spark.createDataFrame([(*r, "y") for r in items], "item_id long, text string, words string")
    got = Counter(map(tuple, decontam.report(d, b).collect()))
    assert got == Counter(brute(docs, items))
    kept = Counter(r.doc_id for r in decontam.clean(d, b).collect())
    assert kept == Counter(r[0] for r in brute(docs, items) if not r[5])
    assert decontam.report(d.limit(0), b).count() == 0
    assert decontam.report(d, b.limit(0)).where("contaminated").count() == 0


def near(docs, items, slop, n):
    """(doc, item): for some start, each of a window's words stands within slop of its place."""
    for k, t in docs:
        at = {}
        w = words(t)
        for i, x in enumerate(w):
            at.setdefault(x, set()).add(i)
        for item, u in items:
            v = words(u)
            for i in range(max(1, len(v) - n + 1) if v else 0):
                win = v[i : i + n]
                if any(all(any(s + j + d in at.get(x, ()) for d in range(-slop, slop + 1)) for j, x in enumerate(win)) for s in range(-n, len(w) + n)):
                    yield k, item


@pytest.mark.parametrize("limit", [400_000, -1])
def test_proximity_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", limit)
    monkeypatch.setattr(decontam, "DOCUMENT_ROWS", limit)
    rng = random.Random(22)
    vocab = ["a", "b", "c", "d", "e", "f%d"]

    def text(k):
        return " ".join(v % rng.randrange(4) if "%" in v else v for v in rng.choices(vocab, k=k))

    items = [(i, text(rng.choice([1, 2, 3, 4, 6]))) for i in range(12)] + [(50, None), (51, "nowhere at all")]
    docs = [(i, text(rng.randrange(12))) for i in range(40)] + [(None, "a b c d"), (60, None), (60, "a b"), (60, "a b")]
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, term int")
    b = spark.createDataFrame(items, "item_id long, text string")
    for slop in (0, 1, 2):
        got = {tuple(r) for r in decontam.proximity(d, b, slop=slop, n=4).collect()}
        assert got == set(near(docs, items, slop, 4))


def test_long_text(spark):
    rng = random.Random(23)
    long = " ".join(f"w{rng.randrange(50)}" for _ in range(200_000))
    item = " ".join(long.split()[100_000:100_012])
    d = spark.createDataFrame([(1, long), (2, "w1 w2")], "doc_id long, text string")
    b = spark.createDataFrame([(5, item)], "item_id long, text string")
    assert sorted(map(tuple, decontam.report(d, b).collect()), key=str) == sorted(brute([(1, long), (2, "w1 w2")], [(5, item)]), key=str)
