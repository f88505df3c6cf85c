import hashlib
import random
from collections import Counter

import numpy as np

from tallyline.llm import substring


def brute(rows):
    texts = [(k, [w.encode() for w in (t or "").encode().decode().replace("\x1c", "\x00").split(" ") if w]) for k, t in rows]
    seen = Counter(tuple(w[i : i + 35]) for _, w in texts for i in range(len(w) - 34))
    for k, w in texts:
        gone = set()
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone.update(range(i, i + 35))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        yield k, len(w), len(gone), hashlib.sha256(kept).hexdigest()


def corpus(rng, n):
    def words(k):
        return ["w%d" % rng.randrange(10**6) for _ in range(k)]

    passages = [words(k) for k in (34, 35, 36, 50, 80, 200)]
    rows = []
    for i in range(n):
        w = words(rng.randrange(60))
        for p in rng.sample(passages, rng.randrange(3)):
            at, cut = rng.randrange(len(w) + 1), rng.randrange(8)
            w[at:at] = p[cut:] if rng.random() < 0.5 else p
        rows.append((i, " ".join(w)))
    return rows + [(n, rows[0][1]), (n + 1, None), (n + 2, ""), (n + 3, " ".join(["a"] * 90)), (n + 4, " ".join(words(34)))]


def test_cover_shares_an_aligned_position():
    for d in range(substring.PERIOD):
        assert any((c + d) % substring.PERIOD in substring.COVER for c in substring.COVER)


def test_against_brute_force(spark):
    rows = corpus(random.Random(11), 80)
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, at int")
    assert Counter(map(tuple, substring.dedup(docs).collect())) == Counter(brute(rows))


def test_repeated_and_null_ids(spark):
    rng = random.Random(12)
    long = " ".join("v%d" % i for i in range(60))
    rows = corpus(rng, 20) + [(None, long), (3, "x y"), (500, "q " * 40 + "z"), (501, long + " tail")]
    rows += [(502, " ".join("u%d" % i for i in range(40)))] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, substring.dedup(docs).collect())) == Counter(brute(rows))
    kept = {r.doc_id: (r.kept, r.kept_sha256) for r in substring.dedup(docs, with_text=True).collect()}
    assert all(hashlib.sha256(t.encode()).hexdigest() == h for t, h in kept.values())
    assert kept[501][0] == "tail" and kept[502][0] == ""
    assert substring.dedup(docs.limit(0)).count() == 0


def test_scattering_keeps_one_place():
    h = np.array([5, 7, 5, 5, 9], np.uint64)
    out, known = substring._scattered(h, np.arange(5), np.arange(5))
    assert known.tolist() == [True, False, True, True, False] and (out == h).sum() == 3


def test_very_long_text(spark):
    rng = random.Random(21)
    words = ["w%d" % rng.randrange(10**6) for _ in range(150_000)]
    words[90_000:90_000] = words[1_000:1_080]
    rows = [(1, " ".join(words)), (2, " ".join(words[50_000:50_060])), (3, " ".join(["a"] * 100_000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, substring.dedup(docs).collect())) == Counter(brute(rows))
