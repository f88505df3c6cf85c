import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyline.llm import simhash
from tallyline.llm.common import connected_components


def slow_fp(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", low) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def roots_of(n, links):
    up = list(range(n))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        up[max(top(a), top(b))] = min(top(a), top(b))
    return [top(i) for i in range(n)]


def test_fingerprint():
    for t in ["", None, "A", "a b", "A b  c\n", "One two Three four ÉCOLE five\x0bsix\x1cseven", "x " * 500]:
        assert simhash.fingerprint(t) == slow_fp(t)


def near(rng, n):
    fps = [rng.getrandbits(64) for _ in range(n)]
    for f in fps[: n // 2]:
        for _ in range(4):
            g = rng.choice(fps[-4:] + [f])
            for _ in range(rng.randrange(1, 5)):
                g ^= 1 << rng.randrange(64)
            fps.append(g)
    return sorted(set(fps))


def check(spark, fps, block):
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    at = {f: i for i, f in enumerate(signed)}
    got = [(at[r.a], at[r.b]) for r in simhash.links(df, block=block).collect()]
    assert all((fps[a] ^ fps[b]).bit_count() <= 3 for a, b in got)
    want = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    assert roots_of(len(fps), got) == roots_of(len(fps), want)


def test_links_connect_all(spark):
    rng = random.Random(1)
    check(spark, near(rng, 120), 8192)
    base = rng.getrandbits(64)
    dense = {base}
    while len(dense) < 300:
        g = base
        for _ in range(rng.randrange(1, 5)):
            g ^= 1 << rng.randrange(64)
        dense.add(g)
    check(spark, sorted(dense), 8192)
    check(spark, sorted(dense), 7)


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = roots_of(300, edges)
    assert got == {n: want[n] for e in edges if e[0] != e[1] for n in e}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates(spark):
    rng = random.Random(6)
    words = ["w%d" % rng.randrange(5000) for _ in range(400)]
    copy = words[:200] + ["zz"] + words[201:]
    texts = [" ".join(words), " ".join(copy), " ".join(words), None, "", "one two", "One  two", " ".join(reversed(words))]
    rows = [(i + 10, t, 1) for i, t in enumerate(texts)] + [(None, "one two", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    out = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    fps = {k: slow_fp(t) for k, t, _ in rows}
    for k in fps:
        assert int(out[k].fingerprint, 16) == fps[k]
    keys = [k for k in fps if k is not None]
    want = roots_of(len(keys), [(i, j) for i in range(len(keys)) for j in range(i) if (fps[keys[i]] ^ fps[keys[j]]).bit_count() <= 3])
    assert [out[k].component_id for k in keys] == [keys[w] for w in want]
    assert out[None].component_id == 15
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_one_row_stays_whatever_the_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a, "en"), (1, a, "en"), (1, a, "es"), (2, a, "en"), (2, b, "en"), (None, c, "en"), (None, c, "en"), (3, None, "en"), (4, "", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string")
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    assert Counter(map(tuple, kept.collect())) == Counter([(1, a, "en"), (2, b, "en"), (None, c, "en"), (3, None, "en")])


def slow_set(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def smallest_of_classes(rows):
    """The smallest id of each class of rows (id, text), by comparing all pairs."""
    sets = [slow_set(t) for _, t in rows]
    roots = roots_of(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if alike(sets[i], sets[j])])
    least = {}
    for (k, _), root in zip(rows, roots):
        least[root] = min(least.get(root, k), k)
    return sorted(least.values())


def test_near_copies_of_the_given_table_go(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(r.doc_id for r in simhash.representatives(docs).collect()) == smallest_of_classes(rows)


def test_chains_and_common_passages(spark):
    rng = random.Random(4)
    words = [f"w{rng.randrange(9000)}" for _ in range(220)]
    texts = []
    for _ in range(12):  # each is near the one before, the ends are far apart
        at = rng.randrange(0, 190)
        words = words[:at] + [f"x{rng.randrange(9000)}" for _ in range(14)] + words[at + 14 :]
        texts.append(" ".join(words))
    common = " ".join(f"c{i}" for i in range(60))
    texts += [common + " " + " ".join(f"y{rng.randrange(9000)}" for _ in range(rng.randrange(0, 60))) for _ in range(30)]
    texts += ["", None, "one two", "One  two", "one two three"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.representatives(docs).collect()) == smallest_of_classes(rows)
    assert simhash.representatives(docs.limit(0)).count() == 0


def test_wide_fingerprints_of_similar_sets_are_near():
    rng = np.random.default_rng(5)
    apart, seeds = [], simhash._seeds(6)
    for _ in range(300):
        shared, own = rng.integers(0, 2**63, 320, np.uint64), rng.integers(0, 2**63, (2, 40), np.uint64)  # similarity 0.8
        a, b = (simhash.wide_fingerprint(np.unique(np.concatenate([shared, x])), seeds) for x in own)
        apart.append(int(np.bitwise_count(a ^ b).sum()))
    assert abs(np.mean(apart) / 384 - 0.1515) < 0.01 and np.mean(np.array(apart) <= simhash.allowed(384)) > 0.99


def test_very_long_text():
    text = " ".join(f"w{i % 977}" for i in range(300_000))
    assert simhash.fingerprint(text) == slow_fp(text)
    assert len(simhash.shingle_set(text, 5)) == 977


def test_shapes_grow_with_the_texts():
    assert simhash.shape(1000) == (16, 16) and simhash.shape(1000).words == 6 and simhash.allowed(128) == 32 and simhash.allowed(384) == 80
    for texts in (1 << 19, 1 << 22, 1 << 26, 1 << 34):
        form = simhash.shape(texts)
        meetings = texts * form.segments * (form.bits + 1) / 2**form.bits
        assert meetings < 40_000 and form.words * 64 >= 128 + form.bits * form.segments


def edited(rng, words, most):
    words = list(words)
    for _ in range(rng.randrange(1, most + 1)):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**9)}"
    return words


@pytest.mark.parametrize("bits", [16, 20])
def test_loose_group_against_all_pairs(spark, bits):
    rng = random.Random(bits)
    base = [f"w{rng.randrange(9000)}" for _ in range(140)]
    texts = [" ".join(edited(rng, base, 9)) for _ in range(400)]
    texts += [" ".join(edited(rng, [f"v{i}" for i in range(100)], 3)) for _ in range(90)] + [" ".join(f"u{rng.randrange(10**6)}" for _ in range(80)) for _ in range(100)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: r.root for r in simhash.similar(docs, form=simhash.shape(1 << (bits + 3))).collect()}
    sets = [slow_set(t) for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if alike(sets[i], sets[j])]
    kept = sum(got[i] == got[j] for i, j in pairs)
    assert kept >= 0.99 * len(pairs) and len(pairs) > 1000
    want = roots_of(len(rows), pairs)
    assert all(want[i] == want[j] for i in got for j in got if got[i] == got[j])


def test_many_near_copies_in_bounded_time(spark):
    rng = random.Random(8)
    base = [f"w{rng.randrange(9000)}" for _ in range(150)]
    rows = [(i, " ".join(edited(rng, base, 2) if i % 10 else [f"x{rng.randrange(10**7)}" for _ in range(40)])) for i in range(20_000)]
    began = time.time()
    kept = simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string")).count()
    assert 2000 < kept < 2020 and time.time() - began < 240


def test_a_loose_crowd_costs_no_row_a_pair(spark, monkeypatch):
    rng = random.Random(12)
    base = [f"w{rng.randrange(9000)}" for _ in range(140)]
    texts = [" ".join(edited(rng, base, 2)) for _ in range(250)]  # a large group
    texts += [" ".join(edited(rng, edited(rng, base, 6), 9)) for _ in range(250)]  # beside it, most of them not similar enough
    rows = list(enumerate(texts))
    met, plain = [], simhash._met
    monkeypatch.setattr(simhash, "_met", lambda *args: met.append(plain(*args)) or met[0])
    monkeypatch.setattr(simhash, "SIDE", 100)  # several cells
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: r.root for r in simhash.similar(docs).collect()}
    sets = [slow_set(t) for t in texts]
    want = roots_of(len(rows), [(i, j) for i in range(len(sets)) for j in range(i) if alike(sets[i], sets[j])])
    assert all((got[i] == got[j]) == (want[i] == want[j]) for i in got for j in got) and 100 < len(set(want)) <= 251
    assert met[0].count() < 2 * len(rows)


def test_overlaps_one_by_one_and_all_at_once():
    rng = np.random.default_rng(3)
    sets = {k: np.unique(rng.integers(0, 3000, rng.integers(0, 400))).astype(np.uint64) for k in range(30)}
    pairs = [(i, j) for i in sets for j in sets if i < j]
    want = [len(set(sets[i].tolist()) & set(sets[j].tolist())) for i, j in pairs]
    assert simhash._overlaps(sets, *zip(*pairs)).tolist() == want
    assert simhash._overlaps(sets, *zip(*pairs[:20])).tolist() == want[:20]


def test_rows_with_maps(spark):
    text = " ".join(f"w{i}" for i in range(50))
    docs = spark.createDataFrame([(1, text, {"k": 2}), (1, text, {"k": 1}), (2, text, None)], "doc_id long, text string, tags map<string, int>")
    assert [tuple(r) for r in simhash.representatives(docs).collect()] == [(1, text, {"k": 1})]
