import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from tallyline.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, v int, ids string, code int"


def brute(rows, parts=16, entries=64, rounds=2):
    kept = [(i, lab, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    w = len(kept[0][2]) // parts
    cut = [[v[j * w : j * w + w] for j in range(parts)] for _, _, v in kept]
    books = [[list(x[j]) for x in cut[:entries]] for j in range(parts)]

    def assign():
        out = []
        for x in cut:
            found = []
            for j in range(parts):
                d = [sum((a - b) ** 2 for a, b in zip(x[j], e)) for e in books[j]]
                found.append((d.index(min(d)), min(d)))
            out.append(found)
        return out

    for _ in range(rounds):
        got = assign()
        for j in range(parts):
            for e in range(len(books[j])):
                own = [x[j] for x, f in zip(cut, got) if f[j][0] == e]
                if own:
                    books[j][e] = [sum(c) // len(own) for c in zip(*own)]
    got = assign()
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    error = [sum(s for _, s in f) for f in got]
    by = Counter()
    for (_, lab, _), e in zip(kept, error):
        by[lab] += e
    for (i, lab, _), f, e in zip(kept, got, error):
        yield i, "".join("%02x" % c for c, _ in f), e, by[lab], digest


def corpus(rng, n, dim=32):
    """Clusters, ties (components of few values), equal vectors, and what has no code."""
    centres = [[rng.uniform(-1, 1) for _ in range(dim)] for _ in range(9)]
    rows = []
    for k in range(n):
        c = rng.choice(centres)
        v = [x + rng.gauss(0, 0.05) for x in c] if k % 3 else [rng.choice([-0.5, 0.0, 0.25]) for _ in range(dim)]
        rows.append((k if k % 50 else k // 2, v, rng.choice([None, 1, 2])))
    rows += [rows[5]] * 4 + [(None, rows[6][1], None), (9_000, None, 1), (9_001, [], 1), (9_002, [None] * dim, 2), (9_003, [float("nan")] + [0.0] * (dim - 1), 2), (9_004, [float("inf")] * dim, 1)]
    return rows


def run(spark, rows, **parameters):
    df = spark.createDataFrame([([*r, 1, "x", 2]) for r in rows], SCHEMA).repartition(3)
    return Counter(map(tuple, codes.report(df, **parameters).collect()))


def test_against_brute_force(spark):
    rows = corpus(random.Random(3), 500)
    assert run(spark, rows) == Counter(brute(rows))


@pytest.mark.parametrize(("rounds", "block", "entries"), [(0, 64, 8), (1, 7, 8), (6, 50, 20), (3, 100, 1)])
def test_rounds_blocks_and_entries(spark, rounds, block, entries):
    rows = corpus(random.Random(rounds), 200, dim=16)
    assert run(spark, rows, rounds=rounds, block=block, entries=entries) == Counter(brute(rows, entries=entries, rounds=rounds))


def test_few_rows_and_none(spark):
    rows = [(4, [0.5] * 16, None), (2, [-0.1] * 16, 1)]
    assert run(spark, rows) == Counter(brute(rows))
    assert run(spark, [(1, None, 1), (2, [float("nan")] * 16, 1)]) == Counter()
    assert codes.report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_other_lengths_have_no_code(spark):
    rows = [(k, [k / 10] * 16, 1) for k in range(20)]
    assert run(spark, rows + [(-1, [1.0] * 32, 1), (-2, [1.0] * 15, 1)]) == Counter(brute(rows))


def test_far_components_are_refused(spark):
    with pytest.raises(Exception, match="beyond"):
        run(spark, [(1, [3e9] * 16, 1)])


def test_only_violated_parts_are_looked_at():
    rng = np.random.default_rng(1)
    vectors = np.concatenate([rng.integers(-3, 4, (500, 1, 4)) + 1000 * k for k in range(4)]).astype(np.int32)
    books = np.array([[[1000 * k] * 4 for k in range(4)]], np.int64)
    block = codes.Block.first(vectors, books)
    moved = books.copy()
    moved[0, 2] += 1
    drift = codes.drifts(books, moved)
    assert block.advance(moved, drift) == 0 and block.codes[:, 0].tolist() == sorted([0, 1, 2, 3] * 500)
    far = moved.copy()
    far[0, 2] = -900
    drift = drift + codes.drifts(moved, far)
    looked = block.advance(far, drift)
    assert 500 <= looked <= 2000 and (block.codes[:, 0] == codes.nearest(vectors[:, 0], far[0])[0]).all()
    again = codes.Block.load(len(vectors), far, *block.dump())
    assert again.advance(far, drift) <= looked and (again.codes == block.codes).all()
