import random

from tallyline.operators import similar_sets as ss


def brute(sets, percent):
    keys = sorted(sets)
    return sorted((a, b, len(sets[a] & sets[b]), len(sets[a] | sets[b])) for i, a in enumerate(keys) for b in keys[i + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]))


def test_equals_all_pairs(spark):
    rng = random.Random(1)
    sets = {}
    for k in range(300):
        base = set(rng.sample(range(60), rng.randrange(1, 20))) if k % 3 or not sets else set(sets[rng.randrange(k)])
        for _ in range(rng.randrange(3)):
            base ^= {rng.randrange(60)}
        sets[k] = base
    rows = spark.createDataFrame([(k, [str(x) for x in v]) for k, v in sets.items()], "k long, v array<string>")
    for percent in (50, 85, 100):
        got = sorted(tuple(r) for r in ss.similar_sets(rows, "k", "v", percent).collect())
        assert got == brute(sets, percent) and got
    assert ss.similar_sets(rows.limit(0), "k", "v", 85).count() == 0


def test_few_candidates_meet(spark):
    rows = spark.range(2000).selectExpr("id AS k", "transform(sequence(0, 19), i -> concat(IF(i < 15, 'common ', concat('own ', id, ' ')), i)) AS v")
    joined = ss.similar_sets(rows, "k", "v", 85)
    assert joined.count() == 0  # 15 of 25 shared; the rarest items are each one's own, so none meets
    first = spark.range(2000).selectExpr("id AS k", "array(concat('a', id div 2), 'b', 'c', 'd') AS v")
    assert ss.similar_sets(first, "k", "v", 85).count() == 1000


def test_lines_of_other_vendors(spark):
    import datetime

    day = datetime.date(2024, 1, 1)
    rows = [(0, "a", day, "Pintura façana principal"), (1, "b", day + datetime.timedelta(120), "PINTURA  facana principal."), (2, "b", day + datetime.timedelta(121), "pintura facana principal"), (3, "a", day, "pintura facana principal"), (4, "c", day, "lampisteria"), (5, None, day, "pintura facana principal"), (6, "c", None, "pintura facana principal"), (7, "c", day, None)]
    out = {r.id: r.similar for r in ss.similar_lines(spark.createDataFrame(rows, "id int, v string, d date, t string"), "id", "v", "d", "t").collect()}
    assert out == {0: 1, 1: 2, 2: 0, 3: 1, 4: 0, 5: 0, 6: 0, 7: 0}
