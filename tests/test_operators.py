import random
from datetime import date

from pyspark.sql import functions as F

from tallyline.operators import assign, joins, ordered, scoring


def test_range_and_amount_joins(spark):
    rng = random.Random(1)
    left = [(i, rng.choice("ab"), a := rng.randrange(200), a + rng.randrange(60)) for i in range(60)]
    right = [(i, rng.choice("ab"), rng.randrange(260)) for i in range(80)]
    a, b = spark.createDataFrame(left, "i int, k string, lo int, hi int"), spark.createDataFrame(right, "j int, k string, p int")
    got = {(r.i, r.j) for r in joins.range_join(a, b, ["k"], "p", "lo", "hi", 25).collect()}
    assert got == {(i, j) for i, k, lo, hi in left for j, q, p in right if k == q and lo <= p <= hi}
    c = joins.amount_range_join(a, b, ["k"], "lo", "p", 3)
    assert {(r.i, r.j) for r in c.collect()} == {(i, j) for i, k, lo, _ in left for j, q, p in right if k == q and abs(lo - p) <= 3} and c.count() == len({(r.i, r.j) for r in c.collect()})


def test_asof_and_nearest(spark):
    rng = random.Random(2)
    left = [(i, rng.choice("ab"), rng.randrange(40)) for i in range(50)]
    right = [(j, rng.choice("ab"), rng.randrange(40)) for j in range(30)]
    a, b = spark.createDataFrame(left, "i int, k string, t int"), spark.createDataFrame(right, "j int, k string, u int")
    got = {r.i: r.asof_j for r in joins.asof_latest(a, b, ["k"], "t", "u", ["j"], ["j"]).collect()}
    assert got == {i: max(((u, j) for j, q, u in right if q == k and u <= t), default=(0, None))[1] for i, k, t in left}
    near = {r.i: r.near_j for r in joins.nearest(a, b, ["k"], "t", "u", "j").collect()}
    assert near == {i: min(((abs(u - t), j) for j, q, u in right if q == k), default=(0, None))[1] for i, k, t in left}


def test_greedy_equals_sequential(spark):
    rng = random.Random(3)
    for _ in range(3):
        pairs = sorted({(rng.randrange(9), rng.randrange(9)) for _ in range(40)})
        rows = [(a, b, rng.randrange(5)) for a, b in pairs]
        left, right, want = set(), set(), set()
        for a, b, s in sorted(rows, key=lambda r: (r[2], r[0], r[1])):
            if a not in left and b not in right:
                left.add(a), right.add(b), want.add((a, b))
        df = spark.createDataFrame(rows, "a int, b int, s int")
        assert {(r.a, r.b) for r in assign.greedy_pairs(df, "a", "b", [F.col("s")]).collect()} == want


def test_interval_first_fit(spark):
    rng = random.Random(5)
    opens = [(i, rng.choice("ab"), rng.randrange(60), rng.randrange(2)) for i in range(40)]
    closes = [(j, rng.choice("ab"), rng.randrange(60), rng.randrange(2)) for j in range(40)]
    free, want = sorted(closes, key=lambda c: (c[2], c[0])), set()
    for i, k, t, e in sorted(opens, key=lambda o: (o[2], o[0])):
        hit = next((c for c in free if c[1] == k and c[3] == e and 0 < c[2] - t <= 15), None)
        if hit:
            free.remove(hit), want.add((i, hit[0]))
    a, b = spark.createDataFrame(opens, "i int, k string, t int, e int"), spark.createDataFrame(closes, "j long, k string, u int, f int")
    got = {(r.i, r.j) for r in assign.interval_first_fit(a, b, ["k"], "i", "j", "t", "u", 15, [("e", "f")]).collect()}
    assert got == want


def test_sets_are_exclusive(spark):
    sets = spark.createDataFrame([("x", ["1", "2"], 1), ("y", ["2", "3"], 2), ("z", ["3", "4"], 3)], "t string, parts array<string>, o int")
    assert {r.t for r in assign.greedy_sets(sets, "t", [F.col("o")]).collect()} == {"x", "z"}


def test_parameters_and_matches(spark):
    v = spark.createDataFrame([("k", 1, 1, date(2020, 1, 1)), ("k", 2, 2, date(2021, 1, 1)), ("k", 3, 1, date(2022, 1, 1))], "key string, value int, version int, valid_from date")
    rows = spark.createDataFrame([(date(2019, 1, 1),), (date(2020, 6, 1),), (date(2023, 1, 1),)], "d date").orderBy("d")
    assert [r.k for r in joins.parameter_asof(rows, v, "k", "d").orderBy("d").collect()] == [None, 1, 2]
    assert [r.k for r in joins.parameter_asof(rows, v, "k", "d", by_version=False).orderBy("d").collect()] == [None, 1, 3]
    a = spark.createDataFrame([(1, "x", "p"), (2, "x", "q"), (3, "y", "r")], "i int, k string, m string")
    b = spark.createDataFrame([(7, "x", "p"), (8, "y", "z")], "j int, k string, m string")
    assert {(r.i, r.j, r.phase) for r in joins.two_phase_match(a, b, [("k", "k"), ("m", "m")], "i", "j").collect()} == {(3, 8, 1), (1, 7, 2)}


def test_running_balance(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for k in range(8):
        run, bad = 0, 0
        for n in range(12):
            v = rng.randrange(-50, 50)
            printed = None if rng.random() < 0.3 else run + v + (rng.choice([0, 0, 0, 7]))
            if printed is not None:
                bad += printed != run + v
            run = printed if printed is not None else run + v
            rows.append((k, n, float(v), None if printed is None else float(printed), 0.0))
        want[k] = bad
    df = spark.createDataFrame(rows, "k int, n int, v double, s double, o double")
    assert {r.k: r.breaks for r in ordered.running_balance(df, "k", ["n"], "v", "s", "o").collect()} == want


def test_groups_and_votes(spark):
    pages = [("b", i, k, link) for i, (k, link) in enumerate([("x", None), ("x", None), ("y", None), ("y", True), ("y", False), ("y", None), ("y", None), ("y", None)])]
    df = spark.createDataFrame(pages, "b string, i int, k string, link boolean")
    assert [r.group for r in ordered.group_pages(df, "b", "i", "k", "link", cap=3).orderBy("i").collect()] == [1, 1, 2, 2, 3, 3, 3, 4]
    votes = spark.createDataFrame([("g", "x", 1), ("g", "y", 2), ("h", "x", 1), ("h", "x", 2), ("h", "y", 0)], "g string, v string, o int")
    assert {(r.g, r.v, r.first_seen, r.votes) for r in ordered.majority(votes, "g", "v", "o").collect()} == {("g", "mixed", "x", 1), ("h", "x", "x", 2)}
    near = spark.createDataFrame([("b", "p", 100, 0b1111), ("b", "q", 104, 0b0111), ("b", "r", 120, 0b1111), ("b", "s", 105, 1 << 40 | 0b1111000000)], "b string, id string, t int, h long")
    assert {(r.id, r.near) for r in ordered.near_pages(near, "b", "id", "t", "h").collect()} == {("q", "p")}


def test_coverage_and_merge(spark):
    spans = spark.createDataFrame([("a", date(2024, 1, 15), date(2024, 4, 2))], "k string, a date, b date")
    held = spark.createDataFrame([("a", date(2024, 2, 20), date(2024, 3, 1))], "k string, s date, e date")
    got = {r.month.month: r.covered for r in ordered.month_coverage(spans, held, "k", "a", "b", "s", "e").collect()}
    assert got == {1: False, 2: True, 3: True, 4: False}
    flagged = joins.interval_overlap(spans, held, ["k"], "a", "b", "s", "e").first()
    assert flagged.covered
    old = spark.createDataFrame([(1, "x", "proposed"), (2, "y", "rejected"), (4, "w", "proposed")], "k int, v string, status string")
    new = spark.createDataFrame([(1, "x2", "proposed"), (2, "y2", "proposed"), (3, "z", "proposed")], "k int, v string, status string")
    assert {(r.k, r.v, r.outcome) for r in ordered.merge_keeping(old, new, ["k"], "status").collect()} == {(1, "x2", "updated"), (2, "y", "kept"), (3, "z", "inserted"), (4, "w", "untouched")}


def test_scores(spark):
    hits = spark.createDataFrame([("A1", "A", 3, "e", 0.9, 1.0, 1.0), ("D1", "D", 4, "e", 1.0, 1.0, 0.7), ("D2", "D", 2, "", 1.0, 1.0, 1.0), ("D3", "D", 2, "", 1.0, 1.0, 1.0)], "rule_code string, family string, severity int, event_key string, extraction_quality double, specificity double, independence double")
    top = scoring.collapse_by_event(scoring.scored(hits))
    assert {(r.rule_code, tuple(r.absorbed)) for r in top.collect()} == {("D1", ("A1",)), ("D2", ()), ("D3", ())}
    again = scoring.collapse_by_event(top.drop("absorbed"))
    assert again.count() == 3
    low = spark.range(1).select(scoring.wilson_lower(F.lit(9), F.lit(10)).alias("w")).first().w
    assert abs(low - 0.5958) < 1e-3
    points = spark.createDataFrame([("p", "r", "S8", 25), ("p", "r", "S8", 10), ("p", "r", "S3", 45), ("p", "r", "S3", 30)], "party string, role string, signal string, points int")
    assert scoring.link_points(points, "party", "role").first().points == 80


def one_by_one(targets, parts):
    """The pass over targets in order, each searching what is left."""
    from itertools import combinations

    free = sorted(parts, key=lambda p: (p[1], p[0]))
    for t, day, due in sorted(targets, key=lambda x: (x[1], x[0])):
        seen = [p for p in free if -5 <= p[1] - day <= 120][:12]
        for n in (2, 3):
            found = next((c for c in combinations(seen, n) if c[-1][1] - c[0][1] <= 120 and any(abs(d - sum(p[2] for p in c)) <= n for d in due)), None)
            if found:
                free = [p for p in free if p not in found]
                yield t, tuple(p[0] for p in found), sum(p[2] for p in found)
                break


def test_partial_stream_is_the_pass_in_order(spark):
    import random
    from datetime import date, timedelta

    rng = random.Random(3)
    start = date(2024, 1, 1)
    want, left, right = set(), [], []
    for c in range(12):
        targets = [(f"{c}-{i:02d}", rng.randrange(300), [rng.choice([30, 50, 70, 90]) for _ in range(rng.choice([1, 1, 2]))]) for i in range(rng.randrange(1, 20))]
        parts = [(f"{c}-{i:02d}", rng.randrange(400), rng.choice([10, 20, 25, 40, 7])) for i in range(rng.randrange(1, 60))]
        want |= set(one_by_one(targets, parts))
        left += [(f"k{c}", t, start + timedelta(d), due) for t, d, due in targets]
        right += [(f"k{c}", p, start + timedelta(d), v) for p, d, v in parts]
    a = spark.createDataFrame(left + [("k1", None, start, [1]), ("k1", "z", None, [1])], "c string, t string, day date, due array<long>")
    b = spark.createDataFrame(right + [("k1", "z", start, None)], "c string, p string, at date, v long")
    got = {(r.t, tuple(r.parts), r.total) for r in assign.partial_stream(a, b, ["c"], "t", "day", "due", "p", "at", "v").collect()}
    assert got == want and len(want) > 20
    assert assign.partial_stream(a.limit(0), b, ["c"], "t", "day", "due", "p", "at", "v").count() == 0


def test_two_invoices_of_one_amount_take_different_sets(spark):
    from datetime import date

    a = spark.createDataFrame([("c", x, date(2024, 1, 1), [3000]) for x in "AB"], "c string, t string, day date, due array<long>")
    b = spark.createDataFrame([("c", f"d{i}", date(2024, 1, 2 + i), v) for i, v in enumerate((1000, 2000, 1000, 2000))], "c string, p string, at date, v long")
    got = {r.t: r.parts for r in assign.partial_stream(a, b, ["c"], "t", "day", "due", "p", "at", "v").collect()}
    assert got == {"A": ["d0", "d1"], "B": ["d2", "d3"]}
