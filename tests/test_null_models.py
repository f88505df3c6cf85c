import hashlib
import math
import random
from collections import Counter, defaultdict

from tallyline.plans import null_models


def plain(rows, permutations, seed):
    strata = defaultdict(list)
    for r in rows:
        strata[r[1]].append(r)
    null = [Counter() for _ in range(permutations)]
    for members in strata.values():
        members.sort()
        for p in range(permutations):
            ranked = sorted(members, key=lambda r: (hashlib.md5(f"{seed}|{p}|{r[0]}".encode()).hexdigest(), r[0]))
            for r, label in zip(ranked, members):
                if r[3] and label[2] is not None:
                    null[p][label[2]] += 1
    for e in {r[2] for r in rows if r[2] is not None}:
        observed = sum(1 for r in rows if r[2] == e and r[3])
        counts = sorted(n[e] for n in null)
        p95 = counts[math.ceil(0.95 * permutations) - 1]
        yield e, observed, sum(counts) / permutations, p95, (1 + sum(c >= observed for c in counts)) / (permutations + 1), permutations, observed > p95


def test_equals_plain_permutations_at_any_partitioning(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice(["a", "b", None]), rng.choice(["x", "y", "z", None]), rng.random() < 0.2) for k in range(400)]
    rows += [(1000 + k, "a", "w", k % 10 != 0) for k in range(30)]
    df = spark.createDataFrame(rows, "id int, s string, e string, hit boolean")
    want = sorted(plain(rows, 40, 7))
    for n in (1, 5):
        assert sorted(map(tuple, null_models.permutation_null(df.repartition(n), "id", ["s"], "e", "hit", 40, 7).collect())) == want
    assert {w[0]: w[-1] for w in want}["w"] and not all(w[-1] for w in want)
    assert null_models.permutation_null(df.limit(0), "id", ["s"], "e", "hit").count() == 0


def test_gate(spark):
    findings = spark.createDataFrame([("C4", "w"), ("C4", "x"), ("C4", "new"), ("D1", "x"), (None, "x")], "rule_code string, entity string")
    nulls = spark.createDataFrame([("C4", "w", True), ("C4", "x", False)], "rule_code string, entity string, exceeds boolean")
    out = {(r.rule_code, r.entity): r.worklist_eligible for r in null_models.gate(findings, nulls).collect()}
    assert out == {("C4", "w"): True, ("C4", "x"): False, ("C4", "new"): False, ("D1", "x"): True, (None, "x"): True}
