import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyline.llm import quality
from tallyline.llm.common import table
from tallyline.llm.queries import op4_quality


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    if not os.path.exists(sf_dir):
        pytest.skip("the table isn't there")
    out = op4_quality(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").where("held_out")
    row = out.agg(F.count("*").alias("n"), F.avg((F.col("predicted") == F.col("quality")).cast("int")).alias("acc"), F.avg("quality").alias("base")).first()
    assert row.n > 50 and row.acc > 0.97 > row.base


def test_features_and_descent():
    assert quality.features(None).tolist() == quality.features(" \n").tolist()
    assert len(quality.features("word " * 30_000)) < 30
    rows = [quality.features(t) for t in ["good words here", "more good words", "BAD!! BAD!!", "AWFUL!! NO!!"] * 5]
    y = np.array([1, 1, -1, -1] * 5)
    r = quality.ratios(rows, y)
    w, b = quality.descend(rows, y, r)
    assert all((w[x] @ quality.scaled(x, r) + b > 0) == (c > 0) for x, c in zip(rows, y))


def auc(scores, y):
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(scores))
    ranks[order] = np.arange(1, len(scores) + 1)
    for v in set(scores.tolist()):  # equal scores share their mean rank
        ranks[scores == v] = ranks[scores == v].mean()
    pos = y > 0
    return (ranks[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_words_alone_can_tell_texts_apart():
    rng = np.random.default_rng(3)
    good, bad = ([f"{c}{i}x" for i in range(40)] for c in ("al", "bo"))
    both = [f"m{i}" for i in range(200)]
    texts, y = [], []
    for i in range(400):
        own = good if i % 2 else bad
        texts.append(" ".join([*rng.choice(both, 20), *rng.choice(own, 3)]))
        y.append(1 if i % 2 else -1)
    rows, y = [quality.features(t, marks=False) for t in texts], np.array(y)
    model = quality.fit(rows[:300], y[:300])
    scores = np.array(quality._scores(texts[300:], *model))
    assert auc(scores, y[300:]) > 0.99


def test_ratios_and_descent_against_plain_versions(monkeypatch):
    monkeypatch.setattr(quality, "BITS", 6)
    rng = np.random.default_rng(4)
    rows = [np.unique(rng.integers(0, 64, rng.integers(1, 9))) for _ in range(60)]
    y = np.where(rng.random(60) < 0.4, 1, -1)
    r = quality.ratios(rows, y)
    count = {(c, f): 1 + sum(f in x for x, z in zip(rows, y) if z == c) for c in (1, -1) for f in range(64)}
    total = {c: sum(count[c, f] for f in range(64)) for c in (1, -1)}
    for f in range(64):
        seen = count[1, f] + count[-1, f] - 2
        want = math.log(count[1, f] / total[1]) - math.log(count[-1, f] / total[-1]) if seen >= quality.LEAST else 0
        assert abs(r[f] - want) < 1e-12
    # the descent's weights minimise the hinge loss with its cost: no small step in any direction does better
    monkeypatch.setattr(quality, "EPOCHS", 3000)
    w, b = quality.descend(rows, y, r)
    n = {c: (y == c).sum() for c in (1, -1)}
    cost = {c: quality.COST * max(n.values()) / n[c] for c in n}

    def loss(w, b):
        return (w @ w + b * b) / 2 + sum(cost[c] * max(0, 1 - c * (w[x] @ quality.scaled(x, r) + b)) for x, c in zip(rows, y.tolist()))

    best = loss(w, b)
    for _ in range(300):
        step = rng.normal(size=65) * 10.0 ** -rng.integers(1, 4)
        assert loss(w + step[:64], b + step[64]) > best - 2e-3


def test_very_long_text():
    assert len(quality.features("word " * 300_000)) < 30


def test_several_texts_of_one_id_are_one_choice(spark):
    rows = [(1, "good words here"), (1, "other good words"), (2, "BAD!! BAD!!"), (2, None), (3, "fine words"), (4, "NO!! NO!!")]
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 0)], "doc_id long, quality int")
    models = []
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame([(*r, "x") for r in order], "doc_id long, text string, quality string").repartition(3)
        models.append(quality.train(docs, labels))
    assert all((a == b).all() for a, b in zip(*models))


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "Aa bb."), (1, "Aa bb."), (None, None), (2, ""), (3, "XX!! YY!!")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (3, None), (9, 1)], "doc_id long, quality int")
    for part in (labels, labels.limit(0), labels.where("doc_id = 9")):
        out = quality.score(docs, quality.train(docs, part)).collect()
        assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
    assert all(r.score == 0.5 for r in quality.score(docs, quality.train(docs, labels.limit(0))).collect())
    assert quality.score(docs.limit(0), quality.train(docs, labels)).count() == 0
    kept = quality.keep_good(docs, quality.train(docs, labels.limit(0)))
    assert kept.count() == 5 and kept.schema == docs.schema
