import math
import zlib

import numpy as np

from lodestone.llm import preference as p


def make(n, seed=0):
    rng = np.random.default_rng(seed)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(40)]
        bad = i % 4 == 0
        rows.append((i, " ".join(w + "***" if bad else w for w in words), "xx", i % 4))
        labels.append((i, int(not bad), 0))
    return rows, labels


def test_gradient_matches_numbers():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, p.FEATURES))
    y = (x[:, 0] + 0.3 * rng.normal(size=300) > 0).astype(int)
    model = p.fit(x, y, pairs=3000)
    s = model.strength(x)
    won = (s[y == 1][:, None] > s[y == 0][None, :]).mean()
    assert won > 0.95 and abs(model.weights[0]) == np.abs(model.weights).max()
    assert (model.score(x) >= p.CUT).mean() == (y == 1).mean()
    assert ((0 <= model.score(x)) & (model.score(x) <= 1)).all()


def test_fit_and_score_by_a_plain_version():
    """The loss is written out pair by pair; its slope at the fitted weights is none, and scores follow from the weights."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, p.FEATURES))
    y = (x[:, 1] - x[:, 2] + rng.normal(size=120) > 0).astype(int)
    model = p.fit(x, y, pairs=400)
    z = [[min(8.0, max(-8.0, (v - m) / s)) for v, m, s in zip(row, x.mean(axis=0), x.std(axis=0))] for row in x]
    rng = np.random.default_rng(p.SEED)
    better, worse = rng.choice(np.flatnonzero(y == 1), 400), rng.choice(np.flatnonzero(y == 0), 400)
    pairs = [[a - b for a, b in zip(z[i], z[j])] for i, j in zip(better, worse)]

    def loss(w):
        beaten = [sum(a * b for a, b in zip(d, w)) for d in pairs]
        return sum(math.log1p(math.exp(-v)) for v in beaten) / len(pairs) + p.RIDGE / 2 * sum(v * v for v in w)

    weights = model.weights.tolist()
    for k in range(p.FEATURES):
        up, down = ([v + e * (i == k) for i, v in enumerate(weights)] for e in (1e-4, -1e-4))
        assert abs(loss(up) - loss(down)) / 2e-4 < 1e-5
        assert min(loss(up), loss(down)) >= loss(weights) - 1e-12
    strengths = [sum(a * b for a, b in zip(row, weights)) for row in z]
    order = sorted(strengths)
    threshold = (order[(y == 0).sum() - 1] + order[(y == 0).sum()]) / 2
    for got, s in zip(model.score(x), strengths):
        assert abs(got - 1 / (1 + math.exp(-(s - threshold) / model.spread) * 0.7 / 0.3)) < 1e-9
        assert (got >= p.CUT) == (s >= threshold)


def test_held_out_accuracy_and_inputs(spark):
    rows, labels = make(240)
    rows += [(1000, None, "a", 1), (1001, "", "b", 1), (None, "null id", "c", 1), (5, rows[5][1], "d", 1), (1002, "x" * 300_000, "e", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    marks = spark.createDataFrame(labels + [(5, 1, 0), (None, 0, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    got = p.classify(docs, marks).collect()
    assert len(got) == len(rows)
    right = [r.predicted == labels[r.doc_id][1] for r in got if r.held_out and r.doc_id is not None and r.doc_id < 240]
    assert len(right) > 20 and all(right)
    for r in got:
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1
    assert [r.score for r in got if r.doc_id == 1000] == [r.score for r in got if r.doc_id == 1001]
    flipped = marks.withColumn("quality", __import__("pyspark.sql.functions", fromlist=["expr"]).expr("case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - quality else quality end"))
    assert sorted((r.doc_id or -1, r.score) for r in p.classify(docs, flipped).collect()) == sorted((r.doc_id or -1, r.score) for r in got)


def test_one_class_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    marks = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    assert [r.predicted for r in p.classify(docs, marks).collect()] == [1, 1]
    assert p.classify(docs.limit(0), marks.limit(0)).count() == 0
