import random

import numpy as np
from pyspark.sql import functions as F

from odonto.llm import quality
from odonto.llm.common import is_remainder


def corpus(rng, n):
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(["the", "of", "and"]) if rng.random() < .4 else f"w{rng.randrange(3000)}" for _ in range(rng.randrange(20, 120))]
        good = rng.random() < .7
        rows.append((i, " ".join(words) + "." if good else " ".join(w.upper() + "!!" if i % 2 else w + "###" for w in words)))
        labels.append((i, int(good), 0))
    return rows, labels


def test_held_out_accuracy(spark, docs_of):
    rows, labels = corpus(random.Random(1), 240)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = quality.classify(docs_of(rows), lab, is_remainder(F.col("doc_id"), 4, 2)).collect()
    truth = {i: q for i, q, _ in labels}
    held = [r for r in out if r.held_out]
    assert len(out) == 240 and 30 < len(held) < 90 and all(0 <= r.score <= 1 for r in out)
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > .95
    # Held-out labels are never read: turning them over changes no score.
    turned = spark.createDataFrame([(i, 1 - q if any(r.doc_id == i and r.held_out for r in out) else q, 0) for i, q, _ in labels], "doc_id long, quality int, toxic int")
    again = quality.classify(docs_of(rows), turned, is_remainder(F.col("doc_id"), 4, 2)).collect()
    assert {r.doc_id: round(r.score, 9) for r in again} == {r.doc_id: round(r.score, 9) for r in out}


def test_odd_rows_and_missing_labels(spark, docs_of, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = quality.classify(odd, none, is_remainder(F.col("doc_id"), 4, 2)).collect()
    assert len(rows) == odd.count() and {r.score for r in rows} == {0.5}
    one = spark.createDataFrame([(3, 1, 0), (4, 1, 0), (6, None, 0)], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.classify(odd, one, is_remainder(F.col("doc_id"), 4, 2)).collect()} == {1.0}
    assert quality.classify(empty, none, is_remainder(F.col("doc_id"), 4, 2)).count() == 0


def test_features_approximate_a_gaussian_kernel():
    rng = np.random.default_rng(0)
    d, width = len(quality.STATISTICS), 2.0
    turn = rng.normal(0, 1 / (width * np.sqrt(d)), (d, 20000))
    m = quality.Model(np.zeros(d), np.ones(d), turn, rng.uniform(0, 2 * np.pi, 20000), None, None, None)
    x = rng.normal(0, 1, (6, d))
    z = m.features(x)[:, 1 + d:]
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * width ** 2 * d))
    assert np.abs(z @ z.T - want).max() < .05


def test_isotonic_pools_violators():
    knots, levels = quality.isotonic(np.array([0., 1, 2, 3]), np.ones(4), np.array([0., 1, 0, 1]))
    assert levels.tolist() == [0, 0, .5, .5, 1, 1] and knots.tolist() == [0, 0, 1, 2, 3, 3]
