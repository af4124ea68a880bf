from __future__ import annotations

import zlib

import numpy as np

from flowrill.llm.quality import fit_pairs, fit_quality, keep_good, quality_scores, text_features
from flowrill.llm.queries import QUERIES


def test_ranks_held_out_documents(spark):
    sf_dir = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in QUERIES["op1_quality"](spark, sf_dir).collect()}
    assert len(got) == 10_000
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    right = total = 0
    for row in labels:
        held = zlib.crc32(str(row.doc_id).encode()) % 5 == 0
        assert got[row.doc_id].held_out == held
        assert got[row.doc_id].predicted == int(got[row.doc_id].score >= 0.3)
        if held:
            total += 1
            right += got[row.doc_id].predicted == row.quality
    assert total > 500 and right / total > 0.97


def test_held_out_labels_are_not_learned(spark, make_docs):
    docs = make_docs(*[(i, "LOUD!! WORDS!!" if i % 2 else "some quiet words.") for i in range(60)])
    rows = [(i, 1 - i % 2) for i in range(60)]
    flipped = [(i, q if zlib.crc32(str(i).encode()) % 5 else 1 - q) for i, q in rows]
    a, b = (fit_quality(docs, spark.createDataFrame(x, "doc_id long, quality int")) for x in (rows, flipped))
    assert np.array_equal(a.weights, b.weights) and a.threshold == b.threshold


def test_pairs_recover_an_order():
    rng = np.random.default_rng(3)
    features = rng.normal(size=(800, 4))
    label = (features @ [2.0, -1.0, 0.0, 0.5] + rng.logistic(size=800) > 0.8).astype(int)
    model = fit_pairs(features, label)
    strength = features @ [2.0, -1.0, 0.0, 0.5]
    assert np.corrcoef(strength, np.log(model.scores(features) / (1 - model.scores(features))))[0, 1] > 0.98
    assert abs((model.scores(features) >= 0.3).mean() - label.mean()) < 0.01


def test_weights_are_those_of_another_optimiser():
    """Every row meets rows of the other label in turn; small steps uphill on the pairs' loss."""
    rng = np.random.default_rng(8)
    features = rng.normal(size=(60, 3)) * [1, 10, 0.1] + 5
    label = (features[:, 0] + rng.normal(size=60) > 5.3).astype(int)
    model = fit_pairs(features, label, pairs_each=4, penalty=1.0)
    standard = (features - features.mean(axis=0)) / features.std(axis=0)
    one, zero = np.flatnonzero(label), np.flatnonzero(label == 0)
    few, many = sorted((one, zero), key=len)
    step = 1 + len(few) // 4
    pairs = [(many[t % len(many)], few[(t + j * step) % len(few)]) for j in range(4) for t in range(len(many))]
    better, worse = zip(*[(a, b) if label[a] else (b, a) for a, b in pairs])
    difference, weights = standard[list(better)] - standard[list(worse)], np.zeros(3)
    for _ in range(20_000):
        p = 1 / (1 + np.exp(-difference @ weights))
        weights += 0.002 * (difference.T @ (1 - p) - weights)
    assert np.allclose(model.weights, weights, atol=1e-6)
    assert model.threshold == np.quantile(standard @ weights, len(zero) / 60) or np.isclose(
        model.threshold, np.quantile(standard @ weights, len(zero) / 60), atol=1e-5
    )


def test_a_null_id_is_held_out(spark, messy):
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    rows = quality_scores(messy, labels).collect()
    assert {r.held_out for r in rows if r.doc_id is None} == {True} and all(r.held_out is not None for r in rows)


def test_odd_rows(spark, messy, make_docs):
    for rows in ([], [(1, 1)], [(1, 1), (2, 0), (3, None), (None, 1), (99, 0), (1, 1), (5, 0)]):
        labels = spark.createDataFrame(rows, "doc_id long, quality int")
        got = quality_scores(messy, labels).collect()
        assert len(got) == messy.count()
        assert all(0 <= r.score <= 1 for r in got)
        kept = keep_good(messy, labels)
        assert kept.columns == messy.columns
        assert kept.count() == sum(r.predicted for r in got)
    assert quality_scores(make_docs(), labels).count() == 0
    assert len(text_features("")) == len(text_features("x"))
