"""Nearest neighbours against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowrill.operators import neighbours


def _data(spark, n, m, seed, duplicates):
    rng = np.random.default_rng(seed)
    points = rng.normal(size=(n, 3)).round(1 if duplicates else 6)
    if duplicates:
        points[: n // 3] = points[0]  # a third of all points are copies
    labels = rng.choice(["BENIGN", "DoS", "PortScan"], n)
    queries = np.vstack([rng.normal(size=(m - 3, 3)).round(1 if duplicates else 6), points[:2], [[9.0, 9.0, 9.0]]])
    columns = ["flow_id", "label", "a", "b", "c"]
    train = spark.createDataFrame([(f"t{i:05d}", str(labels[i]), *map(float, p)) for i, p in enumerate(points)], columns)
    test = spark.createDataFrame([(f"q{i:05d}", "?", *map(float, q)) for i, q in enumerate(queries)], columns)
    return points, labels, queries, train, test


def _brute(points, labels, queries, k):
    found, votes = {}, {}
    for i, q in enumerate(queries):
        square = np.zeros(len(points))
        for d in range(3):
            square += (q[d] - points[:, d]) ** 2
        distance = np.sqrt(square)
        best = np.lexsort((np.arange(len(points)), distance))[:k]
        found[f"q{i:05d}"] = [f"t{b:05d}" for b in best]
        weights = {}
        zero = (distance[best] == 0).any()
        for b in best:
            w = float(distance[b] == 0) if zero else 1.0 / distance[b]
            weights[labels[b]] = weights.get(labels[b], 0.0) + w
        votes[f"q{i:05d}"] = min(weights, key=lambda c: (-weights[c], c))
    return found, votes


@pytest.mark.parametrize("duplicates", [False, True])
def test_equal_to_brute_force_with_many_leaves_and_blocks(spark, monkeypatch, duplicates):
    monkeypatch.setattr(neighbours, "POINTS_PER_BLOCK", 40)
    monkeypatch.setattr(neighbours, "QUERIES_PER_BLOCK", 25)
    monkeypatch.setattr(neighbours, "SAMPLE_ROWS", 60)
    monkeypatch.setattr(neighbours, "MAX_LEAVES", 5)
    points, labels, queries, train, test = _data(spark, 500, 80, 7, duplicates)
    found, votes = _brute(points, labels, queries, 5)
    near = neighbours.nearest(train, test, ["a", "b", "c"], "label", "flow_id", 5)
    ours = {
        r["q_key"]: [x["p_key"] for x in sorted(r["n"])]
        for r in near.groupBy("q_key").agg(F.collect_list(F.struct("distance", "p_key")).alias("n")).collect()
    }
    assert ours == found
    predicted = {r["q_key"]: r["prediction"] for r in neighbours.vote(near).collect()}
    assert predicted == votes


def test_fewer_points_than_neighbours(spark):
    points, labels, queries, train, test = _data(spark, 3, 5, 1, False)
    predicted = {r["flow_id"]: r["prediction"] for r in neighbours.knn_classify(train, test, ["a", "b", "c"]).collect()}
    assert predicted == _brute(points, labels, queries, 5)[1]


def test_blocks_send_nothing_beyond_the_bound_and_nothing_stays_cached(spark):
    points, _, queries, train, test = _data(spark, 60, 6, 3, False)
    cached = set(spark.sparkContext._jsc.getPersistentRDDs())
    neighbours.nearest(train, test, ["a", "b", "c"], "label", "flow_id", 5).collect()
    assert set(spark.sparkContext._jsc.getPersistentRDDs()) <= cached
    known = train.selectExpr("flow_id as p_key", "label as p_label", "array(a, b, c) as p_x").toPandas()
    asked = test.selectExpr("flow_id as q_key", "array(a, b, c) as q_x").toPandas()
    asked["bound"] = 0.5
    found = neighbours._block_search(5)(asked, known)
    within = np.sqrt(((queries[:, None] - points[None]) ** 2).sum(axis=2)) <= 0.5
    assert found["distance"].max() <= 0.5
    assert dict(found.groupby("q_key").size()) == {f"q{i:05d}": min(5, n) for i, n in enumerate(within.sum(axis=1)) if n}


def test_first_of_a_row_settles_ties_by_column_and_puts_nan_last():
    square = np.array([[2.0, 1.0, 1.0, 1.0], [np.nan, 3.0, np.nan, np.nan], [0.0, 0.0, 0.0, 5.0]])
    for k in (1, 2, 3, 4, 5):
        row, column = neighbours._first(square, k)
        best = np.argsort(square, axis=1, kind="stable")[:, :k]
        assert column.tolist() == best.ravel().tolist()
        assert row.tolist() == np.repeat(np.arange(3), best.shape[1]).tolist()


def test_candidates_hold_the_nearest_and_few_others():
    rng = np.random.default_rng(5)
    for known in (rng.normal(size=(1000, 4)) + 1e4, rng.integers(0, 3, (1000, 4)).astype(float)):
        asked, bounds = known[:200] + 0.01, np.full(200, np.inf)
        bounds[::2] = 0.5
        known[3] = np.nan
        square = np.zeros((200, 1000))
        for d in range(4):
            square += (asked[:, d, None] - known[:, d]) ** 2
        row, column, found = neighbours._nearest_rows(asked, bounds, known, 5)
        for i in range(200):
            best = [j for j in np.argsort(square[i], kind="stable")[:5] if not np.sqrt(square[i, j]) > bounds[i]]
            ours = [j for j in column[row == i] if not np.sqrt(square[i, j]) > bounds[i] and j != 3]
            assert ours == [j for j in best if j != 3]
        assert np.array_equal(found, square[row, column], equal_nan=True)
    row, _ = neighbours._candidates(rng.normal(size=(50, 4)), np.full(50, np.inf), rng.normal(size=(4096, 4)), 5)
    assert len(row) < 50 * 100  # of 4,096 points each
