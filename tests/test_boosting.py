"""Histogram trees equal versions that look at every row of every node."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from flowrill.operators import boosting
from flowrill.operators.boosting import BoostedTrees, bin_edges, binned, fit_boosted, fit_tree

FEATURES = ["x0", "x1", "x2"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(11)
    x = np.round(rng.normal(size=(400, 3)), 2)
    label = (x[:, 0] + x[:, 1] ** 2 + 0.3 * rng.normal(size=400) > 0.8).astype(int) + (x[:, 2] > 0.9)
    rows = [(i, *map(float, r), int(c)) for i, (r, c) in enumerate(zip(x, label))]
    rows += [(400, None, 0.5, float("inf"), 0), (401, float("nan"), -0.5, -1.0, 1)]
    return spark.createDataFrame(rows, "id int, x0 double, x1 double, x2 double, label_code int").cache()


def bins_of(table, edges):
    rows = sorted((r.id, r.label_code, r.bins) for r in binned(table, FEATURES, edges, "id", "label_code").collect())
    return np.array([b for _, _, b in rows]), np.array([c for _, c, _ in rows])


def where(tree, x, at=0):
    node = tree[at]
    return node if node.feature < 0 else where(tree, x, node.left if x[node.feature] <= node.cut else node.right)


def brute_boost(x, g, h, depth, penalty, least):
    """A tree as nested tuples (feature, cut, left, right) with leaf weights, all cuts tried."""
    weight = -g.sum() / (h.sum() + penalty)
    best = (1e-9, None)
    if depth:
        score = lambda m: g[m].sum() ** 2 / (h[m].sum() + penalty)
        for f in range(x.shape[1]):
            for cut in range(32):
                left = x[:, f] <= cut
                if h[left].sum() >= least and h[~left].sum() >= least:
                    gain = score(left) + score(~left) - score(np.ones(len(g), bool))
                    if gain > best[0] + 1e-9:
                        best = (gain, (f, cut))
    if best[1] is None:
        return float(weight)
    f, cut = best[1]
    left = x[:, f] <= cut
    return (f, cut, brute_boost(x[left], g[left], h[left], depth - 1, penalty, least), brute_boost(x[~left], g[~left], h[~left], depth - 1, penalty, least))


def nested(tree, at=0):
    node = tree[at]
    return node.value if node.feature < 0 else (node.feature, node.cut, nested(tree, node.left), nested(tree, node.right))


def same(a, b):
    if isinstance(a, tuple):
        return isinstance(b, tuple) and a[:2] == b[:2] and same(a[2], b[2]) and same(a[3], b[3])
    return a == pytest.approx(b, abs=1e-9)


def value(tree, x):
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


@pytest.mark.parametrize("n_classes", [2, 3])
def test_splits_and_leaf_weights_equal_brute_force(table, n_classes):
    rows = table.where(f"label_code < {n_classes}")
    model = fit_boosted(rows, FEATURES, "label_code", n_classes, rounds=5, depth=3)
    x, y = bins_of(rows, model.edges)
    outputs = 1 if n_classes == 2 else n_classes
    margin = np.zeros((len(y), outputs))
    for trees in model.rounds:
        if n_classes == 2:
            p = 1 / (1 + np.exp(-margin[:, 0]))
            slopes = [(p - y, p * (1 - p))]
        else:
            e = np.exp(margin - margin.max(axis=1, keepdims=True))
            p = e / e.sum(axis=1, keepdims=True)
            slopes = [(p[:, k] - (y == k), p[:, k] * (1 - p[:, k])) for k in range(outputs)]
        for k, (g, h) in enumerate(slopes):
            expected = brute_boost(x, g, h, 3, 1.0, 1.0)
            assert same(nested(trees[k]), expected)
            margin[:, k] += 0.1 * np.array([value(expected, row) for row in x])
    wanted = (margin[:, 0] > 0).astype(int) if n_classes == 2 else margin.argmax(axis=1)
    again = BoostedTrees.from_json(model.to_json())
    for one in (model, again):
        assert [r.prediction for r in sorted(one.predict(rows, "id").collect())] == wanted.tolist()
    assert (wanted == y).mean() > 0.7


def brute_tree(x, y, depth, min_split, n_classes):
    counts = np.bincount(y, minlength=n_classes)
    best = (1e-9, None)
    if depth and len(y) >= min_split:
        pure = lambda m: (np.bincount(y[m], minlength=n_classes) ** 2).sum() / m.sum()
        for f in range(x.shape[1]):
            for cut in range(32):
                left = x[:, f] <= cut
                if left.any() and not left.all():
                    gain = pure(left) + pure(~left) - pure(np.ones(len(y), bool))
                    if gain > best[0] + 1e-9:
                        best = (gain, (f, cut))
    if best[1] is None:
        return int(counts.argmax())
    f, cut = best[1]
    left = x[:, f] <= cut
    return (f, cut, brute_tree(x[left], y[left], depth - 1, min_split, n_classes), brute_tree(x[~left], y[~left], depth - 1, min_split, n_classes))


def test_decision_tree_splits_from_ten_rows_on(table):
    for min_split in (10, 60):
        model = fit_tree(table, FEATURES, "label_code", 3, min_split=min_split)
        x, y = bins_of(table, model.edges)
        expected = brute_tree(x, y, 5, min_split, 3)
        assert nested(model.tree) == expected
        assert [r.prediction for r in sorted(model.predict(table, "id").collect())] == [value(expected, r) for r in x]


def test_constant_and_empty_inputs(table):
    one = fit_boosted(table.where("label_code = 0").limit(20), ["x0"], "label_code", rounds=2)
    assert {r.prediction for r in one.predict(table, "id").collect()} == {0}
    assert bin_edges(table.limit(0), FEATURES) == [[], [], []]
    empty = fit_boosted(table.limit(0), FEATURES, "label_code", rounds=1)
    assert {r.prediction for r in empty.predict(table, "id").collect()} == {0}


def test_a_task_sums_a_level_of_all_trees_in_arrays():
    rng = np.random.default_rng(7)
    n, features, n_bins = 500, 3, 4
    bins, g, h = rng.integers(0, n_bins, (n, features)), rng.normal(size=(n, 2)), rng.random((n, 2))
    split = [boosting.Node(0.0, 1, 2, 1, 2), boosting.Node(0.0), boosting.Node(0.0)]
    batch = pa.RecordBatch.from_pydict({
        "bins": pa.array(bins.tolist(), pa.list_(pa.int32())),
        "g": pa.array([[None, r[1]] if i == 0 else list(r) for i, r in enumerate(g)], pa.list_(pa.float64())),
        "h": pa.array(h.tolist(), pa.list_(pa.float64())),
    })
    g[0, 0] = 0.0  # a null slope counts as none
    wanted = {}
    for i in range(n):
        for k, node in ((0, 0), (1, 1 if bins[i, 1] <= 2 else 2)):
            for f in range(features):
                if (k, node) != (1, 1):  # a closed node
                    at = wanted.setdefault((k, node, f, int(bins[i, f])), [0.0, 0.0])
                    at[0] += g[i, k]
                    at[1] += h[i, k]
    parts = [batch.slice(0, 200), batch.slice(200, 0), batch.slice(200)]
    sums = boosting._histograms([[boosting.Node()], split], [{0}, {2}], features, n_bins)
    found = {tuple(r.values())[:4]: tuple(r.values())[4:] for out in sums(iter(parts)) for r in out.to_pylist()}
    assert found.keys() == wanted.keys()
    assert all(np.allclose(found[key], wanted[key]) for key in wanted)


@pytest.mark.parametrize(("features", "n_bins"), [(3, 300), (10, 32)])
def test_blocks_hold_rows_with_their_margins_and_give_the_same_sums(features, n_bins):
    rng = np.random.default_rng(3)
    n, outputs = 1000, 2
    bins, label = rng.integers(0, n_bins, (n, features)), rng.integers(0, outputs, n).tolist()
    label[5] = None
    batch = pa.RecordBatch.from_pydict({"bins": pa.array(bins.tolist(), pa.list_(pa.int32())), "label": pa.array(label, pa.int32())})
    blocks = list(boosting._blocks(features, n_bins, outputs)(iter([batch.slice(0, 0), batch])))
    assert [b.num_rows for b in blocks] == [-(-n // boosting._BLOCK_ROWS)]  # no step per row later
    split = [boosting.Node(0.0, 1, n_bins // 2, 1, 2), boosting.Node(0.5), boosting.Node(-0.25)]
    trees = [split, [boosting.Node(0.125)]]
    raised = list(boosting._raised_margins(trees, features, n_bins, 0.1)(iter(blocks)))
    (found, classes, margin), = boosting._unpacked([raised[0]], features, n_bins)
    assert np.array_equal(found, bins) and classes[5] == boosting._UNKNOWN
    assert np.allclose(margin, np.stack([0.1 * np.where(bins[:, 1] <= n_bins // 2, 0.5, -0.25), np.full(n, 0.0125)], axis=1))
    g, h = boosting._slopes(classes, margin)
    assert not g[5].any() and h[5].all()
    plain = pa.RecordBatch.from_pydict({
        "bins": batch.column("bins"), "g": pa.array(g.tolist(), pa.list_(pa.float64())), "h": pa.array(h.tolist(), pa.list_(pa.float64())),
    })
    shown = lambda sums, rows: [r for out in sums(trees, [{1, 2}, {0}], features, n_bins)(iter(rows)) for r in out.to_pylist()]
    ours, wanted = shown(boosting._block_histograms, [raised[0].slice(0, 3), raised[0].slice(3)]), shown(boosting._histograms, [plain])
    assert [list(r.values())[:4] for r in ours] == [list(r.values())[:4] for r in wanted]
    assert np.allclose([list(r.values())[4:] for r in ours], [list(r.values())[4:] for r in wanted])
