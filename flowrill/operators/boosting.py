"""Trees fitted level by level from histograms: second-order boosting, and a decision tree.

Features are cut into bins once. A level of all trees of a round is one aggregate: sums per tree,
node, feature and bin, made of arrays in a task and then added up, whose result has a fixed number of
rows and decides the splits. Rows are never sorted, collected or moved to a node; where a row is follows from the trees.

Missing values are in the first bin. Equal gains go to the first feature and bin. Nodes without a
gain stay leaves.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from flowrill.session import delete_path, shared_dir

BINS = 32


@dataclass
class Node:
    """An inner node sends rows with ``bin <= cut`` of its feature to the left; a leaf has a value."""

    value: float | int = 0.0
    feature: int = -1
    cut: int = 0
    left: int = -1
    right: int = -1


Tree = list[Node]


def bin_edges(rows: DataFrame, features: list[str], bins: int = BINS) -> list[list[float]]:
    """At most ``bins - 1`` edges of each feature, by quantiles; bin i is above i edges."""
    shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    row = rows.agg(*[F.percentile_approx(F.col(f).cast("double"), shares, 10_000).alias(f"q{i}") for i, f in enumerate(features)])
    return [sorted({float(q) for q in (found or []) if math.isfinite(q)}) for found in row.first()]


def binned(rows: DataFrame, features: list[str], edges: list[list[float]], *keep: str) -> DataFrame:
    """The kept columns and ``bins``, the bin of every feature."""

    def number(name: str, own: list[float]) -> Column:
        value = F.col(name).cast("double")
        return F.size(F.filter(F.array(*[F.lit(e) for e in own]), lambda e: e < value)) if own else F.lit(0)

    numbers = [number(f, own) for f, own in zip(features, edges)]
    return rows.select(*keep, F.array(*[F.coalesce(n, F.lit(0)).cast("int") for n in numbers]).alias("bins"))


def tree_sql(tree: Tree, shown, at: int = 0) -> str:
    """SQL over ``bins``: what ``shown`` says of the node a row ends in."""
    node = tree[at]
    if node.feature < 0:
        return shown(at, node)
    left, right = (tree_sql(tree, shown, child) for child in (node.left, node.right))
    return f"(CASE WHEN bins[{node.feature}] <= {node.cut} THEN {left} ELSE {right} END)"


def _value(at: int, node: Node) -> str:
    return f"{node.value!r}D" if isinstance(node.value, float) else str(node.value)


def _open(nodes: set[int]):
    return lambda at, node: str(at) if at in nodes else "-1"


def _sums(keys: np.ndarray, values: np.ndarray, n_bins: int) -> np.ndarray:
    """Values by feature and bin; ``keys`` has feature and bin of each row of values."""
    out = np.zeros((int(keys[:, 0].max()) + 1, n_bins, values.shape[1]))
    out[keys[:, 0], keys[:, 1]] = values
    return out


_HISTOGRAM = "k int, node int, feature int, bin int, g double, h double"


class _Histogram:
    """Sums of slopes and curvatures by tree, open node, feature and bin."""

    def __init__(self, trees: list[Tree], fringe: list[set[int]], n_features: int, n_bins: int):
        self.n_features, self.n_bins, self.shapes = n_features, n_bins, []
        for tree, nodes in zip(trees, fringe):
            place = np.full(len(tree), -1)
            place[sorted(nodes)] = np.arange(len(nodes))
            self.shapes.append((_arrays(tree), place, sorted(nodes)))
        self.totals = [np.zeros((3, len(nodes) * n_features * n_bins)) for *_, nodes in self.shapes]

    def add(self, bins: np.ndarray, g: np.ndarray, h: np.ndarray) -> None:
        """Rows by their bins (rows x features), slopes and curvatures (rows x trees)."""
        cells = self.n_features * self.n_bins
        for k, (arrays, place, nodes) in enumerate(self.shapes):
            if not nodes:
                continue
            at = place[_node_of(arrays, bins)]
            own = np.flatnonzero(at >= 0)
            base, total = at[own] * cells, self.totals[k]
            weights = g[own, k], h[own, k]
            for f in range(self.n_features):
                cell = base + f * self.n_bins + bins[own, f]
                for i, values in enumerate((None, *weights)):
                    total[i] += np.bincount(cell, values, total.shape[1])

    def batches(self):
        """Rows of ``_HISTOGRAM``, for cells that hold rows."""
        cells, n_bins = self.n_features * self.n_bins, self.n_bins
        for k, (*_, nodes) in enumerate(self.shapes):
            met = np.flatnonzero(self.totals[k][0])
            columns = [np.full(len(met), k), np.array(nodes, int)[met // cells], met % cells // n_bins, met % n_bins]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int32()) for c in columns), *(pa.array(t[met]) for t in self.totals[k][1:])],
                ["k", "node", "feature", "bin", "g", "h"],
            )


def _arrays(tree: Tree) -> list[np.ndarray]:
    return [np.array([getattr(n, name) for n in tree]) for name in ("feature", "cut", "left", "right")]


def _node_of(arrays: list[np.ndarray], bins: np.ndarray) -> np.ndarray:
    """The node each row is in."""
    feature, cut, left, right = arrays
    at, row = np.zeros(len(bins), int), np.arange(len(bins))
    while (feature[at] >= 0).any():
        below = bins[row, np.maximum(feature[at], 0)] <= cut[at]
        at = np.where(feature[at] >= 0, np.where(below, left[at], right[at]), at)
    return at


def _histograms(trees: list[Tree], fringe: list[set[int]], n_features: int, n_bins: int):
    """For mapInArrow over ``bins, g, h``: a task's sums by tree, open node, feature and bin."""

    def sums(batches):
        found = _Histogram(trees, fringe, n_features, n_bins)
        for batch in batches:
            if not batch.num_rows:
                continue
            bins = batch.column("bins").flatten().to_numpy().reshape(batch.num_rows, n_features)
            g, h = (
                pc.fill_null(batch.column(name).flatten(), 0.0).to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                for name in ("g", "h")
            )
            found.add(bins, g, h)
        yield from found.batches()

    return sums


# Rows are stored in blocks of few rows, whose readers hold thousands of them: the bins, the classes
# and the margins as bytes. An Arrow column of such blocks is one array of all their rows.
_BLOCK_ROWS = 128
_ROWS_AT_ONCE = 1 << 16
_UNKNOWN = -(2**31)  # in place of a null class
_BLOCKS = "bins binary, label binary, margin binary"


def _bin_type(n_bins: int) -> np.dtype:
    return np.min_scalar_type(max(n_bins - 1, 0))


def _blocks(n_features: int, n_bins: int, outputs: int):
    """For mapInArrow over ``label, bins``: blocks of rows with margins of 0."""

    def pack(batches):
        for batch in batches:
            if batch.num_rows:
                bins = batch.column("bins").flatten().to_numpy().reshape(batch.num_rows, n_features)
                label = pc.fill_null(batch.column("label"), _UNKNOWN).to_numpy(zero_copy_only=False)
                yield _packed(bins.astype(_bin_type(n_bins)), label.astype(np.int32), np.zeros((len(label), outputs)))

    return pack


def _packed(bins: np.ndarray, label: np.ndarray, margin: np.ndarray) -> pa.RecordBatch:
    bounds = np.append(np.arange(0, len(label), _BLOCK_ROWS), len(label))

    def column(values: np.ndarray) -> pa.Array:
        offsets = (bounds * (values.nbytes // len(label))).astype(np.int32)
        buffers = [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))]
        return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, buffers)

    return pa.RecordBatch.from_arrays([column(x) for x in (bins, label, margin)], ["bins", "label", "margin"])


def _unpacked(batches, n_features: int, n_bins: int):
    """(bins, classes, margins) of the rows in blocks, some at a time."""

    def values(column: pa.Array, kind) -> np.ndarray:
        _, offsets, data = column.buffers()
        places = np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(column.type) else np.int32)
        first, last = places[column.offset], places[column.offset + len(column)]
        return np.frombuffer(data, np.uint8)[first:last].view(kind)

    for batch in batches:
        if not batch.num_rows:
            continue
        label = values(batch.column("label"), np.int32)
        bins = values(batch.column("bins"), _bin_type(n_bins)).reshape(len(label), n_features)
        margin = values(batch.column("margin"), float).reshape(len(label), -1)
        for at in range(0, len(label), _ROWS_AT_ONCE):
            rows = slice(at, at + _ROWS_AT_ONCE)
            yield bins[rows], label[rows], margin[rows]


def _raised_margins(trees: list[Tree], n_features: int, n_bins: int, rate: float):
    """For mapInArrow over blocks: the blocks with a round's trees added to the margins."""

    def raise_(batches):
        shapes = [(_arrays(t), np.array([n.value for n in t])) for t in trees]
        for bins, label, margin in _unpacked(batches, n_features, n_bins):
            grown = [margin[:, k] + (0.0 + rate * value[_node_of(arrays, bins)]) for k, (arrays, value) in enumerate(shapes)]
            yield _packed(bins, label, np.stack(grown, axis=1))

    return raise_


def _slopes(label: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slope and curvature of the logistic loss by each margin; an unknown class has no slope."""
    if margin.shape[1] == 1:
        share, wanted = 1 / (1 + np.exp(-margin)), label[:, None]
    else:
        raised = np.exp(margin - margin.max(axis=1, keepdims=True))
        share = raised / raised.sum(axis=1, keepdims=True)
        wanted = label[:, None] == np.arange(margin.shape[1])
    return np.where(label[:, None] == _UNKNOWN, 0.0, share - wanted), share * (1 - share)


def _block_histograms(trees: list[Tree], fringe: list[set[int]], n_features: int, n_bins: int):
    """:func:`_histograms` over blocks."""

    def sums(batches):
        found = _Histogram(trees, fringe, n_features, n_bins)
        for bins, label, margin in _unpacked(batches, n_features, n_bins):
            with np.errstate(over="ignore"):
                found.add(bins, *_slopes(label, margin))
        yield from found.batches()

    return sums


@dataclass
class BoostedTrees:
    """Summed trees per class (one for two classes), each round's leaves weighed by ``rate``."""

    features: list[str]
    edges: list[list[float]]
    n_classes: int
    rate: float
    rounds: list[list[Tree]] = field(default_factory=list)

    def margins(self, rounds: list[list[Tree]], k: int) -> str:
        return " + ".join(["0.0D", *(f"{self.rate!r}D * {tree_sql(r[k], _value)}" for r in rounds)])

    def predict(self, rows: DataFrame, *keep: str) -> DataFrame:
        """The kept columns and ``prediction``, the class number; of equal margins the first."""
        table = binned(rows, self.features, self.edges, *keep)
        if self.n_classes == 2:
            label = F.when(F.expr(self.margins(self.rounds, 0)) > 0, 1).otherwise(0)
        else:
            margins = F.array(*[F.expr(self.margins(self.rounds, k)) for k in range(self.n_classes)])
            label = F.array_position(margins, F.array_max(margins)).cast("int") - 1
        return table.select(*keep, label.alias("prediction"))

    def to_json(self) -> str:
        return json.dumps({**vars(self), "rounds": [[[vars(n) for n in t] for t in r] for r in self.rounds]})

    @classmethod
    def from_json(cls, text: str) -> BoostedTrees:
        found = json.loads(text)
        rounds = [[[Node(**n) for n in t] for t in r] for r in found.pop("rounds")]
        return cls(**found, rounds=rounds)


def best_split(sums: np.ndarray, penalty: float, least: float):
    """``(gain, feature, cut, left sums, right sums)`` of slopes and curvatures by feature and bin."""
    upto = np.cumsum(sums, axis=1)
    whole = upto[:, -1:, :]
    rest = whole - upto
    score = lambda s: s[..., 0] ** 2 / (s[..., 1] + penalty)
    gain = score(upto) + score(rest) - score(whole)
    gain[(upto[..., 1] < least) | (rest[..., 1] < least)] = -np.inf
    feature, cut = np.unravel_index(int(np.argmax(gain)), gain.shape)
    return gain[feature, cut], int(feature), int(cut), upto[feature, cut], rest[feature, cut]


def fit_boosted(
    train: DataFrame, features: list[str], label: str, n_classes: int = 2, rounds: int = 100, depth: int = 3,
    rate: float = 0.1, penalty: float = 1.0, least: float = 1.0, bins: int = BINS,
) -> BoostedTrees:
    """Newton boosting of the logistic loss: a tree per class and round (one for two classes).

    A leaf weighs -G / (H + ``penalty``) of its rows' slopes G and curvatures H, a split must leave
    ``least`` of H on either side. Classes are numbered from 0. All classes share one histogram a
    level. A round takes ``depth`` jobs and one that stores the rows' margins, so that plans stay small.
    Rows are stored in blocks, a byte for each bin, which arrays are made of without a step per row.
    """
    spark = train.sparkSession
    edges = bin_edges(train, features, bins)
    model = BoostedTrees(features, edges, n_classes, rate)
    outputs = 1 if n_classes == 2 else n_classes
    rows = binned(train.withColumn("label", F.col(label).cast("int")), features, edges, "label")
    table = rows.mapInArrow(_blocks(len(features), bins, outputs), _BLOCKS)
    path, trees = None, None
    for _ in range(rounds):
        old, path = path, shared_dir(spark, "margins")
        if trees is not None:
            table = table.mapInArrow(_raised_margins(trees, len(features), bins, rate), _BLOCKS)
        table.write.parquet(path, compression="zstd")
        table = spark.read.schema(_BLOCKS).parquet(path)
        if old is not None:
            delete_path(spark, old)
        trees = [[Node()] for _ in range(outputs)]
        fringe = [{0} for _ in range(outputs)]
        for _ in range(depth):
            found = (
                table.mapInArrow(_block_histograms(trees, fringe, len(features), bins), _HISTOGRAM)
                .groupBy("k", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            )  # at most outputs x nodes x features x bins rows
            keys = np.array([r[:4] for r in found], int).reshape(-1, 4)
            values = np.array([r[4:] for r in found], float).reshape(-1, 2)
            for k, tree in enumerate(trees):
                next_fringe = set()
                for at in sorted(fringe[k]):
                    own = (keys[:, 0] == k) & (keys[:, 1] == at)
                    if not own.any():
                        continue
                    sums = _sums(keys[own][:, 2:], values[own], bins)
                    if at == 0:
                        g, h = sums[0].sum(axis=0)
                        tree[0].value = float(-g / (h + penalty))
                    gain, feature, cut, left, right = best_split(sums, penalty, least)
                    if gain > 1e-9:
                        tree[at].feature, tree[at].cut = feature, cut
                        tree[at].left, tree[at].right = len(tree), len(tree) + 1
                        tree += [Node(float(-s[0] / (s[1] + penalty))) for s in (left, right)]
                        next_fringe |= {len(tree) - 2, len(tree) - 1}
                fringe[k] = next_fringe
            if not any(fringe):
                break
        model.rounds.append(trees)
    if path is not None:
        delete_path(spark, path)
    return model


@dataclass
class DecisionTree:
    features: list[str]
    edges: list[list[float]]
    tree: Tree

    def predict(self, rows: DataFrame, *keep: str) -> DataFrame:
        """The kept columns and ``prediction``, the class number."""
        return binned(rows, self.features, self.edges, *keep).select(*keep, F.expr(tree_sql(self.tree, _value)).alias("prediction"))


def fit_tree(
    train: DataFrame, features: list[str], label: str, n_classes: int = 2, depth: int = 5, min_split: int = 10, bins: int = BINS
) -> DecisionTree:
    """A tree by Gini impurity. A node of less than ``min_split`` rows is not split, its children may
    have any number of rows."""
    edges = bin_edges(train, features, bins)
    path = shared_dir(train.sparkSession, "binned")
    binned(train.withColumn("label", F.col(label).cast("int")), features, edges, "label").write.parquet(path)
    table = train.sparkSession.read.parquet(path)
    tree: Tree = [Node(0)]
    fringe = {0}
    cells = F.array(*[F.struct(F.lit(i).alias("feature"), F.col("bins")[i].alias("bin")) for i in range(len(features))])
    for level in range(depth):
        found = (
            table.select("label", F.expr(tree_sql(tree, _open(fringe))).alias("node"), F.inline(cells)).where("node >= 0")
            .groupBy("node", "feature", "bin", "label").agg(F.count(F.lit(1)).alias("n")).collect()
        )  # at most nodes x features x bins x classes rows
        rows = np.array([tuple(r) for r in found], int).reshape(-1, 5)
        next_fringe = set()
        for at in sorted(fringe):
            own = rows[rows[:, 0] == at]
            if not len(own):
                continue
            counts = np.zeros((len(features), bins, n_classes))
            counts[own[:, 1], own[:, 2], own[:, 3]] = own[:, 4]
            whole = counts[0].sum(axis=0)
            tree[at].value = int(np.argmax(whole))
            if whole.sum() < min_split:
                continue
            upto = np.cumsum(counts, axis=1)
            rest = whole - upto
            pure = lambda c: (c**2).sum(axis=-1) / np.maximum(c.sum(axis=-1), 1)
            gain = pure(upto) + pure(rest) - pure(whole)
            gain[(upto.sum(axis=-1) == 0) | (rest.sum(axis=-1) == 0)] = -np.inf
            feature, cut = np.unravel_index(int(np.argmax(gain)), gain.shape)
            if gain[feature, cut] > 1e-9:
                tree[at].feature, tree[at].cut, tree[at].left, tree[at].right = int(feature), int(cut), len(tree), len(tree) + 1
                tree += [Node(int(np.argmax(c[feature, cut]))) for c in (upto, rest)]
                next_fringe |= {len(tree) - 2, len(tree) - 1}
        fringe = next_fringe
        if not fringe:
            break
    delete_path(train.sparkSession, path)
    return DecisionTree(features, edges, tree)
