"""Exact k-nearest-neighbour classification without comparing everything with everything.

Training points are divided into leaves by a small tree built from a bounded sample; any division
gives exact results. A query is first answered inside its own leaf, which bounds how far its true
neighbours can be. It then visits only the leaves whose bounding box lies within that bound. Leaves
are processed in blocks of bounded size, so neither a crowded leaf nor a popular region ever ends up
in one task, and a block emits at most k candidates per query instead of pairs, none beyond the bound.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from flowrill.functions.hashing import seeded_digest
from flowrill.session import delete_path, shared_dir

# Executors get the block functions by value, whether or not this package is installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SAMPLE_ROWS = 20_000
MAX_LEAVES = 1024
POINTS_PER_BLOCK = 4096
# The points of a leaf are sent once for each block of the queries that visit it.
QUERIES_PER_BLOCK = 16_384
# Groups of a block's points whose minima bound the k-th distance.
POINT_GROUPS = 64
_CANDIDATE = "q_key string, distance double, p_key string, p_label string"


def _split_tree(sample: np.ndarray, leaves: int) -> list[tuple[int, float, int, int]]:
    """Nodes (dimension, value, left, right); a leaf has dimension -1 and its number as left."""
    nodes: list[tuple[int, float, int, int]] = []
    numbered = 0

    def grow(points: np.ndarray, share: int) -> int:
        nonlocal numbered
        spot = len(nodes)
        nodes.append((-1, 0.0, 0, 0))
        if share > 1 and len(points) > 1:
            dimension = int(np.argmax(points.max(axis=0) - points.min(axis=0)))
            value = float(np.median(points[:, dimension]))
            below = points[:, dimension] <= value
            if below.any() and not below.all():
                left = grow(points[below], share // 2)
                right = grow(points[~below], share - share // 2)
                nodes[spot] = (dimension, value, left, right)
                return spot
        nodes[spot] = (-1, 0.0, numbered, 0)
        numbered += 1
        return spot

    grow(sample, leaves)
    return nodes


def _leaf_of(nodes: list[tuple[int, float, int, int]]):
    dimension = np.array([n[0] for n in nodes])
    value = np.array([n[1] for n in nodes])
    left, right = np.array([n[2] for n in nodes]), np.array([n[3] for n in nodes])

    @F.pandas_udf("int")
    def leaf(x: pd.Series) -> pd.Series:
        points = np.stack(x.to_numpy()) if len(x) else np.empty((0, 1))
        at = np.zeros(len(x), dtype=np.int64)
        row = np.arange(len(x))
        while True:
            inner = dimension[at] >= 0
            if not inner.any():
                return pd.Series(left[at].astype(np.int32))
            d = np.maximum(dimension[at], 0)
            step = np.where(points[row, d] <= value[at], left[at], right[at])
            at = np.where(inner, step, at)

    return leaf


def _leaves_within(boxes: dict[int, tuple[list[float], list[float]]]):
    """Other leaves whose box is no farther from the query than its bound."""
    numbers = np.array(sorted(boxes))
    low = np.array([boxes[n][0] for n in numbers])
    high = np.array([boxes[n][1] for n in numbers])

    @F.pandas_udf("array<int>")
    def within(x: pd.Series, home: pd.Series, bound: pd.Series) -> pd.Series:
        found = []
        for point, own, limit in zip(x.to_numpy(), home.to_numpy(), bound.to_numpy()):
            gap = np.maximum(np.maximum(low - point, point - high), 0.0)
            # A hair of slack, so that rounding never hides a leaf.
            near = np.sqrt((gap * gap).sum(axis=1)) <= limit * (1 + 1e-9)
            found.append([int(n) for n in numbers[near] if n != own])
        return pd.Series(found)

    return within


def _first(square: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k least of each row, equal ones by column; NaN comes last."""
    if square.shape[1] > k:
        kth = np.partition(square, k - 1, axis=1)[:, k - 1 : k]
        row, column = np.nonzero((square <= kth) | np.isnan(kth))
    else:
        row, column = (x.ravel() for x in np.indices(square.shape))
    order = np.lexsort((column, square[row, column], row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], column[place < k]


def _candidates(wanted: np.ndarray, limits: np.ndarray, known: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Query and point of all pairs that may be among the k nearest and within a squared limit.

    One product gives all squared distances up to a rounding error whose bound is allowed for. The k-th
    least of the minima of disjoint groups of points is no less than the k-th distance. NaN is kept.
    """
    centre = known.mean(axis=0)
    centre = np.where(np.isfinite(centre), centre, 0.0)
    asked, points = wanted - centre, known - centre
    far, lengths = (asked * asked).sum(axis=1), (points * points).sum(axis=1)
    square = asked @ (-2 * points.T)
    square += lengths
    square += far[:, None]
    error = 1e-12 * (far + lengths.max(initial=0.0, where=np.isfinite(lengths)))
    width = len(known) // POINT_GROUPS
    if width > 1 and k <= POINT_GROUPS:
        least = square[:, : width * POINT_GROUPS].reshape(len(square), POINT_GROUPS, width).min(axis=2)
        limits = np.fmin(limits, np.partition(least, k - 1, axis=1)[:, k - 1] + error)
    return np.nonzero(~(square > (limits + error)[:, None]))


def _nearest_rows(
    wanted: np.ndarray, bounds: np.ndarray, known: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, point and squared distance of the k nearest points of each query, equal ones by number.

    Distances are computed by differences, for the candidates only; points beyond the bound may be left out.
    """
    parts = []
    for start in range(0, len(wanted), 128):
        block = wanted[start : start + 128]
        # A hair of slack, so that rounding never hides a point.
        row, column = _candidates(block, bounds[start : start + 128] ** 2 * (1 + 1e-9), known, k)
        square = np.zeros(len(row))
        for d in range(known.shape[1]):
            gap = block[row, d] - known[column, d]
            square += gap * gap
        order = np.lexsort((column, square, row))
        row, column, square = row[order], column[order], square[order]
        first = np.arange(len(row)) - np.searchsorted(row, row) < k
        parts.append((start + row[first], column[first], square[first]))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _block_search(k: int):
    def search(queries: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"q_key": [], "distance": [], "p_key": [], "p_label": []}).astype(
            {"q_key": str, "distance": float, "p_key": str, "p_label": str}
        )
        if not len(queries) or not len(points):
            return empty
        # Points are in key order, so equal distances are settled by key.
        points = points.sort_values("p_key", kind="stable")
        wanted, known = np.stack(queries["q_x"].to_numpy()), np.stack(points["p_x"].to_numpy())
        asked, bounds = queries["q_key"].to_numpy(), queries["bound"].to_numpy()
        keys, labels = points["p_key"].to_numpy(), points["p_label"].to_numpy()
        row, column, square = _nearest_rows(wanted, bounds, known, k)
        distance = np.sqrt(square)
        near = ~(distance > bounds[row])
        row, column = row[near], column[near]
        return pd.DataFrame(
            {"q_key": asked[row], "distance": distance[near], "p_key": keys[column], "p_label": labels[column]}
        )

    return search


def _blocks(column: str, sizes: dict[int, int], per_block: int) -> Column:
    """Number of blocks of a leaf, as an expression on the leaf number."""
    counts = [max(1, math.ceil(sizes.get(n, 0) / per_block)) for n in range(max(sizes, default=0) + 1)]
    return F.element_at(F.array(*[F.lit(c) for c in counts]), F.col(column) + 1)


def _sizes(df: DataFrame) -> dict[int, int]:
    """Rows per leaf; at most MAX_LEAVES rows come to the driver."""
    return {r["leaf"]: r["count"] for r in df.groupBy("leaf").count().collect()}


def _search(queries: DataFrame, points: DataFrame, point_sizes: dict[int, int], k: int) -> DataFrame:
    """The best k points within the bound of each query in every block of its leaf."""
    query_sizes = _sizes(queries)
    size_map = {n: query_sizes.get(n, 0) for n in point_sizes}
    q_blocks = _blocks("leaf", size_map, QUERIES_PER_BLOCK)
    p_blocks = _blocks("leaf", point_sizes, POINTS_PER_BLOCK)
    asking = queries.select(
        "leaf", "q_key", "q_x", "bound",
        F.pmod(F.xxhash64("q_key"), q_blocks).cast("int").alias("q_block"),
        F.explode(F.sequence(F.lit(0), p_blocks - 1)).alias("p_block"),
    )
    known = points.select(
        "leaf", "p_key", "p_x", "p_label",
        F.pmod(F.xxhash64("p_key"), p_blocks).cast("int").alias("p_block"),
        F.explode(F.sequence(F.lit(0), q_blocks - 1)).alias("q_block"),
    )
    keys = ["leaf", "q_block", "p_block"]
    return asking.groupBy(*keys).cogroup(known.groupBy(*keys)).applyInPandas(_block_search(k), _CANDIDATE)


def _best(candidates: DataFrame, k: int) -> DataFrame:
    """k best candidates per query; a query has at most k candidates per visited block."""
    order = Window.partitionBy("q_key").orderBy("distance", "p_key")
    return candidates.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")


def _stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """A table written to the shared folder, for several passes, and its path."""
    path = shared_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def nearest(
    train: DataFrame, test: DataFrame, features: list[str], label: str, key: str, k: int = 5
) -> DataFrame:
    """The k nearest training rows of every test row: (q_key, distance, p_key, p_label).

    Distances are Euclidean; equal distances are settled by the training key.
    """
    vector = F.array(*[F.col(c).cast("double") for c in features])
    named = train.select(
        F.col(key).cast("string").alias("p_key"), F.col(label).cast("string").alias("p_label"),
        vector.alias("p_x"),
    )
    # Of identical points only the first k can ever be among k neighbours.
    copies = Window.partitionBy("p_x").orderBy("p_key")
    points = named.withColumn("_c", F.row_number().over(copies)).where(F.col("_c") <= k).drop("_c")
    points, path = _stored(points, "points")
    total = points.count()
    sample = (
        points.select("p_x", seeded_digest(42, "p_key").alias("d")).orderBy("d").limit(SAMPLE_ROWS)
    )
    drawn = np.array([r["p_x"] for r in sample.collect()], dtype=float).reshape(-1, len(features))
    leaves = min(MAX_LEAVES, max(1, math.ceil(total / POINTS_PER_BLOCK)))
    leaf = _leaf_of(_split_tree(drawn, leaves))
    placed, _ = _stored(points.withColumn("leaf", leaf("p_x")), "placed")
    delete_path(train.sparkSession, path)
    edges = placed.groupBy("leaf").agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.min(F.col("p_x")[i]) for i in range(len(features))]).alias("low"),
        F.array(*[F.max(F.col("p_x")[i]) for i in range(len(features))]).alias("high"),
    ).collect()  # one row per leaf
    sizes = {r["leaf"]: r["n"] for r in edges}
    boxes = {r["leaf"]: (r["low"], r["high"]) for r in edges}

    asked = test.select(F.col(key).cast("string").alias("q_key"), vector.alias("q_x"))
    queries, _ = _stored(asked.withColumn("leaf", leaf("q_x")), "queries")
    unbounded = queries.withColumn("bound", F.lit(float("inf")))
    at_home, _ = _stored(_best(_search(unbounded, placed, sizes, k), k), "at-home")
    bounds = at_home.groupBy("q_key").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("far"))
    bounded = queries.join(bounds, "q_key", "left").withColumn(
        "bound", F.when(F.col("n") >= k, F.col("far")).otherwise(F.lit(float("inf")))
    )
    visits = bounded.select(
        "q_key", "q_x", "bound", F.explode(_leaves_within(boxes)("q_x", "leaf", "bound")).alias("leaf")
    )
    elsewhere = _search(visits, placed, sizes, k)
    return _best(at_home.unionByName(elsewhere), k)


def vote(neighbours: DataFrame) -> DataFrame:
    """Distance-weighted class per query; neighbours at distance zero outvote all others.

    Equal votes go to the smaller class name.
    """
    per_class = neighbours.groupBy("q_key", "p_label").agg(
        F.count_if(F.col("distance") == 0).alias("exact"),
        F.sum(F.when(F.col("distance") > 0, 1.0 / F.col("distance"))).alias("weight"),
    )
    weight = F.when(F.col("exact") > 0, F.lit(0.0)).otherwise(F.col("weight"))
    first = F.min(F.struct(-F.col("exact"), -weight, F.col("p_label").alias("prediction")))
    return per_class.groupBy("q_key").agg(first.alias("best")).select("q_key", "best.prediction")


def knn_classify(
    train: DataFrame, test: DataFrame, features: list[str], label: str = "label",
    key: str = "flow_id", k: int = 5,
) -> DataFrame:
    """Predicted class of every test row: (key, prediction as text)."""
    return vote(nearest(train, test, features, label, key, k)).withColumnRenamed("q_key", key)
