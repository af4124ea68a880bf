"""Exact quantiles and rank cutoffs without sorting a whole group in one task.

A plain window over a class or over the whole table sends the group to a single task. Here rows are
first counted per ordered bucket, map-side, and only the bucket that holds the wanted rank is
sorted. The results are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Sketch accuracy: its rank error is at most rows / ACCURACY.
ACCURACY = 100_000
# Interval half-widths as shares of the rows, widest first; the narrowest that fits is used.
MARGINS = (1e-3, 2.0 / ACCURACY)


def exact_quantiles(
    df: DataFrame, columns: list[str], probabilities: list[float]
) -> DataFrame:
    """Exact quantiles with linear interpolation, as (column_name, probability, value).

    Built-in exact percentiles keep all distinct values of the table in one aggregation buffer.
    Here a sketch with a guaranteed rank error gives, for each quantile, an interval that must
    hold it; a second pass counts the rows below the interval and the values inside it, about
    4 / ACCURACY of a large table's rows, equal values combined. Null and NaN are ignored.
    """
    pairs = [
        F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("double").alias("value"))
        for c in columns
    ]
    values = df.select(F.inline(F.array(*pairs))).where(
        F.col("value").isNotNull() & ~F.isnan("value")
    )
    sides = [
        (margin, [max(p - margin, 0.0) for p in probabilities], [min(p + margin, 1.0) for p in probabilities])
        for margin in MARGINS
    ]
    cuts = [F.lit(q) for _, lows, highs in sides for q in lows + highs]
    sketch = values.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("value").alias("least"),
        F.max("value").alias("most"),
        F.percentile_approx("value", F.array(*cuts), ACCURACY).alias("cut"),
    )
    k = len(probabilities)
    intervals = []
    for i, p in enumerate(probabilities):
        low, high = F.col("least"), F.col("most")
        for j, (margin, lows, highs) in enumerate(sides):
            # The margin must cover the sketch's error and three more rows.
            enough = F.col("n") * (margin - 1.0 / ACCURACY) >= 3
            at = 2 * k * j + i
            if lows[i] > 0.0:
                low = F.when(enough, F.col("cut")[at]).otherwise(low)
            if highs[i] < 1.0:
                high = F.when(enough, F.col("cut")[at + k]).otherwise(high)
        intervals.append(
            F.struct(
                F.lit(float(p)).alias("probability"), low.alias("low"), high.alias("high")
            )
        )
    # One row per requested column, so its size is fixed by the call.
    bounds = F.broadcast(sketch.select("column_name", "n", F.array(*intervals).alias("spans")))

    # Key null stands for all rows below the interval; nulls sort first.
    counted = (
        values.join(bounds, "column_name")
        .select("column_name", "n", "value", F.inline("spans"))
        .where(F.col("value") <= F.col("high"))
        .groupBy(
            "column_name", "n", "probability",
            F.when(F.col("value") >= F.col("low"), F.col("value")).alias("key"),
        )
        .agg(F.count(F.lit(1)).alias("c"))
    )
    running = Window.partitionBy("column_name", "probability").orderBy(F.col("key").asc_nulls_first())
    position = F.col("probability") * (F.col("n") - 1)
    below = F.floor(position)
    ranked = counted.withColumn("upto", F.sum("c").over(running))
    found = ranked.groupBy("column_name", "probability", "n").agg(
        F.min(F.when(F.col("upto") > below, F.struct("upto", "key"))).alias("lower"),
        F.min(
            F.when(F.col("upto") > F.least(below + 1, F.col("n") - 1), F.struct("upto", "key"))
        ).alias("upper"),
    )
    low, high = F.col("lower.key"), F.col("upper.key")
    value = low + F.when(high == low, F.lit(0.0)).otherwise((high - low) * (position - below))
    checked = F.when(
        low.isNull() | high.isNull(),
        F.raise_error("quantile outside the interval given by the sketch").cast("double"),
    ).otherwise(value)
    return found.select("column_name", "probability", checked.alias("value"))


# More groups than this are joined, fewer are named in expressions.
MAX_NAMED_GROUPS = 1000


def named_groups(df: DataFrame, group: str) -> list | None:
    """The groups of a table, or None if they are more than ``MAX_NAMED_GROUPS``.

    Distinct values are combined map-side and at most that many come to the driver, so that a table
    with few classes is not shuffled on its class.
    """
    rows = df.where(F.col(group).isNotNull()).select(group).distinct().limit(MAX_NAMED_GROUPS + 1).collect()
    return sorted(r[0] for r in rows) if len(rows) <= MAX_NAMED_GROUPS else None


def digest_cutoffs(
    df: DataFrame,
    group: str,
    digest: str,
    tie: str,
    limits: dict[str, Column],
    groups: list | None = None,
    hex_digits: int = 4,
) -> DataFrame:
    """Per group, the (digest, tie) of the row at each wanted rank in digest order.

    One row per group: ``group`` and a struct column per limit, null where the limit is 0. A limit
    is an expression over ``group_rows`` and ``smallest_group`` (the size of the smallest group).
    Selecting "the first n rows of a group" is then a comparison with the cutoff, without ranking,
    sorting or shuffling the group.

    The head of the hex digest puts a group's rows into ``16 ** hex_digits`` ordered buckets. Rows
    are counted per bucket (combined map-side); only the one bucket that holds the wanted rank is
    ranked, a share of ``16 ** -hex_digits`` of its group. Both passes read the group, the key and
    nothing else.
    """
    keyed = df.select(
        group, digest, tie, F.substring(F.col(digest), 1, hex_digits).alias("_bucket")
    ).where(F.col(group).isNotNull())
    if groups is not None:
        keyed = keyed.where(F.col(group).isin(*groups))
    per_bucket = keyed.groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    # At most 16 ** hex_digits rows per group from here on.
    of_group = Window.partitionBy(group)
    earlier = of_group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        group, "_bucket", "_rows",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_rows").over(of_group).alias("group_rows"),
    )
    smallest = per_bucket.groupBy(group).agg(F.sum("_rows").alias("_n")).agg(
        F.min("_n").alias("smallest_group")
    )
    wanted = F.array(
        *[
            F.struct(F.lit(name).alias("_limit"), limit.cast("bigint").alias("_at"))
            for name, limit in limits.items()
        ]
    )
    boundary = (
        offsets.crossJoin(F.broadcast(smallest))  # one row
        .select(group, "_bucket", "_rows", "_before", F.inline(wanted))
        .where((F.col("_before") < F.col("_at")) & (F.col("_before") + F.col("_rows") >= F.col("_at")))
        .select(group, "_bucket", "_limit", (F.col("_at") - F.col("_before")).alias("_need"))
    )
    # One row per group and limit: of known size where the groups are named.
    boundary = F.broadcast(boundary) if groups is not None else boundary
    ordered = Window.partitionBy(group, "_limit").orderBy(digest, tie)
    at_limit = (
        keyed.join(boundary, [group, "_bucket"])
        .withColumn("_r", F.row_number().over(ordered))
        .where(F.col("_r") == F.col("_need"))
    )
    cutoff = F.struct(F.col(digest).alias("digest"), F.col(tie).alias("tie"))
    return at_limit.groupBy(group).agg(
        *[F.max(F.when(F.col("_limit") == name, cutoff)).alias(name) for name in limits]
    )


def attach_cutoffs(df: DataFrame, cutoffs: DataFrame, group: str, groups: list | None) -> DataFrame:
    """Join the cutoffs to the rows; broadcast only where the number of groups is known."""
    if groups is not None:
        return df.where(F.col(group).isin(*groups)).join(F.broadcast(cutoffs), group, "left")
    return df.join(cutoffs, group, "left")


def within(cutoff: str, digest: str, tie: str) -> Column:
    """Whether a row is among the rows up to a cutoff."""
    key = F.struct(F.col(digest).alias("digest"), F.col(tie).alias("tie"))
    return F.coalesce(key <= F.col(cutoff), F.lit(False))
