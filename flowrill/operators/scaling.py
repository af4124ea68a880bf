"""Standardisation with the population deviation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def standard_scale(df: DataFrame, features: list[str], split: str | None = "split") -> DataFrame:
    """Scale features to mean 0 and population deviation 1, fitted on the training rows.

    Without a ``split`` column all rows are used for fitting. A constant feature keeps deviation 1.
    The statistics are a single row, attached to every row; nothing is shuffled.
    """
    fit = df if split is None else df.where(F.col(split) == "train")
    stats = fit.agg(
        *[F.avg(c).alias(f"_mean_{c}") for c in features],
        *[F.stddev_pop(c).alias(f"_dev_{c}") for c in features],
    )
    scaled = df.crossJoin(F.broadcast(stats))  # one row
    keep = [c for c in df.columns if c not in features]
    return scaled.select(
        *keep,
        *[
            (
                (F.col(c) - F.col(f"_mean_{c}"))
                / F.when(F.col(f"_dev_{c}") == 0, F.lit(1.0)).otherwise(F.col(f"_dev_{c}"))
            ).alias(c)
            for c in features
        ],
    )
