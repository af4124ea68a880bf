"""Data profiling: one aggregate row for all columns, turned into one row per column."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from flowrill.functions.numbers import INF
from flowrill.operators.clean import numeric_columns
from flowrill.operators.ranking import exact_quantiles
from flowrill.schema import RATE_COLUMNS


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def _per_column(df: DataFrame, columns: list[str], metrics: dict) -> DataFrame:
    """Compute ``metrics`` (name -> function of a column) for every column in one pass."""
    aggregates = [
        fn(name).alias(f"m{i}_{metric}")
        for i, name in enumerate(columns)
        for metric, fn in metrics.items()
    ]
    row = df.agg(*aggregates)
    structs = [
        F.struct(
            F.lit(name).alias("column_name"),
            *[F.col(f"m{i}_{metric}").alias(metric) for metric in metrics],
        )
        for i, name in enumerate(columns)
    ]
    return row.select(F.inline(F.array(*structs)))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, most frequent first; missing values are not counted."""
    return (
        df.where(_col(column).isNotNull())
        .groupBy(_col(column).alias(column))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), _col(column))
    )


def null_profile(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Null or NaN values per column, and in total as column ``*``."""
    names = list(columns or df.columns)
    floating = {
        f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }

    def missing(name: str) -> Column:
        col = _col(name)
        return F.count_if((col.isNull() | F.isnan(col)) if name in floating else col.isNull())

    per_column = _per_column(df, names, {"missing": missing})
    total = per_column.agg(F.sum("missing").alias("missing")).select(
        F.lit("*").alias("column_name"), "missing"
    )
    return per_column.unionByName(total)


def inf_profile(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Numeric columns holding infinite values, with their number."""
    names = list(columns or numeric_columns(df))
    profile = _per_column(
        df, names, {"infinite": lambda n: F.count_if(F.abs(_col(n).cast("double")) == F.lit(INF))}
    )
    return profile.where(F.col("infinite") > 0)


def inf_counts(df: DataFrame, columns: Iterable[str] = tuple(RATE_COLUMNS)) -> DataFrame:
    """Infinite values of the given columns, zeros included."""
    return _per_column(
        df,
        list(columns),
        {"infinite": lambda n: F.count_if(F.abs(_col(n).cast("double")) == F.lit(INF))},
    )


def rate_quartiles(
    df: DataFrame, columns: Iterable[str] = tuple(RATE_COLUMNS),
    probabilities: Iterable[float] = (0.25, 0.5, 0.75),
) -> DataFrame:
    """Exact quartiles with linear interpolation, as (column_name, probability, value)."""
    return exact_quantiles(df, list(columns), list(probabilities))


def describe_rates(df: DataFrame, columns: Iterable[str] = tuple(RATE_COLUMNS)) -> DataFrame:
    """count, mean, sample standard deviation, min, exact quartiles and max per column."""
    names = list(columns)

    def number(name: str) -> Column:
        return F.nanvl(_col(name).cast("double"), F.lit(None).cast("double"))

    moments = _per_column(
        df, names,
        {
            "n": lambda c: F.count(number(c)),
            "mean": lambda c: F.avg(number(c)),
            "std": lambda c: F.stddev_samp(number(c)),
            "min": lambda c: F.min(number(c)),
            "max": lambda c: F.max(number(c)),
        },
    )
    quartiles = (
        exact_quantiles(df, names, [0.25, 0.5, 0.75])
        .groupBy("column_name")
        .agg(
            F.max(F.when(F.col("probability") == 0.25, F.col("value"))).alias("q1"),
            F.max(F.when(F.col("probability") == 0.5, F.col("value"))).alias("median"),
            F.max(F.when(F.col("probability") == 0.75, F.col("value"))).alias("q3"),
        )
    )
    return moments.join(quartiles, "column_name", "left").select(
        "column_name", "n", "mean", "std", "min", "q1", "median", "q3", "max"
    )


def feature_min_max(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Smallest and largest value per column; NaN is ignored, infinity is not."""

    def number(name: str) -> Column:
        return F.nanvl(_col(name).cast("double"), F.lit(None).cast("double"))

    return _per_column(
        df, list(columns),
        {"min_value": lambda c: F.min(number(c)), "max_value": lambda c: F.max(number(c))},
    )


def dataset_shape(df: DataFrame, step: str) -> DataFrame:
    """Rows and columns of a table after a step."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(step).alias("step"), "n_rows", F.lit(len(df.columns)).alias("n_columns")
    )
