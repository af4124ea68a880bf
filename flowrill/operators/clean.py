"""Cleaning and feature selection: narrow projections and filters, no shuffle unless noted."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window, functions as F, types as T

from flowrill.functions.flow_text import (
    SCORED_LABELS,
    UNKNOWN_CATEGORY,
    attack_category,
    parse_flow_timestamp,
)
from flowrill.functions.numbers import null_if_not_finite
from flowrill.operators.ranking import named_groups
from flowrill.schema import (
    CANONICAL_COLUMNS,
    DUPLICATE_HEADER,
    IDENTIFIER_COLUMNS,
    MODEL_FEATURES,
    RATE_COLUMNS,
    column_type,
    short_name,
)


def drop_duplicate_header(df: DataFrame) -> DataFrame:
    """Trim the header names and drop the public captures' duplicate column."""
    return df.toDF(*[c.strip() for c in df.columns]).drop(DUPLICATE_HEADER)


def rename_canonical(df: DataFrame) -> DataFrame:
    """Rename by position to the canonical header; the number of columns must fit."""
    if len(df.columns) != len(CANONICAL_COLUMNS):
        raise ValueError(f"expected {len(CANONICAL_COLUMNS)} columns, got {len(df.columns)}")
    return df.toDF(*CANONICAL_COLUMNS)


def _typed(name: str) -> str:
    """SQL text typing one text column; text keeps one call per column on the driver."""
    column, data_type = f"`{name}`", column_type(name).simpleString()
    if data_type == "string":
        return f"nullif({column}, '') as {short_name(name)}"
    number = f"try_cast(trim({column}) as double)"
    if data_type != "double":
        # Through double, so that 5.7 and 3.0 truncate instead of failing.
        number = f"try_cast({number} as {data_type})"
    return f"{number} as {short_name(name)}"


def coerce_flows(df: DataFrame) -> DataFrame:
    """Text capture to typed flows under short names, with ``ts`` and ``flow_date`` derived.

    Types are fixed per column: text that is not a number becomes null instead of staying text in
    a numeric column. Only canonical columns present in ``df`` are kept.
    """
    present = [c for c in CANONICAL_COLUMNS if c in df.columns]
    typed = df.selectExpr(*[_typed(c) for c in present])
    if "Timestamp" not in present:
        return typed
    return typed.withColumn("ts", parse_flow_timestamp("timestamp_raw")).withColumn(
        "flow_date", F.col("ts").cast("date")
    )


def numeric_columns(df: DataFrame) -> list[str]:
    """Names of the numeric columns, in schema order."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def _floating(df: DataFrame) -> list[str]:
    return [
        f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    ]


def drop_non_finite(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Drop rows with a null, NaN or infinite value in ``columns`` (default: in any column)."""
    names = list(columns) if columns is not None else df.columns
    floating = set(_floating(df))
    tests = [
        f"coalesce(abs(`{c}`) < double('Infinity'), false)" if c in floating else f"`{c}` is not null"
        for c in names
    ]
    return df.where(" and ".join(tests)) if tests else df


def drop_non_finite_rates(df: DataFrame) -> DataFrame:
    """Drop rows whose byte or packet rate is null, NaN or infinite."""
    return drop_non_finite(df, RATE_COLUMNS)


def non_finite_to_null(df: DataFrame) -> DataFrame:
    """Infinite and NaN values to null, all rows kept."""
    floating = set(_floating(df))
    return df.select(
        *[
            null_if_not_finite(F.col(f"`{c}`")).alias(c) if c in floating else F.col(f"`{c}`")
            for c in df.columns
        ]
    )


def add_attack_category(df: DataFrame, label: str = "label") -> DataFrame:
    """Add ``class_label``, the category of the detailed label (``Unknown`` when unlisted)."""
    return df.withColumn("class_label", attack_category(label))


def drop_unknown(df: DataFrame, column: str = "class_label") -> DataFrame:
    return df.where(F.col(column) != UNKNOWN_CATEGORY)


def exclude_classes(df: DataFrame, classes: Iterable[str], column: str = "class_label") -> DataFrame:
    """Rows of none of the given classes; a missing class is kept."""
    return df.where(F.col(column).isNull() | ~F.col(column).isin(*classes))


def class_subset(df: DataFrame, value: str, column: str = "label", head: int | None = None,
                 order: Iterable[str] = ("ts", "flow_id")) -> DataFrame:
    """Rows of one class; ``head`` keeps the first of them in ``order``."""
    subset = df.where(F.col(column) == value)
    if head is None:
        return subset
    return subset.orderBy(*[F.col(c).asc_nulls_last() for c in order]).limit(head)


def drop_protocol_zero(df: DataFrame) -> DataFrame:
    """Drop protocol 0 where the column exists; a missing protocol is kept."""
    if "protocol" not in df.columns:
        return df
    return df.where(F.col("protocol").isNull() | (F.col("protocol") != 0))


def select_model_features(df: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """The model's ten features, after the ``keep`` columns."""
    return df.select(*keep, *MODEL_FEATURES)


def align_features(df: DataFrame, expected: Iterable[str], keep: Iterable[str] = ()) -> DataFrame:
    """Exactly the expected features in order; a missing one is added as 0."""
    return df.select(
        *keep, *[F.col(c) if c in df.columns else F.lit(0.0).alias(c) for c in expected]
    )


def drop_identifiers(df: DataFrame, identifiers: Iterable[str] = IDENTIFIER_COLUMNS) -> DataFrame:
    """Everything that may be a feature."""
    return df.drop(*identifiers)


def encode_label(
    df: DataFrame,
    column: str = "label",
    output: str = "label_code",
    classes: Iterable[str] | None = None,
) -> DataFrame:
    """Alphabetical class codes from 0; rows without a class are dropped.

    With ``classes`` known the codes are a plain expression. Otherwise the distinct classes are
    looked up first; only if they are very many are they ranked as a table and joined back.
    """
    present = df.where(F.col(column).isNotNull())
    if classes is None:
        classes = named_groups(df, column)
    if classes is not None:
        code = F
        for index, name in enumerate(sorted(classes)):
            code = code.when(F.col(column) == name, F.lit(index))
        return present.withColumn(output, code.otherwise(F.lit(None).cast("int")))
    codes = label_codes(present, column, output)
    return present.join(codes, column)


def label_codes(df: DataFrame, column: str = "label", output: str = "label_code") -> DataFrame:
    """One row per class with its alphabetical code."""
    distinct = df.where(F.col(column).isNotNull()).select(column).distinct()
    return distinct.select(
        column, (F.row_number().over(Window.orderBy(column)) - 1).alias(output)
    )


def decode_label(
    df: DataFrame,
    column: str = "prediction",
    output: str = "label",
    classes: Iterable[str] = SCORED_LABELS,
) -> DataFrame:
    """Class name of a numeric code; ``-1`` as text for a code out of range."""
    name = F
    for index, value in enumerate(sorted(classes)):
        name = name.when(F.col(column) == index, F.lit(value))
    return df.withColumn(output, name.otherwise(F.lit("-1")))
