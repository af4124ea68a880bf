"""Number handling of dirty flow values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

INF = float("inf")


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def is_finite(value: Column | str) -> Column:
    """True for a number that is neither null, NaN nor infinite (Spark orders NaN above infinity)."""
    return F.coalesce(F.abs(_col(value).cast("double")) < F.lit(INF), F.lit(False))


def number_or_zero(value: Column | str) -> Column:
    """Missing, NaN and infinite numbers count as zero."""
    number = _col(value).cast("double")
    return F.when(is_finite(number), number).otherwise(F.lit(0.0))


def whole_or_zero(value: Column | str) -> Column:
    """Integer part, truncated towards zero; missing and non-finite count as zero."""
    return number_or_zero(value).cast("bigint")


def text_to_double(value: Column | str) -> Column:
    """Numeric-looking text to a number, anything else to null (never an ANSI error)."""
    return F.trim(_col(value)).try_cast("double")


def text_to_whole(value: Column | str, type_name: str = "bigint") -> Column:
    """Text to an integer via double, so ``5.7`` and ``3.0`` truncate instead of failing.

    NaN, infinite and too large numbers become null.
    """
    return text_to_double(value).try_cast(type_name)


def null_if_not_finite(value: Column | str) -> Column:
    """Infinite and NaN values to null."""
    number = _col(value)
    return F.when(is_finite(number), number)


def round_half_up(value: Column | str) -> Column:
    """Display rounding: ties go towards positive infinity, also for negative numbers."""
    return F.floor(_col(value) + F.lit(0.5)).cast("bigint")
