"""Repeatable pseudo-random draws derived from row keys.

A draw depends only on the seed and the row's key, never on partitioning or task order, so a lost
executor recomputes the very same sample.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def seeded_digest(seed: int, key: Column | str, *parts: str | Column) -> Column:
    """md5 hex of ``seed:parts...:key``."""
    col = F.col(key) if isinstance(key, str) else key
    tokens: list[Column] = [F.lit(str(seed))]
    tokens += [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    return F.md5(F.concat_ws(":", *tokens, F.coalesce(col.cast("string"), F.lit(""))))


def unit_uniform(digest: Column) -> Column:
    """Number in [0, 1) from the first 32 bits of a digest."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def uniform_between(digest: Column, low: float, high: float) -> Column:
    return F.lit(low) + F.lit(high - low) * unit_uniform(digest)
