"""Balancing, splitting and augmenting training sets, repeatably."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowrill.functions.flow_text import BENIGN, DOS
from flowrill.functions.hashing import seeded_digest, uniform_between
from flowrill.operators.ranking import attach_cutoffs, digest_cutoffs, named_groups, within
from flowrill.schema import MODEL_FEATURES

# Features rounded to whole numbers after augmentation.
INTEGER_FEATURES = ["flow_duration", "total_fwd_packet", "fin", "syn", "rst", "ack"]


_DIGEST = "_digest"


def _with_cutoffs(
    df: DataFrame, label: str, key: str, seed: int, limits: dict[str, Column],
    classes: list | None, hex_digits: int,
) -> DataFrame:
    if classes is None:
        classes = named_groups(df, label)
    keyed = df.where(F.col(label).isNotNull()).withColumn(_DIGEST, seeded_digest(seed, key))
    cutoffs = digest_cutoffs(keyed, label, _DIGEST, key, limits, classes, hex_digits)
    return attach_cutoffs(keyed, cutoffs, label, classes)


def undersample_to_min(
    df: DataFrame,
    label: str = "label",
    key: str = "flow_id",
    seed: int = 42,
    classes: list | None = None,
    hex_digits: int = 4,
) -> DataFrame:
    """As many rows of every class as the smallest class has; exact and repeatable.

    Rows of a class are taken in the order of a seeded digest of their key, up to a cutoff. With
    the ``classes`` named, the rows themselves are not shuffled at all.
    """
    marked = _with_cutoffs(
        df, label, key, seed, {"_keep": F.col("smallest_group")}, classes, hex_digits
    )
    return marked.where(within("_keep", _DIGEST, key)).select(*df.columns)


def split_stratified(
    df: DataFrame,
    label: str = "label",
    key: str = "flow_id",
    test_fraction: float = 0.2,
    seed: int = 42,
    classes: list | None = None,
    hex_digits: int = 4,
) -> DataFrame:
    """Add ``split``: the first ``floor(rows * test_fraction)`` of each class are ``test``.

    Features and label stay in one row, so dropping rows later keeps them aligned.
    """
    limits = {"_test": F.floor(F.col("group_rows") * F.lit(test_fraction))}
    marked = _with_cutoffs(df, label, key, seed, limits, classes, hex_digits)
    return _split(marked, key).select(*df.columns, "split")


def balanced_split(
    df: DataFrame,
    label: str = "label",
    key: str = "flow_id",
    test_fraction: float = 0.2,
    seed: int = 42,
    classes: list | None = None,
    hex_digits: int = 4,
) -> DataFrame:
    """Undersampling and stratified split from one set of cutoffs.

    Gives the classes of :func:`undersample_to_min` with the first ``floor(smallest *
    test_fraction)`` rows of each as ``test``, for the passes of one of the two steps.
    """
    limits = {
        "_keep": F.col("smallest_group"),
        "_test": F.floor(F.col("smallest_group") * F.lit(test_fraction)),
    }
    marked = _with_cutoffs(df, label, key, seed, limits, classes, hex_digits)
    kept = marked.where(within("_keep", _DIGEST, key))
    return _split(kept, key).select(*df.columns, "split")


def _split(marked: DataFrame, key: str) -> DataFrame:
    return marked.withColumn(
        "split", F.when(within("_test", _DIGEST, key), "test").otherwise("train")
    )


def augment_dos(
    df: DataFrame,
    factor: int = 1,
    rate_scale: float = 0.05,
    other_scale: float = 10.0,
    label: str = "label",
    key: str = "flow_id",
    seed: int = 42,
) -> DataFrame:
    """Benign rows unchanged plus ``factor`` noisy copies of every DoS row (the originals go).

    The packet rate gets uniform noise of ``rate_scale``; the other features of ``other_scale``,
    made absolute. Count features are rounded half to even. The noise of a cell depends only on
    the seed, the copy number, the feature and the row's key.
    """
    rows = df.select(key, *[F.col(c).cast("double").alias(c) for c in MODEL_FEATURES], label)
    benign = rows.where(F.col(label) == BENIGN).withColumn("copy", F.lit(0))
    copies = rows.where(F.col(label) == DOS).withColumn(
        "copy", F.explode(F.sequence(F.lit(1), F.lit(factor)))
    )

    def noisy(feature: str):
        scale = rate_scale if feature == "flow_packets_s" else other_scale
        digest = seeded_digest(seed, key, F.col("copy"), feature)
        value = F.col(feature) * (F.lit(1.0) + uniform_between(digest, -scale, scale))
        if feature != "flow_packets_s":
            value = F.abs(value)
        return F.bround(value, 0) if feature in INTEGER_FEATURES else value

    augmented = copies.select(key, *[noisy(c).alias(c) for c in MODEL_FEATURES], label, "copy")
    return benign.unionByName(augmented)
