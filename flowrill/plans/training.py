"""From raw captures to a training set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowrill.operators.clean import (
    add_attack_category,
    coerce_flows,
    drop_duplicate_header,
    drop_non_finite,
    drop_non_finite_rates,
    drop_unknown,
    encode_label,
    rename_canonical,
    select_model_features,
)
from flowrill.operators.sampling import balanced_split
from flowrill.session import delete_path, shared_dir

# Rows of a task of a fit: some 100 MB of features, so that rounds have few tasks.
TASK_ROWS = 1_000_000


def clean_training(raw: DataFrame) -> DataFrame:
    """Raw public capture (text columns) to typed, categorised rows without missing values.

    Header trimming, positional rename, category lookup, dropping unknown classes and incomplete
    rows are one chain of projections and filters: one pass, no shuffle, nothing cached.
    """
    canonical = rename_canonical(drop_duplicate_header(raw))
    typed = coerce_flows(canonical)
    categorised = drop_unknown(add_attack_category(typed))
    # ts and flow_date are derived from the timestamp text; an unparseable text is not a gap.
    required = [c for c in categorised.columns if c not in ("ts", "flow_date")]
    return drop_non_finite(categorised, required)


def training_rows(
    flows: DataFrame,
    classes: list[str],
    label: str = "label",
    seed: int = 42,
    hex_digits: int = 4,
) -> DataFrame:
    """Balanced, encoded and split model features: flow_id, ten features, label_code, split."""
    usable = drop_non_finite_rates(flows).where(F.col(label).isin(*classes))
    features = select_model_features(usable, keep=["flow_id", label])
    split = balanced_split(features, label, seed=seed, classes=classes, hex_digits=hex_digits)
    return encode_label(split, label, "label_code", classes=classes).drop(label)


def stored_flows(spark: SparkSession, flows: DataFrame) -> DataFrame:
    """The flows as a table, written here, so that what makes them runs once for several readers."""
    path = shared_dir(spark, "flows")
    flows.write.parquet(path, compression="zstd")
    return spark.read.schema(flows.schema).parquet(path)


def stored_training_rows(
    spark: SparkSession, flows: DataFrame, classes: list[str], label: str = "label", task_rows: int = TASK_ROWS,
    from_table: bool = False,
) -> DataFrame:
    """:func:`training_rows` from a table, written here, in partitions for the many passes of a fit.

    What training needs of the usable flows is written first: the passes that find the cutoffs read
    that, and what makes the flows runs once. With ``from_table`` the flows are a table's and are read
    from there instead. Every pass of a fit has a task per partition, whose results go to the driver;
    there are no more of them than cores, or than ``task_rows`` asks for.
    """
    base = None
    if not from_table:
        usable = drop_non_finite_rates(flows).where(F.col(label).isin(*classes))
        base = shared_dir(spark, "usable")
        features = select_model_features(usable, keep=["flow_id", label])
        features.write.parquet(base, compression="zstd")
        flows = spark.read.parquet(base)
    path = shared_dir(spark, "training")
    training_rows(flows, classes, label).write.parquet(path, compression="zstd")
    if base:
        delete_path(spark, base)
    return in_tasks(spark.read.parquet(path), task_rows)


def in_tasks(rows: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """Rows of a stored table in at most as many partitions as there are cores, or as ``task_rows`` asks for."""
    return rows.coalesce(max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // task_rows)))
