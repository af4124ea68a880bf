"""Classification quality from (label, prediction) counts.

The predictions are reduced to one row per pair of classes first; everything after that works on
this small table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def confusion_counts(predictions: DataFrame, label: str = "label", prediction: str = "prediction"):
    """Rows per occurring (label, prediction)."""
    return predictions.groupBy(
        F.col(label).alias("label"), F.col(prediction).alias("prediction")
    ).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(
    predictions: DataFrame, classes: list, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """Rows per (label, prediction) over the given classes, zeros included."""
    cells = [(a, b) for a in classes for b in classes]
    counters = [
        F.count_if((F.col(label) == a) & (F.col(prediction) == b)).alias(f"c{i}")
        for i, (a, b) in enumerate(cells)
    ]
    row = predictions.agg(*counters)
    return row.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(a).alias("label"), F.lit(b).alias("prediction"),
                        F.col(f"c{i}").alias("n"),
                    )
                    for i, (a, b) in enumerate(cells)
                ]
            )
        )
    )


def _ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(top / F.nullif(bottom.cast("double"), F.lit(0.0)), F.lit(0.0))


def _f1(precision: Column, recall: Column) -> Column:
    return F.coalesce(
        2 * precision * recall / F.nullif(precision + recall, F.lit(0.0)), F.lit(0.0)
    )


def per_class(predictions: DataFrame, label: str = "label", prediction: str = "prediction"):
    """Precision, recall, F1 and support per class; an undefined ratio is 0.

    A class that is only predicted, never true, counts with support 0.
    """
    counts = confusion_counts(predictions, label, prediction)
    sides = counts.select(
        F.inline(
            F.array(
                F.struct(
                    F.col("label").alias("class"), F.col("n").alias("support"),
                    F.lit(0).cast("bigint").alias("predicted"),
                    F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
                    .alias("hits"),
                ),
                F.struct(
                    F.col("prediction").alias("class"), F.lit(0).cast("bigint").alias("support"),
                    F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("hits"),
                ),
            )
        )
    )
    totals = sides.groupBy("class").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"),
        F.sum("hits").alias("hits"),
    )
    ratios = totals.select(
        "class", "support", "hits",
        _ratio(F.col("hits"), F.col("predicted")).alias("precision"),
        _ratio(F.col("hits"), F.col("support")).alias("recall"),
    )
    return ratios.withColumn("f1", _f1(F.col("precision"), F.col("recall")))


def classification_metrics(
    predictions: DataFrame, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """Accuracy and macro-averaged precision, recall and F1 in one row."""
    return per_class(predictions, label, prediction).agg(
        (F.sum("hits") / F.sum("support")).alias("accuracy"),
        F.avg("precision").alias("precision"),
        F.avg("recall").alias("recall"),
        F.avg("f1").alias("f1"),
    )


def classification_report(
    predictions: DataFrame, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """Per-class rows, then accuracy, macro average and weighted average."""
    classes = per_class(predictions, label, prediction)
    total = F.sum("support")

    def weighted(name: str) -> Column:
        return F.sum(F.col(name) * F.col("support")) / total

    accuracy = F.sum("hits") / total
    averages = classes.agg(
        total.alias("support"), accuracy.alias("acc"),
        *[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")],
        *[weighted(c).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")],
    )
    rows = averages.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("class"), precision.alias("precision"),
                        recall.alias("recall"), f1.alias("f1"), F.col("support"),
                    )
                    for name, precision, recall, f1 in [
                        ("accuracy", *[F.col("acc")] * 3),
                        ("macro avg", *[F.col(f"macro_{c}") for c in ("precision", "recall", "f1")]),
                        ("weighted avg", *[F.col(f"weighted_{c}") for c in ("precision", "recall", "f1")]),
                    ]
                ]
            )
        )
    )
    named = classes.select(
        F.col("class").cast("string").alias("class"), "precision", "recall", "f1", "support"
    )
    return named.unionByName(rows)


def best_model(metrics: DataFrame) -> DataFrame:
    """The row with the highest accuracy, ties by name."""
    return metrics.orderBy(F.col("accuracy").desc(), F.col("model")).limit(1)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
