"""Gaussian naive Bayes as one aggregation and one projection."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

# Fixed value: share of the largest feature variance added to every variance.
VAR_SMOOTHING = 1e-9


def gaussian_nb(
    df: DataFrame,
    features: list[str],
    classes: list[str],
    label: str = "label",
    split: str = "split",
    key: str = "flow_id",
) -> DataFrame:
    """Fit on the ``train`` rows, predict the ``test`` rows: (key, label, prediction).

    Means, variances and priors of all classes are one row of conditional aggregates, attached to
    the test rows; the scores are column arithmetic. An equal score goes to the earlier class.
    """
    train = df.where((F.col(split) == "train") & F.col(label).isin(*classes))
    stats: list[Column] = []
    for i, name in enumerate(classes):
        here = F.col(label) == name
        stats.append(F.count_if(here).alias(f"n{i}"))
        for j, feature in enumerate(features):
            stats.append(F.avg(F.when(here, F.col(feature))).alias(f"m{i}_{j}"))
            stats.append(F.var_pop(F.when(here, F.col(feature))).alias(f"v{i}_{j}"))
    for j, feature in enumerate(features):
        stats.append(F.var_pop(feature).alias(f"v_{j}"))
    fitted = train.agg(*stats)
    epsilon = F.lit(VAR_SMOOTHING) * (
        F.greatest(*[F.col(f"v_{j}") for j in range(len(features))])
        if len(features) > 1 else F.col("v_0")
    )
    total = sum((F.col(f"n{i}") for i in range(1, len(classes))), F.col("n0"))
    # Per class: constant term, and mean and inverse doubled variance of each feature.
    terms: list[Column] = []
    for i in range(len(classes)):
        variances = [F.col(f"v{i}_{j}") + epsilon for j in range(len(features))]
        constant = F.ln(F.col(f"n{i}") / total)
        for variance in variances:
            constant = constant - 0.5 * F.ln(F.lit(2 * math.pi) * variance)
        terms.append(constant.alias(f"k{i}"))
        for j, variance in enumerate(variances):
            terms += [F.col(f"m{i}_{j}"), variance.alias(f"s{i}_{j}")]
    model = fitted.select(*terms)

    scored = (
        df.where(F.col(split) == "test")
        .select(key, label, *features)
        .crossJoin(F.broadcast(model))  # one row
    )
    scores = []
    for i in range(len(classes)):
        score = F.col(f"k{i}")
        for j, feature in enumerate(features):
            gap = F.col(feature) - F.col(f"m{i}_{j}")
            score = score - gap * gap / (2 * F.col(f"s{i}_{j}"))
        scores.append(score.alias(f"score{i}"))
    ranked = scored.select(key, label, *scores)
    best = (
        F.greatest(*[F.col(f"score{i}") for i in range(len(classes))])
        if len(classes) > 1 else F.col("score0")
    )
    prediction = F
    for i, name in enumerate(classes):
        prediction = prediction.when(F.col(f"score{i}") == best, F.lit(name))
    return ranked.select(key, label, prediction.otherwise(F.lit(None)).alias("prediction"))
