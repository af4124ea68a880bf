"""Scoring of raw flows: clean, filter, select, align, predict, label."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

from flowrill.functions.flow_text import BENIGN, DOS
from flowrill.operators.clean import align_features, decode_label, drop_non_finite, drop_protocol_zero
from flowrill.schema import MODEL_FEATURES

# Fixed weights of the linear demonstration scorer (not a trained model).
LINEAR_BIAS = -1.0
LINEAR_WEIGHTS = {
    "flow_duration": 0.00002,
    "total_fwd_packet": 0.01,
    "fwd_packet_length_mean": -0.0001,
    "flow_bytes_s": 0.00001,
    "flow_packets_s": 0.0005,
    "flow_iat_mean": -0.002,
    "fin": 0.1,
    "syn": 0.05,
    "rst": 0.2,
    "ack": -0.05,
}


def scorable(flows: DataFrame, required: Iterable[str] | None = None) -> DataFrame:
    """Flows that may be scored: nothing missing or infinite in ``required``, no protocol 0.

    By default every column is required, except those derived from the timestamp text.
    """
    derived = ("ts", "flow_date")
    needed = [c for c in flows.columns if c not in derived] if required is None else list(required)
    return drop_protocol_zero(drop_non_finite(flows, needed))


def score_flows(
    flows: DataFrame,
    model: PipelineModel,
    expected: Iterable[str] = tuple(MODEL_FEATURES),
    required: Iterable[str] | None = None,
) -> DataFrame:
    """Scorable flows with their predicted label in place of the old one; all columns kept."""
    ready = scorable(flows, required)
    expected = list(expected)
    missing = [c for c in expected if c not in ready.columns]
    for name in missing:
        ready = ready.withColumn(name, F.lit(0.0))
    keep = [c for c in ready.columns if c != "label" and c not in missing]
    scored = decode_label(model.transform(ready), "prediction", "label")
    return scored.select(*keep, "label")


def linear_label(weights: dict[str, float] = LINEAR_WEIGHTS, bias: float = LINEAR_BIAS):
    """Label expression of a linear scorer with given weights."""
    score = F.lit(bias)
    for name, weight in weights.items():
        score = score + F.lit(weight) * F.col(name)
    return F.when(score > 0, F.lit(DOS)).otherwise(F.lit(BENIGN))


def score_linear(flows: DataFrame, required: Iterable[str] | None = None) -> DataFrame:
    """:func:`score_flows` with the fixed linear scorer, entirely inside code generation."""
    features = align_features(scorable(flows, required), MODEL_FEATURES, keep=["flow_id"])
    return features.select("flow_id", linear_label().alias("label"))
