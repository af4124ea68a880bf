"""Quality classifier: Bradley-Terry ranking of documents, thresholded at a score quantile.

Preference pairs are a document labelled 1 and one labelled 0. A linear strength over text features
is fitted so that the logistic of the difference of strengths gives the preference (logistic loss
on feature differences, no intercept). The threshold is the quantile of the labelled documents'
strengths at their share of label 0, and strengths are shifted so that it maps to ``cut``.

Only the text makes a score: null and empty texts have features too, equal texts have equal scores,
and each row is scored alone. Labels that are null, or without a document, are ignored; repeated
labels count repeatedly. Without both labels to learn from, every text scores the share of label 1
(0.5 without labels). Columns beside those named are ignored or carried through unchanged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from flowrill.llm.frames import fresh

CUT = 0.3
MAX_LABELLED = 20_000
_UPPER = slice(65, 91)
_LOWER = slice(97, 123)
_DIGIT = slice(48, 58)
_PLAIN_MARKS = list(b".,;:'\"()-?")
_LOUD = list(b"!")
_BARS = list(b"|")
_SYMBOLS = list(b"#$%&*+/<=>@[\\]^_`{}~")


def text_features(text: str) -> list[float]:
    """Shares of character classes and repetitions in a whole text, each also on a steep scale."""
    data = text.encode("utf-8")
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n = max(len(data), 1)
    upper, lower = int(counts[_UPPER].sum()), int(counts[_LOWER].sum())
    tokens = data.split()
    n_tokens = max(len(tokens), 1)
    lines = data.split(b"\n")
    shares = [
        upper / max(upper + lower, 1),
        counts[_LOUD].sum() / n,
        counts[_BARS].sum() / n,
        counts[_SYMBOLS].sum() / n,
        counts[_DIGIT].sum() / n,
        sum(map(eq, tokens, tokens[1:])) / n_tokens,
        1 - len(set(lines)) / len(lines),
    ]
    steep = [math.sqrt(s) for s in shares]
    return [
        *shares,
        *steep,
        counts[_PLAIN_MARKS].sum() / n,
        counts[128:].sum() / n,
        len(set(tokens)) / n_tokens,
        len(set(tokens)) / n_tokens * math.log1p(n_tokens),
        math.log1p(n_tokens),
        math.log1p(n / n_tokens),
        math.log1p(len(lines)),
        float(not tokens),
    ]


@dataclass(frozen=True)
class QualityModel:
    """Strength is ``(features - mean) / scale . weights``; ``threshold`` maps to ``cut``."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    cut: float
    constant: float | None = None

    def scores(self, features: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(features), self.constant)
        logit = self._strength(features) - self.threshold + math.log(self.cut / (1 - self.cut))
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))

    def _strength(self, features: np.ndarray) -> np.ndarray:
        return ((features - self.mean) / self.scale) @ self.weights


def fit_pairs(
    features: np.ndarray, label: np.ndarray, cut: float = CUT, pairs_each: int = 8, penalty: float = 1.0
) -> QualityModel:
    """Fit from labelled rows. Each row meets ``pairs_each`` rows of the other label, in turn."""
    zero, one = np.flatnonzero(label == 0), np.flatnonzero(label == 1)
    width = features.shape[1]
    mean, scale = np.zeros(width), np.ones(width)
    if not zero.size or not one.size:
        constant = float(label.mean()) if label.size else 0.5
        return QualityModel(mean, scale, np.zeros(width), 0.0, cut, constant)
    mean, scale = features.mean(axis=0), features.std(axis=0)
    scale[scale < 1e-12] = 1.0
    standard = (features - mean) / scale
    turns = np.arange(max(zero.size, one.size))
    step = 1 + min(zero.size, one.size) // pairs_each
    better = np.concatenate([one[(turns + (j * step if one.size < zero.size else 0)) % one.size] for j in range(pairs_each)])
    worse = np.concatenate([zero[(turns + (0 if one.size < zero.size else j * step)) % zero.size] for j in range(pairs_each)])
    difference = standard[better] - standard[worse]
    weights = np.zeros(width)
    for _ in range(30):  # Newton steps on the penalised logistic loss
        p = 1 / (1 + np.exp(-np.clip(difference @ weights, -500, 500)))
        slope = difference.T @ (1 - p) - penalty * weights
        curve = (difference * (p * (1 - p))[:, None]).T @ difference + penalty * np.eye(width)
        move = np.linalg.solve(curve, slope)
        weights = weights + move
        if np.abs(move).max() < 1e-8:
            break
    threshold = float(np.quantile(standard @ weights, zero.size / label.size))
    return QualityModel(mean, scale, weights, threshold, cut)


def held_out(doc_id: Column) -> Column:
    """Every fifth document, by a checksum of its id; a null id counts as an empty one, held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit_quality(docs: DataFrame, labels: DataFrame, cut: float = CUT, max_labelled: int = MAX_LABELLED) -> QualityModel:
    """Learn from labelled documents that are not held out.

    The fit uses at most ``max_labelled`` of them, the first by a hash of their id: this bounds the
    labels that are sent to the tasks and the feature rows that come back.
    """
    order = [F.xxhash64(F.col("doc_id")), "quality"]
    sample = (
        labels.select("doc_id", F.col("quality").cast("int").alias("quality"))
        .where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
        .orderBy(*order).limit(max_labelled)
    )
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    schema = T.StructType(
        [chosen.schema["doc_id"], chosen.schema["quality"], T.StructField("features", T.ArrayType(T.DoubleType()))]
    )

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [text_features(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("quality"), pa.array(found, pa.list_(pa.float64()))],
                names=["doc_id", "quality", "features"],
            )

    rows = chosen.mapInArrow(measure, schema).orderBy(*order, "features").limit(max_labelled).collect()
    width = len(text_features(""))
    features = np.array([r["features"] for r in rows], float).reshape(len(rows), width)
    return fit_pairs(features, np.array([r["quality"] for r in rows], int), cut)


def score_texts(docs: DataFrame, model: QualityModel, keep: list[str], out: str) -> DataFrame:
    """The ``keep`` columns and the score ``out`` of each row's ``text``."""
    wanted = docs.select(*[f"`{c}`" for c in dict.fromkeys([*keep, "text"])])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            texts = batch.column(names.index("text"))
            features = np.array([text_features(t.as_py() or "") for t in texts], float)
            scores = model.scores(features) if len(features) else np.zeros(0)
            arrays = [batch.column(names.index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(scores, pa.float64())], names=[*keep, out])

    schema = T.StructType([*[wanted.schema[c] for c in keep], T.StructField(out, T.DoubleType())])
    return wanted.mapInArrow(score, schema)


def quality_scores(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per row."""
    model = fit_quality(docs, labels, **options)
    scored = score_texts(docs, model, ["doc_id"], "score")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= model.cut).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Rows whose score reaches the cut, all columns unchanged."""
    model = fit_quality(docs, labels, **options)
    score = fresh(docs, "score")
    scored = score_texts(docs, model, docs.columns, score)
    return scored.where(F.col(score) >= model.cut).select(*[f"`{c}`" for c in docs.columns])
