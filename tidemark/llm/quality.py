"""Quality classifier: naive Bayes support vectors over byte n-gram indicators.

Texts become sets of hashed byte 1- to 3-grams. Class log-count ratios scale the indicators, and a
linear hinge-loss model is fitted on the scaled indicators by dual coordinate descent; a logistic curve
over its margins gives the score. The model is fitted on at most TRAIN_ROWS labelled rows, the ones
whose ids hash lowest; every row is scored on its whole text. Labels, language, source and id are never
inputs of a score.

Defined results: a null text counts as empty and scores by the bias alone. Rows without a usable label
train nothing; where only one class is labelled every score is 1 for that class or 0, and 0.5 where
nothing is labelled. Repeated labels of a row train once (the smaller label).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import arrow_rows, ships

ships(__name__)

TRAIN_ROWS = 6000
FEATURES = 1 << 16
EPOCHS = 12
COST = 1.0


def indicators(text: bytes, seen: np.ndarray) -> np.ndarray:
    """Sorted feature numbers of the n-grams of a text; seen is a cleared array of FEATURES flags."""
    b = np.frombuffer(text, np.uint8).astype(np.uint32)
    seen[b] = True
    if len(b) > 1:
        pair = b[:-1] * np.uint32(257) + b[1:] + np.uint32(1)
        seen[(pair * np.uint32(2654435761)) >> np.uint32(16)] = True
        if len(b) > 2:
            triple = pair[:-1] * np.uint32(8191) + b[2:] * np.uint32(31) + np.uint32(7)
            seen[(triple * np.uint32(2246822519)) >> np.uint32(16)] = True
    found = np.flatnonzero(seen)
    seen[found] = False
    return found


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(FEATURES, bool)
    for batch in batches:
        sets = [indicators(x.as_py() or b"", seen).astype(np.uint16).tobytes() for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), pa.array(sets, pa.binary())], ["label", "found"])


class Model:
    """weights: hinge weight times log-count ratio of each feature; slope and shift turn margins into scores."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float, shift: float):
        self.weights, self.bias, self.slope, self.shift = weights, bias, slope, shift

    def score(self, found: np.ndarray) -> float:
        margin = self.bias + (self.weights[found].sum() / np.sqrt(len(found)) if len(found) else 0.0)
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -500, 500))))


def log_count_ratios(sets: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    counts = np.ones((2, FEATURES))
    for found, label in zip(sets, y):
        counts[label, found] += 1
    shares = counts / counts.sum(axis=1, keepdims=True)
    return np.log(shares[1] / shares[0])


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Hinge loss with an L2 penalty by dual coordinate descent; the bias is a feature of value one."""
    w, bias = np.zeros(FEATURES), 0.0
    dual = np.zeros(len(rows))
    sign = np.where(y == 1, 1.0, -1.0)
    norms = np.array([v @ v + 1.0 for v in values])
    order = np.random.default_rng(7)
    for _ in range(epochs):
        moved = 0.0
        for k in order.permutation(len(rows)):
            gradient = sign[k] * (w[rows[k]] @ values[k] + bias) - 1
            new = min(max(dual[k] - gradient / norms[k], 0.0), cost[k])
            step = (new - dual[k]) * sign[k]
            if step:
                w[rows[k]] += step * values[k]
                bias += step
                moved = max(moved, abs(step))
                dual[k] = new
        if moved < 1e-4:
            break
    return w, bias


def logistic_curve(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through the margins, with smoothed targets, by Newton steps."""
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margins, np.ones(len(margins))], axis=1)
    balance = np.where(y == 1, 0.5 / n1, 0.5 / n0)
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (balance * (p - target)) + 1e-6 * beta
        hess = (x * (balance * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def fit(sets: list[np.ndarray], y: np.ndarray) -> Model:
    y = np.asarray(y, np.int64)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(FEATURES), 0.0, 0.0, 0.0 if not len(y) else (1000.0 if y[0] else -1000.0))
    ratios = log_count_ratios(sets, y)
    values = [ratios[found] / np.sqrt(max(1, len(found))) for found in sets]
    share = np.bincount(y, minlength=2) / len(y)
    w, bias = dual_descent(sets, values, y, COST * 0.5 / share[y])
    margins = np.array([w[f] @ v + bias for f, v in zip(sets, values)])
    return Model(w * ratios, bias, *logistic_curve(margins, y))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS) -> Model:
    """Fit on the rows of `labels` given, at most `rows` of them; labels may hold other ids too."""
    arrow_rows(docs.sparkSession)
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("label"))
    chosen = usable.orderBy(F.xxhash64("id"), "id").limit(rows)  # the bound that makes it safe to broadcast
    marked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).join(F.broadcast(chosen), "id")
    found = marked.select("label", "text").mapInArrow(_featurise, "label int, found binary").collect()
    found.sort(key=lambda r: (r.label, bytes(r.found)))
    return fit([np.frombuffer(r.found, np.uint16).astype(np.int64) for r in found], np.array([r.label for r in found], np.int64))


def scored(docs: DataFrame, model: Model, text_col: str = "text", only: float | None = None, score_col: str = "score") -> DataFrame:
    """docs with a column `score_col`; with `only`, just the rows that score at least so much."""
    arrow_rows(docs.sparkSession)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.weights, model.bias, model.slope, model.shift))
    names = docs.columns
    slot = "_score_text"
    at = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, seen = Model(*shared.value), np.zeros(FEATURES, bool)
        for batch in batches:
            score = np.fromiter((m.score(indicators(x.as_py() or b"", seen)) for x in batch.column(at)), np.float64, batch.num_rows)
            out = pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(score)], [*names, score_col])
            yield out if only is None else out.filter(pa.array(score >= only))

    schema = T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())])
    return docs.withColumn(slot, F.col(text_col).cast("binary")).mapInArrow(run, schema)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, held_out, score, predicted. Rows whose id's CRC-32 leaves 1 over 3 are held out of the fit."""

    def held(name: str):
        return F.coalesce(F.crc32(F.col(name).cast("string")) % 3 == 1, F.lit(False))

    model = train(docs, labels.where(~held(id_col)), id_col, text_col)
    out = scored(docs.select(id_col, text_col), model, text_col)
    return out.select(id_col, held(id_col).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
