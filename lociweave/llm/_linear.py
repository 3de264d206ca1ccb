"""Small sparse logistic models, fitted on a bounded sample of labelled rows.

Executors turn texts into sparse hashed features; only those of the sample reach
the driver, which fits the weights.  Scoring runs on the executors over all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import chosen


def sample_labelled(docs: DataFrame, labels: DataFrame, label: str, bound: int, seed: int) -> DataFrame:
    """(doc_id, text, label) of about `bound` labelled documents at most, chosen by a hash of doc_id.

    The labelled rows are few by the bound, so they are broadcast and only the sample's texts move.  A doc_id
    that is repeated counts once: of its texts the one that sorts first, of its labels the largest.
    """
    labels = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    n = labels.count()
    if n > bound:
        labels = labels.where(chosen(bound / n, seed, "doc_id"))
        if labels.isEmpty():
            raise RuntimeError(f"no row was sampled from {n} labelled documents")
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(labels), "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def gathered(features: DataFrame, most_bytes: int, *columns: str):
    """Rows of features for the driver, ordered by doc_id; as many documents as have `most_bytes` in the binary columns.

    Documents are taken in the order of a hash, and there are no more of them than the sample's bound.
    """
    size = sum((F.octet_length(c) for c in columns), F.lit(0).cast("long"))
    sizes = features.groupBy("doc_id").agg(F.sum(size).alias("size")).orderBy(F.xxhash64("doc_id")).toPandas()
    within = sizes["doc_id"][sizes["size"].cumsum() <= most_bytes].tolist()
    if len(within) < len(sizes):
        features = features.where(F.col("doc_id").isin(within))
    return features.toPandas().sort_values([c for c in ("doc_id", "form") if c in features.columns], kind="stable").reset_index(drop=True)


@dataclass
class Sparse:
    """Rows of sparse features: row numbers, feature numbers and values, and the number of rows."""

    row: np.ndarray
    index: np.ndarray
    value: np.ndarray
    rows: int

    @classmethod
    def of(cls, parts: list[tuple[np.ndarray, np.ndarray]]) -> Sparse:
        row = np.repeat(np.arange(len(parts), dtype=np.int32), [len(i) for i, _ in parts])
        index = np.concatenate([np.zeros(0, np.int32), *(i for i, _ in parts)]).astype(np.int32)
        value = np.concatenate([np.zeros(0, np.float32), *(v for _, v in parts)]).astype(np.float32)
        return cls(row, index, value, len(parts))

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * weights[self.index], self.rows)

    def back(self, errors: np.ndarray, dim: int) -> np.ndarray:
        return np.bincount(self.index, self.value * errors[self.row], dim)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_logistic(x: Sparse, y: np.ndarray, dim: int, l2: float, steps: int, pairs: Sparse | None = None, pair_weight: float = 0.0, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise log loss + l2 |w|^2 + pair_weight mean((pairs w)^2), by Adam.

    Both classes weigh alike.  `pairs` holds differences of features whose scores should not differ.
    """
    weights, bias = np.zeros(dim), 0.0
    share = max(1e-9, y.mean())
    balance = np.where(y == 1, 0.5 / share, 0.5 / max(1e-9, 1 - share)) / len(y)
    m, v, t = np.zeros(dim + 1), np.zeros(dim + 1), 0
    for t in range(1, steps + 1):
        errors = (sigmoid(x.dot(weights) + bias) - y) * balance
        slope = np.append(x.back(errors, dim) + 2 * l2 * weights, errors.sum())
        if pairs is not None and pairs.rows:
            slope[:-1] += pairs.back(2 * pair_weight * pairs.dot(weights) / pairs.rows, dim)
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope * slope
        move = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8) * (1 - 0.9 * t / steps)
        weights, bias = weights - move[:-1], bias - move[-1]
    return weights, float(bias)


def fit_platt(scores: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, offset) with sigmoid(slope * score + offset) a calibrated probability; smoothed targets, Newton steps."""
    if len(scores) == 0:
        return 1.0, 0.0
    positive = y.sum()
    target = np.where(y == 1, (positive + 1) / (positive + 2), 1 / (len(y) - positive + 2))
    a, b = 1.0, 0.0
    x = np.stack([scores, np.ones_like(scores)])
    for _ in range(50):
        p = sigmoid(a * scores + b)
        hessian = (x * (p * (1 - p))) @ x.T + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, x @ (p - target))
        step = np.clip(step, -2, 2)
        a, b = a - step[0], b - step[1]
    return float(max(a, 1e-6)), float(b)
