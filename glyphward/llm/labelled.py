"""Bounded samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphward.llm.tables import fold_of


@dataclass
class Sample:
    texts: list[str]
    y: np.ndarray
    prior: float  # share of label 1 among all rows that may be learnt from


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, per_class: dict[int, int]) -> Sample:
    """At most ``per_class[k]`` documents of each label k, outside the held-out fold, in the order of a hash of the id.

    Rows with a null id or label are not learnt from; of an id with several labels the largest
    counts. Only the ids that are drawn (bounded by ``per_class``) are broadcast, and only their
    texts come to the driver.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y"))
    known = known.where(fold_of("doc_id", folds) != held_out).withColumn("by", F.xxhash64("doc_id"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    drawn = None
    for k, most in sorted(per_class.items()):
        part = known.where(F.col("y") == k).orderBy("by", "doc_id").limit(most).select("doc_id", "y")
        drawn = part if drawn is None else drawn.union(part)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(drawn), "doc_id").select("doc_id", "text", "y").toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    total = sum(counts.get(k, 0) for k in per_class)
    return Sample(rows.column("text").to_pylist(), rows.column("y").to_numpy().astype(np.int64), counts.get(1, 0) / total if total else 0.5)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Weights of a ridge logistic regression (the last is the intercept) by Newton's method."""
    x1 = np.c_[x, np.ones(len(x))]
    w = np.zeros(x1.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[-1, -1] = 1e-9
    weight = weight / weight.sum()
    for _ in range(steps):
        p = sigmoid(x1 @ w)
        gradient = x1.T @ (weight * (p - y)) + penalty @ w
        hessian = (x1 * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x1 + penalty
        step = np.linalg.solve(hessian, gradient)
        w -= step * min(1, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w
