"""Bounded samples of labelled rows for the classifiers, and what they share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, where: Column | None = None, balanced: bool = False, salt: str = "sample") -> DataFrame:
    """(doc_id, text, lang, y) of about ``rows`` labelled documents at most, taken by a hash of the id.

    balanced: half of each class, as far as there are that many.  Rows with a
    null id, text or label are left out.  The sampled ids are broadcast: their
    number is bounded by ``rows``.
    """
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)")
    if where is not None:
        known = known.where(where)
    sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    total = sum(sizes.values())
    rate = {y: min(1.0, (rows / 2 / n) if balanced else rows / total) for y, n in sizes.items()}
    share = F.when(F.col("y") == 1, rate.get(1, 0.0)).otherwise(rate.get(0, 0.0))
    ids = known.where(F.pmod(F.xxhash64(F.lit(salt), "doc_id"), F.lit(1_000_000)) < share * 1_000_000)
    ids = ids.groupBy("doc_id").agg(F.max("y").alias("y"))
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), lang.alias("lang")).where("text IS NOT NULL")
    return texts.join(F.broadcast(ids), "doc_id")


def adam(state: dict, name: str, value: np.ndarray, grad: np.ndarray, rate: float, step: int) -> None:
    m, v = state.setdefault(name, (np.zeros_like(value), np.zeros_like(value)))
    m += 0.1 * (grad - m)
    v += 0.001 * (grad * grad - v)
    value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve from margins to probabilities, by Newton steps on smoothed targets."""
    pos, neg = float((y == 1).sum()), float((y == 0).sum())
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * margin + b)
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - target) * margin).sum() + 1e-3 * (a - 1), (p - target).sum()])
        h = np.array([[(w * margin * margin).sum() + 1e-3, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-7:
            break
    return (float(a), float(b)) if np.isfinite([a, b]).all() else (1.0, 0.0)
