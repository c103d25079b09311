"""Bounded, reproducible samples of labelled documents, and small numpy helpers for fitting."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5. A null id counts as an empty text, so its fold is 0."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(5))


def held_out(doc_id: str = "doc_id") -> Column:
    """Fold 0 is never learned from."""
    return fold(doc_id) == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """(doc_id, text, label, fold) of at most `per_class` labelled documents of each class, none of them held out.

    The sample is that of the smallest hashes of doc_id, so it is the same on every run, and a document that is in
    it stays in it as a table grows until smaller hashes push it out. Rows without label or id are left out; of several
    labels of one id the largest counts; of several rows of one id the one whose text has the smallest hash is taken. So the
    sample has 2 * per_class rows at most. The ids chosen are broadcast, and only their texts are shuffled.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    known = known.select(F.col("doc_id").alias("_doc"), "label", F.xxhash64("doc_id").alias("_at"))
    chosen = None
    for c in (0, 1):
        part = known.filter(F.col("label") == c).orderBy("_at", "_doc").limit(per_class).drop("_at")
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("_doc"))
    one = found.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("at"), F.col("text").alias("text"))).alias("one"))
    return one.select("doc_id", "one.text", "label", fold().cast("int").alias("fold"))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def adam(params: list[np.ndarray], grads, steps: int, rate: float) -> list[np.ndarray]:
    """Minimise with Adam; grads(params, step) gives one gradient for each parameter."""
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, steps + 1):
        for i, g in enumerate(grads(params, t)):
            m[i] += 0.1 * (g - m[i])
            v[i] += 0.001 * (g * g - v[i])
            params[i] = params[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return params


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Weights (bias last) of a logistic regression, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * len(x) * np.eye(len(w)), x.T @ (p - y) + ridge * len(x) * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w
