"""Bounded samples of labelled rows and the calibration shared by the trained scorers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def id_remainder(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids count as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds)).cast("int")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """doc_id, text and label of up to ``per_class`` labelled documents a class, and how many each class has.

    ``usable`` says which doc_ids may be learnt from. The sample is those with the smallest hashes of
    doc_id, so it is the same on every run; its ids are few enough to broadcast by construction. Rows of
    equal text and label enter once. An id with both labels counts as the larger one.
    """
    known = labels.where(usable & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label")).where("label in (0, 1)")
    population = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    first = [known.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    picked = first[0].union(first[1]).select(F.col("doc_id").alias("picked"), "label")
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).join(F.broadcast(picked), F.col("doc_id") == F.col("picked"))
    rows = rows.withColumns({"h": F.xxhash64("text"), "n": F.octet_length("text")}).dropDuplicates(["label", "h", "n"])
    return rows.select("doc_id", "text", "label"), population


def fit_logistic(x: np.ndarray, y: np.ndarray, population: dict[int, int], ridge: float = 1e-3) -> np.ndarray:
    """Weights (bias last) of a logistic regression with classes weighted to their share of the population."""
    seen, total = np.bincount(y, minlength=2), sum(population.values())
    prior = (population.get(1, 0) + 0.5) / (total + 1)
    if not seen.all():
        return np.append(np.zeros(x.shape[1]), np.log(prior / (1 - prior)))
    weight = np.where(y == 1, prior / seen[1], (1 - prior) / seen[0]) * len(y)
    middle, spread = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - middle) / spread, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (weight * (p - y)) + ridge * len(y) * np.append(w[:-1], 0)
        curve = (z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + ridge * len(y) * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    out = w[:-1] / spread
    return np.append(out, w[-1] - (out * middle).sum())


def logistic(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -500, 500)))
