"""Quality score from a byte-level convolutional network in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidlake.llm.labelled import fit_logistic, id_remainder, labelled_sample, logistic

HALF = 128  # a chunk is two neighbouring halves, so chunks overlap by half
_SLAB = 512 * HALF


@dataclass
class Network:
    """filters[k, byte, f]: what a byte at place k adds to filter f; top weighs the pooled filters."""

    filters: np.ndarray
    bias: np.ndarray
    top: np.ndarray
    weights: np.ndarray

    def halves(self, data: np.ndarray) -> np.ndarray:
        """Largest response of every filter in each half chunk of a byte array."""
        width = len(self.filters)
        padded = np.concatenate([data, np.zeros(max(0, width - len(data)) + width - 1, np.uint8)])
        n, out = max(len(data), 1), []
        for lo in range(0, n, _SLAB):
            size = min(_SLAB, n - lo)
            z = self.filters[0][padded[lo : lo + size]]
            for k in range(1, width):
                z += self.filters[k][padded[lo + k : lo + k + size]]
            out.append(np.maximum.reduceat(z, np.arange(0, size, HALF), axis=0))
        return np.maximum(np.concatenate(out) + self.bias, 0)

    def logit(self, text: str | None) -> float:
        """Chunk maxima averaged and maximised over the whole document, weighed into one number."""
        half = self.halves(np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8))
        chunks = np.maximum(half[:-1], half[1:]) if len(half) > 1 else half
        return float(np.concatenate([chunks.mean(0), chunks.max(0), [1.0]]) @ self.top)


def fit(texts: list[str], labels: np.ndarray, filters: int = 16, width: int = 5, epochs: int = 6, batch: int = 32, rate: float = 0.02, seed: int = 7) -> Network:
    """Trains by Adam on the logistic loss; the gradient reaches a filter through its maxima only."""
    rng = np.random.default_rng(seed)
    net = Network(rng.normal(0, 0.2, (width, 256, filters)).astype("f4"), np.zeros(filters, "f4"), np.zeros(2 * filters + 1, "f4"), np.array([1.0, 0.0]))
    net.top[: 2 * filters] = rng.normal(0, 0.1, 2 * filters)
    params = [net.filters, net.bias, net.top]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    data = [np.frombuffer((t or "").encode("utf-8", "surrogatepass"), np.uint8) for t in texts]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(data))
        for lo in range(0, len(order), batch):
            slopes = [np.zeros_like(p) for p in params]
            chosen = order[lo : lo + batch]
            for i in chosen:
                padded = np.concatenate([data[i], np.zeros(width, np.uint8)])
                n = max(len(data[i]), 1)
                z = sum(net.filters[k][padded[k : k + n]] for k in range(width))
                blocks = -(-n // HALF)
                full = np.full((blocks * HALF, filters), -np.inf, "f4")
                full[:n] = z
                full = full.reshape(blocks, HALF, filters)
                where = full.argmax(1)
                half = np.take_along_axis(full, where[:, None], 1)[:, 0]
                where += np.arange(blocks)[:, None] * HALF
                if blocks > 1:
                    second = half[1:] > half[:-1]
                    chunk, at = np.where(second, half[1:], half[:-1]), np.where(second, where[1:], where[:-1])
                else:
                    chunk, at = half, where
                value = np.maximum(chunk + net.bias, 0)
                mean, peak = value.mean(0), value.argmax(0)
                x = np.concatenate([mean, value.max(0), [1.0]])
                error = 1 / (1 + np.exp(-np.clip(x @ net.top, -30, 30))) - labels[i]
                slopes[2] += error * x
                down = np.tile(error * net.top[:filters] / len(value), (len(value), 1))
                down[peak, np.arange(filters)] += error * net.top[filters:-1]
                down *= value > 0
                slopes[1] += down.sum(0)
                for k in range(width):
                    np.add.at(slopes[0][k], (padded[at + k], np.arange(filters)[None, :]), down)
            step += 1
            for p, g, (m, v) in zip(params, slopes, moments, strict=True):
                g /= len(chosen)
                m[:], v[:] = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def train(
    docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 3, held: int = 1, per_class: int = 1500, max_bytes: int = 1 << 15, per_class_slabs: int = 3000, **options
) -> Network:
    """Learns from labelled rows whose id remainder modulo ``folds`` is not ``held``.

    At most ``per_class`` documents of each class go to the driver for fitting, those with the smallest hashes. One of
    over ``max_bytes`` enters in slabs of a quarter as many characters, each with its document's label; of slabs and
    short documents together ``per_class_slabs`` a class enter, again by hash. That bounds the sample; scoring covers
    whole documents of any length. A fifth of the documents calibrates the probability to the classes' true shares.
    """
    usable = id_remainder(F.col("doc_id"), folds) != held
    sample, population = labelled_sample(docs, labels, label, usable, per_class)
    size = max_bytes // 4
    starts = F.when(F.octet_length("text") > max_bytes, F.sequence(F.lit(1), F.length("text"), F.lit(size))).otherwise(F.array(F.lit(1)))
    slab = F.when(F.octet_length("text") > max_bytes, F.substr(F.col("text"), F.col("start"), F.lit(size))).otherwise(F.col("text"))
    slabs = sample.select("doc_id", "label", "text", F.explode(starts).alias("start")).select("doc_id", "label", "start", slab.alias("text"), F.pmod(F.xxhash64("doc_id"), F.lit(5)).alias("part"))
    first = [slabs.where(F.col("label") == k).orderBy(F.xxhash64("doc_id", "start"), "doc_id", "start", "text").limit(per_class_slabs) for k in (0, 1)]
    rows = first[0].unionAll(first[1]).toPandas().sort_values(["doc_id", "label", "start"])
    learn, check = rows[rows["part"] > 0], rows[rows["part"] == 0]
    net = fit(learn["text"].tolist(), learn["label"].to_numpy(int), **options)
    logits = np.array([[net.logit(t)] for t in check["text"]]).reshape(-1, 1)
    net.weights = fit_logistic(logits, check["label"].to_numpy(int), population)
    return net


def score_quality(docs: DataFrame, net: Network, threshold: float = 0.5) -> DataFrame:
    """All rows and columns of ``docs`` with score (0 to 1) and predicted (1 from ``threshold`` on).

    Null and empty texts are one chunk of padding and get its score. Columns named score or predicted
    are replaced. Every row is scored on its own, so repeated rows and null ids are like others; an empty table gives
    an empty result. Very long texts are read whole, their filters in slabs.
    """
    held = docs.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(logistic(np.array([[held.value.logit(t)] for t in texts]).reshape(-1, 1), held.value.weights))

    return docs.withColumn("score", score("text")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
