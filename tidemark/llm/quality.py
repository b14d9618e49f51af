"""Quality classifier: supervised subword embeddings in the manner of fastText.

Words and byte n-grams are hashed into a table of learned vectors. A document is the average of the vectors of all its
features, a linear layer and softmax turn the average into class probabilities, and both layers are trained by stochastic
gradient descent in numpy on a bounded sample of labelled rows.

Scoring needs one number per table row, since the difference of the two class logits is linear in the average. The table is
of fixed size, so the model that travels to the tasks does not grow with the corpus.

Defined results: a null or empty text has no features and gets the score of the bias alone; every row is kept. Rows whose label is
null or neither 0 nor 1 are not learned from. Without labels of both classes the score is 0.5 for all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.hashing import mix, word_hashes
from tidemark.operators.distributed import top_per_key

GRAMS = (3, 5)
BITS = 18
_PIECE = 1 << 20


def features(text: str | None) -> Iterator[np.ndarray]:
    """Table rows of the word and n-gram features of a whole text, in pieces of bounded size."""
    raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
    shift = np.uint64(64 - BITS)
    yield (word_hashes(raw) >> shift).astype(np.int64)
    for n in GRAMS:
        for at in range(0, max(0, len(raw) - n + 1), _PIECE):
            piece = raw[at : at + _PIECE + n - 1].astype(np.uint64)
            length = len(piece) - n + 1
            value = np.full(length, n, dtype=np.uint64)
            for i in range(n):
                value = value << np.uint64(8) | piece[i : i + length]
            yield (mix(value) >> shift).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """Vectors of the features, weights and bias of the output layer, and the logit each feature adds."""

    vectors: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    @property
    def logits(self) -> np.ndarray:
        return (self.vectors @ (self.weights[:, 1] - self.weights[:, 0])).astype(np.float32)


def train(texts: list[str | None], labels: list[int], dim: int = 8, epochs: int = 8, rate: float = 0.5, seed: int = 7) -> Model:
    """Plain stochastic gradient descent with a rate that falls to zero; the same sample gives the same model."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (1 << BITS, dim)).astype(np.float32)
    weights, bias = np.zeros((dim, 2), dtype=np.float32), np.zeros(2, dtype=np.float32)
    bags = []
    for text in texts:
        rows, counts = np.unique(np.concatenate(list(features(text))), return_counts=True)
        bags.append((rows, (counts / max(1, counts.sum())).astype(np.float32)))
    steps, done = epochs * len(bags), 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            rows, share = bags[i]
            average = share @ vectors[rows]
            logit = average @ weights + bias
            p = np.exp(logit - logit.max())
            slope = p / p.sum()
            slope[labels[i]] -= 1
            step = np.float32(rate * (1 - done / steps))
            back = weights @ slope
            weights -= step * np.outer(average, slope)
            bias -= step * slope
            vectors[rows] -= step * np.outer(share, back)
            done += 1
    return Model(vectors, weights, bias)


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = 2000
) -> Model | None:
    """Train on at most ``sample_rows`` rows of each class: those with the smallest text hashes.

    The sample is a documented bound, and all that ever reaches the driver; None when a class is missing. It is chosen on ids and
    hashes, so no text is shuffled: the texts of the chosen rows come from a second scan that holds the bounded list.
    """
    hashed = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("hash"))
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1)")
    picked = top_per_key(hashed.join(marked, "id"), ["label"], [F.col("hash"), F.col("id")], sample_rows)
    few = docs.sparkSession.createDataFrame(picked.select("id", "hash", "label", "rank").collect(), "id long, hash long, label int, rank int")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("hash", F.xxhash64("text"))
    found = texts.join(F.broadcast(few), ["id", "hash"]).dropDuplicates(["label", "rank"]).select("text", "label", "rank")
    sample = sorted(found.collect(), key=lambda r: (r["rank"], r["label"]))
    if {r["label"] for r in sample} != {0, 1}:
        return None
    return train([r["text"] for r in sample], [r["label"] for r in sample])


def score(text: Column, model: Model | None) -> Column:
    """Probability of class 1 for a text column, from all words and n-grams of the whole text."""
    if model is None:
        return F.lit(0.5)
    table, start = model.logits, float(model.bias[1] - model.bias[0])

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = np.full(len(batch), start)
            for i, t in enumerate(batch):
                total, n = 0.0, 0
                for rows in features(t):
                    total, n = total + float(table[rows].sum(dtype=np.float64)), n + len(rows)
                out[i] += total / max(1, n)
            yield pd.Series(1 / (1 + np.exp(-np.clip(out, -500, 500))))

    return run(text.cast("string"))
