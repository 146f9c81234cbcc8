"""A quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader.

Training takes a bounded, documented sample of the labelled rows. The sample is dealt into shards of bounded size; each
shard's weights are trained in its own task (FTRL-Proximal, McMahan et al. 2013) and the shards' weights are averaged.
Scoring is a sparse dot product per document with the averaged weights, in the task that reads the text: no shuffle.

Cases: a null text counts as empty and is scored by the intercept alone; null labels are not learned from; an id with
several labels counts as its smallest; without any usable label every score is one half; an empty table gives an
empty result; other columns are never looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idscreen.llm.shared import WordHashes, binary_values, mixed

BITS = 18
MAX_TRAINING_ROWS = 24_000
SHARD_ROWS = 6_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.0, 0.0
_SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_SAME_WORD = 0x165667B19E3779F9


class NGrams:
    """Hashed features of a text: runs of letters and digits and runs of marks are words; single words and pairs count.

    A word followed by itself also counts as one shared feature, so that repetition is learned whatever the word. The value of a
    feature is the logarithm of its count, scaled so that a text has length 1; the last feature is the intercept.
    """

    def __init__(self, bits: int) -> None:
        self._bits = bits
        self._hashes = WordHashes()
        self._word = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x00-\x20]+")

    def of(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        h = self._hashes.of(self._word.findall(text))
        if not len(h):
            return np.array([1 << self._bits]), np.ones(1)
        follows = h[:-1] == h[1:]
        pairs = mixed(h[:-1] * np.uint64(_SEEDS[0]) + h[1:] * np.uint64(_SEEDS[1]))
        grams = np.concatenate([h, pairs, np.full(int(follows.sum()), _SAME_WORD, np.uint64)])
        index, counts = np.unique((grams >> np.uint64(64 - self._bits)).astype(np.int64), return_counts=True)
        values = np.log1p(counts)
        values /= np.sqrt((values * values).sum())
        return np.append(index, 1 << self._bits), np.append(values, 1.0)


def _sigmoid(x: float) -> float:
    return float(1.0 / (1.0 + np.exp(-min(35.0, max(-35.0, x)))))


def ftrl(rows: list[tuple[tuple[np.ndarray, np.ndarray], int]], bits: int, epochs: int) -> np.ndarray:
    """Weights after `epochs` passes of FTRL-Proximal over (features, label), in a fixed pseudorandom order."""
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0.0)
        return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            (index, values), label = rows[k]
            zi, ni = z[index], n[index]
            w = weights(zi, ni)
            gradient = (_sigmoid(w @ values) - label) * values
            grown = ni + gradient * gradient
            z[index] = zi + gradient - (np.sqrt(grown) - np.sqrt(ni)) / ALPHA * w
            n[index] = grown
    return weights(z, n)


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    label: str = "label",
    max_rows: int = MAX_TRAINING_ROWS,
    shard_rows: int = SHARD_ROWS,
    bits: int = BITS,
    epochs: int = EPOCHS,
) -> np.ndarray:
    """The averaged weights of all shards; labels are (id, 0 or 1).

    About `max_rows` labelled ids are taken, those with the smallest hashes, so the sample is the same in every run and
    its size is all that reaches the driver: max_rows / shard_rows vectors of 2 ** bits weights.
    """
    usable = (
        labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("doc_id"))
        .agg(F.min(F.col(label).cast("int")).alias("label"))
    )
    total = usable.count()
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    share = int((1 << 30) * min(1.0, max_rows / max(total, 1)))
    shards = max(1, -(-min(total, max_rows) // shard_rows))
    sample = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")).where(place < share)
    joined = sample.join(usable.where(place < share), "doc_id")
    dealt = joined.select(
        F.pmod(F.xxhash64(F.lit("shard"), "doc_id"), F.lit(shards)).alias("shard"), "doc_id", "text", "label"
    )

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        grams = NGrams(bits)
        frame = frame.sort_values("doc_id")
        rows = [(grams.of((t or "").encode()), int(y)) for t, y in zip(frame["text"], frame["label"])]
        vector = ftrl(rows, bits, epochs).astype("<f4").tobytes()
        return pd.DataFrame({"shard": frame["shard"].iloc[:1], "rows": [len(rows)], "weights": [vector]})

    fitted = dealt.groupBy("shard").applyInPandas(fit, "shard bigint, rows bigint, weights binary").collect()
    if not fitted:
        return np.zeros((1 << bits) + 1, np.float32)
    vectors = np.stack([np.frombuffer(r["weights"], "<f4") for r in sorted(fitted, key=lambda r: r["shard"])])
    return vectors.mean(axis=0).astype(np.float32)


def add_score(docs: DataFrame, weights: np.ndarray, text: str, name: str) -> DataFrame:
    """Adds the probability of label 1. The weights go to the executors once; their size is fixed by the bits."""
    bits = (len(weights) - 1).bit_length() - 1
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    # only texts go to Python and only scores come back; other columns stay where they are
    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        w, grams = shared.value.astype(np.float64), NGrams(bits)
        for column in texts:
            scores = []
            for raw in binary_values(column):
                index, values = grams.of(raw)
                scores.append(_sigmoid(w[index] @ values))
            yield pa.array(scores, pa.float64())

    return docs.withColumn(name, score(F.col(text)))
