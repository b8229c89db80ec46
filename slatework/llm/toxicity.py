"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document's features are its distinct words, word pairs and pairs with one or two words between, hashed
to 2**BITS coordinates. Per-coordinate learning rates and the L1 term leave a few thousand weights, which
are all that is sent to the executors. Training is sequential by nature and runs in one task over a
bounded sample of the labelled rows (a documented parameter); scoring covers every text, in place.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


BITS = 20
#: Words hashed at once; overlapping pieces keep every gram of a long text.
CHUNK = 1 << 15
_TO_SPACE = bytes(c if chr(c).isalnum() or c > 127 or c == 39 else 32 for c in range(256))


def _fold(h: np.ndarray) -> np.ndarray:
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - BITS)).astype(np.int32)


def pieces(text: str | None) -> Iterator[np.ndarray]:
    """Feature coordinates of a text, with repeats, in pieces; a text without words has none."""
    words = (text or "").lower().encode("utf-8", "replace").translate(_TO_SPACE).split()
    for at in range(0, len(words), CHUNK):
        some = words[at : at + CHUNK + 3]
        h = np.fromiter(map(zlib.crc32, some), np.uint64, len(some))
        grams = [h]
        for gap in (1, 2, 3):
            if len(h) > gap:
                grams.append(h[:-gap] * np.uint64(0x100000001B3) + (h[gap:] << np.uint64(20)) + np.uint64(gap))
        yield _fold(np.concatenate(grams))


def features(text: str | None) -> np.ndarray:
    """The distinct coordinates of a text."""
    found = [np.unique(p) for p in pieces(text)]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int32)


def ftrl(rows: list[tuple[np.ndarray, int]], epochs: int, alpha: float, beta: float, l1: float, l2: float) -> tuple[np.ndarray, float]:
    """Weights and intercept after ``epochs`` passes in the given order."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias, bias_n = 0.0, 0.0

    def weigh(zi, ni):
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    for _ in range(epochs):
        for x, y in rows:
            zi, ni = z[x], n[x]
            w = weigh(zi, ni)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - y
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[x], n[x] = zi + g - sigma * w, ni + g * g
            bias_n += g * g
            bias -= alpha * g / (beta + np.sqrt(bias_n))
    return weigh(z, n), bias


@dataclass(frozen=True)
class Model:
    """Sparse weights: coordinates, values and the intercept."""

    at: np.ndarray
    weight: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        """The probability of the label; a text without words gets the intercept's."""
        where = np.full(1 << BITS, 0.0, np.float32) if not hasattr(self, "_dense") else self._dense
        if not hasattr(self, "_dense"):
            where[self.at] = self.weight
            object.__setattr__(self, "_dense", where)
        used = [np.unique(p[where[p] != 0]) for p in pieces(text)]
        x = np.unique(np.concatenate(used)) if used else np.zeros(0, np.int32)
        return float(1 / (1 + np.exp(-np.clip(where[x].sum(dtype=np.float64) + self.bias, -35, 35))))

    def __getstate__(self):
        return {"at": self.at, "weight": self.weight, "bias": self.bias}

    def __setstate__(self, state):
        for k, v in state.items():
            object.__setattr__(self, k, v)


def train(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    most_rows: int = 20000,
    most_bytes: int = 64 << 20,
    epochs: int = 5,
    alpha: float = 2.0,
    beta: float = 1.0,
    l1: float = 5.0,
    l2: float = 0.0,
    key: str = "doc_id",
    text: str = "text",
) -> Model:
    """Fit on at most ``most_rows`` labelled rows of ``most_bytes`` together, those with the smallest hash of their key.

    Null keys and labels are left out, a key with several labels counts as 1 if any is. Rows of one key with other texts
    are used each, equal rows once. Without any row the model is a coin toss. Training is one task, which the bounds keep small.
    """
    y = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where("k IS NOT NULL AND y IS NOT NULL").groupBy("k").agg(F.max("y").alias("y"))
    y = y.orderBy(F.xxhash64("k"), "k").limit(most_rows)
    held = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    # Chosen by light rows, so that neither many rows of a key nor long texts come together.
    light = held.select("key", "th", F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes")).join(F.broadcast(y), held["key"] == y["k"])  # most_rows small rows
    order = [F.xxhash64("key"), "key", "th"]
    light = light.select("key", "th", "bytes", "y").distinct().orderBy(*order).limit(most_rows)
    upto = F.sum("bytes").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    light = light.withColumn("upto", upto).where(F.col("upto") <= most_bytes).select(F.col("key").alias("k"), F.col("th").alias("h"), "y")
    chosen = held.join(F.broadcast(light), (held["key"] == F.col("k")) & (held["th"] == F.col("h"))).select("key", "th", "y", "text").dropDuplicates(["key", "th"])

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [(r.key, features(r.text), int(r.y)) for b in batches for r in b.itertuples()]
        rows.sort(key=lambda r: (zlib.crc32(str(r[0]).encode()), r[1].tobytes()))
        w, bias = ftrl([r[1:] for r in rows], epochs, alpha, beta, l1, l2)
        at = np.nonzero(w)[0]
        yield pd.DataFrame({"i": np.append(at, -1), "w": np.append(w[at], bias)})

    found = chosen.select("key", "y", "text").repartition(1).mapInPandas(fit, "i long, w double").toPandas()  # at most 2**BITS weights
    inside = found[found.i >= 0]
    bias = found.w[found.i < 0]
    return Model(inside.i.to_numpy(np.int32), inside.w.to_numpy(np.float32), float(bias.iloc[0]) if len(bias) else 0.0)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score (0 to 1) of every row, whole texts, nothing shuffled; null and empty texts get the intercept's score."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([model.score(t.as_py()) for t in b.column(1)], pa.float64())], ["key", "score"])

    return rows.mapInArrow(run, f"key {docs.schema[key].dataType.simpleString()}, score double")
