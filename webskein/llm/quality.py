"""Operator 5, quality classifier: hashed word n-grams, logistic regression by FTRL-Proximal.

Words and pairs of words, of the text and of its shape (letters by case, digits, runs
collapsed, other signs kept), are hashed to DIMENSIONS weights. Training goes over a
bounded sample of labelled rows in one task; scoring is a sparse dot product a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, materialize, seeded, small_batches
from .jaccard_join import Shingler, _mix

#: Labelled rows that are learnt from at most, weights, passes over the sample.
SAMPLE_ROWS, DIMENSIONS, EPOCHS = 12_000, 1 << 18, 6
ALPHA, BETA, L1, L2 = 5.0, 1.0, 0.02, 0.05

_CLASS = bytes(ord("A") if 65 <= b <= 90 else ord("a") if 97 <= b <= 122 or b >= 128 else ord("0") if 48 <= b <= 57 else b for b in range(256))


class Features:
    """Indices (ascending) and values (of unit length) of a text's n-grams; none for texts without words."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.words = Shingler(1)
        self.mask = np.uint64(dimensions - 1)

    def grams(self, text: bytes, salt: int) -> list[np.ndarray]:
        w = self.words.words(text) + np.uint64(salt)
        return [_mix(w), _mix(w[:-1] * np.uint64(0x9E3779B97F4A7C15) + w[1:])]

    def of(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        text = text or b""
        shape = np.frombuffer(text.translate(_CLASS), dtype=np.uint8)
        shape = shape[np.concatenate([[True], shape[1:] != shape[:-1]])].tobytes() if len(shape) else b""
        grams = np.concatenate([*self.grams(text.lower(), 1), *self.grams(shape, 2)])
        at, n = np.unique(grams & self.mask, return_counts=True)
        x = np.log1p(n.astype(np.float64))
        return at.astype(np.int64), x / np.sqrt(x @ x) if len(x) else x


class Ftrl:
    """Follow the regularised leader, proximal, a rate for each weight; the last weight is the bias, without the L1 penalty."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.z, self.n = np.zeros(dimensions + 1), np.zeros(dimensions + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, l1 = self.z[at], np.where(at == len(self.z) - 1, 0.0, L1)
        w = (np.sign(z) * l1 - z) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def update(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        at, x = np.append(at, len(self.z) - 1), np.append(x, 1.0)
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, seed: int = 5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> np.ndarray:
    """Weights, the bias last, from at most sample_rows labelled rows, those of the least seeded
    hash, none of them held out, in the order of that hash. A row whose labels differ counts as
    the higher one. Only the weights reach the driver: DIMENSIONS numbers at most. No usable
    label: all weights 0."""
    usable = labels.where(F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col))).select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("label"))
    order = seeded(seed, F.col("__id"))
    sample = usable.groupBy("__id").agg(F.max("label").alias("label")).orderBy(order, "__id").limit(sample_rows)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("binary").alias("body")).join(F.broadcast(sample), "__id")
    rows = rows.select(order.alias("o"), F.xxhash64("body").alias("t"), "label", "body").where("body is not null").distinct()

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Features()
        for batch in batches:
            found = [make.of(t) for t in batch.column(3).to_pylist()]
            ends = pa.array(np.concatenate([[0], np.cumsum([len(f[0]) for f in found])]).astype(np.int32))
            at = np.concatenate([f[0] for f in found]) if found else np.empty(0)
            x = np.concatenate([f[1] for f in found]) if found else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.ListArray.from_arrays(ends, pa.array(at.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(x.astype(np.float32)))], names=["o", "t", "label", "at", "x"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Ftrl()
        rows = [(at.values.to_numpy().copy(), x.values.to_numpy().copy(), y.as_py()) for b in batches for at, x, y in zip(b.column(3), b.column(4), b.column(2), strict=True)]
        for _ in range(EPOCHS):
            for at, x, y in rows:
                model.update(at, x, y)
        w = model.weights(np.arange(len(model.z)))
        used = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(w[used], pa.float64())], names=["i", "w"])

    made = rows.mapInArrow(features, "o long, t long, label int, at array<int>, x array<float>")
    with small_batches(docs.sparkSession):
        made = materialize(made, "features")
    out = np.zeros(DIMENSIONS + 1)
    for r in made.repartition(1).sortWithinPartitions("o", "t", "label").mapInArrow(learn, "i long, w double").collect():
        out[r["i"]] = r["w"]
    return out


def quality(docs: DataFrame, labels: DataFrame, weights: np.ndarray | None = None, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, held_out, score (0 to 1), predicted (1 from threshold on) of every whole text.

    Only rows that are not held out teach. Null and empty texts have no features and
    score what the bias says; without labels every score is 0.5. Null ids count as held
    out; repeated rows are each scored; an empty table gives no rows; other columns are
    not read.
    """
    w = train(docs, labels, id_col=id_col, text_col=text_col) if weights is None else weights
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Features()
        for batch in batches:
            dots = np.empty(len(batch))
            for i, t in enumerate(batch.column(1).to_pylist()):
                at, x = make.of(t)
                dots[i] = w[at] @ x + w[-1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(dots, -35, 35))))], names=["id", "score"])

    out = docs.select(F.col(id_col), F.col(text_col).cast("binary")).mapInArrow(run, f"id {kind}, score double")
    with small_batches(docs.sparkSession):
        out = materialize(out, "scored")
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
