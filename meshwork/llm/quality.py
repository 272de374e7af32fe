"""Quality scores: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates.

A text's features are its distinct hashed words, word pairs and shapes of words (letters, digits and other
characters folded to one sign each, and whether a word repeats the one before), each with the same weight, scaled to
length one. A score is a sparse dot product.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.llm.common import U64, WordHasher, blocks, byte_set, map_batches, mix64

DIMENSIONS = 1 << 18
#: Labelled training rows at most: those with the smallest hashes of their ids.
MAX_TRAINING = 8000
_A, _B, _C = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9)


class Features:
    """Distinct dimensions of each text, ascending."""

    def __init__(self):
        inside = byte_set(lambda b: b != 32 and not 9 <= b <= 13)
        self.words, self.shapes = WordHasher(inside, lower=False), WordHasher(inside, lower=False)
        own = self.shapes.values.copy()
        for group in (range(65, 91), range(97, 123), range(48, 58), range(128, 256)):
            own[list(group)] = own[group[0]]
        own[128:] = own[97]  # letters beyond ASCII count as small ones
        self.shapes.values = own

    def __call__(self, column: pa.Array):
        for _, n, raw, bounds in blocks(column):
            words, start, end, at = self.words(raw, bounds)
            # a word's shape: its first two and last two signs
            values = self.shapes.values[raw] if len(raw) else np.zeros(0, U64)
            with np.errstate(over="ignore"):
                last = end - 1
                shape = mix64(values[start] * _A + values[np.minimum(start + 1, last)] * _B + values[np.maximum(last - 1, start)] * _C + values[last]) if len(start) else words
                same = np.zeros(len(words), U64)
                same[1:] = words[1:] == words[:-1]
                same[at[:-1][at[:-1] < at[1:]]] = 0  # a text's first word has none before it
                shape = shape + same
                pair = mix64(words[:-1] * _A + words[1:]) + U64(1)
                shapes = mix64(shape[:-1] * _B + shape[1:]) + U64(2)
            for i in range(n):
                a, z = at[i], at[i + 1]
                yield np.unique(np.concatenate([words[a:z], shape[a:z], pair[a : max(a, z - 1)], shapes[a : max(a, z - 1)]]) % U64(DIMENSIONS)).astype(np.int32)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float

    def score(self, dims: np.ndarray) -> float:
        z = self.bias + (float(self.weights[dims].sum()) / np.sqrt(len(dims)) if len(dims) else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def learn(rows: list[tuple[np.ndarray, int]], epochs: int = 5, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5) -> Model:
    """FTRL-proximal, one row after another in the given order; the last place is the bias. No rows: all scores 0.5."""
    z, n = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)

    def weights(zi, ni):
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    for _ in range(epochs):
        for dims, y in rows:
            at = np.append(dims, DIMENSIONS)
            x = np.full(len(at), 1 / np.sqrt(max(1, len(dims))))
            x[-1] = 1.0
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
            g = (p - y) * x
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[at] = zi + g - sigma * w
            n[at] = ni + g * g
    w = weights(z, n)
    return Model(w[:-1].astype(np.float32), float(w[-1]))


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAINING, label: str = "quality") -> Model:
    """Learns from labelled rows that are not held out: the `most` with the smallest hash of the id, in that order.

    Labels that are null, or whose doc_id is null or not in docs, are left out; a repeated label counts once, and of
    texts that share its id the least is taken. Whole texts become features on the
    executors and only those are collected.
    """
    told = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isNotNull())
    told = told.where(~held_out(F.col("id"))).withColumn("rank", F.xxhash64("id")).orderBy("rank", "id", "y").limit(most)  # at most `most` small rows
    rows = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(told), "id")
    rows = rows.groupBy("rank", "id", "y").agg(F.min("text").alias("text"))  # one row of each label, however often its id repeats

    def run(batches):
        make = Features()
        for batch in batches:
            data = [d.tobytes() for d in make(batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(data, pa.binary())], names=["rank", "y", "data"])

    found = sorted((r["rank"], r["y"], bytes(r["data"])) for r in map_batches(rows, run, "rank long, y int, data binary").toLocalIterator())
    return learn([(np.frombuffer(d, np.int32), y) for _, y, d in found])


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    Empty and null texts score by the bias alone. Rows are scored one by one by their whole texts; repeated rows score
    alike, a null id is not held out; no labels at all give 0.5 everywhere. Other columns are not read.
    """
    model = model or train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        make, own = Features(), shared.value
        for batch in batches:
            scores = [own.score(d) for d in make(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return map_batches(rows, run, f"doc_id {kind}, held_out boolean, score double, predicted int")
