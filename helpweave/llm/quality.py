"""Quality: averaged hashed word and character n-gram vectors with a softmax output, trained by numpy SGD."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helpweave.llm.labelled import code_points, code_values, training_rows
from helpweave.llm.textnum import chunks, lists, prefix_sums, rolling_hash, span_hash
from helpweave.session import materialize

GRAMS = (3, 4)
BITS, DIM = 13, 16
#: Labelled documents that the model is fitted on, at most.
TRAIN_ROWS = 5_000
EPOCHS, BATCH, RATE = 15, 32, 4.0
REPEAT = np.uint64(0x2545F4914F6CDD1D)
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0]] = True


def tokens(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of every word and every character n-gram inside a word (blanks beside it count as its borders).

    A word equal to the one before it adds one token more, the same for all words, so that a stutter of unseen words is seen.
    """
    codes, at = code_points(data, bounds, lower=False)
    blank = (codes < 256) & BLANK[np.minimum(codes, 255)]
    codes = np.where(blank, np.uint32(32), codes)
    n = len(codes)
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    first = ~blank & (edge[:n] | np.r_[True, blank[:-1]][:n])
    last = ~blank & (edge[1:] | np.r_[blank[1:], True][:n])
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(at))
    prefix = prefix_sums(code_values(codes))
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    word = span_hash(prefix, start, end)
    again = np.flatnonzero((word[1:] == word[:-1]) & (row[start[1:]] == row[start[:-1]]))
    rows, hashes = [row[start], row[start[again]]], [word ^ np.uint64(0x5851F42D4C957F2D), np.full(len(again), REPEAT)]
    blanks = np.zeros(n + 1, np.int64)
    np.cumsum(blank, out=blanks[1:])
    stop = np.repeat(at[1:], np.diff(at))
    for g in GRAMS:
        h = rolling_hash(prefix, g)
        i = np.arange(len(h))
        i = i[(blanks[i + g - 1] == blanks[i + 1]) & (i + g <= stop[: len(h)])]
        rows.append(row[i])
        hashes.append(h[i])
    return np.concatenate(rows), (np.concatenate(hashes) >> np.uint64(64 - BITS)).astype(np.int64)


def bags(rows: DataFrame) -> DataFrame:
    """``doc_id, y, buckets, counts`` of the training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, bounds in chunks(b.column(0)):
                row, bucket = tokens(data, bounds)
                key, count = np.unique((row << BITS) | bucket, return_counts=True)
                size = np.bincount(key >> BITS, minlength=j - i)
                yield pa.RecordBatch.from_arrays(
                    [b.column(1).slice(i, j - i), b.column(2).slice(i, j - i),
                     lists((key & ((1 << BITS) - 1)).astype(np.int32), size, pa.int32()), lists(count.astype(np.int32), size, pa.int32())],
                    ["doc_id", "y", "buckets", "counts"])

    return rows.select("text", "doc_id", "y").mapInArrow(run, "doc_id long, y int, buckets array<int>, counts array<int>")


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Model:
    """Input vectors (bucket by dimension), output vectors (dimension by class) and class biases."""

    def __init__(self, vectors: np.ndarray, out: np.ndarray, bias: np.ndarray):
        self.vectors, self.out, self.bias = vectors, out, bias

    def token_logits(self) -> np.ndarray:
        """A token's share of the class logits; averaging vectors and averaging these are the same."""
        return self.vectors.astype(np.float64) @ self.out


def fit(rows: DataFrame) -> Model:
    """SGD over at most ``TRAIN_ROWS`` bags on the driver; the model has a fixed size. With one class only, the bias alone decides."""
    got = bags(rows).toArrow().sort_by("doc_id")
    y = (got["y"].to_numpy().astype(np.int64) > 0).astype(np.int64)
    rng = np.random.default_rng(11)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    n = np.bincount(y, minlength=2) + 0.5
    model = Model(vectors, np.zeros((DIM, 2)), np.log(n / n.sum()))
    if len(np.unique(y)) < 2:
        return model
    steps, total = 0, EPOCHS * -(-len(y) // BATCH)
    out = rng.normal(0, 0.1, (DIM, 2)).astype(np.float32)
    bias = model.bias.astype(np.float32)
    share = np.zeros((len(y), 1 << BITS), np.float32)
    held, count = got["buckets"].combine_chunks(), got["counts"].combine_chunks().flatten().to_numpy()
    share[np.repeat(np.arange(len(y)), held.value_lengths().to_numpy()), held.flatten().to_numpy()] = count
    share /= np.maximum(share.sum(axis=1, keepdims=True), 1)
    del got, held, count
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            pick = order[at : at + BATCH]
            bag = share[pick]
            hidden = bag @ vectors
            err = softmax(hidden @ out + bias)
            err[np.arange(len(pick)), y[pick]] -= 1
            rate = RATE * (1 - steps / total)
            back = err @ out.T
            out -= rate * 0.1 * (hidden.T @ err) / len(pick)
            bias -= rate * 0.02 * err.mean(axis=0)
            vectors -= rate * (bag.T @ back)
            steps += 1
    return Model(vectors, out.astype(np.float64), bias.astype(np.float64))


def train_quality(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Model fitted on at most ``rows`` documents that ``labels.quality`` marks, none of the held-out fold."""
    return fit(materialize(training_rows(documents, labels, "quality", rows)))


def score_quality(documents: DataFrame, model: Model, threshold: float = 0.3, column: str = "text") -> DataFrame:
    """``documents`` with ``score`` (probability of good text) and ``predicted`` (1 from ``threshold`` on).

    The score uses every token of the whole text. Null and empty texts, and texts of blanks only, have
    no tokens: the class biases decide. Rows are scored alone, so repeated rows score alike; other columns pass through;
    an empty table stays empty.
    """
    from pyspark.sql import types as T

    rest = documents.drop("score", "predicted")
    logits = model.token_logits()
    shared = documents.sparkSession.sparkContext.broadcast((logits[:, 1] - logits[:, 0], float(model.bias[1] - model.bias[0])))
    place = rest.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, bias = shared.value
        for b in batches:
            for i, j, data, bounds in chunks(b.column(place)):
                row, bucket = tokens(data, bounds)
                mean = np.bincount(row, weight[bucket], j - i) / np.maximum(np.bincount(row, minlength=j - i), 1)
                made = 1 / (1 + np.exp(-np.clip(mean + bias, -500, 500)))
                yield pa.RecordBatch.from_arrays([*b.slice(i, j - i).columns, pa.array(made)], names=[*b.schema.names, "score"])

    scored = rest.mapInArrow(run, T.StructType([*rest.schema.fields, T.StructField("score", T.DoubleType())]))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
