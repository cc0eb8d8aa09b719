"""Toxicity: linear classifier over character n-grams scaled by naive Bayes log-count ratios; the strongest piece of a text counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helpweave.llm.labelled import code_points, code_values, held_out, training_rows
from helpweave.llm.textnum import chunks, lists, prefix_sums, rolling_hash
from helpweave.session import materialize

GRAMS = (3, 4, 5, 6)
#: Code points of a piece, and from one piece's start to the next: every passage of at most ``STEP`` stands whole in a piece.
PIECE, STEP = 2048, 1024
#: Labelled documents that the model is fitted on, at most.
TRAIN_ROWS = 12_000
#: n-grams of the pieces of training texts that the driver holds, at most on average (4 bytes each); of more, fewer texts are fitted.
TRAIN_GRAMS = 16_000_000
#: n-grams of the training pieces that are summed together.
BLOCK = 1 << 20
#: Least contrast (log-likelihood ratio, distributed as chi-square) of the n-grams that stay in the linear model.
CONTRAST = 20.0
SMOOTH = 0.5
STEPS, RIDGE = 300, 3e-3
#: Leading hash bits of a table that most other n-grams fail; full hashes are compared after it.
FILTER_BITS = 20
#: Distinct n-grams that a counting task holds before it sends them on.
HELD = 1_000_000


class Chosen:
    """Sorted 64-bit hashes of the model's n-grams."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.maybe = np.zeros(1 << FILTER_BITS, bool)
        self.maybe[(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``h`` that hold a chosen hash, and which one."""
        i = np.flatnonzero(self.maybe[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        if not len(i):
            return i, i
        at = np.minimum(np.searchsorted(self.hashes, h[i]), len(self.hashes) - 1)
        ok = self.hashes[at] == h[i]
        return i[ok], at[ok]


def _positions(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix sums of the lower-cased code points, row bounds among them and the row of each."""
    codes, at = code_points(data, bounds, lower=True)
    return prefix_sums(code_values(codes)), at, np.repeat(np.arange(len(bounds) - 1), np.diff(at))


def all_grams(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every distinct n-gram of each row."""
    prefix, at, row = _positions(data, bounds)
    rows, hashes = [], []
    for n in GRAMS:
        h = rolling_hash(prefix, n)
        i = np.arange(len(h))
        i = i[i + n <= at[1:][row[: len(h)]]]
        order = np.lexsort((h[i], row[i]))
        r, h = row[i][order], h[i][order]
        new = np.r_[True, (r[1:] != r[:-1]) | (h[1:] != h[:-1])][: len(r)]
        rows.append(r[new])
        hashes.append(h[new])
    return np.concatenate(rows), np.concatenate(hashes)


def grams(data: np.ndarray, bounds: np.ndarray, chosen: Chosen) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Piece and number of every distinct chosen n-gram of each piece, in order, and the bounds of each row's pieces.

    The pieces overlap and cover the whole text; a text of at most ``PIECE`` code points is one piece.
    """
    prefix, at, row = _positions(data, bounds)
    count = 1 + np.maximum(0, -(-(np.diff(at) - PIECE) // STEP))
    first = np.r_[0, np.cumsum(count)]
    keys = []
    for n in GRAMS:
        i, which = chosen.find(rolling_hash(prefix, n))
        ok = i + n <= at[1:][row[i]]
        i, which = i[ok], which[ok]
        r, place = row[i], i - at[row[i]]
        for back in range(PIECE // STEP):
            piece = place // STEP - back
            ok = (piece >= 0) & (piece < count[r]) & (place + n <= piece * STEP + PIECE)
            keys.append((first[r] + piece)[ok] * len(chosen.hashes) + which[ok])
    key = np.unique(np.concatenate(keys))
    size = max(1, len(chosen.hashes))
    return key // size, key % size, first


def gram_counts(rows: DataFrame) -> DataFrame:
    """``h, pos, neg``: documents of each class that hold the n-gram of that hash; summed in tasks first."""

    def sums(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = np.concatenate([p[0] for p in parts])
        order = np.argsort(h, kind="stable")
        h = h[order]
        new = np.flatnonzero(np.r_[True, h[1:] != h[:-1]][: len(h)])
        pos, neg = (np.add.reduceat(np.concatenate([p[k] for p in parts])[order], new) if len(new) else np.zeros(0, np.int64) for k in (1, 2))
        return h[new], pos, neg

    def send(part) -> Iterator[pa.RecordBatch]:
        h, pos, neg = part
        for i in range(0, len(h), 100_000):
            j = i + 100_000
            yield pa.RecordBatch.from_arrays([pa.array(h[i:j].view(np.int64)), pa.array(pos[i:j]), pa.array(neg[i:j])], ["h", "pos", "neg"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = None
        for b in batches:
            y = b.column(1).to_numpy()
            for i, j, data, bounds in chunks(b.column(0), 1 << 18):
                row, h = all_grams(data, bounds)
                pos = (y[i:j][row] > 0).astype(np.int64)
                part = sums([(h, pos, 1 - pos)])
                seen = part if seen is None else sums([seen, part])
                if len(seen[0]) > HELD:
                    yield from send(seen)
                    seen = None
        if seen is not None:
            yield from send(seen)

    return rows.select("text", "y").mapInArrow(run, "h long, pos long, neg long").groupBy("h").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def features(rows: DataFrame, hashes: np.ndarray) -> DataFrame:
    """``turn, y, grams``: for each piece of each training text, the numbers of the chosen n-grams it holds; ``turn`` is the text's place in a random order (0 to 1)."""
    shared = rows.sparkSession.sparkContext.broadcast(hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = Chosen(shared.value)
        for b in batches:
            for i, j, data, bounds in chunks(b.column(0)):
                piece, which, first = grams(data, bounds, chosen)
                held = lists(which.astype(np.int32), np.bincount(piece, minlength=first[-1]), pa.int32())
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(i, j - i) for k in (1, 2)), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), held)], ["turn", "y", "grams"])

    turn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) / float(1 << 40)
    return rows.select("text", turn.alias("turn"), "y").mapInArrow(run, "turn double, y int, grams array<array<int>>")


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


def _flat(held: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Label and pieces of each text, n-grams of each piece, and their numbers one after the other, without a second copy of the table."""
    table = held.toArrow()
    y = (table["y"].to_numpy() > 0).astype(float)
    lists_ = [c for c in table["grams"].chunks if len(c)]
    del table
    pieces, size, col = [], [], []
    while lists_:
        c = lists_.pop(0)
        inner = c.flatten()
        pieces.append(c.value_lengths().to_numpy())
        size.append(inner.value_lengths().to_numpy())
        col.append(inner.flatten().to_numpy())
    return (y, *(np.concatenate(x) if x else np.zeros(0, np.int32) for x in (pieces, size, col)))


def _piece_sums(weight: np.ndarray, col: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of the weights of each piece's n-grams, a block of pieces at a time."""
    out = np.zeros(len(at) - 1)
    i = 0
    while i < len(out):
        j = max(i + 1, int(np.searchsorted(at, at[i] + BLOCK, "right")) - 1)
        filled = np.flatnonzero(at[i + 1 : j + 1] > at[i:j]) + i
        if len(filled):
            out[filled] = np.add.reduceat(weight[col[at[i] : at[j]]], at[filled] - at[i])
        i = j
    return out


def _gram_sums(err: np.ndarray, best: np.ndarray, col: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Sum over the texts' strongest pieces of the text's error, by n-gram, a block of pieces at a time."""
    out = np.zeros(n)
    size = at[best + 1] - at[best]
    stop = np.r_[0, np.cumsum(size)]
    i = 0
    while i < len(best):
        j = max(i + 1, int(np.searchsorted(stop, stop[i] + BLOCK, "right")) - 1)
        mine = np.arange(stop[j] - stop[i]) + np.repeat(at[best[i:j]] - (stop[i:j] - stop[i]), size[i:j])
        out += np.bincount(col[mine], np.repeat(err[i:j], size[i:j]), n)
        i = j
    return out


def fit(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """Sorted hashes of the n-grams of the model, their weights and the bias, from training rows ``doc_id, text, y``.

    Every n-gram above ``CONTRAST`` is kept. A text counts by its strongest piece, as in ``score``. The driver holds those n-grams
    and, for at most ``TRAIN_ROWS`` texts and about ``TRAIN_GRAMS`` n-grams, which of them each piece has; everything else it makes is of ``BLOCK`` numbers or
    one number a piece. With one class only there are none and the bias is that class's log odds.
    """
    total = {r["y"]: r["n"] for r in rows.groupBy((F.col("y") > 0).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    n1, n0 = total.get(1, 0), total.get(0, 0)
    bias = float(np.log((n1 + SMOOTH) / (n0 + SMOOTH)))
    nothing = np.zeros(0, np.uint64), np.zeros(0), bias
    if not n1 or not n0:
        return nothing
    # log-likelihood ratio: the chi-square formula overrates n-grams of a few documents, which long texts then hit by chance
    def part(of, total):
        return F.when(of > 0, of * F.log(of * (n1 + n0) / ((F.col("pos") + F.col("neg")) * total))).otherwise(0.0)

    with_it = part(F.col("pos"), n1) + part(F.col("neg"), n0)
    both = F.col("pos") + F.col("neg")

    def rest(of, total):
        return F.when(total - of > 0, (total - of) * F.log((total - of) * (n1 + n0) / ((F.lit(n1 + n0) - both) * total))).otherwise(0.0)

    contrast = 2 * (with_it + rest(F.col("pos"), n1) + rest(F.col("neg"), n0))
    got = gram_counts(rows).where(contrast >= CONTRAST).toArrow()
    if not got.num_rows:
        return nothing
    h, p, q = (got[c].to_numpy() for c in ("h", "pos", "neg"))
    h = h.astype(np.int64).view(np.uint64)
    order = np.argsort(h)
    h, p, q = h[order], p[order], q[order]
    ratio = np.log((p + SMOOTH) / (n1 + 2 * SMOOTH)) - np.log((q + SMOOTH) / (n0 + 2 * SMOOTH))
    held = materialize(features(rows, h))
    grams_held = held.agg(F.sum(F.aggregate("grams", F.lit(0), lambda n, g: n + F.size(g)).cast("long"))).first()[0] or 0
    y, pieces, size, col = _flat(held.where(F.col("turn") < TRAIN_GRAMS / max(grams_held, 1)).select("y", "grams"))
    if not len(y):
        return nothing
    first, at = np.r_[0, np.cumsum(pieces)], np.r_[0, np.cumsum(size)]
    doc = np.repeat(np.arange(len(y)), pieces)
    w, b = np.zeros(len(h)), bias
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, STEPS + 1):  # Adam over the whole sample; first the strongest piece by the ratios alone
        z = _piece_sums(ratio * w if t > 1 else ratio, col, at)
        best = np.lexsort((-np.arange(len(doc)), z, doc))[first[1:] - 1]
        err = sigmoid((z[best] if t > 1 else 0.0) + b) - y
        g = np.append(ratio * _gram_sums(err, best, col, at, len(w)) / len(y) + RIDGE * w, err.mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return h, w * ratio, float(b)


def score(documents: DataFrame, model: tuple[np.ndarray, np.ndarray, float], into: str = "score", column: str = "text") -> DataFrame:
    """All columns of ``documents`` and ``into``: probability of the toxic class, from the whole text alone.

    The score is that of the strongest of the overlapping pieces that cover the text, so neither hides a long clean text a
    toxic passage nor do its many n-grams add up.
    """
    from pyspark.sql import types as T

    shared = documents.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*documents.schema.fields, T.StructField(into, T.DoubleType())])
    place = documents.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, weights, bias = shared.value
        chosen = Chosen(hashes)
        for b in batches:
            for i, j, data, bounds in chunks(b.column(place)):
                piece, which, first = grams(data, bounds, chosen)
                z = np.bincount(piece, weights[which], first[-1])
                made = sigmoid(np.maximum.reduceat(z, first[:-1]) + bias)
                yield pa.RecordBatch.from_arrays([*b.slice(i, j - i).columns, pa.array(made)], names=[*b.schema.names, into])

    return documents.mapInArrow(run, schema)


def train_toxicity(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    """Model fitted on at most ``rows`` documents that ``labels.toxic`` marks, none of the held-out fold."""
    return fit(materialize(training_rows(documents, labels, "toxic", rows)))


def score_toxicity(documents: DataFrame, model: tuple[np.ndarray, np.ndarray, float], threshold: float = 0.5) -> DataFrame:
    """``documents`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on).

    Null text counts as empty: it has no n-grams and gets the bias's score. Rows are scored alone, so
    ties and repeated rows score alike; other columns pass through; an empty table stays empty. Without
    usable labels the score is 0.5 at even odds of the classes.
    """
    rest = documents.drop("score", "predicted")
    return score(rest, model).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


__all__ = ["fit", "gram_counts", "held_out", "score", "score_toxicity", "train_toxicity"]
