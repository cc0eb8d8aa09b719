"""Code points of text chunks and bounded training samples, shared by the trained scorers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One fold of five is held out.
FOLDS = 5
#: Lower-case form of code points below 65536 that have one of one code point.
LOWER_CODE = np.array([ord(c) if len(c := chr(i).lower()) == 1 and ord(c) < 65536 else i for i in range(65536)], np.uint32)
CODE_MIX = np.random.default_rng(7).integers(1, 1 << 63, 65536, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def code_points(data: np.ndarray, bounds: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes and the row bounds among them."""
    heads = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    if lower:
        codes = np.where(codes < 65536, LOWER_CODE[np.minimum(codes, 65535)], codes)
    return codes, heads[bounds]


def code_values(codes: np.ndarray) -> np.ndarray:
    """Random-looking 64-bit value of each code point."""
    return CODE_MIX[codes & 0xFFFF] + (codes >> 16).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % FOLDS == 0


def training_rows(documents: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """``doc_id, text, y`` of at most ``rows`` labelled documents outside the held-out fold.

    Rows are chosen by a hash of the id. Null labels or ids are left out; of several labels of one
    document the largest counts, of several texts the least. ``rows`` bounds the ids that are broadcast, whatever the input size.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    picked = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    return found.groupBy("doc_id", "y").agg(F.min("text").alias("text"))
