"""Substring dedup: documents parsed against an index of first occurrences, long factors removed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helpweave.llm.anchors import among, runs, window_anchors
from helpweave.llm.textnum import Words, chunks, lists, prefix_sums, span_hash
from helpweave.session import materialize

#: Words of the grams that anchors are chosen from.
GRAM = 8


def profiles(documents: DataFrame, width: int) -> DataFrame:
    """``doc_id, n_words, whole, anchors``: number of words, hash of the word sequence, hashes of the anchors of all windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, bounds in chunks(b.column(1)):
                words = Words(data, bounds)
                start, place, gram = window_anchors(words.hash, words.bounds, width, GRAM)
                new = np.r_[True, place[1:] != place[:-1]][: len(place)]
                row = np.repeat(np.arange(j - i), words.counts)[place[new]]
                whole = span_hash(prefix_sums(words.hash), words.bounds[:-1], words.bounds[1:])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array(words.counts.astype(np.int64)), pa.array(whole.view(np.int64)),
                     lists(gram[new].view(np.int64), np.bincount(row, minlength=j - i), pa.int64())], ["doc_id", "n_words", "whole", "anchors"])

    return documents.mapInArrow(run, "doc_id long, n_words long, whole long, anchors array<long>")


def windows(documents: DataFrame, width: int) -> DataFrame:
    """``doc_id, start, h``: hash of every window whose anchor is in the row's array ``shared``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            for i, j, data, bounds in chunks(b.column(1)):
                words = Words(data, bounds)
                start, place, gram = window_anchors(words.hash, words.bounds, width, GRAM)
                part = b.column(2).slice(i, j - i)
                row = np.repeat(np.arange(j - i), words.counts)[start]
                held = np.repeat(np.arange(j - i), part.value_lengths().to_numpy())
                ok = among(row, gram, held, part.flatten().to_numpy().view(np.uint64))
                start, row = start[ok], row[ok]
                h = span_hash(prefix_sums(words.hash), start, start + width)
                yield pa.RecordBatch.from_arrays([pa.array(ids[i:j][row]), pa.array((start - words.bounds[row]).astype(np.int32)), pa.array(h.view(np.int64))], ["doc_id", "start", "h"])

    return documents.select("doc_id", "text", "shared").mapInArrow(run, "doc_id long, start int, h long")


def factors(documents: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Duplicate windows by document, and the documents that copy a smaller one whole.

    ``doc_id, starts, sources``: first words of the windows whose word sequence also starts in a document of smaller id, and
    the smallest such id; and ``doc_id, source`` of whole copies of at least ``width`` words.

    The index blocks are the hash partitions of the first-occurrence table: window hash to the least document that has it.
    Windows are made only where documents can meet: around anchors that two documents share, in documents that are no whole copies.
    """
    known = materialize(profiles(documents, width))
    long = known.where(F.col("n_words") >= width)
    first = long.groupBy("whole", "n_words").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last")).where("source < last").drop("last")
    copies = materialize(long.join(first, ["whole", "n_words"]).where("doc_id > source").select("doc_id", "source").distinct())
    posted = long.join(copies, "doc_id", "left_anti").select("doc_id", F.explode(F.array_distinct("anchors")).alias("g"))
    shared = posted.groupBy("g").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("g")
    mine = posted.join(shared, "g").groupBy("doc_id").agg(F.collect_list("g").alias("shared"))
    made = materialize(windows(documents.join(mine, "doc_id"), width))
    index = made.groupBy("h").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last")).where("source < last").select("h", "source")
    hits = made.join(index, "h").where("doc_id > source")
    found = hits.groupBy("doc_id").agg(F.collect_list(F.struct("start", "source")).alias("hits"))
    return found.select("doc_id", F.array_sort("hits").alias("hits")), copies


def parse(starts: np.ndarray, sources: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Greedy factors (first word, words, source) of sorted duplicate windows.

    A factor goes on while the next window starts one word on in the same source; at its end the next window is looked up anew, so no
    window across a factor boundary is missed.
    """
    if not len(starts):
        z = np.zeros(0, np.int64)
        return z, z, z
    new = np.flatnonzero(np.r_[True, (np.diff(starts) > 1) | (sources[1:] != sources[:-1])])
    last = np.r_[new[1:], len(starts)] - 1
    return starts[new], starts[last] - starts[new] + width, sources[new]


def drop_repeats(documents: DataFrame, width: int = 50, joined: bool = True) -> DataFrame:
    """``documents`` with new ``text`` and ``n_words, n_removed, factors``: repeated passages go from all but their first document.

    Words are runs of non-blank bytes. A word goes if a window of ``width`` words over it also starts in a document of smaller ``doc_id``;
    all windows are judged on the input. ``joined`` gives the kept words joined by one space; otherwise a text that
    loses nothing is left as it is, and from others the bytes from each removed run up to the next kept word are cut. ``factors`` are
    ``(first, words, source)`` of the parse.

    Null text has no words; it stays null unless ``joined`` makes it empty. Texts shorter than ``width`` words lose nothing. Rows with
    a null ``doc_id`` lose nothing. Rows of equal ``doc_id`` are one document and do not make each other repeats.
    Other columns pass through, columns of the new names are replaced; no rows give no rows.
    """
    from pyspark.sql import types as T

    rest = documents.drop("n_words", "n_removed", "factors")
    plain = rest.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hits, copies = factors(plain, width)
    marks = hits.withColumn("source", F.lit(None).cast("long")).unionByName(copies.withColumn("hits", F.array().cast("array<struct<start:int,source:long>>")))
    names = [f.name for f in rest.schema.fields]
    others = [f for f in rest.schema.fields if f.name != "text"]
    inner = {f.name: f"c{i}" for i, f in enumerate(others)}
    rows = rest.select(F.struct(*[F.col(f"`{n}`").alias(c) for n, c in inner.items()]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("body"))
    rows = rows.join(marks, "doc_id", "left").select("row", "body", F.coalesce("hits", F.array().cast("array<struct<start:int,source:long>>")).alias("hits"), "source")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, bounds in chunks(b.column(1)):
                words = Words(data, bounds)
                part, source = b.column(2).slice(i, j - i), b.column(3).slice(i, j - i).to_pylist()
                size, held = part.value_lengths().to_numpy(), part.flatten()
                at = np.r_[0, np.cumsum(size)]
                starts, sources = held.field(0).to_numpy(), held.field(1).to_numpy()
                null = b.column(1).slice(i, j - i).is_null().to_numpy(zero_copy_only=False)
                texts, lost, made = [], [], []
                for r in range(j - i):
                    w0, n = int(words.bounds[r]), int(words.counts[r])
                    gone = np.zeros(n + 1, np.int64)
                    if source[r] is not None:
                        first, count, ref = np.array([0]), np.array([n]), np.array([source[r]])
                    else:
                        first, count, ref = parse(starts[at[r] : at[r + 1]], sources[at[r] : at[r + 1]], width)
                    np.add.at(gone, first, 1)
                    np.add.at(gone, np.minimum(first + count, n), -1)
                    gone = np.cumsum(gone[:n]) > 0
                    lost.append(int(gone.sum()))
                    made.append([{"first": int(x), "words": int(y), "source": int(z)} for x, y, z in zip(first, count, ref)])
                    s, e = words.start[w0 : w0 + n], words.end[w0 : w0 + n]
                    if joined:
                        a, z = runs(~gone)
                        texts.append(b" ".join(b" ".join(data[s[x] : e[y - 1]].tobytes().split()) for x, y in zip(a, z)).decode("utf-8"))
                    elif not lost[-1]:
                        texts.append(None if null[r] else data[bounds[r] : bounds[r + 1]].tobytes().decode("utf-8"))
                    else:
                        cut = np.r_[bounds[r], s[1:], bounds[r + 1]] if n else np.r_[bounds[r], bounds[r + 1]]
                        a, z = runs(~gone)
                        texts.append(b"".join(data[cut[x] : cut[y]].tobytes() for x, y in zip(a, z)).decode("utf-8"))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array(texts, pa.string()), pa.array(words.counts.astype(np.int64)), pa.array(lost, pa.int64()),
                     pa.array(made, pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64()), ("source", pa.int64())])))],
                    ["row", "text", "n_words", "n_removed", "factors"])

    row = T.StructType([T.StructField(inner[f.name], f.dataType) for f in others])
    factor = T.StructType([T.StructField(n, T.LongType()) for n in ("first", "words", "source")])
    schema = T.StructType([T.StructField("row", row), T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("factors", T.ArrayType(factor))])
    done = rows.mapInArrow(run, schema)
    return done.select(*[F.col("text") if n == "text" else F.col(f"row.{inner[n]}").alias(n) for n in names], "n_words", "n_removed", "factors")
