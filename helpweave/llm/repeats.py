"""Repeated byte strings: sampled suffixes sorted externally, all others induced leftward from them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helpweave.llm.anchors import among, runs, window_anchors
from helpweave.llm.textnum import BYTE_CODE, chunks, lists, prefix_sums, span_hash
from helpweave.session import materialize

#: Bytes of the grams that suffixes are sampled by.
GRAM = 32
#: Occurrences of one sampled gram that a task takes together; a more frequent gram is compared window by window.
TOGETHER = 50_000
#: Suffixes that one induction handles at a time (whole grams, so at most this many more than ``TOGETHER``).
BUFFER = 16_000


def sampled_suffixes(data: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Row, place, gram hash, and least and greatest distance of the window starts that choose each sampled suffix."""
    start, place, gram = window_anchors(BYTE_CODE[data], bounds, width, GRAM)
    if not len(start):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64), z, z
    new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)])
    last = np.r_[new[1:], len(start)] - 1
    row = np.searchsorted(bounds, start[new], "right") - 1
    return row, place[new], gram[new], place[new] - start[last], place[new] - start[new]


def profiles(texts: DataFrame, width: int) -> DataFrame:
    """``h, n, grams``: length in bytes and sampled grams of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, bounds in chunks(b.column(1)):
                row, _, gram, _, _ = sampled_suffixes(data, bounds, width)
                made = lists(gram.view(np.int64), np.bincount(row, minlength=j - i), pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(np.diff(bounds)), made], ["h", "n", "grams"])

    return texts.select("h", "text").mapInArrow(run, "h long, n long, grams array<long>")


def suffix_tuples(texts: DataFrame, width: int) -> DataFrame:
    """``g, h, place, low, high, left, right`` of every suffix whose gram is in the row's array ``shared``.

    ``left`` holds the ``high`` bytes before the place, last first; ``right`` the bytes that its windows reach from it on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, bounds in chunks(b.column(1)):
                row, place, gram, low, high = sampled_suffixes(data, bounds, width)
                part = b.column(2).slice(i, j - i)
                held = np.repeat(np.arange(j - i), part.value_lengths().to_numpy())
                ok = among(row, gram, held, part.flatten().to_numpy().view(np.uint64))
                row, place, gram, low, high = row[ok], place[ok], gram[ok], low[ok], high[ok]
                raw = data.tobytes()
                left = [raw[p - d : p][::-1] for p, d in zip(place.tolist(), high.tolist())]
                right = [raw[p : p + width - d] for p, d in zip(place.tolist(), low.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram.view(np.int64)), b.column(0).slice(i, j - i).take(pa.array(row)), pa.array(place - bounds[row]), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32)),
                     pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["g", "h", "place", "low", "high", "left", "right"])

    return texts.select("h", "text", "shared").mapInArrow(run, "g long, h long, place long, low int, high int, left binary, right binary")


def window_rows(texts: DataFrame, width: int) -> DataFrame:
    """``h, at, w``: hash of every window whose suffix's gram is in the row's array ``shared``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, bounds in chunks(b.column(1)):
                row, place, gram, low, high = sampled_suffixes(data, bounds, width)
                part = b.column(2).slice(i, j - i)
                held = np.repeat(np.arange(j - i), part.value_lengths().to_numpy())
                ok = among(row, gram, held, part.flatten().to_numpy().view(np.uint64))
                count = (high - low + 1)[ok]
                first = np.repeat((place - high)[ok], count)
                at = first + np.arange(len(first)) - np.repeat(np.cumsum(count) - count, count)
                w = span_hash(prefix_sums(BYTE_CODE[data]), at, at + width)
                row = np.repeat(row[ok], count)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i).take(pa.array(row)), pa.array(at - bounds[row]), pa.array(w.view(np.int64))], ["h", "at", "w"])

    return texts.select("h", "text", "shared").mapInArrow(run, "h long, at long, w long")


def padded(cells: pa.Array, width: int) -> np.ndarray:
    """Binary cells as rows of ``width`` bytes, filled up with zeros."""
    raw = b"".join(x[:width].ljust(width, b"\0") for x in cells.to_pylist())
    return np.frombuffer(raw, np.uint8).reshape(len(cells), width)


def induce(gram: np.ndarray, left: np.ndarray, right: np.ndarray, low: np.ndarray, high: np.ndarray, width: int) -> np.ndarray:
    """Which windows repeat, by suffix and distance of the window's start from it.

    Suffixes come sorted by gram and ``right``; the common prefixes of neighbours give, for any length, the classes of equal right parts.
    The order of the suffixes one byte further left is induced from that of the last wave: the tuple (class so far, byte before).
    A window is the pair of its left class and its right class at the length that is left over; it repeats if the pair occurs twice.
    """
    m = len(gram)
    out = np.zeros((m, int(high.max()) + 1), bool)
    common = np.full(m, -1)
    if m > 1:
        equal = right[1:] == right[:-1]
        common[1:] = np.where(equal.all(axis=1), width, equal.argmin(axis=1))
        common[1:][gram[1:] != gram[:-1]] = -1
    part = np.cumsum(np.r_[True, gram[1:] != gram[:-1]]) - 1
    live = np.arange(m)
    for d in range(out.shape[1]):
        if d:
            keep = high[live] >= d
            live, part = live[keep], part[keep]
            code = part.astype(np.int64) * 256 + left[live, d - 1]
            _, part, count = np.unique(code, return_inverse=True, return_counts=True)
            keep = count[part] > 1
            live, part = live[keep], part[keep]
        if len(live) < 2:
            break
        mine = np.flatnonzero(low[live] <= d)
        if len(mine) < 2:
            continue
        ends = np.cumsum(common < width - d)
        code = part[mine].astype(np.int64) * (m + 1) + ends[live[mine]]
        _, which, count = np.unique(code, return_inverse=True, return_counts=True)
        out[live[mine], d] = count[which] > 1
    return out


def repeated_spans(tuples: DataFrame, width: int) -> DataFrame:
    """``h, first, last``: byte spans covered by repeated windows, from suffix tuples.

    The tuples of a gram meet in one partition; the sort by gram and right part is Spark's external sort (runs on disk, merged by
    a queue), so a partition may exceed memory. A task then reads them as a stream and induces a bounded buffer of whole grams at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def spans(t: pa.Table) -> pa.RecordBatch:
            t = t.combine_chunks()
            cell = lambda c: t[c].chunk(0) if t[c].num_chunks == 1 else pa.concat_arrays(t[c].chunks)
            low, high, place = (cell(c).to_numpy().astype(np.int64) for c in ("low", "high", "place"))
            again = induce(cell("g").to_numpy(), padded(cell("left"), max(1, int(high.max()))), padded(cell("right"), width), low, high, width)
            flat = np.zeros((len(low), again.shape[1] + 1), np.int8)
            flat[:, :-1] = again
            edge = np.diff(np.r_[0, flat.ravel()])
            a, z = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            row, near, far = a // flat.shape[1], a % flat.shape[1], (z - 1) % flat.shape[1]
            return pa.RecordBatch.from_arrays([pc.take(cell("h"), pa.array(row)), pa.array(place[row] - far), pa.array(place[row] - near + width)], ["h", "first", "last"])

        kept: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            while b.num_rows:
                if rows < BUFFER:
                    kept.append(b.slice(0, BUFFER))
                    rows += kept[-1].num_rows
                    b = b.slice(kept[-1].num_rows)
                    continue
                now = kept[-1].column(0)[kept[-1].num_rows - 1].as_py()
                same = int(np.argmax(np.r_[b.column(0).to_numpy() != now, True]))
                kept.append(b.slice(0, same))
                b = b.slice(same)
                if b.num_rows:
                    yield spans(pa.Table.from_batches([x for x in kept if x.num_rows]))
                    kept, rows = [], 0
        kept = [x for x in kept if x.num_rows]
        if kept:
            yield spans(pa.Table.from_batches(kept))

    sorted_ = tuples.repartition("g").sortWithinPartitions("g", "right")
    return sorted_.mapInArrow(run, "h long, first long, last long")


def drop_repeated_bytes(documents: DataFrame, width: int = 400, together: int = TOGETHER) -> DataFrame:
    """``documents`` with ``kept`` (binary) and ``n_bytes, n_removed, n_spans, removed``: bytes in repeated strings go everywhere.

    Texts are UTF-8 bytes (null: empty). A byte goes if a string of ``width`` bytes over it also starts at any other place of
    any row, overlapping itself included; the first occurrence goes too, and all strings are judged on the input. Strings never
    cross rows. ``removed`` holds the maximal runs as ``(first, last)`` byte places. Repeated rows are copies of each other: from
    ``width`` bytes on they lose everything. Shorter texts lose nothing. Ids are not looked at, so null or equal ids change nothing;
    other columns pass through, columns of the new names are replaced; no rows give no rows.

    Equal texts are handled once. Suffixes are sampled so that every window holds one chosen by its own bytes; only suffixes whose
    gram occurs twice are sorted. A gram with more than ``together`` occurrences never meets in one task: its windows are counted by hash.
    """
    from pyspark.sql import types as T

    rest = documents.drop("kept", "n_bytes", "n_removed", "n_spans", "removed")
    names = [f.name for f in rest.schema.fields]
    others = [f for f in rest.schema.fields if f.name != "text"]
    inner = {f.name: f"c{i}" for i, f in enumerate(others)}
    rows = rest.select(F.struct(F.lit(1).alias("one"), *[F.col(f"`{n}`").alias(c) for n, c in inner.items()]).alias("row"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("h", F.xxhash64(F.coalesce("text", F.lit("")), F.octet_length(F.coalesce("text", F.lit("")))))
    known = materialize(profiles(rows, width).groupBy("h").agg(F.count("*").alias("copies"), F.first("n").alias("n"), F.first("grams").alias("grams")))
    posted = known.select("h", F.explode("grams").alias("g"))
    often = posted.groupBy("g").agg(F.count("*").alias("df")).where("df > 1")
    mine = posted.distinct().join(often, "g").groupBy("h").agg(
        F.collect_list(F.when(F.col("df") <= together, F.col("g"))).alias("shared"), F.collect_list(F.when(F.col("df") > together, F.col("g"))).alias("hot"))
    # one row of each text, chosen before and in the shuffle that the join needs as well
    texts = rows.groupBy("h").agg(F.first("text").alias("text")).join(mine, "h")
    spans = repeated_spans(suffix_tuples(texts.where(F.size("shared") > 0), width), width)
    hot = materialize(window_rows(texts.where(F.size("hot") > 0).select("h", "text", F.col("hot").alias("shared")), width))
    again = hot.groupBy("w").agg(F.count("*").alias("df")).where("df > 1").select("w")
    spans = spans.unionByName(hot.join(again, "w").select("h", F.col("at").alias("first"), (F.col("at") + width).alias("last")))
    found = spans.groupBy("h").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    whole = known.where((F.col("copies") > 1) & (F.col("n") >= width)).select("h", F.array(F.struct(F.lit(0).cast("long").alias("first"), F.col("n").alias("last"))).alias("all"))
    marks = materialize(found.join(whole, "h", "full").select("h", F.coalesce("all", "spans").alias("spans")))
    joined = rows.join(marks, "h", "left").select("row", "text", F.coalesce("spans", F.array().cast("array<struct<first:long,last:long>>")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, bounds in chunks(b.column(1)):
                part = b.column(2).slice(i, j - i)
                size, held = part.value_lengths().to_numpy(), part.flatten()
                base = np.repeat(bounds[:-1], size)
                cover = np.zeros(len(data) + 1, np.int64)
                np.add.at(cover, held.field(0).to_numpy() + base, 1)
                np.add.at(cover, held.field(1).to_numpy() + base, -1)
                gone = np.cumsum(cover[:-1]) > 0
                kept, lost, cut = [], [], []
                for r in range(j - i):
                    g, d = gone[bounds[r] : bounds[r + 1]], data[bounds[r] : bounds[r + 1]]
                    a, z = runs(g) if g.any() else ((), ())
                    kept.append(d[~g].tobytes() if len(a) else d.tobytes())
                    lost.append(int(g.sum()))
                    cut.append([{"first": int(x), "last": int(y)} for x, y in zip(a, z)])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(kept, pa.binary()), pa.array(np.diff(bounds)), pa.array(lost, pa.int64()), pa.array([len(c) for c in cut], pa.int64()),
                     pa.array(cut, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))], ["row", "text", "kept", "n_bytes", "n_removed", "n_spans", "removed"])

    row = T.StructType([T.StructField("one", T.IntegerType()), *[T.StructField(inner[f.name], f.dataType) for f in others]])
    long = [T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")]
    span = T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())])
    schema = T.StructType([T.StructField("row", row), T.StructField("text", T.StringType()), T.StructField("kept", T.BinaryType()), *long, T.StructField("removed", T.ArrayType(span))])
    done = joined.mapInArrow(run, schema)
    return done.select(*[F.col("text") if n == "text" else F.col(f"row.{inner[n]}").alias(n) for n in names], "kept", "n_bytes", "n_removed", "n_spans", "removed")
