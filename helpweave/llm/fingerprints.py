"""Document fingerprints: a randomised edit embedding, sampled in bands.

A walk over a text writes each character to one or more coordinates: how long it stays at a character depends on shared random bits of the
coordinate and the character. Two walks that an edit has put out of step meet again after a few coordinates, so that few edits change few
coordinates (edit distance becomes Hamming distance). Texts are cut where their own characters say so and every piece is walked anew, all pieces at
once. Half of each block of coordinates is sampled: that is a band. A fingerprint keeps, for each of 64 slots, the least band hash that falls into it,
so its length does not depend on the text's.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helpweave.llm.graph import components
from helpweave.llm.labelled import code_values
from helpweave.llm.textnum import chunks, fresh, mix, prefix_sums, rolling_hash
from helpweave.session import materialize

SLOTS = 64
#: A slot that no band falls into.
EMPTY = 0xFFFF
#: Coordinates of a band, and how many of them are sampled.
BLOCK, SAMPLED = 8, 5
#: Most coordinates that one character takes.
STAY = 8
#: Characters before a cut that decide on it, one cut in so many places on average, longest piece.
CONTEXT, SPACING, LONGEST = 8, 64, 256
#: Code points that are walked together.
STEP = 1 << 20
KINDS = 256

_rng = np.random.default_rng(11)
_COORDINATES = LONGEST * STAY + 1


def _walk_table() -> np.ndarray:
    """Next coordinate after each character kind (row) and coordinate: behind the first set bit, ``STAY`` on at most."""
    go = _rng.random((KINDS, _COORDINATES + STAY)) < 0.5
    out = np.full((KINDS, _COORDINATES), STAY, np.int32)
    for stay in range(STAY - 1, 0, -1):
        out[go[:, stay - 1 : stay - 1 + _COORDINATES]] = stay
    return (out + np.arange(_COORDINATES, dtype=np.int32)).ravel()


def _sample_weights() -> np.ndarray:
    """Sums of the random odd numbers of the sampled coordinates before each coordinate."""
    blocks = -(-_COORDINATES // BLOCK)
    weight = _rng.integers(1, 1 << 63, blocks * BLOCK, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    chosen = _rng.random((blocks, BLOCK)).argsort(axis=1) < SAMPLED
    return np.r_[np.uint64(0), np.cumsum(np.where(chosen.ravel(), weight, np.uint64(0)), dtype=np.uint64)]


NEXT, WEIGHT = _walk_table(), _sample_weights()


def pieces(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the pieces of all rows, and the hash of the characters before each (0 at a row's start)."""
    before = rolling_hash(prefix_sums(values), CONTEXT)
    end = np.arange(len(before)) + CONTEXT
    row_start = np.repeat(bounds[:-1], np.diff(bounds))
    cut = end[(before % np.uint64(SPACING) == 0)] if len(before) else end
    cut = cut[cut < len(values)]
    cut = cut[cut - CONTEXT >= row_start[cut]] if len(cut) else cut
    starts = np.unique(np.r_[bounds[:-1][np.diff(bounds) > 0], cut])
    length = np.diff(np.r_[starts, len(values)])
    more = (length - 1) // LONGEST
    if more.any():
        inner = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1
        starts = np.sort(np.r_[starts, np.repeat(starts, more) + inner * LONGEST])
    at = starts - CONTEXT
    ok = at >= (row_start[starts] if len(starts) else at)
    return starts, np.where(ok, before[np.maximum(at, 0)] if len(before) else np.uint64(0), np.uint64(0))


def bands(values: np.ndarray, start: np.ndarray, end: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band hashes of the pieces, and the piece of each; ``values`` are the pieces' characters one after the other."""
    kind = (values >> np.uint64(55)).astype(np.int64) % KINDS * _COORDINATES
    after = np.empty(len(values), np.int32)
    order = np.argsort(start - end, kind="stable")  # longest first, so that the pieces still walking are a prefix
    first, size = start[order], (end - start)[order]
    place = np.zeros(len(order), np.int32)
    for i in range(int(size[0]) if len(size) else 0):
        live = int(np.searchsorted(-size, -i, "left"))
        at = first[:live] + i
        place[:live] = NEXT[kind[at] + place[:live]]
        after[at] = place[:live]
    head = np.empty(len(values), np.int32)
    head[1:] = after[:-1]
    head[start] = 0
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * (WEIGHT[after] - WEIGHT[head]), out=total[1:])
    cross = np.flatnonzero(after // BLOCK > head // BLOCK)
    piece = np.searchsorted(start, cross, "right") - 1
    # a rest of less than half a block belongs to the band before it
    last = after[end - 1]
    cross_block = after[cross] // BLOCK
    keep = (cross_block < (last // BLOCK)[piece]) | (last % BLOCK >= BLOCK // 2)[piece]
    cross, piece, cross_block = cross[keep], piece[keep], cross_block[keep]
    edge = total[cross] + values[cross] * (WEIGHT[cross_block * BLOCK] - WEIGHT[head[cross]])
    # bands end at the crossings and at the pieces' ends
    n = len(start)
    owner = np.r_[piece, np.arange(n)]
    order = np.argsort(owner, kind="stable")  # a piece's end follows its crossings
    owner, value = owner[order], np.r_[edge, total[end]][order]
    fresh = np.r_[True, owner[1:] != owner[:-1]][: len(owner)]
    before = np.r_[np.uint64(0), value[:-1]][: len(value)]
    before[fresh] = total[start]
    number = np.arange(len(owner)) - np.flatnonzero(fresh)[owner] if len(owner) else owner
    return mix((value - before) + mix(seed[owner] + number.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))), owner


def sketch(codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Fingerprint of each row of code points: ``SLOTS`` numbers of 16 bits; a text without characters has empty slots alone."""
    rows = len(bounds) - 1
    least = np.full(rows * SLOTS, 0xFFFFFFFF, np.uint32)
    values = code_values(codes)
    starts, seed = pieces(values, bounds)
    ends = np.r_[starts[1:], len(values)][: len(starts)]
    row = np.searchsorted(bounds, starts, "right") - 1
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + STEP, "right")))
        x, z = starts[i], ends[j - 1]
        h, piece = bands(values[x:z], starts[i:j] - x, ends[i:j] - x, seed[i:j])
        slot = row[i:j][piece] * SLOTS + (h >> np.uint64(58)).astype(np.int64)
        np.minimum.at(least, slot, (h & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        i = j
    low = np.minimum(least & np.uint32(0xFFFF), np.uint32(EMPTY - 1)).astype(np.uint16)
    return np.where(least == 0xFFFFFFFF, np.uint16(EMPTY), low).reshape(rows, SLOTS)


def likeness_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of common bands of two fingerprints (twice the common over the sum), estimated from the slots; 1 where both are empty."""
    same = ((a == b) & (a != EMPTY)).sum(axis=1)
    used = ((a != EMPTY) | (b != EMPTY)).sum(axis=1)
    share = np.where(used > 0, same / np.maximum(used, 1), 1.0)
    return 2 * share / (1 + share)


def hexes(prints: np.ndarray) -> pa.Array:
    raw, size = prints.astype(">u2").tobytes().hex(), 4 * SLOTS
    return pa.array([raw[i : i + size] for i in range(0, len(raw), size)], pa.string())


def _from_hex(column: pd.Series) -> np.ndarray:
    raw = bytes.fromhex("".join(column.fillna("f" * 4 * SLOTS)))
    return np.frombuffer(raw, ">u2").reshape(len(column), SLOTS)


@F.pandas_udf(T.DoubleType())
def _likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(likeness_of(_from_hex(a), _from_hex(b)))


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two fingerprint columns, 0 to 1; a null fingerprint counts as that of an empty text."""
    return _likeness(a, b)


def _valid(data: np.ndarray, bounds: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Bytes, row bounds and code points; broken UTF-8 is replaced row by row."""
    raw = data.tobytes()
    try:
        codes = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
    except UnicodeDecodeError:
        rows = [raw[a:b].decode("utf-8", "replace").encode() for a, b in zip(bounds[:-1], bounds[1:])]
        raw, bounds = b"".join(rows), np.r_[0, np.cumsum([len(r) for r in rows])]
        codes = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
    return raw, bounds, codes


def _heads(raw: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte place of each code point (and the end), and the row bounds among them."""
    heads = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
    return np.r_[heads, len(raw)], np.searchsorted(heads, bounds)


def fingerprint(documents: DataFrame, column: str = "text", into: str = "fingerprint") -> DataFrame:
    """All columns of ``documents`` and ``into``: the fingerprint of the whole text as hex digits.

    Null texts count as empty, whose fingerprint has empty slots alone. Rows are taken alone, so equal texts have equal fingerprints; other columns pass
    through (one named like ``into`` is replaced); an empty table stays empty. Memory grows with the longest text, about 60 bytes a character.
    """
    rest = [f for f in documents.schema.fields if f.name != into]
    given = documents.select(*[F.col(f"`{f.name}`") for f in rest], F.col(f"`{column}`").cast("binary").alias(fresh("_walked", [f.name for f in rest])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, bounds in chunks(b.column(len(rest))):
                raw, bounds, codes = _valid(data, bounds)
                made = hexes(sketch(codes, _heads(raw, bounds)[1]))
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(i, j - i) for k in range(len(rest))), made], names=[*(f.name for f in rest), into])

    return given.mapInArrow(run, T.StructType([*rest, T.StructField(into, T.StringType())]))


def near_groups(prints: DataFrame, key: str = "doc_id", column: str = "fingerprint", at_least: float = 0.9, width: int = 4) -> DataFrame:
    """``key, group_id`` of rows whose fingerprints are alike: banding of the slots, then comparison of whole fingerprints.

    Equal fingerprints are one node. Nodes that agree in ``width`` used slots of a band meet there; each is compared with the least fingerprint of the band (its
    leader) alone, so a band's cost grows with its rows, and linked where the likeness is ``at_least``. Groups are what these links connect; ``group_id`` is the
    least key of a group. At a likeness of 0.9 two nodes share no band of 4 slots with a chance of 1 in 10,000. Null keys and null fingerprints are left out.
    """
    given = prints.where(F.col(key).isNotNull() & F.col(column).isNotNull()).select(F.col(f"`{key}`").alias("key"), F.col(f"`{column}`").alias("print"))
    nodes = materialize(given.groupBy("print").agg(F.min("key").alias("node")))
    digits = 4 * width
    none = "f" * 4
    parts = F.array(*[F.struct(F.lit(i).alias("band"), F.substring("print", i * digits + 1, digits).alias("bits")) for i in range(SLOTS // width)])
    posted = nodes.select("node", "print", F.explode(parts).alias("p")).select("node", "print", "p.*")
    for i in range(width):
        posted = posted.where(F.substring("bits", 4 * i + 1, 4) != none)
    leader = posted.groupBy("band", "bits").agg(F.min("print").alias("lead"), F.min_by("node", "print").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    met = posted.join(leader, ["band", "bits"]).where("node <> a").select("a", F.col("node").alias("b"), "lead", "print").distinct()
    links = met.where(likeness(F.col("lead"), F.col("print")) >= at_least).select("a", "b")
    found = components(links)
    group = nodes.join(found, F.col("node") == F.col("id"), "left").select("print", F.coalesce("component_id", "node").alias("group_id"))
    return given.join(group, "print").select(F.col("key").alias(key), "group_id")


def _ordered(documents: DataFrame, key: str, text: str) -> tuple[DataFrame, int]:
    """Rows ``bucket, tail, key, text`` in buckets of consecutive rows (descending key, nulls last, equal keys by their text's hash); each bucket ends with a copy
    (``tail``) of the row that follows it, the first row of all following the last."""
    spark = documents.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = documents.select(F.col(f"`{key}`").cast("long").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    place = [F.col("key").isNull().cast("int").alias("late"), F.coalesce(F.bitwise_not("key"), F.lit(0)).alias("turn"), F.xxhash64("text").alias("sum")]
    places = materialize(rows.select(*place)).repartitionByRange(2 * width, "late", "turn", "sum")
    firsts = places.groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct("late", "turn", "sum")).alias("at")).collect()
    cuts = sorted({tuple(r["at"]) for r in firsts})

    @F.pandas_udf("int")
    def bucket(late: pd.Series, turn: pd.Series, sum_: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(cuts, at) - 1 for at in zip(late, turn, sum_)], dtype="int32")

    @F.pandas_udf("boolean")
    def first(late: pd.Series, turn: pd.Series, sum_: pd.Series) -> pd.Series:
        known = set(cuts)
        return pd.Series([at in known for at in zip(late, turn, sum_)], dtype=bool)

    at = [F.col("late"), F.col("turn"), F.col("sum")]
    own = rows.select("key", "text", *place).withColumns({"bucket": bucket(*at), "first": first(*at)})
    before = F.pmod(F.col("bucket") - 1, F.lit(max(1, len(cuts))))
    copies = F.when(F.col("first"), F.array(F.struct("bucket", F.lit(False).alias("tail")), F.struct(before.alias("bucket"), F.lit(True).alias("tail")))).otherwise(
        F.array(F.struct("bucket", F.lit(False).alias("tail"))))
    dealt = own.withColumn("copy", F.explode(copies)).select("copy.bucket", "copy.tail", "late", "turn", "sum", "key", "text").repartitionById(width, F.col("bucket"))
    return dealt.sortWithinPartitions("bucket", "tail", "late", "turn", "sum").select("tail", "key", F.col("text").cast("binary").alias("text")), len(cuts)


def compare_with_next(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness to each other and to the next text's.

    The edited text is the text whose last half (of its code points, rounded down) is replaced by as many first ones, or all, of the next text; next is the
    row of the next lower key, and the first row after the last. Returns ``key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``, one row
    per row. The text is shuffled once, into buckets of consecutive rows; a long run of one key is split too, by the texts' hashes.

    Null texts count as empty; a null key comes after all others; rows of equal key follow one another by their texts' hash, so repeated rows are each other's next (all
    but one); a single row is its own next; an empty table stays empty; other columns are not returned.
    """
    dealt, _ = _ordered(documents, key, text)

    def emit(keys, tails, raw, bounds, codes):
        heads, at = _heads(raw, bounds)
        own = sketch(codes, at)
        n = np.diff(at)
        keep = at[:-1] + n - n // 2
        cut = heads[keep]
        taken = heads[at[1:-1] + np.minimum(n[:-1] // 2, n[1:])]
        real = [i for i, tail in enumerate(tails[:-1]) if not tail]
        edited = [raw[bounds[i] : cut[i]] + raw[bounds[i + 1] : taken[i]] for i in real]
        joined = b"".join(edited)
        edges = np.r_[0, np.cumsum([len(e) for e in edited])].astype(np.int64)
        changed = sketch(np.frombuffer(joined.decode().encode("utf-32-le"), np.uint32), _heads(joined, edges)[1])
        real = np.array(real, np.int64)
        return pa.RecordBatch.from_arrays(
            [keys.take(pa.array(real)), pa.array(n[real]), pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()), hexes(own[real]), hexes(changed),
             pa.array(likeness_of(own[real], changed)), pa.array(likeness_of(own[real], own[real + 1]))],
            names=["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row waits for its next
        for b in batches:
            for i, j, data, bounds in chunks(b.column(2)):
                raw, bounds, codes = _valid(data, bounds)
                part = b.slice(i, j - i)
                keys, tails = part.column(1), part.column(0).to_pylist()
                if held is not None:
                    keys, tails = pa.concat_arrays([held[0], keys]), held[1] + tails
                    raw, bounds, codes = held[2] + raw, np.r_[0, bounds + len(held[2])], np.r_[held[3], codes]
                if len(tails) > 1:
                    yield emit(keys, tails, raw, bounds, codes)
                chars = len(raw[bounds[-2] : bounds[-1]].decode())
                held = keys.slice(len(tails) - 1), tails[-1:], raw[bounds[-2] :], codes[len(codes) - chars :]

    schema = "key long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.mapInArrow(run, schema).withColumnRenamed("key", key)
