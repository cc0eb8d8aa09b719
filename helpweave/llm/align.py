"""Alignment of two tokenizations of each text: groups of tokens between the byte places where both end, and corpus-wide link counts.

A fragment describes a byte range of a text: an open prefix (tokens up to the first common end), closed groups, an open suffix. Fragments of neighbouring ranges
compose by joining the left one's suffix with the right one's prefix, which is associative, so a very long text is cut into ranges that different tasks
tokenize, and a tree of small groups puts its fragments together.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helpweave.llm.bpe import PATTERN, Cells, _list_parts, byte_letters
from helpweave.llm.counts import frequent
from helpweave.llm.textnum import lists
from helpweave.session import materialize

#: Texts of more bytes than ``LONG`` are cut into ranges of ``RANGE`` bytes; so many fragments are joined at once.
LONG, RANGE, FAN = 1 << 16, 1 << 14, 8
#: Bytes of text that are aligned together, units that a task remembers, links that are made together at most (a larger group is made from its distinct ids).
STEP, MEMO, WIDE_GROUP = 1 << 20, 500_000, 4096
#: Id pairs of highest count whose counts every task gets; those of all others are joined.
SHARED = 1_000_000
#: Distinct pairs that a counting task holds before it sends them on.
HELD = 1_000_000
_SHAPE = "a array<int>, b array<int>, na array<int>, nb array<int>"


def units(text: str) -> list[str]:
    """Parts of ``text`` between spaces; a space after white space (or at the start) stays inside, so that every cut is before a space that follows other text."""
    parts = text.split(" ")
    if "" not in parts and list(map(str.rstrip, parts)) == parts:
        return parts
    out, held = [], []
    for part in parts:
        held.append(part)
        if part and not part[-1].isspace():
            out.append(" ".join(held) if len(held) > 1 else part)
            held = []
    if held == [""] and out:
        out[-1] += " "  # B gives nothing for a space alone
    elif held:
        out.append(" ".join(held))
    return out


class Pair:
    """Two tokenizer files: ids and token bytes of space + text by a byte-level BPE (A) and of text by a sentence piece model that adds the space (B).

    A's ids must follow the order of its merges. Its special strings are plain text here.
    """

    def __init__(self, a_path: str, b_path: str):
        from sentencepiece import SentencePieceProcessor
        from tiktoken import Encoding

        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = {c: n for n, c in byte_letters().items()}
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        made = [ranks[bytes(letters[c] for c in "".join(m if isinstance(m, list) else m.split(" ")))] for m in spec["model"]["merges"]]
        if made != sorted(made):
            raise ValueError(f"{a_path}: ids do not follow the order of the merges")
        self.a = Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = SentencePieceProcessor(model_file=b_path)
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for raw, i in ranks.items():
            self.a_bytes[i] = raw
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(t) for t in x], np.int64) for x in (self.a_bytes, self.b_bytes))
        self.b_cells = Cells(self.b_bytes)
        #: A token of B never runs over the space between two units, so units can be tokenized alone.
        self.apart = not any("▁" in p.lstrip("▁") for i, p in enumerate(pieces) if not self.b.is_control(i))

    def split(self, text: str) -> list[str]:
        return units(text) if self.apart else [text]

    def encode(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the units by A and how many each has, the same by B, and whether both give the unit's bytes back (no ids where they do not)."""
        raw = (" " + " ".join(parts)).encode()
        size = np.fromiter(map(len, map(str.encode, parts)), np.int64, len(parts)) + 1
        # units one after the other are cut where units meet, so many are one call; not those that end in white space
        tails = [i for i, (p, q) in enumerate(zip(parts, map(str.rstrip, parts))) if not q or p != q or not self.apart]
        own = set(tails)
        rest = " ".join(p for i, p in enumerate(parts) if i not in own) if tails else " ".join(parts)
        ids = np.array(self.a.encode_ordinary(" " + rest) if len(own) < len(parts) else [], np.int64)
        alone = np.zeros(len(parts), bool)
        alone[tails] = True
        stops = np.cumsum(np.where(alone, 0, size))
        n_a = np.diff(np.r_[0, np.searchsorted(np.cumsum(self.a_size[ids]), stops, "right")])
        if tails:
            edge = _starts(n_a)
            found = {i: np.array(self.a.encode_ordinary(" " + parts[i]), np.int64) for i in tails}
            ids = np.concatenate([x for i in range(len(parts)) for x in (ids[edge[i] : edge[i + 1]], found.get(i, ids[:0]))])
            n_a[tails] = [len(found[i]) for i in tails]
        found = self.b.encode(parts, num_threads=1)
        n_b = np.fromiter(map(len, found), np.int64, len(found))
        b = np.fromiter(chain.from_iterable(found), np.int64, int(n_b.sum()))
        b_at = _starts(n_b)
        ok = np.diff(_starts(self.b_size[b])[b_at]) == size
        if not ok.all() or self.b_cells.join(b, b_at[[0, -1]])[0] != raw:
            at = _starts(size).tolist()
            ok &= np.fromiter((x == raw[i:j] for x, i, j in zip(self.b_cells.join(b, b_at), at, at[1:])), bool, len(parts))
        if ok.all():
            return ids, n_a, b, n_b, ok
        return ids[np.repeat(ok, n_a)], np.where(ok, n_a, 0), b[np.repeat(ok, n_b)], np.where(ok, n_b, 0), ok


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.r_[0, np.cumsum(sizes)]


class Runs:
    """Runs of numbers by index, with room for more."""

    def __init__(self, kind=np.int32):
        self.flat, self.at = np.zeros(0, kind), np.zeros(1, np.int64)

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.flat, self.at = np.r_[self.flat, flat.astype(self.flat.dtype)], np.r_[self.at, self.at[-1] + np.cumsum(sizes)]

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The runs of ``rows`` one after the other, and where each starts."""
        sizes = self.at[rows + 1] - self.at[rows]
        stop = _starts(sizes)
        return self.flat[np.arange(stop[-1]) + np.repeat(self.at[rows] - stop[:-1], sizes)], stop


class Block:
    """Aligned texts (or units): ids of A and B and the token counts of the groups, each with row bounds."""

    def __init__(self, a, b, na, nb):
        (self.a, self.a_at), (self.b, self.b_at), (self.na, self.at), (self.nb, _) = a, b, na, nb

    @classmethod
    def of_lists(cls, batch: pa.RecordBatch, first: int) -> Block:
        return cls(*(_list_parts(batch.column(first + k)) for k in range(4)))

    def arrays(self) -> list[pa.Array]:
        return [lists(v.astype(np.int32), np.diff(at), pa.int32()) for v, at in ((self.a, self.a_at), (self.b, self.b_at), (self.na, self.at), (self.nb, self.at))]

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, A id, B id and number of occurrences of the links of all rows; a pair may come several times."""
        na, nb = self.na.astype(np.int64), self.nb.astype(np.int64)
        row = np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))
        a_from, b_from = _starts(na)[:-1], _starts(nb)[:-1]
        n = na * nb
        small = np.flatnonzero(n <= WIDE_GROUP)
        stop = _starts(n[small])
        g = np.repeat(small, n[small])
        k = np.arange(stop[-1]) - np.repeat(stop[:-1], n[small])
        parts = [(row[g], self.a[a_from[g] + k // nb[g]], self.b[b_from[g] + k % nb[g]], np.ones(len(g), np.int64))]
        for i in np.flatnonzero(n > WIDE_GROUP):
            x, m = np.unique(self.a[a_from[i] : a_from[i] + na[i]], return_counts=True)
            y, k = np.unique(self.b[b_from[i] : b_from[i] + nb[i]], return_counts=True)
            parts.append((np.full(len(x) * len(y), row[i]), np.repeat(x, len(y)), np.tile(y, len(x)), (m[:, None] * k).ravel()))
        return tuple(np.concatenate(p) for p in zip(*parts))

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of the distinct links of each row, how often each occurs there, and the number of codes of each row."""
        row, a, b, m = self.links()
        return _distinct(row, (a.astype(np.int64) << 32) | b, m, len(self.at) - 1)


def _distinct(row: np.ndarray, code: np.ndarray, times: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((code, row))
    row, code = row[order], code[order]
    new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (code[1:] != code[:-1])][: len(row)])
    return code[new], np.add.reduceat(times[order], new) if len(new) else times[:0], np.bincount(row[new], minlength=rows)


class Aligner:
    """Aligned units, each tokenized once as long as it is remembered. ``derive`` makes further values of new units, which are kept in ``more``."""

    def __init__(self, pair: Pair, derive=None):
        self.pair, self.derive = pair, derive
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.a, self.b, self.na, self.nb, self.ok = Runs(), Runs(), Runs(), Runs(), np.zeros(0, bool)
        self.more = None

    def rows(self, parts: list[str]) -> np.ndarray:
        """Number of each unit; new ones are tokenized and grouped."""
        if len(self.known) > MEMO:
            self.clear()
        new = list(set(parts).difference(self.known))
        if new:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            a, n_a, b, n_b, ok = self.pair.encode(new)
            ends = np.cumsum(self.pair.a_size[a]), np.cumsum(self.pair.b_size[b])
            cuts = np.intersect1d(*ends, assume_unique=True)
            owner = np.searchsorted(np.cumsum(n_a), np.searchsorted(ends[0], cuts), "right")
            groups = np.bincount(owner, minlength=len(new))
            counts = [np.diff(np.r_[0, np.searchsorted(end, cuts, "right")]) for end in ends]
            self.ok = np.r_[self.ok, ok]
            for held, flat, n in ((self.a, a, n_a), (self.b, b, n_b), (self.na, counts[0], groups), (self.nb, counts[1], groups)):
                held.add(flat, n)
            if self.derive:
                made = Block((a, _starts(n_a)), (b, _starts(n_b)), (counts[0], _starts(groups)), (counts[1], _starts(groups)))
                self.more = self.derive(made, self.more)
        return np.fromiter(map(self.known.__getitem__, parts), np.int64, len(parts))

    def units_of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Units of whole texts and where each text's start; none for texts that are null, empty or not given back by both tokenizers."""
        parts = [self.pair.split(t) if t else [] for t in texts]
        rows = self.rows([u for p in parts for u in p])
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        bad = np.bincount(np.repeat(np.arange(len(parts)), size), ~self.ok[rows], len(parts)) > 0
        return rows[~np.repeat(bad, size)], _starts(np.where(bad, 0, size))

    def block(self, texts: list[str | None]) -> Block:
        rows, edge = self.units_of(texts)
        return Block(*((v, stop[edge]) for v, stop in (held.take(rows) for held in (self.a, self.b, self.na, self.nb))))

    def fragment(self, text: str, skip: int, take: int) -> tuple:
        """Fragment of the byte range ``skip`` to ``skip + take`` of space + ``text``: tokens that end in it, and the counts of prefix, groups and suffix."""
        rows = self.rows(self.pair.split(text))
        sides, ends = [], []
        for held, size in ((self.a, self.pair.a_size), (self.b, self.pair.b_size)):
            ids = held.take(rows)[0]
            end = np.cumsum(size[ids])
            mine = (end > skip) & (end <= skip + take)
            sides.append(ids[mine])
            ends.append(end[mine])
        cuts = np.intersect1d(*ends, assume_unique=True)
        counts = [np.diff(np.r_[0, np.searchsorted(end, cuts, "right"), len(end)]) for end in ends]
        return bool(self.ok[rows].all()), *sides, *counts


def compose(left: tuple, right: tuple) -> tuple:
    """Fragment of two neighbouring ranges: the left suffix and the right prefix become one part."""
    glue = lambda x, y: np.r_[x[:-1], x[-1] + y[0], y[1:]]
    return left[0] and right[0], np.r_[left[1], right[1]], np.r_[left[2], right[2]], glue(left[3], right[3]), glue(left[4], right[4])


def _decoded(column: pa.Array) -> list[str | None]:
    """Texts; None for null and broken ones."""

    def one(raw):
        try:
            return None if raw is None else raw.decode()
        except UnicodeDecodeError:
            return None

    return [one(x) for x in column.to_pylist()]


def _spans(texts: list[str | None], most: int):
    i, n = 0, len(texts)
    while i < n:
        j, size = i, 0
        while j < n and (j == i or size + len(texts[j] or "") <= most):
            size += len(texts[j] or "")
            j += 1
        yield i, j
        i = j


def _ranges(text: str, pair: Pair) -> Iterator[tuple[int, int, str]]:
    """``skip, take, text`` of the byte ranges of a long text, each with the whole units around it. A range that would cut a unit larger than a quarter of it
    ends behind that unit, so that no unit is tokenized by many ranges."""
    parts = pair.split(text)
    at = _starts(np.array([len(p.encode()) + 1 for p in parts], np.int64))
    edges = np.arange(0, at[-1], RANGE)
    unit = np.searchsorted(at, edges, "right") - 1
    large = (at[unit + 1] - at[unit] > RANGE // 4) & (at[unit] < edges)
    edges = np.unique(np.r_[0, np.where(large, at[unit + 1], edges), at[-1]])
    for x, z in zip(edges[:-1], edges[1:]):
        i, j = int(np.searchsorted(at, x, "right")) - 1, int(np.searchsorted(at, z, "left"))
        yield int(x - at[i]), int(z - x), " ".join(parts[i:j])


def _long_texts(rows: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``row, key`` and the alignment of very long texts: ranges in tasks of their own, composed in a tree."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair(a_path, b_path)
        for b in batches:
            for row, key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), _decoded(b.column(2))):
                found = list(_ranges(text, pair)) if text else [(0, 0, "")]
                skip, take, part = zip(*found)
                n = len(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row] * n, pa.int64()), pa.array([key] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array(skip, pa.int64()), pa.array(take, pa.int64()), pa.array(part, pa.string())],
                    names=["row", "key", "part", "skip", "take", "text"])

    def fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(Pair(a_path, b_path))
        for b in batches:
            skip, take, text = (b.column(k).to_pylist() for k in (3, 4, 5))
            for i in range(b.num_rows):
                found = aligner.fragment(text[i], skip[i], take[i]) if take[i] else (False, [], [], [0], [0])
                made = [pa.array([x], pa.list_(pa.int32())) for x in found[1:]]
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(i, 1) for k in range(3)), pa.array([found[0]]), *made], names=["row", "key", "part", "ok", "a", "b", "na", "nb"])

    ranges = materialize(rows.mapInArrow(cut, "row long, key long, part long, skip long, take long, text string"))
    last = ranges.agg(F.max("part")).first()[0] or 0
    shape = f"row long, key long, part long, ok boolean, {_SHAPE}"
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made = ranges.repartition(width, "row", "part").mapInArrow(fragments, shape)

    def join(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("part")
        whole = reduce(compose, zip(group["ok"], *(group[c].map(lambda x: np.asarray(x, np.int64)) for c in ("a", "b", "na", "nb"))))
        first = group.iloc[0]
        return pd.DataFrame([[first["row"], first["key"], first["part"] // FAN, *whole]], columns=["row", "key", "part", "ok", "a", "b", "na", "nb"]).astype({"key": "Int64"})

    while last > 0:
        made = made.groupBy("row", F.floor(F.col("part") / FAN)).applyInPandas(join, shape)
        last //= FAN
    none = F.array().cast("array<int>")
    closed = [F.when(F.col("ok"), F.expr(f"slice({c}, 1, size({c}) - 1)")).otherwise(none).alias(c) for c in ("na", "nb")]  # the suffix of a whole text is empty
    return materialize(made.select("row", "key", *[F.when(F.col("ok"), F.col(c)).otherwise(none).alias(c) for c in ("a", "b")], *closed))


class Alignment:
    """Alignment of every text of a table, made anew by each reader for texts of usual length and kept for very long ones.

    Rows are numbered; ``key`` is a long column. Texts that are null, empty, broken UTF-8, or that the two tokenizers do not give back, have no tokens. Rows are
    aligned alone, so ties and repeated rows align alike, and each repeated row counts as a document. An empty table has empty results; other columns are not returned.
    """

    def __init__(self, documents: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text"):
        self.paths = a_path, b_path
        raw = F.col(f"`{text}`").cast("binary")
        number = F.monotonically_increasing_id() * 2
        long = F.coalesce(F.length(raw) > LONG, F.lit(False))
        given = documents.select(F.col(f"`{key}`").cast("long").alias("key"), raw.alias("text"), long.alias("long"))
        self.short = given.where("NOT long").select(number.alias("row"), "key", "text")
        self.long = _long_texts(given.where("long").select((number + 1).alias("row"), "key", "text"), a_path, b_path)

    def _map(self, make, schema: str, derive=None) -> DataFrame:
        """``make(parts)`` gives record batches of parts ``(row, key, aligner, texts)`` of usual texts or ``(row, key, None, block)`` of long ones."""
        paths = self.paths

        def of_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def parts():
                aligner = Aligner(Pair(*paths), derive)
                for b in batches:
                    texts = _decoded(b.column(2))
                    for i, j in _spans(texts, STEP):
                        yield b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), aligner, texts[i:j]

            yield from make(parts())

        def of_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from make((b.column(0).slice(i, 1), b.column(1).slice(i, 1), None, Block.of_lists(b.slice(i, 1), 2)) for b in batches for i in range(b.num_rows))

        return self.short.mapInArrow(of_text, schema).unionByName(self.long.mapInArrow(of_lists, schema))

    def groups(self) -> DataFrame:
        """``row, key, a, b, na, nb``: token ids by both tokenizers, and how many of each the groups hold, in order."""

        def make(parts):
            for row, key, aligner, given in parts:
                block = aligner.block(given) if aligner else given
                yield pa.RecordBatch.from_arrays([row, key, *block.arrays()], names=["row", "key", "a", "b", "na", "nb"])

        return self._map(make, f"row long, key long, {_SHAPE}")

    def pair_counts(self) -> DataFrame:
        """``a, b, n``: documents that hold the pair of ids linked; summed in tasks first."""

        def derive(block, held):
            code, _, n = block.pairs()
            held = held or Runs(np.int64)
            held.add(code, n)
            return held

        def make(parts):
            held: list = []
            size = 0

            def sums():
                code, n = (np.concatenate(x) for x in zip(*held))
                order = np.argsort(code, kind="stable")
                code = code[order]
                new = np.flatnonzero(np.r_[True, code[1:] != code[:-1]][: len(code)])
                return code[new], np.add.reduceat(n[order], new) if len(new) else n

            def send(code, n):
                for i in range(0, len(code), 100_000):
                    x = code[i : i + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array((x >> 32).astype(np.int32)), pa.array((x & 0xFFFFFFFF).astype(np.int32)), pa.array(n[i : i + 100_000])], names=["a", "b", "n"])

            for _, _, aligner, given in parts:
                if aligner:
                    units_, edge = aligner.units_of(given)
                    doc = np.repeat(np.arange(len(given)), np.diff(edge))
                    once = np.unique((doc << 32) | units_)  # a unit once a document
                    doc, units_ = once >> 32, once & 0xFFFFFFFF
                    code, at = aligner.more.take(units_) if aligner.more else (np.zeros(0, np.int64), np.zeros(1, np.int64))
                    code = _distinct(np.repeat(doc, np.diff(at)), code, np.ones(len(code), np.int64), len(given))[0]
                else:
                    code = given.pairs()[0]
                code = np.sort(code)
                new = np.flatnonzero(np.r_[True, code[1:] != code[:-1]][: len(code)])
                held.append((code[new], np.diff(np.r_[new, len(code)])))
                size += len(new)
                if size > HELD:
                    held = [sums()]
                    size = len(held[0][0])
                    if size > HELD // 2:
                        yield from send(*held[0])
                        held, size = [], 0
            if held:
                yield from send(*sums())

        return self._map(make, "a int, b int, n long", derive).groupBy("a", "b").agg(F.sum("n").alias("n"))

    def scores(self) -> DataFrame:
        """``key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``: sizes of each alignment, how many links have the highest count of their A id,
        the sum of the links' counts, and the digest of the groups' ids (empty without tokens).

        The counts of at most ``SHARED`` pairs, those of the highest count classes, go to every task, as do the highest counts by A id (no more than its
        vocabulary); all other pairs are joined.
        """
        counts = materialize(self.pair_counts())
        spark = counts.sparkSession
        top = counts.groupBy("a").agg(F.max("n").alias("best"))
        best_rows = top.toArrow()
        best = np.zeros(1 + max([0, *best_rows["a"].to_pylist()]), np.int64)
        best[best_rows["a"].to_numpy()] = best_rows["best"].to_numpy()
        often = frequent(counts, SHARED).toArrow()
        code = (often["a"].to_numpy().astype(np.int64) << 32) | often["b"].to_numpy()
        order = np.argsort(code)
        shared = spark.sparkContext.broadcast((code[order], often["n"].to_numpy()[order], best))
        a_path, b_path = self.paths
        cells: list = []

        def scored(block: Block):
            """Sums of each row, its digest text, and the links of it whose counts are not here."""
            known, number, best = shared.value
            if not cells:
                pair = Pair(a_path, b_path)
                base = max(len(pair.a_bytes), len(pair.b_bytes))
                cells.extend((base, Cells([b"%d%b" % (i, mark) for mark in (b",", b"|", b";") for i in range(base)])))
            base, table = cells
            rows = len(block.at) - 1
            na, nb = block.na.astype(np.int64), block.nb.astype(np.int64)
            a_stop, b_stop = np.cumsum(na), np.cumsum(nb)
            # tokens in the order of the digest: of each group first A's, then B's
            cell = np.empty(len(block.a) + len(block.b), np.int64)
            a_mark, b_mark = np.zeros(len(block.a), np.int64), np.zeros(len(block.b), np.int64)
            a_mark[a_stop - 1], b_mark[b_stop - 1] = base, 2 * base
            cell[np.arange(len(block.a)) + np.repeat(b_stop - nb, na)] = block.a + a_mark
            cell[np.arange(len(block.b)) + np.repeat(a_stop, nb)] = block.b + b_mark
            code, m, size = block.pairs()
            of = np.repeat(np.arange(rows), size)
            at = np.minimum(np.searchsorted(known, code), max(0, len(known) - 1))
            found = known[at] == code if len(known) else np.zeros(len(code), bool)
            n = np.where(found, number[at], 0) if len(known) else np.zeros(len(code), np.int64)
            links = np.bincount(np.repeat(np.arange(rows), np.diff(block.at)), na * nb, rows)
            sums = [np.diff(block.a_at), np.diff(block.b_at), np.diff(block.at), links,
                    np.bincount(of, np.where(found & (n == best[code >> 32]), m, 0), rows), np.bincount(of, m * n, rows)]
            return np.array(sums).astype(np.int64), table.join(cell, block.a_at + block.b_at), code[~found], m[~found], np.bincount(of[~found], minlength=rows)

        def derive(block, held):
            sums, texts, code, times, size = scored(block)
            held = held or [np.zeros((6, 0), np.int64), [], Runs(np.int64), Runs(np.int64)]
            held[0] = np.concatenate([held[0], sums], axis=1)
            held[1].extend(texts)
            held[2].add(code, size)
            held[3].add(times, size)
            return held

        def make(parts):
            for row, key, aligner, given in parts:
                if aligner:
                    units_, edge = aligner.units_of(given)
                    held = aligner.more or [np.zeros((6, 0), np.int64), [], Runs(np.int64), Runs(np.int64)]
                    running = np.zeros((6, len(units_) + 1), np.int64)
                    np.cumsum(held[0][:, units_], axis=1, out=running[:, 1:])
                    sums = running[:, edge[1:]] - running[:, edge[:-1]]
                    pick = held[1].__getitem__
                    numbers = units_.tolist()
                    texts = [b"".join(map(pick, numbers[x:z])) for x, z in zip(edge[:-1].tolist(), edge[1:].tolist())]
                    code, at = held[2].take(units_)
                    doc = np.repeat(np.repeat(np.arange(len(given)), np.diff(edge)), np.diff(at))
                    code, times, size = _distinct(doc, code, held[3].take(units_)[0], len(given))
                else:
                    sums, texts, code, times, size = scored(given)
                digest = [hashlib.sha256(t[:-1]).hexdigest() if t else "" for t in texts]
                rest = [lists(x.astype(k), size, t) for x, k, t in ((code >> 32, np.int32, pa.int32()), (code & 0xFFFFFFFF, np.int32, pa.int32()), (times, np.int64, pa.int64()))]
                yield pa.RecordBatch.from_arrays(
                    [row, key, *(pa.array(x) for x in sums), pa.array(digest, pa.string()), *rest],
                    names=["row", "key", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "ra", "rb", "rm"])

        schema = ("row long, key long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, "
                  "ra array<int>, rb array<int>, rm array<long>")
        part = materialize(self._map(make, schema, derive))
        rare = part.where("size(ra) > 0").select("row", F.explode(F.arrays_zip("ra", "rb", "rm")).alias("r")).select("row", F.col("r.ra").alias("a"), F.col("r.rb").alias("b"), F.col("r.rm").alias("m"))
        held = rare.join(counts, ["a", "b"]).join(F.broadcast(top), "a")  # one row per id of A's vocabulary
        more = held.groupBy("row").agg(F.sum(F.when(F.col("n") == F.col("best"), F.col("m")).otherwise(0)).alias("more_best"), F.sum(F.col("m") * F.col("n")).alias("more_sum"))
        none = F.lit(0).cast("long")
        return part.join(more, "row", "left").select(
            "key", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("more_best", none)).alias("n_best"),
            (F.col("count_sum") + F.coalesce("more_sum", none)).alias("count_sum"), "groups_sha256")
