"""Benchmark decontamination: windows of typed templates and of exact words joined by hash, with slots checked for consistency."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helpweave.llm.labelled import code_points, code_values
from helpweave.llm.textnum import BYTE_CODE, LOWER, Words, chunks, code_windows, lists, prefix_sums, span_hash
from helpweave.session import materialize

#: Template words in a window, the least share of them that is literal, and the share of an item's windows that a document must hold.
WIDTH, LITERAL, COVER = 6, 0.5, 0.5
#: Consecutive exact words (all of a shorter item) that make an item held, and the share of its words in matching windows that does, whatever share of windows that is.
RUN, WORDS = 13, 0.75
#: Benchmark windows up to which their hashes are broadcast as a filter; a larger benchmark is joined without it.
FILTER_LIMIT = 2_000_000
#: Benchmark windows up to which the windows themselves are broadcast as well.
JOIN_LIMIT = 100_000
UNITS = (
    "mm cm km inch inches ft foot feet yd yard yards mile miles mg kg gram grams ton tons lb lbs pound pounds oz ounce ounces "
    "ml litre litres liter liters sec seconds minute minutes hour hours day days week weeks month months year years "
    "dollar dollars euro euros cent cents usd eur gbp percent degree degrees kmh mph hz khz mhz kw"
)
BREAK = np.zeros(256, np.int64)
BREAK[[ord(c) for c in ".!?:;\n\r"]] = 1
GAP = np.ones(256, bool)
GAP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
EXACT = np.uint64(0x3C6EF372FE94F82B)
#: Code points whose case folding is another single one, after lower case.
FOLD = {ord(c): ord(f) for i in range(128, 65536) if len(f := (c := chr(i).lower()).casefold()) == 1 and len(c) == 1 and f != c}
LITERAL_WORD, NUMBER, NAME, UNIT = range(4)
TYPE_CODE = np.array([0, 0x8F1BBCDCBFA53E0B, 0xA24BAED4963EE407, 0xC2B2AE3D27D4EB4F], np.uint64)


def _lower(data: np.ndarray) -> np.ndarray:
    """A-Z and the capitals of two UTF-8 bytes led by C3 in lower case; lengths stay."""
    out = LOWER[data]
    if len(data) > 1:
        after = data[1:]
        out[1:][(data[:-1] == 0xC3) & (after >= 0x80) & (after <= 0x9E) & (after != 0x97)] += 32
    return out


_unit_bytes = np.frombuffer(UNITS.encode(), np.uint8)
_unit_words = Words(_unit_bytes, np.array([0, len(_unit_bytes)]), blank=GAP)
UNIT_HASHES = np.sort(_unit_words.hash)


class Template:
    """Canonical words of a chunk: code, type and own value of each.

    Words are runs of letters and digits. A word that starts with a digit is a number; a capitalised word inside a sentence is a
    name; a word of ``UNITS`` is a unit; all others are literal, in lower case.
    """

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        words = Words(data, bounds, blank=GAP)
        low = _lower(data)
        self.bounds, start, end = words.bounds, words.start, words.end
        self.value = span_hash(prefix_sums(BYTE_CODE[low]), start, end)
        head = data[start]
        second = data[np.minimum(start + 1, max(0, len(data) - 1))] if len(data) else head
        upper = ((head >= 65) & (head <= 90)) | ((head == 0xC3) & (second >= 0x80) & (second <= 0x9E))
        breaks = np.zeros(len(data) + 1, np.int64)
        np.cumsum(BREAK[data], out=breaks[1:])
        opens = np.ones(len(start), bool)
        opens[1:] = breaks[start[1:]] > breaks[end[:-1]]
        opens[self.bounds[:-1][self.bounds[:-1] < len(start)]] = True
        self.kind = np.zeros(len(start), np.int64)
        at = np.minimum(np.searchsorted(UNIT_HASHES, self.value), len(UNIT_HASHES) - 1)
        self.kind[UNIT_HASHES[at] == self.value] = UNIT
        self.kind[upper & ~opens] = NAME
        self.kind[(head >= 48) & (head <= 57)] = NUMBER
        self.code = np.where(self.kind == LITERAL_WORD, self.value, TYPE_CODE[self.kind])
        heads = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
        codes, _ = code_points(data, bounds, lower=True)
        high = np.flatnonzero(codes >= 128)
        if len(high):
            some, back = np.unique(codes[high], return_inverse=True)
            codes = codes.copy()
            codes[high] = np.array([FOLD.get(int(c), int(c)) for c in some], np.uint32)[back]
        self.exact = span_hash(prefix_sums(code_values(codes)), heads[start], heads[end])

    def exact_windows(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, first word and hash of all windows of ``width`` words without regard to case or type."""
        h, whole = code_windows(self.exact, self.bounds, width)
        at = np.flatnonzero(whole)
        row = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))[at]
        return row, at, h[at] ^ EXACT

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, first word and hash of the windows of ``width`` words that are literal enough."""
        h, whole = code_windows(self.code, self.bounds, width)
        if not len(h):
            none = np.zeros(0, np.int64)
            return none, none, h
        literal = np.zeros(len(self.code) + 1, np.int64)
        np.cumsum(self.kind == LITERAL_WORD, out=literal[1:])
        at = np.flatnonzero(whole & (literal[width:] - literal[: len(literal) - width] >= LITERAL * width)[: len(h)])
        row = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))[at]
        return row, at, h[at]

    def slots(self, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Values of the placeholders in each window, their places in it, and how many each has."""
        if not len(at):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        grid = at[:, None] + np.arange(width)
        held = self.kind[grid] != LITERAL_WORD
        return self.value[grid][held], np.nonzero(held)[1], held.sum(axis=1)


def template_windows(texts: DataFrame, key: str, wanted, width: int, widths: list[int] | None = None) -> DataFrame:
    """``key, at, h, slots, spots, exact, n, literal``: windows of each text (only hashes in the sorted broadcast array ``wanted``, if given).

    Template windows of ``width`` words, and exact windows (``exact``) of each of ``widths``; without ``widths`` of ``width`` or of all
    words of a shorter text. ``n`` is the number of words, ``literal`` that of template windows. Exact windows shorter than ``width``
    are whole items, so one of each hash is kept for a text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            for i, j, data, bounds in chunks(b.column(1)):
                t = Template(data, bounds)
                n = np.diff(t.bounds)
                literal = np.zeros(j - i, np.int64)
                for exact, w in [(False, width), *((True, w) for w in (widths if widths is not None else range(1, width + 1)))]:
                    row, at, h = t.exact_windows(w) if exact else t.windows(w)
                    if not exact:
                        literal = np.bincount(row, minlength=j - i)
                    elif widths is None and w < width:
                        ok = n[row] == w
                        row, at, h = row[ok], at[ok], h[ok]
                    if wanted is not None:
                        have = wanted.value
                        ok = have[np.minimum(np.searchsorted(have, h), len(have) - 1)] == h if len(have) else np.zeros(len(h), bool)
                        row, at, h = row[ok], at[ok], h[ok]
                    if exact and w < width and len(h):
                        order = np.lexsort((at, h, row))
                        row, at, h = row[order], at[order], h[order]
                        ok = np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])]
                        row, at, h = row[ok], at[ok], h[ok]
                    value, spot, count = t.slots(at[:0] if exact else at, w)
                    count = np.zeros(len(at), np.int64) if exact else count
                    yield pa.RecordBatch.from_arrays(
                        [ids.slice(i, j - i).take(pa.array(row)), pa.array(at - t.bounds[row]), pa.array(h.view(np.int64)), lists(value.view(np.int64), count, pa.int64()),
                         lists(spot, count, pa.int64()), pa.array(np.full(len(at), exact)), pa.array(n[row]), pa.array(literal[row])],
                        [key, "at", "h", "slots", "spots", "exact", "n", "literal"])

    kind = dict(texts.dtypes)[key]
    return texts.select(key, F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"{key} {kind}, at long, h long, slots array<long>, spots array<long>, exact boolean, n long, literal long")


def contamination(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH, cover: float = COVER) -> DataFrame:
    """``doc_id, item_id, windows, of, first, last, reparameterised``: benchmark items that documents hold.

    ``of`` are the windows of ``width`` words of an item (one window of all words, if it has fewer), ``windows`` those that the document
    has at their places: as the same words without regard to case, or as a template whose slots are consistent. Each number,
    name or unit of the item stands for its most frequent value in the alignment (in a tie for the item's own, or else for none); windows with another
    value do not count, unless they are the item's word for word. A document holds an item when ``windows`` are at least ``cover`` of ``of``,
    or the template windows are of those that are literal enough, or windows cover ``WORDS`` of the item's words, or ``RUN`` words in a
    row (all words of a shorter item) are the same.

    ``reparameterised`` says that some value differs from the item's. ``first`` and ``last`` are word places in the document.
    Null and empty texts and texts without words hold nothing and are held by nothing. Null ids give no rows. Repeated documents or
    items give one row per pair of ids. Other columns are ignored.
    """
    items = materialize(template_windows(benchmark.where("item_id IS NOT NULL").select("item_id", "text"), "item_id", None, width))
    widths = sorted(r["w"] for r in items.select(F.least("n", F.lit(width)).alias("w")).distinct().collect())
    items = items.select("item_id", F.col("at").alias("item_at"), "h", F.col("slots").alias("item_slots"), "spots", "exact", "n", "literal")
    spark = documents.sparkSession
    wanted = None
    size = items.count()
    if size <= FILTER_LIMIT:
        found = items.select("h").distinct().toArrow()["h"].to_numpy().astype(np.int64).view(np.uint64)
        wanted = spark.sparkContext.broadcast(np.sort(found))
    hits = template_windows(documents.where("doc_id IS NOT NULL").select("doc_id", "text"), "doc_id", wanted, width, widths).select("doc_id", "at", "h", "slots", "exact")
    both = hits.join(F.broadcast(items) if size <= JOIN_LIMIT else items, ["h", "exact"]).withColumn("shift", F.col("at") - F.col("item_at"))
    filled = F.transform(F.arrays_zip("item_slots", "slots", "spots"), lambda z: F.struct((F.col("item_at") + z["spots"]).alias("place"), z["item_slots"].alias("item"), z["slots"].alias("doc")))
    aligned = both.groupBy("doc_id", "item_id", "shift", "n", "literal").agg(
        F.collect_set(F.when(F.col("exact"), F.col("item_at"))).alias("same"),
        F.collect_set(F.when(~F.col("exact"), F.struct(F.col("item_at").alias("at"), filled.alias("slots")))).alias("templates"), F.min("at").alias("first"), F.max("at").alias("last"))
    votes = F.array_distinct(F.flatten(F.transform("templates", lambda t: t["slots"])))
    aligned = aligned.withColumn("votes", votes)
    values = F.array_distinct(F.transform("votes", lambda v: F.struct(v["item"].alias("item"), v["doc"].alias("doc"))))
    count = lambda p: F.size(F.filter("votes", lambda v: (v["item"] == p["item"]) & (v["doc"] == p["doc"])))
    aligned = aligned.withColumn("values", F.transform(values, lambda p: F.struct(p["item"].alias("item"), p["doc"].alias("doc"), count(p).alias("c"))))
    beaten = lambda p: F.exists("values", lambda o: (o["item"] == p["item"]) & (o["doc"] != p["doc"]) & ((o["c"] > p["c"]) | ((o["c"] == p["c"]) & (p["item"] != p["doc"]))))
    chosen = F.transform(F.filter("values", lambda p: ~beaten(p)), lambda p: F.struct(p["item"].alias("item"), p["doc"].alias("doc")))
    aligned = aligned.withColumn("chosen", chosen)
    fits = lambda t: F.forall(t["slots"], lambda z: F.array_contains("chosen", F.struct(z["item"].alias("item"), z["doc"].alias("doc")))) | F.forall(t["slots"], lambda z: z["item"] == z["doc"])
    aligned = aligned.withColumn("templates", F.filter("templates", fits)).withColumn("same", F.array_sort("same"))
    one = F.least("n", F.lit(width))
    steps = (F.least("n", F.lit(RUN)) - one).cast("int")
    run = F.exists(F.transform("same", lambda x, i: F.get("same", i + steps) == x + steps), lambda ok: F.coalesce(ok, F.lit(False)))
    aligned = aligned.withColumn("run", run)
    pairs = aligned.groupBy("doc_id", "item_id", "n", "literal").agg(
        F.array_distinct(F.flatten(F.collect_list("same"))).alias("exact"), F.array_distinct(F.flatten(F.collect_list(F.transform("templates", lambda t: t["at"])))).alias("kept"),
        F.max("run").alias("run"), F.min("first").alias("first"), (F.max("last") + F.min(one) - 1).alias("last"),
        F.max(F.exists("templates", lambda t: F.exists(t["slots"], lambda z: z["item"] != z["doc"]))).alias("reparameterised"))
    pairs = pairs.withColumn("places", F.array_union("exact", "kept")).withColumn("windows", F.size("places").cast("long")).withColumn("of", F.col("n") - one + 1)
    words = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + one - 1)))))
    held = (F.col("windows") >= cover * F.col("of")) | F.col("run") | (words >= WORDS * F.col("n"))
    held |= (F.col("literal") > 0) & (F.size("kept") >= cover * F.col("literal"))
    found = pairs.where((F.col("windows") > 0) & held).groupBy("doc_id", "item_id")
    return found.agg(F.max("windows").alias("windows"), F.max("of").alias("of"), F.min("first").alias("first"), F.max("last").alias("last"), F.max("reparameterised").alias("reparameterised"))


def drop_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``documents`` (all columns, all rows) without those that hold a benchmark item; rows with a null ``doc_id`` stay."""
    held = contamination(documents, benchmark).select("doc_id").distinct()
    return documents.join(held, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in documents.columns])
