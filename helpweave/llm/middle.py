"""Fill-in-the-middle: documents cut into prefix, middle and suffix, and put together again in training order.

Positions in bytes and in code points are converted through a sparse index of the characters that take more than one byte:
only their places and excess bytes are kept, and everything between two of them is arithmetic.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helpweave.llm.textnum import chunks, fresh

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Per cent of the documents that are cut, and of those the per cent in suffix-first order.
CUT, SPM = 90, 20
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True


class Exceptions:
    """Multibyte characters of a run of UTF-8 bytes: byte place, code-point place, and excess bytes up to and with each.

    A stray byte of broken UTF-8 that continues nothing counts as part of the character before it.
    """

    def __init__(self, data: np.ndarray):
        lead = np.flatnonzero(data >= 0xC0)
        excess = 1 + (data[lead] >= 0xE0).astype(np.int64) + (data[lead] >= 0xF0)
        stray = np.flatnonzero((data & 0xC0) == 0x80)
        if len(stray) != excess.sum():  # broken text: count what is there
            owner = np.searchsorted(lead, stray, "right") - 1
            excess = np.bincount(owner[owner >= 0], minlength=len(lead)).astype(np.int64)
        self.total = np.r_[0, np.cumsum(excess)]
        self.at_byte = lead
        self.at_char = lead - self.total[:-1]

    def to_char(self, byte: np.ndarray) -> np.ndarray:
        """Code points before each byte place (the start of a character, or the end)."""
        return byte - self.total[np.searchsorted(self.at_byte, byte)]

    def to_byte(self, char: np.ndarray) -> np.ndarray:
        """Bytes before each code-point place."""
        return char + self.total[np.searchsorted(self.at_char, char)]


def unit_starts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Byte places at which a unit starts: a run of ASCII letters is one, and so is any other code point."""
    letter = LETTER[data]
    start = (data & 0xC0) != 0x80
    start[1:] &= ~(letter[1:] & letter[:-1])
    first = bounds[:-1][bounds[:-1] < bounds[1:]]
    start[first] = True
    return np.flatnonzero(start)


def draws(key: Column, seed: int = 1) -> list[Column]:
    """Four numbers below 2 ** 32 that depend on the seed and the key alone (a null key counts as empty)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(documents: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 1, cut: int = CUT, spm: int = SPM) -> DataFrame:
    """All columns of ``documents`` but ``text``, then ``units, form, prefix_chars, middle_chars, output``.

    The text is cut at two units drawn from ``seed`` and ``key``; a unit is a run of ASCII letters or one other code point. ``form``
    is ``psm`` (prefix, suffix, middle), ``spm`` (suffix first) or ``plain`` (the text as it is): for the share of documents beyond ``cut``
    per cent, empty texts, and texts that hold one of the marks themselves, so that ``restore`` never has to guess.

    Null texts count as empty. Rows are cut alone: repeated rows come out alike, rows of equal key and other text are cut at other places, a null key
    draws like an empty one. Columns of ``documents`` named like a result are replaced, all others pass through; an empty table stays empty.
    """
    made = [T.StructField("units", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()),
            T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())]
    names = [f.name for f in made]
    rest = [f for f in documents.schema.fields if f.name not in (text, *names)]
    draw = F.array(*draws(F.col(f"`{key}`"), seed))
    kept = [f.name for f in rest]
    given = documents.select(*[F.col(f"`{n}`") for n in kept], draw.alias(fresh("_draw", kept)), F.col(f"`{text}`").cast("binary").alias(fresh("_text", kept)))
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            drawn = b.column(len(rest)).flatten().to_numpy().reshape(-1, 4)
            for i, j, data, bounds in chunks(b.column(len(rest) + 1)):
                starts = unit_starts(data, bounds)
                first = np.searchsorted(starts, bounds)
                n = np.diff(first)
                h = drawn[i:j]
                ends = np.sort(h[:, :2] % (n + 1)[:, None], axis=1) + first[:-1, None]
                # the unit after the last of a document starts where the next document does
                cuts = np.minimum(np.r_[starts, len(data)][ends], bounds[1:, None])
                chars = Exceptions(data).to_char(np.c_[bounds[:-1], cuts])
                raw = data.tobytes()
                form, out = [], []
                for k in range(j - i):
                    x, z = int(bounds[k]), int(bounds[k + 1])
                    a, c = int(cuts[k, 0]), int(cuts[k, 1])
                    whole = raw[x:z]
                    if x == z or h[k, 2] % 100 >= cut or any(m in whole for m in marks):
                        form.append("plain")
                        out.append(whole)
                    elif h[k, 3] % 100 < spm:
                        form.append("spm")
                        out.append(b"".join((marks[1], raw[c:z], marks[0], raw[x:a], marks[2], raw[a:c])))
                    else:
                        form.append("psm")
                        out.append(b"".join((marks[0], raw[x:a], marks[1], raw[c:z], marks[2], raw[a:c])))
                plain = np.array([f == "plain" for f in form])
                sizes = np.diff(chars, axis=1)
                new = [pa.array(n, pa.int64()), pa.array(form, pa.string()), *(pa.array(sizes[:, s], pa.int64(), mask=plain) for s in (0, 1)),
                       pa.array(out, pa.binary()).view(pa.string())]
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, j - i) for c in range(len(rest))), *new], names=[*b.schema.names[: len(rest)], *names])

    return given.mapInArrow(run, T.StructType([*rest, *made]))


def restore(output: Column, form: Column) -> Column:
    """The text behind an output; column functions only. A mark occurs once in an output that is not plain."""
    last = F.substring_index(output, MIDDLE, -1)
    head = F.substring_index(output, MIDDLE, 1)
    behind = {m: F.substring_index(head, m, -1) for m in (PREFIX, SUFFIX)}
    before = {m: F.substr(F.substring_index(head, m, 1), F.lit(len(PREFIX) + 1)) for m in (PREFIX, SUFFIX)}
    return (
        F.when(form == "psm", F.concat(before[SUFFIX], last, behind[SUFFIX]))
        .when(form == "spm", F.concat(behind[PREFIX], last, before[PREFIX]))
        .otherwise(output)
    )
