"""Choice of frequent words without sorting or gathering all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def frequent(counts: DataFrame, limit: int) -> DataFrame:
    """The rows (``n``: a positive count) of the highest count classes that hold at most ``limit`` rows together.

    Classes are eighths of a doubling of the count, so the choice needs a histogram of a few hundred rows only and no task sends
    more than its share of the chosen words.
    """
    level = F.floor(F.log2(F.col("n").cast("double")) * 8)
    sizes = counts.groupBy(level.alias("level")).agg(F.count("*").alias("words")).collect()
    room, cut = limit, None
    for r in sorted(sizes, key=lambda r: -r["level"]):
        if r["words"] > room:
            break
        room, cut = room - r["words"], r["level"]
    return counts.where(F.lit(False) if cut is None else level >= cut)
