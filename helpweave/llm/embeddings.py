"""Embedding near-dedup: int8 tile products with an error bound per vector, full precision only where it can matter."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helpweave.llm.graph import components
from helpweave.session import materialize

#: Distinct vectors in one tile; a task holds two tiles.
TILE = 2048
#: Pairs recomputed at once in full precision.
EXACT = 1 << 16
#: Room for the rounding of the bound itself.
SLACK = 1e-9


def usable(vector: Column) -> Column:
    """True for vectors that have a direction: not null, no null or non-finite component, not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Int8 codes, scales and error norms of unit rows: row = scale * code + rest, and norm(rest) is at most the error."""
    scale = np.abs(x).max(axis=1) / 127.0
    code = np.rint(x / scale[:, None]).astype(np.int8)
    error = np.linalg.norm(x - scale[:, None] * code, axis=1) + SLACK
    return code, scale, error


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def tile_links(a: np.ndarray, b: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """Index pairs of unit rows with cosine from ``threshold`` on, and how many pairs needed full precision.

    For rows ``s*q + e`` the product of the codes misses the cosine by at most
    ``|e1|*|s2*q2| + |s1*q1|*|e2| + |e1|*|e2|``, and ``|s*q|`` is at most ``1 + |e|``. Sums of int8 products stay below 2**24 up to
    1,040 dimensions, so float32 matrices multiply them exactly there; beyond, float64 is used.
    """
    qa, sa, ea = quantise(a)
    qb, sb, eb = quantise(b)
    kind = np.float32 if a.shape[1] <= 1040 else np.float64
    near = (qa.astype(kind) @ qb.astype(kind).T).astype(np.float64) * sa[:, None] * sb[None, :]
    bound = ea[:, None] * (1 + eb)[None, :] + (1 + ea)[:, None] * eb[None, :] + ea[:, None] * eb[None, :] + SLACK
    maybe = near >= threshold - bound
    if same:
        maybe &= np.tri(len(a), len(b), -1, dtype=bool).T
    i, j = np.nonzero(maybe)
    sure = near[i, j] >= threshold + bound[i, j]
    ask = np.flatnonzero(~sure)
    for at in range(0, len(ask), EXACT):
        k = ask[at : at + EXACT]
        sure[k] = np.einsum("ij,ij->i", a[i[k]], b[j[k]]) >= threshold
    return i[sure], j[sure], len(ask)


def forest(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, least node of its part) that join the same nodes as the given links; at most ``n`` of them."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        low = np.minimum(low, low[low])
        if np.array_equal(low, root):
            break
        root = low
    at = np.flatnonzero(root != np.arange(n))
    return at, root[at]


def near_vectors(vectors: DataFrame, threshold: float = 0.98, key: str = "vec_id", vector: str = "embedding", block: str = "label", tile: int = TILE) -> DataFrame:
    """``key, n_links, component_id, kept`` for every row.

    Rows link when their blocks are equal and not null, their lengths are equal and their cosine in double precision
    reaches ``threshold``. Vectors that are null, empty, zero or hold null or non-finite components link with nothing: 0 links, own
    component, kept. Repeated rows are vectors of their own and link with each other. Other columns are ignored; no rows give no rows.

    Equal vectors are compared once: only distinct ones go into tiles, so a hot vector costs one comparison. A block of any
    size is cut into tiles of about ``tile`` vectors and each pair of tiles is one small task; a task gives link
    counts per vector and a spanning forest, never all pairs.
    """
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).alias("vec"), F.col(block).alias("block"))
    rows = rows.withColumn("ok", usable(F.col("vec")) & F.col("block").isNotNull())
    rows = rows.withColumn("same", F.when(F.col("ok"), F.sha2(F.concat_ws("|", F.col("block").cast("string"), F.col("vec").cast("string")), 256)))
    known = rows.where("ok").groupBy("same").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("block").alias("block"), F.first("vec").alias("vec"))
    known = materialize(known.withColumn("block", F.concat_ws("|", F.col("block").cast("string"), F.size("vec").cast("string"))))
    sizes = known.groupBy("block").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    placed = known.join(sizes, "block").withColumn("t", F.pmod(F.xxhash64("same"), F.col("tiles")).cast("int"))
    copies = placed.select("rep", "n", "vec", "block", "t", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("o"))
    pairs = copies.select("rep", "n", "vec", "block", "t", F.least("t", "o").alias("lo"), F.greatest("t", "o").alias("hi"))

    def compare(g: pd.DataFrame) -> pd.DataFrame:
        lo, hi = int(g["lo"].iat[0]), int(g["hi"].iat[0])
        g = g.sort_values("rep", ignore_index=True)
        x, n = unit(np.vstack(g["vec"].to_numpy()).astype(np.float64)), g["n"].to_numpy()
        a = np.flatnonzero(g["t"].to_numpy() == lo)
        b = a if lo == hi else np.flatnonzero(g["t"].to_numpy() == hi)
        i, j, asked = tile_links(x[a], x[b], threshold, lo == hi)
        i, j = a[i], b[j]
        links = np.bincount(i, n[j], len(g)) + np.bincount(j, n[i], len(g))
        node, root = forest(i, j, len(g))
        low = np.arange(len(g))
        low[node] = root
        some = np.flatnonzero(links > 0)
        rep = g["rep"].to_numpy()
        return pd.DataFrame({"rep": rep[some], "links": links[some].astype(np.int64), "root": rep[low[some]]})

    found = materialize(pairs.groupBy("block", "lo", "hi").applyInPandas(compare, "rep long, links long, root long"))
    parts = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    classes = known.select("same", "rep", "n").join(counts, "rep", "left").join(parts.withColumnRenamed("id", "rep"), "rep", "left").select(
        "same", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component_id", "rep").alias("part"))
    out = rows.select("id", "same").join(classes, "same", "left")
    part = F.coalesce("part", "id")
    return out.select(F.col("id").alias(key), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), part.alias("component_id"), (F.col("id") == part).alias("kept"))
