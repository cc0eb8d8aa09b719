"""Exact top documents without scoring every pair: an index of document blocks, and a threshold per query that decides which blocks are read.

Documents are dealt to blocks by a hash of their id. The index has one row per term and block: the block's documents of that term, and the largest weight among them.
What a query's terms can add up to in a block bounds every score in it, so a query is answered in two waves:

1. The blocks of highest bound are scored. Their k-th best score is reached by k documents: the query's threshold.
2. Only blocks whose bound reaches the threshold are scored, and only documents that reach it are returned.

Inside a task, the queries that read one block are scored against it together, as sums over arrays; no row is made for a pair that does not come near the top. Every
comparison leaves a slack, so documents of equal score survive and the result equals full scoring.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helpweave.session import fan_out, materialize

#: Documents of a block, on average.
BLOCK_DOCS = 512
#: Blocks of highest bound that give a query its threshold.
FIRST_BLOCKS = 24
#: Queries that meet a block in one task, and products of weights that are made at a time there.
BATCH, PRODUCTS = 2048, 1 << 21
SLACK = 1e-6


def block_rows(postings: DataFrame, norms: DataFrame) -> DataFrame:
    """``term_id, block, lexical, top, low, docs, ws`` from ``postings (block, term_id, lexical, doc, w)``; weights that are not lexical are divided by the document's norm
    in ``norms (part, of, norm)``, which is dealt alike.

    Rows are dealt by block, that is by document, so a term that most documents hold is spread like any other.
    """
    doc = postings.schema["doc"].dataType.simpleString()
    names = ["term_id", "block", "lexical", "top", "low", "docs", "ws"]

    def flat(column: pa.ChunkedArray) -> pa.Array:
        whole = column.combine_chunks()
        return pa.concat_arrays(whole.chunks) if isinstance(whole, pa.ChunkedArray) else whole

    def cut(t: pa.Table, norm: pa.Table) -> pa.Table:
        t = t.sort_by([("term_id", "ascending"), ("doc", "ascending")])
        lexical, w, docs, term = t["lexical"].to_numpy(), t["w"].to_numpy(), flat(t["doc"]), t["term_id"].to_numpy()
        if norm.num_rows:
            place = pa.compute.index_in(docs, flat(norm["of"])).fill_null(0).to_numpy()
            w = np.where(lexical, w, w / norm["norm"].to_numpy()[place])
        first = np.flatnonzero(np.r_[np.ones(min(1, len(term)), bool), term[1:] != term[:-1]])
        at = pa.array(np.r_[first, len(term)].astype(np.int32))
        whole = [flat(t[k]).take(pa.array(first)) for k in names[:3]]
        tops = [pa.array(f.reduceat(w, first) if len(first) else w) for f in (np.maximum, np.minimum)]
        lists = [pa.ListArray.from_arrays(at, v) for v in (docs, pa.array(w))]
        return pa.Table.from_arrays([*whole, *tops, *lists], names=names)

    fields = f"term_id long, block long, lexical boolean, top double, low double, docs array<{doc}>, ws array<double>"
    rows = fan_out(postings.select("block", "term_id", "lexical", "doc", "w"), "block").groupBy("block")
    return rows.cogroup(fan_out(norms, "part").groupBy("part")).applyInArrow(cut, fields)


def block_bounds(terms: DataFrame, blocks: DataFrame) -> DataFrame:
    """``qid, block, most_b, most_c``: what the terms ``(qid, term_id, qw > 0)`` can add up to in each block that has any of them, by kind."""
    add = F.greatest(F.col("qw") * F.col("top"), F.lit(0.0))
    held = terms.select("qid", "term_id", "qw").join(blocks.select("term_id", "block", "lexical", "top"), "term_id")
    return held.groupBy("qid", "block").agg(F.sum(F.when(F.col("lexical"), add).otherwise(0.0)).alias("most_b"), F.sum(F.when(F.col("lexical"), 0.0).otherwise(add)).alias("most_c"))


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column one after the other, and where each list starts."""
    whole = column.combine_chunks()
    whole = pa.concat_arrays(whole.chunks) if isinstance(whole, pa.ChunkedArray) else whole
    return whole.flatten().to_numpy(), np.r_[0, np.cumsum(whole.value_lengths().to_numpy())]


def _sums(ask: pa.Table, held: pa.Table):
    """For slices of the queries of ``ask``: first and last query, and matrices by query and document of hits and of both sums; and the documents."""
    order = np.argsort(held["term_id"].to_numpy(), kind="stable")
    term = held["term_id"].to_numpy()[order]
    lexical = held["lexical"].combine_chunks().to_numpy(zero_copy_only=False)[order]
    (docs, at), (ws, _) = _flat(held["docs"]), _flat(held["ws"])
    known, col = np.unique(docs, return_inverse=True)
    start, size = at[:-1][order], np.diff(at)[order]
    want, edge = _flat(ask["term_ids"])
    qws = _flat(ask["qws"])[0]
    row = np.minimum(np.searchsorted(term, want), len(term) - 1)
    ok = term[row] == want
    query, row, qw = np.repeat(np.arange(ask.num_rows), np.diff(edge))[ok], row[ok], qws[ok]
    cost = np.cumsum(size[row])
    i = 0
    while i < len(row):
        # whole queries, as many as make a bounded number of products
        j = int(np.searchsorted(cost, (cost[i - 1] if i else 0) + PRODUCTS, "right"))
        j = int(np.searchsorted(query, query[max(i, min(j, len(row) - 1))], "left")) if j < len(row) else len(row)
        j = j if j > i else int(np.searchsorted(query, query[i], "right"))
        q0, q1 = query[i], query[j - 1] + 1
        n = size[row[i:j]]
        stop = np.r_[0, np.cumsum(n)]
        place = np.arange(stop[-1]) + np.repeat(start[row[i:j]] - stop[:-1], n)
        cell = np.repeat((query[i:j] - q0) * len(known), n) + col[place]
        product, lex = np.repeat(qw[i:j], n) * ws[place], np.repeat(lexical[row[i:j]], n)
        shape, cells = (q1 - q0, len(known)), (q1 - q0) * len(known)
        hit = np.bincount(cell, minlength=cells).reshape(shape) > 0
        yield q0, q1, hit, np.bincount(cell, np.where(lex, product, 0.0), cells).reshape(shape), np.bincount(cell, np.where(lex, 0.0, product), cells).reshape(shape), known
        i = j


def _meet(asked: DataFrame, packed: DataFrame, blocks: DataFrame, queries: int, emit, columns: dict[str, str]) -> DataFrame:
    """``emit(ask, q0, q1, hit, b, c, known)`` gives the columns of the rows that a task returns for some queries and one block; the first is the query's place in ``ask``.

    ``asked``: ``qid, block`` and what ``emit`` reads; ``packed``: ``qid, term_ids, qws``. More than ``BATCH`` queries meet a block in several tasks.
    """
    batches = max(1, -(-queries // BATCH))
    batch = F.pmod(F.xxhash64("qid"), F.lit(batches)).cast("int")
    left = asked.join(packed.select("qid", "term_ids", "qws"), "qid").withColumn("batch", batch)
    needed = asked.select(F.col("block").alias("read"), batch.alias("batch")).distinct()
    known = packed.select(F.explode("term_ids").alias("term_id")).distinct()
    held = blocks.select(F.col("block").alias("own"), "term_id", "lexical", "docs", "ws").join(known, "term_id", "left_semi")
    right = held.join(needed, F.col("own") == F.col("read")).select(F.col("read").alias("block"), "batch", "term_id", "lexical", "docs", "ws")

    def score(ask: pa.Table, held: pa.Table) -> pa.Table:
        out = [[] for _ in columns]
        ids = ask["qid"].combine_chunks()
        if ask.num_rows and held.num_rows:
            for part in _sums(ask, held):
                for kept, v in zip(out, emit(ask, *part)):
                    kept.append(v)
        flat = [np.concatenate(v) if v else np.zeros(0, np.int64) for v in out]
        types = {"qid": ids.type, "doc": held.schema.field("docs").type.value_type, "n": pa.int64()}
        made = pa.Table.from_arrays([ids.take(pa.array(flat[0].astype(np.int64))), *map(pa.array, flat[1:])], names=list(columns))
        return made.cast(pa.schema([pa.field(c, types.get(c, pa.float64())) for c in columns]))

    return left.groupBy("block", "batch").cogroup(right.groupBy("block", "batch")).applyInArrow(score, ", ".join(f"{c} {t}" for c, t in columns.items()))


def _types(packed: DataFrame, blocks: DataFrame) -> dict[str, str]:
    return {"qid": dict(packed.dtypes)["qid"], "doc": dict(blocks.dtypes)["docs"][6:-1], "bm25": "double", "cosine": "double"}


def block_scores(asked: DataFrame, packed: DataFrame, blocks: DataFrame, k: int, queries: int) -> DataFrame:
    """``qid, doc, bm25, cosine, score`` of the best ``k`` documents (with ties) of each pair in ``asked (qid, block, alpha, beta, floor)`` that reach ``floor``; the score is
    ``alpha * bm25 + beta * cosine``."""

    def emit(ask, q0, q1, hit, b, c, known):
        alpha, beta, floor = (ask[x].to_numpy()[q0:q1, None] for x in ("alpha", "beta", "floor"))
        total = np.where(hit, alpha * b + beta * c, -np.inf)
        kth = np.partition(total, len(known) - k, axis=1)[:, len(known) - k, None] if k < len(known) else np.full((len(total), 1), -np.inf)
        x, y = np.nonzero(hit & (total >= np.maximum(kth, floor) - SLACK))
        return x + q0, known[y], b[x, y], c[x, y], total[x, y]

    return _meet(asked, packed, blocks, queries, emit, _types(packed, blocks) | {"score": "double"})


def block_ends(asked: DataFrame, packed: DataFrame, blocks: DataFrame, queries: int) -> DataFrame:
    """``qid, n, b_lo, b_hi, c_lo, c_hi`` of each pair in ``asked (qid, block)``: documents that share a term, and their least and largest sums."""

    def emit(ask, q0, q1, hit, b, c, known):
        x = np.flatnonzero(hit.any(axis=1))
        low, high = (lambda v: np.where(hit, v, np.inf).min(axis=1)[x]), (lambda v: np.where(hit, v, -np.inf).max(axis=1)[x])
        return x + q0, hit.sum(axis=1)[x], low(b), high(b), low(c), high(c)

    return _meet(asked, packed, blocks, queries, emit, {"qid": dict(packed.dtypes)["qid"], "n": "long"} | dict.fromkeys(("b_lo", "b_hi", "c_lo", "c_hi"), "double"))


def block_fronts(asked: DataFrame, packed: DataFrame, blocks: DataFrame, queries: int, weights: tuple[float, float]) -> DataFrame:
    """``qid, doc, bm25, cosine`` of the documents of each pair in ``asked (qid, block, cap)`` that can be best by ``w0 * bm25 / peak + w1 * cosine`` for some peak
    between the pair's best BM25 and ``cap``: those that no other document of the block surpasses in both. Documents of the largest cosine are always among them."""
    near, (w0, w1) = 1e-8, weights

    def emit(ask, q0, q1, hit, b, c, known):
        b, c = np.where(hit, b, -np.inf), np.where(hit, c, -np.inf)
        order = np.lexsort((-c, -b), axis=1)
        b, c = np.take_along_axis(b, order, 1), np.take_along_axis(c, order, 1)
        far = np.maximum.accumulate(c, axis=1)
        before = np.c_[np.full((len(c), 1), -np.inf), far[:, :-1]]
        lead = np.maximum.accumulate(np.where(c > before, np.arange(c.shape[1]), 0), axis=1)  # who set the largest cosine so far
        lead = np.c_[np.zeros((len(c), 1), np.int64), lead[:, :-1]]
        with np.errstate(invalid="ignore"):
            gain = w0 * (np.take_along_axis(b, lead, 1) - b) / np.maximum(ask["cap"].to_numpy()[q0:q1, None], 1e-9)
        kept = (c > before + near) | ((c >= before - near) & (gain <= w1 * near + 2e-9)) | (c == far[:, -1:])
        x, y = np.nonzero(kept & np.isfinite(b))
        return x + q0, known[order[x, y]], b[x, y], c[x, y]

    return _meet(asked, packed, blocks, queries, emit, _types(packed, blocks))


def _placed(bounds: DataFrame, most) -> DataFrame:
    """Bounds with the place of each block among those of its query, the highest first."""
    return materialize(bounds.withColumn("most", most).withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("most"), "block"))))


def best_documents(packed: DataFrame, bounds: DataFrame, blocks: DataFrame, k: int, queries: int) -> DataFrame:
    """``qid, doc, bm25, cosine, score`` of the documents that can be among the best ``k`` of each query by ``alpha * bm25 + beta * cosine`` (neither negative).

    The true best ``k``, with all ties, are among the rows; the caller ranks them. ``packed``: ``qid, term_ids, qws, alpha, beta``; ``bounds`` come from ``block_bounds``.
    """
    placed = _placed(bounds.join(packed.select("qid", "alpha", "beta"), "qid"), F.col("alpha") * F.col("most_b") + F.col("beta") * F.col("most_c"))
    lowest = F.lit(float("-inf"))
    ask = ["qid", "block", "alpha", "beta", "floor"]
    first = materialize(block_scores(placed.where(F.col("place") <= FIRST_BLOCKS).withColumn("floor", lowest).select(*ask), packed, blocks, k, queries))
    ranked = first.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"))))
    floors = ranked.where(F.col("r") == k).select("qid", F.col("score").alias("floor"))
    more = placed.where(F.col("place") > FIRST_BLOCKS).join(floors, "qid", "left").withColumn("floor", F.coalesce("floor", lowest)).where(F.col("most") >= F.col("floor") - SLACK)
    if more.isEmpty():
        return first
    return first.unionByName(block_scores(more.select(*ask), packed, blocks, k, queries))


def best_fronts(packed: DataFrame, bounds: DataFrame, blocks: DataFrame, queries: int, weights: tuple[float, float], ends: bool = False) -> DataFrame:
    """``qid, doc, bm25, cosine`` with the document of largest BM25 of each query, and the best by ``w0 * bm25 / (largest BM25) + w1 * cosine`` with all ties.

    A block is read after the first ones if it may hold a larger BM25, or a document that beats the best one seen whatever the largest BM25 turns out to be; with
    ``ends`` also if it may hold a larger cosine, so that the largest of both are there.
    """
    w0, w1 = weights
    tops = bounds.groupBy("qid").agg((F.max("most_b") + 1e-9).alias("cap"))
    placed = _placed(bounds.join(tops, "qid"), w0 * F.col("most_b") / F.greatest("cap", F.lit(1e-9)) + w1 * F.col("most_c"))
    first = materialize(block_fronts(placed.where(F.col("place") <= FIRST_BLOCKS).select("qid", "block", "cap"), packed, blocks, queries, weights))
    sure = first.join(tops, "qid").groupBy("qid").agg(F.max("bm25").alias("seen"), F.max("cosine").alias("seen_c"), F.max(w0 * F.col("bm25") / F.col("cap") + w1 * F.col("cosine")).alias("floor"))
    may = w0 * F.when(F.col("seen") > 0, F.least(F.lit(1.0), F.col("most_b") / F.col("seen"))).otherwise(F.lit(float("inf"))) + w1 * F.col("most_c")
    more = placed.where(F.col("place") > FIRST_BLOCKS).join(sure, "qid", "left").where(
        F.col("seen").isNull() | (F.col("most_b") >= F.col("seen") - SLACK) | (may >= F.col("floor") - SLACK) | (F.lit(ends) & (F.col("most_c") >= F.col("seen_c") - SLACK)))
    if more.isEmpty():
        return first
    return first.unionByName(block_fronts(more.select("qid", "block", "cap"), packed, blocks, queries, weights))
