"""MinHash near-dedup: an inverted join over signature coordinates with a match threshold, confirmed on full sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helpweave.llm.embeddings import forest
from helpweave.llm.graph import components
from helpweave.llm.textnum import Words, binaries, chunks, lists, mix, prefix_sums, span_hash
from helpweave.session import materialize

#: Signature coordinates, and how many must agree. At similarity 0.8 fewer agree with a chance below 1e-8.
COORDINATES, MATCHES = 64, 30
#: Nodes in a tile of a large group, columns of a set matrix made at a time, and nodes in a tile of a long posting list.
TILE, COLUMNS, LISTED = 512, 4096, 2048
_seed = np.random.default_rng(64)
FLIP = _seed.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + _seed.integers(0, 2, COORDINATES, dtype=np.uint64)
TIMES = _seed.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(data: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted, and their number per row.

    A-Z are lower-cased; a row of fewer words than ``width`` has its whole word sequence as one shingle.
    """
    words = Words(data, bounds, lower=True)
    hashes, whole = words.windows(width)
    n = len(bounds) - 1
    row = np.repeat(np.arange(n), words.counts)[: len(hashes)][whole]
    hashes = hashes[whole]
    short = np.flatnonzero((words.counts > 0) & (words.counts < width))
    if len(short):
        at = words.bounds
        hashes = np.r_[hashes, span_hash(prefix_sums(words.hash), at[short], at[short + 1])]
        row = np.r_[row, short]
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    if len(row):
        new = np.r_[True, (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])]
        hashes, row = hashes[new], row[new]
    return hashes, np.bincount(row, minlength=n)


def set_ids(hashes: np.ndarray, size: np.ndarray) -> np.ndarray:
    """One 64-bit id of each (non-empty) set."""
    at = (np.cumsum(size) - size)[size > 0]
    return mix(np.add.reduceat(mix(hashes), at) ^ (np.add.reduceat(mix(hashes ^ FLIP[0]), at) * TIMES[0])) if len(at) else np.zeros(0, np.uint64)


def signatures(documents: DataFrame, width: int) -> DataFrame:
    """``doc_id, n, node, signature``: set size, set id (equal sets share it) and the least hash per coordinate (32 bits).

    A document without words has size 0, a null id and an empty signature.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, bounds in chunks(b.column(1)):
                hashes, size = shingle_sets(data, bounds, width)
                some = size > 0
                at = (np.cumsum(size) - size)[some]
                values = np.zeros((len(at), COORDINATES), np.uint32)
                for k in range(COORDINATES if len(at) else 0):
                    values[:, k] = np.minimum.reduceat((hashes ^ FLIP[k]) * TIMES[k], at) >> np.uint64(32)
                node = np.zeros(j - i, np.uint64)
                node[some] = set_ids(hashes, size)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array(size.astype(np.int64)), pa.array(node.view(np.int64), mask=~some),
                     lists(values.ravel().view(np.int32), some * COORDINATES, pa.int32())], ["doc_id", "n", "node", "signature"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n long, node long, signature array<int>")


def full_sets(documents: DataFrame, width: int) -> DataFrame:
    """``node, shingles``: the whole set of each text as sorted 64-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, data, bounds in chunks(b.column(0)):
                hashes, size = shingle_sets(data, bounds, width)
                some = size > 0
                yield pa.RecordBatch.from_arrays([pa.array(set_ids(hashes, size).view(np.int64)), binaries(hashes, size[some])], ["node", "shingles"])

    return documents.select("text").mapInArrow(run, "node long, shingles binary")


def prefixes(classes: DataFrame, matches: int = MATCHES) -> DataFrame:
    """``key, node, n``: the postings that have to be joined.

    Each node is posted under its coordinate-value pairs. Values that no other node has are dropped;
    a node left with fewer than ``matches`` has no partner. Two nodes that agree ``matches`` times share one of the rarest
    ``left - matches + 1`` values of either, so the longer posting lists are skipped.
    """
    posted = classes.select("node", "n", F.posexplode("signature").alias("k", "v"))
    posted = posted.select("node", "n", (F.shiftleft(F.col("k").cast("long"), 32).bitwiseOR(F.col("v").cast("long").bitwiseAND(0xFFFFFFFF))).alias("key"))
    often = posted.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    kept = posted.join(often, "key").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("keys"))
    kept = kept.where(F.size("keys") >= matches).select("node", "n", F.explode(F.slice("keys", F.lit(1), F.size("keys") - (matches - 1))).alias("p"))
    return kept.select("p.key", "node", "n")


def agreeing(pairs: DataFrame, classes: DataFrame, matches: int) -> DataFrame:
    """``a, b, agree`` of the pairs whose signatures agree ``matches`` times at least."""
    s = classes.select("node", "signature")
    pairs = pairs.join(s.select(F.col("node").alias("a"), F.col("signature").alias("sa")), "a").join(s.select(F.col("node").alias("b"), F.col("signature").alias("sb")), "b")
    agree = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda z: z))
    return pairs.select("a", "b", agree.alias("agree")).where(F.col("agree") >= matches)


def group_sets(groups: DataFrame, classes: DataFrame, documents: DataFrame, width: int) -> DataFrame:
    """``node, part, shingles`` of the grouped nodes (``node, part``); sets are made for these only."""
    ids = classes.select("node", F.col("rep").alias("doc_id")).join(groups.select("node"), "node").select("doc_id").distinct()
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(ids, "doc_id")
    return full_sets(texts, width).groupBy("node").agg(F.first("shingles").alias("shingles")).join(groups, "node")


def set_links(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (from ``a``, from ``b``) of sets that reach ``percent``; exact intersection sizes by matrix products.

    Only shingles that two of the sets share can count, so only they become columns, a block of columns at a time.
    """
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    _, col, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, shared = np.repeat(np.arange(len(sets)), size), held[col] > 1
    column = np.cumsum(held > 1) - 1
    row, col = row[shared], column[col[shared]]
    both = np.zeros((len(a), len(b)))
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for at in range(0, int(col[-1]) + 1 if len(col) else 0, COLUMNS):
        i, j = np.searchsorted(col, [at, at + COLUMNS])
        x = np.zeros((len(sets), min(COLUMNS, int(col[-1]) + 1 - at)), np.float32)
        x[row[i:j], col[i:j] - at] = 1
        both += x[a] @ x[b].T
    either = size[a][:, None] + size[b][None, :] - both
    i, j = np.nonzero(100 * both >= percent * either)
    return a[i], b[j]


def linked_parts(sets: DataFrame, percent: int, tile: int = TILE) -> DataFrame:
    """``a, b``: links (node, root) that join the same nodes as all links inside each part.

    A part of more than ``tile`` nodes is cut into tiles and each pair of tiles is one task; small parts
    share tasks. A task gives a spanning forest, so no rows of pairs exist at any group size.
    """
    sizes = sets.groupBy("part").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    total = sizes.agg(F.coalesce(F.sum("tiles"), F.lit(0)).alias("n")).first()["n"]
    placed = sets.join(sizes, "part").withColumn("t", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    copies = placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    home = F.when(F.col("tiles") > 1, F.col("part")).otherwise(F.pmod(F.xxhash64("part"), F.lit(max(1, total // 64))))
    rows = copies.select((F.col("tiles") > 1).alias("cut"), home.alias("home"), F.least("t", "o").alias("lo"), F.greatest("t", "o").alias("hi"), "t", "part", "node", "shingles")

    def compare(g):
        import pandas as pd

        out_a, out_b = [], []
        g = g.sort_values(["part", "node"], ignore_index=True)
        part, node, t = g["part"].to_numpy(), g["node"].to_numpy(), g["t"].to_numpy()
        lo, hi = int(g["lo"].iat[0]), int(g["hi"].iat[0])
        edge = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
        for i, j in zip(edge[:-1].tolist(), edge[1:].tolist()):
            if j - i < 2:
                continue
            sets_ = [np.frombuffer(x, np.uint64) for x in g["shingles"].iloc[i:j]]
            x = np.flatnonzero(t[i:j] == lo)
            y = x if lo == hi else np.flatnonzero(t[i:j] == hi)
            u, v = set_links(sets_, x, y, percent)
            k, root = forest(u, v, j - i)
            out_a.append(node[i:j][k])
            out_b.append(node[i:j][root])
        none = np.zeros(0, np.int64)
        return pd.DataFrame({"a": np.concatenate([none, *out_a]), "b": np.concatenate([none, *out_b])})

    return rows.groupBy("cut", "home", "lo", "hi").applyInPandas(compare, "a long, b long")


def agreeing_rows(a: np.ndarray, b: np.ndarray, matches: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (row of ``a``, row of ``b``) of signatures that agree ``matches`` times at least."""
    step = max(1, (1 << 22) // max(1, b.size))
    found = [np.nonzero(np.count_nonzero(a[i : i + step, None] == b[None], axis=2) >= matches) for i in range(0, len(a), step)]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *[i + step * k for k, (i, _) in enumerate(found)]]), np.concatenate([none, *[j for _, j in found]])


def joined_parts(lists: DataFrame, classes: DataFrame, percent: int, matches: int, tile: int = LISTED) -> DataFrame:
    """``a, b``: links that join what all pairs of ``lists (key, node, n, part)`` join that share a key, lie in different parts,
    can reach ``percent`` by their sizes ``n`` and whose signatures agree ``matches`` times.

    A key of more than ``tile`` nodes is cut into tiles and each pair of tiles is one task; short keys share tasks.
    Signatures are compared as arrays and a task gives a spanning forest, so no rows of pairs exist at any length of a key.
    """
    sizes = lists.groupBy("key").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    buckets = max(1, lists.count() // (tile // 4))
    placed = lists.join(sizes, "key").withColumn("t", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")).join(classes.select("node", "signature"), "node")
    copies = placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    home = F.when(F.col("tiles") > 1, F.col("key")).otherwise(F.pmod(F.xxhash64("key"), F.lit(buckets)))
    rows = copies.select((F.col("tiles") > 1).alias("cut"), home.alias("home"), F.least("t", "o").alias("lo"), F.greatest("t", "o").alias("hi"), "t", "key", "node", "n", "part", "signature")

    def compare(g):
        import pandas as pd

        out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        g = g.sort_values(["key", "node"], ignore_index=True)
        key, node, n, part, t = (g[c].to_numpy() for c in ("key", "node", "n", "part", "t"))
        signature = np.vstack(g["signature"].to_numpy())
        lo, hi = int(g["lo"].iat[0]), int(g["hi"].iat[0])
        edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
        for i, j in zip(edge[:-1].tolist(), edge[1:].tolist()):
            parts, of, held = np.unique(part[i:j], return_inverse=True, return_counts=True)
            if len(parts) < 2:
                continue
            # nodes of the largest part are not compared with each other
            odd = of != held.argmax()
            x, y = t[i:j] == lo, t[i:j] == hi
            u, v = [], []
            for p, q in ((x & odd, y), (x & ~odd, y & odd)):
                p, q = np.flatnonzero(p), np.flatnonzero(q)
                k, m = agreeing_rows(signature[i:j][p], signature[i:j][q], matches)
                u.append(p[k])
                v.append(q[m])
            u, v = np.concatenate(u), np.concatenate(v)
            size = n[i:j]
            ok = (of[u] != of[v]) & (size[u] * 100 >= size[v] * percent) & (size[v] * 100 >= size[u] * percent)
            k, root = forest(u[ok], v[ok], j - i)
            out_a.append(node[i:j][k])
            out_b.append(node[i:j][root])
        return pd.DataFrame({"a": np.concatenate(out_a), "b": np.concatenate(out_b)})

    return rows.groupBy("cut", "home", "lo", "hi").applyInPandas(compare, "a long, b long").distinct()


def near_duplicates(documents: DataFrame, width: int = 5, percent: int = 80, matches: int = MATCHES, tile: int = TILE) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``documents (doc_id, text)``.

    Rows link when ``100 * intersection >= percent * union`` of their sets of distinct ``width``-word shingles (A-Z lower-cased,
    words are runs of non-blank bytes; a shorter text is one shingle). Null, empty and blank texts have an empty
    set, link with nothing and are kept. ``component_id`` is the least doc_id reachable. Equal texts and repeated rows are one
    component; of rows that share a doc_id all are returned. Other columns are ignored; no rows give no rows.

    Equal sets are joined once, as one node. Nodes meet in the posting lists of their rare signature values. Each node is compared
    with one node of each list, and those that agree ``matches`` times fall into one group; then nodes of a list that are still in
    different groups are compared, tile by tile, and may join groups. So two nodes that agree often enough are in one group, without
    rows of pairs being made. Links are found on full sets, group by group.
    """
    sets = materialize(signatures(documents, width))
    classes = materialize(sets.where("n > 0").groupBy("node", "n").agg(F.min("doc_id").alias("rep"), F.first("signature").alias("signature")))
    posted = materialize(prefixes(classes, matches))
    hub = posted.groupBy("key").agg(F.min("node").alias("hub"))
    starred = posted.join(hub, "key").where("node != hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    starred = materialize(agreeing(starred, classes, matches))
    part = components(starred)
    now = posted.join(part.withColumnRenamed("id", "node"), "node", "left").withColumn("part", F.coalesce("component_id", "node")).drop("component_id")
    mixed = now.groupBy("key").agg(F.min("part").alias("p0"), F.max("part").alias("p1")).where("p0 != p1").select("key")
    left = materialize(now.join(mixed, "key", "left_semi"))
    across = joined_parts(left, classes, percent, matches)
    part = components(starred.select("a", "b").unionByName(across))
    roots = part.select(F.col("component_id").alias("node")).distinct()
    groups = materialize(part.select(F.col("id").alias("node"), F.col("component_id").alias("part")).unionByName(roots.select("node", F.col("node").alias("part"))))
    links = linked_parts(materialize(group_sets(groups, classes, documents, width)), percent, tile)
    part = components(links)
    ids = classes.select("node", "rep").join(part.withColumnRenamed("id", "node"), "node", "left").withColumn("part", F.coalesce("component_id", "node"))
    least = ids.groupBy("part").agg(F.min("rep").alias("component"))
    of = ids.join(least, "part").select("node", "component")
    out = sets.select("doc_id", "n", "node").join(of, "node", "left")
    whole = F.coalesce("component", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), whole.alias("component_id"), (F.col("doc_id") == whole).alias("kept"))
