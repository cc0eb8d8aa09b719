"""Fingerprints, fill-in-the-middle and tokenizer alignment against plain Python, and odd rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n\t ", "x", "one", "A.", "<P> in it", "<S", "P> <", "é漢🙂", "🙂" * 40, "ab  cd   ", "  two leading", "a\x1c b", "▁ mark", "x" * 3000, "=" * 700 + "!",
       "the cat sat on the mat " * 40, "the cat sat on the mat " * 40, "<|endoftext|> here", "tab\tand odd spaces 　 here", "naïve café 漢字 mixed 🙂 text " * 9]
WIDE = "doc_id long, text string, n_chars string, form long, row int, `key` string, output int, fingerprint long, n_a string, _text string"


def wide(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "c", 7, 1, "k", 2, 3, "n", "t") for i, t in zip(ids, texts)], WIDE)


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


# --- op12 ---------------------------------------------------------------------------------
def plain_middle(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = sha(f"1:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_middle_equals_plain_python_and_is_undone(spark):
    from helpweave.llm.middle import fill_in_middle, restore

    rng = random.Random(4)
    texts = ODD + ["".join(rng.choice("ab <PSM>é漢🙂\n") for _ in range(rng.randrange(60))) for _ in range(300)]
    df = wide(spark, texts).unionByName(wide(spark, ["no id", None, "same", "same"], [None, None, 5, 5]))
    done = fill_in_middle(df).withColumn("back", restore(F.col("output"), F.col("form")))
    assert {"n_chars", "row", "key", "fingerprint", "n_a", "_text"} <= set(done.columns)
    key = lambda r: tuple((x is not None, x) for x in r)
    got = sorted([(r["doc_id"], r["units"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["back"]) for r in done.collect()], key=key)
    want = sorted([(r["doc_id"], *plain_middle(r["doc_id"], r["text"]), r["text"] or "") for r in df.collect()], key=key)
    assert got == want
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert fill_in_middle(df.limit(0)).collect() == []


def test_middle_keeps_broken_bytes(spark):
    from helpweave.llm.middle import fill_in_middle, restore

    raw = [b"ab\xff\xc3 cd\x80\x80e", b"\x80", b"\xf0\x9f", "ok é".encode()]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw * 8)], "doc_id long, b binary").withColumn("text", F.col("b").cast("string"))
    for r in fill_in_middle(df).withColumn("back", restore(F.col("output"), F.col("form")).cast("binary")).collect():
        assert bytes(r["back"]) == bytes(r["b"])


def test_sparse_index_converts_both_ways():
    from helpweave.llm.middle import Exceptions

    rng = random.Random(8)
    for _ in range(50):
        text = "".join(rng.choice("abcdé漢🙂ñ ") for _ in range(rng.randrange(80)))
        index = Exceptions(np.frombuffer(text.encode(), np.uint8))
        chars = np.arange(len(text) + 1)
        bytes_ = np.array([len(text[:c].encode()) for c in chars])
        assert (index.to_byte(chars) == bytes_).all() and (index.to_char(bytes_) == chars).all()
        assert len(index.at_byte) == sum(ord(c) > 127 for c in text)


# --- op11 ---------------------------------------------------------------------------------
def plain_bands(text):
    """Band hashes of one text, one coordinate at a time."""
    from helpweave.llm import fingerprints as f
    from helpweave.llm.labelled import code_values
    from helpweave.llm.textnum import mix, prefix_sums, rolling_hash

    one = lambda x: int(mix(np.array([x % 2**64], np.uint64))[0])
    value = [int(v) for v in code_values(np.array([ord(c) for c in text], np.uint32))]
    window = rolling_hash(prefix_sums(np.array(value, np.uint64)), f.CONTEXT)
    before = {i + f.CONTEXT: int(h) for i, h in enumerate(window)}
    starts = []
    for i in range(len(value)):
        if i == 0 or (before.get(i, 1) % f.SPACING == 0) or i - starts[-1] == f.LONGEST:
            starts.append(i)
    weight = np.diff(f.WEIGHT)
    table = f.NEXT.reshape(f.KINDS, -1)
    out = set()
    for x, z in zip(starts, [*starts[1:], len(value)]):
        embedded, at = [], 0
        for v in value[x:z]:
            after = int(table[(v >> 55) % f.KINDS, at])
            embedded += [v] * (after - at)
            at = after
        blocks = [embedded[i : i + f.BLOCK] for i in range(0, len(embedded), f.BLOCK)]
        edges = list(range(f.BLOCK, len(embedded), f.BLOCK))
        if len(blocks) > 1 and len(blocks[-1]) < f.BLOCK // 2:
            edges.pop()
        edges = [0, *edges, len(embedded)]
        seed = before.get(x, 0) if x else 0
        for n, (a, b) in enumerate(zip(edges, edges[1:])):
            total = sum(embedded[k] * int(weight[k]) for k in range(a, b))
            out.add(one(total + one(seed + n * 0xD6E8FEB86659FD93)))
    return out


def plain_sketch(text):
    from helpweave.llm import fingerprints as f

    slots = [f.EMPTY] * f.SLOTS
    for k in range(f.SLOTS):
        mine = [h & 0xFFFFFFFF for h in plain_bands(text) if h >> 58 == k]
        if mine:
            slots[k] = min(min(mine) & 0xFFFF, f.EMPTY - 1)
    return "".join(f"{s:04x}" for s in slots)


def test_fingerprints_equal_walks_of_single_coordinates(spark):
    from helpweave.llm.fingerprints import fingerprint

    rng = random.Random(6)
    texts = [t for t in ODD] + [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "été"]) for _ in range(n)) for n in (3, 30, 130)]
    got = {r["doc_id"]: r for r in fingerprint(wide(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert got[i]["fingerprint"] == plain_sketch(t or ""), t and t[:30]
    assert got[0].asDict().keys() == set(wide(spark, []).columns)
    assert got[0]["fingerprint"] == "f" * 256


def test_next_and_edited_texts(spark):
    from helpweave.llm.fingerprints import compare_with_next, fingerprint, likeness

    rows = [(10 * i, t) for i, t in enumerate(ODD)] + [(None, "last of all"), (40, "other text of an id"), (170, "x" * 3000)]
    df = wide(spark, [t for _, t in rows], [i for i, _ in rows])
    hashes = {r["text"]: r["h"] for r in df.select(F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    order = sorted([(i, t or "") for i, t in rows], key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1]]))
    want = []
    for k, (i, t) in enumerate(order):
        follow = order[(k + 1) % len(order)][1]
        edited = t[: len(t) - len(t) // 2] + follow[: len(t) // 2]
        want.append((i, t, edited, follow))
    flat = [x for w in want for x in w[1:]]
    prints = {r["doc_id"]: r["fingerprint"] for r in fingerprint(wide(spark, flat)).collect()}
    triples = [tuple(prints[3 * k + j] for j in range(3)) for k in range(len(want))]
    near = spark.createDataFrame(triples, "a string, b string, c string").select(likeness(F.col("a"), F.col("b")).alias("x"), likeness(F.col("a"), F.col("c")).alias("y")).collect()
    expected = [(w[0], len(w[1]), sha(w[2]), p[0], p[1], r["x"], r["y"]) for w, p, r in zip(want, triples, near)]
    names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    got = [tuple(r[n] for n in names) for r in compare_with_next(df.repartition(3)).collect()]
    assert Counter(got) == Counter(expected)
    assert compare_with_next(df.limit(0)).collect() == []
    single = compare_with_next(df.where("doc_id = 180")).collect()[0]
    assert single["near_next"] == 1.0


def test_few_edits_change_few_slots_and_groups_are_found(spark):
    from helpweave.llm.fingerprints import fingerprint, likeness, near_groups

    rng = random.Random(5)
    text = lambda: " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(400))
    rows, ids = [], 0
    for k in range(20):
        words = text().split()
        for edits in (0, 1, 2, 120):
            w = list(words)
            for _ in range(edits):
                at = rng.randrange(len(w))
                w[at : at + 1] = rng.choice([[], ["new"], [w[at], "more"]])
            rows.append((4 * k + (0, 1, 2, 120).index(edits), " ".join(w)))
            ids += 1
    prints = fingerprint(spark.createDataFrame(rows, "doc_id long, text string")).cache()
    a = prints.where("doc_id % 4 = 0").select(F.expr("doc_id div 4").alias("k"), F.col("fingerprint").alias("a"))
    b = prints.select(F.expr("doc_id div 4").alias("k"), (F.col("doc_id") % 4).alias("e"), F.col("fingerprint").alias("b"))
    mean = {r["e"]: r["m"] for r in a.join(b, "k").groupBy("e").agg(F.avg(likeness(F.col("a"), F.col("b"))).alias("m")).collect()}
    assert mean[0] == 1 and mean[1] > 0.95 and mean[2] > 0.92 and mean[3] < 0.4
    group = {r["doc_id"]: r["group_id"] for r in near_groups(prints, at_least=0.8).collect()}
    for k in range(20):
        assert [group[4 * k + j] for j in range(3)] == [4 * k] * 3 and group[4 * k + 3] == 4 * k + 3
    assert near_groups(prints.limit(0)).collect() == []


# --- op13 ---------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def paths():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain_alignment(paths, rows):
    """The results by the two libraries over whole texts, one token at a time."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    from helpweave.llm.align import Pair

    pair, whole_a, whole_b = Pair(*paths), Tokenizer.from_file(paths[0]), SentencePieceProcessor(model_file=paths[1])
    whole_a.encode_special_tokens = True
    docs, counts = [], Counter()
    for i, t in rows:
        groups = []
        a = whole_a.encode(" " + t, add_special_tokens=False).ids if t else []
        b = whole_b.encode(t) if t else []
        whole = (" " + (t or "")).encode()
        if t and b"".join(pair.a_bytes[x] for x in a) == whole == b"".join(pair.b_bytes[x] for x in b):
            left, right, x, y = [], [], 0, 0
            a, b = a[::-1], b[::-1]
            while a or b:
                if a and x <= y:
                    left.append(a.pop())
                    x += len(pair.a_bytes[left[-1]])
                else:
                    right.append(b.pop())
                    y += len(pair.b_bytes[right[-1]])
                if x == y:
                    groups.append((left, right))
                    left, right = [], []
        docs.append((i, groups))
        counts.update({(p, q) for u, v in groups for p in u for q in v})
    best = defaultdict(int)
    for (p, _), n in counts.items():
        best[p] = max(best[p], n)
    out = []
    for i, groups in docs:
        links = [(p, q) for u, v in groups for p in u for q in v]
        text = ";".join(",".join(map(str, u)) + "|" + ",".join(map(str, v)) for u, v in groups)
        out.append((i, sum(len(u) for u, _ in groups), sum(len(v) for _, v in groups), len(groups), len(links), sum(counts[x] == best[x[0]] for x in links),
                    sum(counts[x] for x in links), sha(text) if groups else ""))
    return out


NAMES = ("key", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("long, shared", [(1 << 16, 1_000_000), (400, 50)])
def test_alignment_equals_whole_text_libraries(spark, paths, monkeypatch, long, shared):
    from helpweave.llm import align

    monkeypatch.setattr(align, "LONG", long)
    monkeypatch.setattr(align, "RANGE", long // 8)
    monkeypatch.setattr(align, "SHARED", shared)
    given = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    rows = given + [(1000 + i, t) for i, t in enumerate(ODD)] + [(None, "no id of its own " * 60), (5, "again " * 200), (5, "again " * 200)]
    df = wide(spark, [t for _, t in rows], [i for i, _ in rows])
    got = align.Alignment(df, *paths).scores().collect()
    assert Counter(tuple(r[n] for n in NAMES) for r in got) == Counter(plain_alignment(paths, rows))
    groups = {r["key"]: r for r in align.Alignment(df.where("doc_id = 1018"), *paths).groups().collect()}[1018]
    assert sum(groups["na"]) == len(groups["a"]) and sum(groups["nb"]) == len(groups["b"])
    assert align.Alignment(df.limit(0), *paths).scores().collect() == []


def test_fragments_compose_in_any_order(paths):
    from functools import reduce

    from helpweave.llm.align import Aligner, Pair, compose

    aligner = Aligner(Pair(*paths))
    rng = random.Random(2)
    text = "".join(rng.choice(["the ", "Überraschung ", "zzqx", "  ", "漢字", "word", "🙂", "tion", "\n", "12345 "]) for _ in range(300))
    size = len((" " + text).encode())
    whole = aligner.fragment(text, 0, size)
    same = lambda x, y: x[0] == y[0] and all(np.array_equal(p, q) for p, q in zip(x[1:], y[1:]))
    for _ in range(20):
        edges = sorted({0, size, *(rng.randrange(size) for _ in range(rng.randrange(1, 12)))})
        parts = [aligner.fragment(text, a, b - a) for a, b in zip(edges, edges[1:])]
        assert same(reduce(compose, parts), whole)
        while len(parts) > 1:  # any neighbours first
            i = rng.randrange(len(parts) - 1)
            parts[i : i + 2] = [compose(*parts[i : i + 2])]
        assert same(parts[0], whole)
    assert whole[3][-1] == whole[4][-1] == 0


def test_ranges_cover_a_text_once(paths, monkeypatch):
    from helpweave.llm import align

    monkeypatch.setattr(align, "RANGE", 64)
    pair = align.Pair(*paths)
    for text in ("word " * 100, "x" * 1000, "é" * 50 + " " + "long" * 100 + " end", " "):
        found = list(align._ranges(text, pair))
        assert sum(take for _, take, _ in found) == len(text.encode()) + 1
        assert sum(len(part) for _, _, part in found) < 3 * len(text) + 100
        joined = b"".join((" " + part).encode()[skip : skip + take] for skip, take, part in found)
        assert joined == (" " + text).encode()
