"""Large groups of texts that are alike without being near copies: no rows of pairs."""

import random

from pyspark.sql import functions as F


def test_near_dedup_makes_no_pair_rows_of_a_large_group(spark, monkeypatch):
    from helpweave.llm import minhash

    rng = random.Random(5)
    base = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(400):
        words = list(base)
        for i in rng.sample(range(300), 28):
            words[i] = f"x{rng.random()}"
        texts.append(" ".join(words))
    compared = []
    agreeing = minhash.agreeing

    def counted(pairs, *args):
        compared.append(pairs.count())
        return agreeing(pairs, *args)

    monkeypatch.setattr(minhash, "agreeing", counted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = minhash.near_duplicates(df, 4, percent=50)
    sets = [{tuple(t.split()[i : i + 4]) for i in range(297)} for t in texts]
    root = list(range(400))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(400):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 50 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == {i: find(i) for i in range(400)}
    assert sum(compared) < 400 * minhash.COORDINATES


def test_posting_lists_in_tiles_join_what_all_pairs_join(spark):
    import numpy as np

    from helpweave.llm.graph import components
    from helpweave.llm.minhash import joined_parts

    rng = np.random.default_rng(3)
    signature = rng.integers(0, 3, (300, 64))
    size = rng.integers(80, 130, 300)
    part = rng.integers(0, 12, 300)
    key = [sorted(set(rng.integers(0, 6, 3).tolist())) for _ in range(300)]
    classes = spark.createDataFrame([(i, signature[i].tolist()) for i in range(300)], "node long, signature array<int>")
    lists = spark.createDataFrame([(k, i, int(size[i]), int(part[i])) for i in range(300) for k in key[i]], "key long, node long, n long, part long")
    pairs = [(i, j) for i in range(300) for j in range(i) if set(key[i]) & set(key[j]) and part[i] != part[j] and (signature[i] == signature[j]).sum() >= 30
             and size[i] * 100 >= size[j] * 80 and size[j] * 100 >= size[i] * 80]
    want = {tuple(r) for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert len(pairs) > 50
    for tile in (16, 64, 2048):
        links = joined_parts(lists, classes, 80, 30, tile)
        assert links.where(F.col("a") == F.col("b")).count() == 0
        assert {tuple(r) for r in components(links).collect()} == want
    assert joined_parts(lists.limit(0), classes, 80, 30).collect() == []
