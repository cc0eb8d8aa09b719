"""Top documents from block reads: equal to full scoring at several sizes, with reads that grow slower than the corpus."""

import random

import pytest
from pyspark.sql import functions as F

from helpweave.operators import blockmax as bm, retrieval as rt


def corpus(spark, n, seed=7):
    """Zipf-like texts; queries are passages of the first 40 documents and some loose words."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    weights = [1 / (i + 1) for i in range(3000)]
    texts = [" ".join(rng.choices(words, weights, k=rng.randint(20, 120))) for _ in range(n)]
    queries = []
    for i in range(40):
        t = texts[i].split()
        at = rng.randrange(len(t) - 12)
        queries.append((i, " ".join(t[at : at + 12])))
    queries += [(100, "w0 w1 w2"), (101, "nothing known"), (102, ""), (103, texts[3]), (104, "w2999 w0"), (105, "w5 " * 9)]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(queries, "qid long, text string")


@pytest.fixture(scope="module")
def sized(spark):
    keep, rt.BLOCK_DOCS = rt.BLOCK_DOCS, 64
    out = {}
    for n in (300, 1200, 4800):
        docs, queries = corpus(spark, n)
        out[n] = rt.build_index(docs), queries
    rt.BLOCK_DOCS = keep
    return out


@pytest.mark.parametrize("n", [300, 1200, 4800])
@pytest.mark.parametrize("k", [1, 10])
def test_blocks_give_the_ranking_of_full_scoring(spark, sized, n, k, monkeypatch):
    monkeypatch.setattr(bm, "BATCH", 17)
    monkeypatch.setattr(bm, "PRODUCTS", 500)
    monkeypatch.setattr(bm, "FIRST_BLOCKS", 2)
    index, queries = sized[n]
    for top, full, name in ((rt.bm25_top, rt.bm25_join, "bm25"), (rt.tfidf_top, rt.tfidf_join, "cosine")):
        got = {(r["qid"], r["rank"], r["doc"], round(r[name], 7)) for r in top(queries, index, k).collect()}
        want = {(r["qid"], r["rank"], r["doc"], round(r[name], 7)) for r in rt.top_k(full(queries, index), name, k).collect()}
        assert got == want and len(got) >= 44 * min(k, 3)


@pytest.mark.parametrize("n", [300, 4800])
def test_articles_equal_full_scoring(spark, sized, n, monkeypatch):
    monkeypatch.setattr(bm, "FIRST_BLOCKS", 2)
    index, queries = sized[n]
    got = {r["qid"]: (r["doc"], round(r["score"], 7), round(r["bm25"], 7)) for r in rt.retrieve_articles(queries, index, min_cosine=0.0).collect()}
    pairs = {}
    for r in rt.score_terms(rt.query_terms(queries, index), index).collect():
        pairs.setdefault(r["qid"], []).append((r["doc"], r["bm25"], r["cosine"]))
    want = {}
    for q, mine in pairs.items():
        peak = max(b for _, b, _ in mine)
        doc, b, c = min(mine, key=lambda m: (-round(0.5 * m[1] / (peak + 1e-9) + 0.5 * m[2], 9), m[0]))
        want[q] = doc, round(0.5 * b / (peak + 1e-9) + 0.5 * c, 7), round(b, 7)
    assert got == want and len(got) >= 44


def test_reads_grow_slower_than_the_corpus(spark, sized):
    read, total = {}, {}
    for n, (index, queries) in sized.items():
        asked = rt.ask(rt.query_terms(queries.where("qid < 40"), index), index)
        found = rt.best_scored(asked, index, 1)
        floors = found.groupBy("qid").agg(F.max("score").alias("best"))
        bounds = asked.bounds.withColumn("most", F.col("most_b") + F.col("most_c"))
        read[n] = bounds.join(floors, "qid").where("most >= best").count() + 2 * 40
        total[n] = bounds.count()
    print("blocks read", read, "of", total)
    assert read[4800] / read[300] < 0.5 * total[4800] / total[300]
    assert read[4800] < total[4800] / 4


def test_blocks_hold_each_posting_once(spark, sized):
    index, _ = sized[1200]
    rows = index.blocks.select("term_id", "top", "low", "block", F.explode(F.arrays_zip("docs", "ws")).alias("p")).select("*", "p.docs", "p.ws")
    assert rows.where("ws > top OR ws < low").count() == 0
    assert rows.count() == rows.select("term_id", "docs").distinct().count() == index.terms.agg(F.sum("df")).first()[0]
    assert index.blocks.count() == index.blocks.select("term_id", "block").distinct().count()
    assert index.sizes.agg(F.sum("n")).first()[0] == 1200


def test_ends_equal_those_of_full_scoring(spark, monkeypatch):
    monkeypatch.setattr(rt, "BLOCK_DOCS", 16)
    monkeypatch.setattr(bm, "FIRST_BLOCKS", 1)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    docs = spark.createDataFrame([(i, " ".join(["all", *rng.choices(words, k=4)])) for i in range(90)], "doc_id long, text string")
    queries = spark.createDataFrame([(0, "all w1"), (1, "w1 w2 w3"), (2, "all"), (3, " ".join(words)), (4, "zzz")], "qid long, text string")
    index = rt.build_index(docs)
    rows = rt.score_terms(rt.query_terms(queries, index), index).collect()
    got = {r["qid"]: r for r in rt.score_ends(rt.ask(rt.query_terms(queries, index), index), index).collect()}
    assert set(got) == {0, 1, 2, 3}
    for q in got:
        mine = [(r["bm25"], r["cosine"]) for r in rows if r["qid"] == q]
        mine += [(0.0, 0.0)] * (90 - len(mine))
        want = [f(x[i] for x in mine) for i in (0, 1) for f in (min, max)]
        assert [got[q][c] for c in ("b_lo", "b_hi", "c_lo", "c_hi")] == pytest.approx(want)


def test_an_empty_corpus_and_equal_scores(spark):
    docs = spark.createDataFrame([(i, "red apple pie") for i in (5, 3, 9)] + [(1, None)], "doc_id long, text string")
    index = rt.build_index(docs)
    queries = spark.createDataFrame([(0, "red pie"), (1, None)], "qid long, text string")
    got = [(r["qid"], r["rank"], r["doc"]) for r in rt.tfidf_top(queries, index, 2).orderBy("rank").collect()]
    assert got == [(0, 1, 3), (0, 2, 5)]
    none = rt.build_index(docs.limit(0))
    assert rt.bm25_top(queries, none, 3).collect() == []


def test_index_without_rows_of_tokens_in_a_shuffle(spark, monkeypatch):
    docs, queries = corpus(spark, 300)
    whole = rt.build_index(docs)
    plan = rt.corpus_stats(docs, "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    tokens_made = plan.index("Generate explode")
    assert plan.count("Exchange") == 1 and plan.index("Exchange") > tokens_made  # the plan begins with its last step
    monkeypatch.setattr(rt, "COMMON_TERMS", 40)
    shared = rt.with_terms(rt.corpus_stats(docs, "doc_id", "text"), whole.terms, whole.n_terms)
    assert shared.count() == shared.select("doc", "term").distinct().count() == whole.terms.agg(F.sum("df")).first()[0]
    for top, name, family in ((rt.bm25_top, "bm25", "b:"), (rt.tfidf_top, "cosine", "t:")):
        part = rt.build_index(docs, families=(family,), asked=queries)
        assert part.blocks.count() < whole.blocks.count() / 2 and part.n_terms == part.terms.count()
        assert part.terms.where(~F.col("term").startswith(family)).count() == 0
        got = {(r["qid"], r["rank"], r["doc"], round(r[name], 7)) for r in top(queries, part, 5).collect()}
        assert got == {(r["qid"], r["rank"], r["doc"], round(r[name], 7)) for r in top(queries, whole, 5).collect()} and got
