"""Cases that a shortened job gets wrong: long texts, short or re-cased items, large word lists, repeated ids."""

import random
import re

from pyspark.sql import functions as F

MIDDLE = "/root/testdata/sf0.1"


# --- op3 ---------------------------------------------------------------------------------
def test_toxicity_does_not_depend_on_length(spark):
    from helpweave.llm.toxicity import score_toxicity, train_toxicity

    given = spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{MIDDLE}/labels.parquet")
    insults = {"clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless"}
    texts = [r["text"] for r in given.join(labels.where("toxic = 0"), "doc_id").orderBy("doc_id").collect()]
    clean = " ".join(t for t in texts if not insults & set(re.findall(r"\w+", t.lower())))
    assert len(clean) > 2_000_000
    longest = given.orderBy(F.length("text").desc()).first()["text"]
    other = given.where("doc_id = 4950").first()["text"]
    assert len(longest) > 100_000 and not insults & set(re.findall(r"\w+", (longest + other).lower()))
    rng = random.Random(1)
    letters = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(1_000_000))
    planted = " You pathetic moron. "
    rows = [(0, clean[:1_000_000]), (1, clean[1_000_000:2_000_000]), (2, longest), (3, other), (4, letters), (5, clean[:50_000] + planted + clean[50_000:100_000]),
            (6, longest + planted), (7, planted + clean[:1_000_000])]
    got = score_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), train_toxicity(given, labels)).collect()
    assert {r["doc_id"]: r["predicted"] for r in got} == {i: int(i > 4) for i in range(8)}


# --- op7 ---------------------------------------------------------------------------------
def held(spark, items, texts):
    from helpweave.llm.decontaminate import contamination

    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {(r["doc_id"], r["item_id"]) for r in contamination(df, bench).collect()}


def test_decontamination_finds_short_dense_and_recased_items(spark):
    items = ["Compute 12 + 15 * 3 - 8 / 2", "Name Peru's capital", "Did Anna Smith, Bob Jones and Carl Brown meet Dora White in New York before 1999 or after 2001?",
             "Где живёт Анна Каренина сегодня и почему она не едет домой"]
    texts = [f"Some words first. {t} And some after." for t in items]
    odd = ["Compute 12 + 15 * 3 - 8 / 7", "Name Peru and its capital", "Nothing of it is here"]
    n = len(items)
    want = {(i + n * k, i) for i in range(n) for k in range(3)}
    assert held(spark, items, texts + [t.upper() for t in texts] + [t.lower() for t in texts] + odd) - {(3 * n, 0)} == want


def test_decontamination_keeps_what_agrees_of_a_near_copy(spark):
    item = ("a farmer near Boston counts 12 sheep every morning and sells them at the market in Boston so that after many long weeks of "
            "hard work the barn is empty again and the old dog can sleep on the warm floor until the next spring comes back to the green hills")
    words = item.split()
    quote = " ".join(words[20:45])
    scattered = " ".join("changed" if i % 10 == 9 else w for i, w in enumerate(words))
    texts = [item.replace("Boston", "Bostn", 1), item.replace("12", "13"), "He said: " + quote + " and left.", scattered, " ".join(words[20:29]) + " is short"]
    assert held(spark, [item], texts) == {(0, 0), (1, 0), (2, 0), (3, 0)}


# --- op10 --------------------------------------------------------------------------------
def test_url_words_are_not_cut_in_large_tables(spark):
    from helpweave.llm.urls import Segmenter, segment_names

    letters = "abcdefghijklmnopqrstuvwxyz"
    rare = sorted({"".join(letters[(k // 26**e) % 26] for e in range(4)) for k in range(7, 25_007 * 17, 17)})[:25_000]
    counts = {w: 1 for w in rare} | {"garden": 1, "house": 3, "the": 900}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    names = ["thegardenhouse", "gardenxq", "zz9", rare[17] + "house"]
    got = {r["name"]: r["parts"] for r in segment_names(spark.createDataFrame([(n,) for n in names], "name string"), words).collect()}
    assert len(counts) > 20_000 and got["thegardenhouse"] == ["the", "garden", "house"]
    assert got == {n: Segmenter(counts).split(n) for n in names}


def test_long_title_words_and_long_hosts(spark):
    from helpweave.llm.urls import Segmenter, judge_urls, segment_names, title_words

    long = "donaudampfschifffahrtsgesellschaft"
    pages = spark.createDataFrame([(i, f"<title>the {long} house {long}</title>") for i in range(3)] + [(None, None)], "page_id long, html string")
    words = title_words(pages)
    counts = {r["word"]: r["n"] for r in words.collect()}
    assert counts[long] == 6
    names = [f"the{long}house", long, long[:-1], "x" * 5000 + long]
    got = {r["name"]: r["parts"] for r in segment_names(spark.createDataFrame([(n,) for n in names], "name string"), words).collect()}
    assert got == {n: Segmenter(counts).split(n) for n in names} and got[names[0]] == ["the", long, "house"]
    urls = [(1, f"http://the{long}house.com/a", "<title>x</title>"), (1, f"http://the{long}house.com/a", "<title>x</title>"), (None, None, None), (2, "http://" + "w" * 3000 + ".net/b?c", None)]
    rows = judge_urls(spark.createDataFrame(urls, "page_id long, url string, html string"), [("block", "com", "/z")]).collect()
    assert sorted((r["page_id"] or 0, len(r["host"]), r["verdict"]) for r in rows) == [(0, 0, "allow"), (1, 46, "allow"), (1, 46, "allow"), (2, 3004, "allow")]
