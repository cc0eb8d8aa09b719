"""Training-data operators against brute force, exact round trips and edge cases."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.1"
DOCS = "doc_id long, text string, lang string, score string, row int, h string, source long"
BLANK = re.compile(rb"[\x20\x09-\x0D]+")


def words_of(text):
    return [w for w in BLANK.split((text or "").encode()) if w]


def docs(spark, texts, ids=None):
    """Documents with further columns whose names operators use inside."""
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", 1, "h", 9) for i, t in zip(ids, texts)], DOCS)


def sentence(rng, n, pool=4000):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd_texts():
    """Null, empty, blank, short, long, equal and near texts."""
    rng = random.Random(3)
    base = sentence(rng, 120)
    near = base.split()
    near[60] = "changed"
    passage = sentence(rng, 70)
    return [None, "", " \t\n ", "one", "one two", base, base, " ".join(near), base.upper(), sentence(rng, 40) + " " + passage + "\n" + sentence(rng, 30),
            passage + "  " + sentence(rng, 50), "x" * 3000, "ab " * 4000, sentence(rng, 6000), "é ü 漢字 🙂 " * 60, "ONE TWO", sentence(rng, 30)]


def component_of(links, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# --- op1 ---------------------------------------------------------------------------------
def brute_vectors(rows, threshold=0.98):
    ok = {}
    for i, v, lab in rows:
        if v and lab is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, float)
            ok[i] = (x / np.linalg.norm(x), lab)
    links = [(a, b) for a in ok for b in ok if a < b and ok[a][1] == ok[b][1] and len(ok[a][0]) == len(ok[b][0]) and ok[a][0] @ ok[b][0] >= threshold]
    part = component_of(links, [i for i, _, _ in rows])
    count = Counter(x for pair in links for x in pair)
    return {i: (count[i], part[i], part[i] == i) for i, _, _ in rows}


@pytest.mark.parametrize("tile", [7, 2048])
def test_embeddings_equal_brute_force(spark, tile):
    from helpweave.llm.embeddings import near_vectors

    rng = np.random.default_rng(5)
    centre = rng.normal(size=(6, 16))
    rows = [(i, [float(x) for x in np.float32(centre[i % 6] + rng.normal(size=16) * rng.choice([0.02, 0.13, 0.2]))], int(i % 6 % 3)) for i in range(90)]
    rows += [(90, rows[0][1], 0), (91, [2 * x for x in rows[0][1]], 0), (92, rows[0][1], None), (93, None, 0), (94, [], 0), (95, [0.0] * 16, 0),
             (96, [float("nan")] + [1.0] * 15, 0), (97, [None] + [1.0] * 15, 0), (98, [float("inf")] * 16, 0), (99, rows[0][1][:8], 0)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, rep string").repartition(3)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_vectors(df, tile=tile).collect()}
    want = brute_vectors([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows])
    assert got == want
    assert sum(x[0] for x in want.values()) > 50
    assert near_vectors(df.limit(0)).collect() == []


def test_quantised_bound_is_never_wrong():
    from helpweave.llm.embeddings import tile_links, unit

    rng = np.random.default_rng(8)
    x = unit(np.repeat(rng.normal(size=(20, 64)), 10, axis=0) + rng.normal(size=(200, 64)) * 0.14)
    i, j, asked = tile_links(x, x, 0.98, True)
    want = {(a, b) for a, b in zip(*np.nonzero(np.triu(x @ x.T >= 0.98, 1)))}
    assert set(zip(i, j)) == want and 0 < asked < 200 * 199 / 4


# --- op2 ---------------------------------------------------------------------------------
def brute_passages(rows, width):
    first = {}
    for i, t in rows:
        w = words_of(t)
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = {}
    for i, t in rows:
        w, gone = words_of(t), set()
        for k in range(len(w) - width + 1):
            if i is not None and first[tuple(w[k : k + width])] < i:
                gone |= set(range(k, k + width))
        out[i] = (len(w), len(gone), b" ".join(x for n, x in enumerate(w) if n not in gone).decode())
    return out


@pytest.mark.parametrize("width", [20, 50])
def test_substring_equals_brute_force(spark, odd_texts, width):
    from helpweave.llm.substring import drop_repeats

    rng = random.Random(7)
    pieces = [sentence(rng, n) for n in (19, 20, 21, 49, 50, 51, 80)]
    texts = odd_texts + [" ".join(rng.choice(pieces) for _ in range(6)) + " " + sentence(rng, 5) for _ in range(25)] + ["a b c " * 40, "b c a " * 40]
    df = docs(spark, texts).repartition(4)
    done = drop_repeats(df, width)
    assert done.columns == [*df.columns, "n_words", "n_removed", "factors"]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["text"]) for r in done.collect()}
    want = brute_passages(list(enumerate(texts)), width)
    assert got == want and sum(v[1] for v in want.values()) > 500
    cut = {r["doc_id"]: r["text"] for r in drop_repeats(df, width, joined=False).collect()}
    assert all(cut[i] == texts[i] for i in cut if not want[i][1])
    assert all(" ".join(x.decode() for x in words_of(cut[i])) == want[i][2] for i in cut)
    assert all(r["words"] >= width for x in done.collect() if x["n_removed"] for r in x["factors"])
    assert drop_repeats(df.limit(0)).collect() == []


def test_substring_null_and_equal_ids(spark):
    from helpweave.llm.substring import drop_repeats

    text = sentence(random.Random(1), 60)
    got = drop_repeats(docs(spark, [text, text, text, text], [None, 4, 4, 9]), 50).collect()
    assert sorted((r["doc_id"] or -1, r["n_removed"]) for r in got) == [(-1, 0), (4, 0), (4, 0), (9, 60)]


# --- op3, op9 ------------------------------------------------------------------------------
@pytest.mark.parametrize("module, label, least", [("op3", "toxic", 0.95), ("op9", "quality", 0.97)])
def test_classifiers_on_the_held_out_fold(spark, module, label, least):
    import importlib
    import zlib

    fn = {"op3": "op3_toxicity", "op9": "op9_quality"}[module]
    got = getattr(importlib.import_module(f"helpweave.llm.{module}"), fn)(spark, MIDDLE)
    rows = got.join(spark.read.parquet(f"{MIDDLE}/labels.parquet").drop("score"), "doc_id").toPandas()
    assert all((zlib.crc32(str(i).encode()) % 5 == 0) == h for i, h in zip(rows["doc_id"], rows["held_out"]))
    out = rows[rows["held_out"]]
    assert rows["score"].between(0, 1).all() and (out[label] == out["predicted"]).mean() >= least


@pytest.mark.parametrize("kind", ["toxicity", "quality"])
def test_classifiers_on_odd_input(spark, odd_texts, kind):
    import importlib

    m = importlib.import_module(f"helpweave.llm.{kind}")
    train, score = getattr(m, f"train_{kind}"), getattr(m, f"score_{kind}")
    label = {"toxicity": "toxic", "quality": "quality"}[kind]
    df = docs(spark, odd_texts + odd_texts[:3], [*range(len(odd_texts)), None, 1, 1])
    labels = spark.createDataFrame([(i, None if i == 5 else i % 2, "x") for i in [*range(len(odd_texts)), 3]] + [(None, 1, "x")], f"doc_id long, {label} int, text string")
    got = score(df, train(df, labels)).collect()
    assert len(got) == len(odd_texts) + 3 and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in got)
    by_text = {}
    for r in got:
        by_text.setdefault(r["text"] or "", set()).add(r["score"])
    assert all(len(v) == 1 for v in by_text.values())
    model = train(df, labels.limit(0))
    assert {r["score"] for r in score(df, model).collect()} == {0.5}
    assert score(df.limit(0), model).collect() == []


# --- op4 ---------------------------------------------------------------------------------
def brute_near(rows, width, percent=80):
    sets = {}
    for i, t in rows:
        w = [x.lower() for x in words_of(t)]
        sets[i] = ({tuple(w)} if w else set()) if len(w) < width else {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}
    ids = list(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    part = component_of(links, ids)
    return {i: (len(sets[i]), part[i], part[i] == i) for i in ids}


@pytest.mark.parametrize("width, tile", [(4, 512), (5, 3)])
def test_near_duplicates_equal_brute_force(spark, odd_texts, width, tile):
    from helpweave.llm.minhash import near_duplicates

    rng = random.Random(11)
    texts = list(odd_texts)
    for _ in range(6):
        base = sentence(rng, rng.randrange(60, 200)).split()
        for _ in range(8):  # edits around the threshold
            copy = list(base)
            for _ in range(rng.randrange(0, len(base) // 18)):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    shared = sentence(rng, 40)  # half of each text, never enough to link
    texts += [shared + " " + sentence(rng, 40) for _ in range(30)]
    df = docs(spark, texts).repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(df, width, tile=tile).collect()}
    want = brute_near(list(enumerate(texts)), width)
    assert got == want and sum(not v[2] for v in want.values()) > 20
    assert near_duplicates(df.limit(0)).collect() == []


def test_components_of_chains_and_stars(spark):
    from helpweave.llm.graph import components

    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (300, 200), (300, 200)]
    got = {r["id"]: r["component_id"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = component_of(links, {x for p in links for x in p})
    assert got == {k: v for k, v in want.items() if k != v}


# --- op5 ---------------------------------------------------------------------------------
def test_chat_round_trip(spark):
    from helpweave.llm.chat import format_conversations, read_back

    nasty = ["\\### Assistant: </turn> ok", "", None, "\\", "\\\\l<h#b", "### user: x </turn>### ", "a\nb", "🙂é"]
    rows = [(c, t, ["user", "assistant", "sys:#", None][(c + t // 2) % 4], nasty[(c * 3 + t) % len(nasty)], "x") for c in range(6) for t in range(7)]
    rows += [(None, 0, "user", "lost", "x"), (1, None, "assistant", "first", "x"), rows[3], (50, 5, "user", "z" * 50_000, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string").repartition(3)
    got = {r["conv_id"]: r for r in read_back(format_conversations(df)).collect()}
    for c in {r[0] for r in rows}:
        mine = sorted(((-1 if t is None else t, r or "", x or "") for cc, t, r, x, _ in rows if cc == c))
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == [(r, x) for _, r, x in mine]
        assert list(got[c]["masked"]) == [x for _, r, x in mine if r == "assistant"]
        for p in got[c]["loss_spans"]:
            assert 0 <= p["start"] and p["start"] + p["length"] <= len(got[c]["formatted"])
    assert format_conversations(df.limit(0)).collect() == []


# --- op6 ---------------------------------------------------------------------------------
def test_bpe_equals_the_library(spark, odd_texts):
    from tokenizers import Tokenizer

    from helpweave.llm.bpe import decode, encode, tokenizer_path

    path = tokenizer_path(spark)
    rng = random.Random(2)
    letters = [*"abc  \n\t'sdrvé1٣!?漢🙂", "<|endoftext|>", "'re", "  ", "<|endof", "\x1c", "\u200b"]
    texts = odd_texts + ["".join(rng.choice(letters) for _ in range(rng.randrange(50))) for _ in range(120)] + ["ab" * 3000, "<|endoftext|>"]
    tok = Tokenizer.from_file(path)
    df = docs(spark, texts).withColumn("ids", F.lit("clash"))
    done = encode(df, path, limit=500)
    got = {r["doc_id"]: r["ids"] for r in done.collect()}
    want = {i: tok.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    assert got == want
    back = {r["doc_id"]: r["text"] for r in decode(done, path).collect()}
    assert back == {i: tok.decode(want[i], skip_special_tokens=False) for i in want} == {i: t or "" for i, t in enumerate(texts)}
    broken = decode(spark.createDataFrame([(1, [want[14][0]]), (2, None), (3, [])], "doc_id long, ids array<int>"), path).orderBy("doc_id").collect()
    assert [r["text"] for r in broken] == [tok.decode([want[14][0]], skip_special_tokens=False), "", ""]
    assert encode(df.limit(0), path).collect() == []


def test_lexicon_is_minimal_and_exact():
    from helpweave.llm.bpe import Lexicon, compile_lexicon

    words = sorted({f"{a}{b}{c}".encode() for a in ("", "un", "re") for b in ("do", "tie", "é") for c in ("", "s", "ing")})
    lex = Lexicon(compile_lexicon(words), np.zeros(0, np.int32), np.zeros(len(words), np.int64))
    assert lex.find(words).tolist() == list(range(len(words)))
    assert lex.find([b"", b"un", b"dos!", b"tieings", b"\xff"]).tolist() == [-1] * 5
    assert lex.dead < 20  # suffixes are shared: far fewer states than letters


# --- op7 ---------------------------------------------------------------------------------
def test_decontamination_finds_plain_and_reparameterised_items(spark, odd_texts):
    from helpweave.llm.decontaminate import contamination, drop_contaminated

    item = "A train leaves for Boston with 12 passengers and 3 bags of 40 kg each, how heavy are all the bags that Mary took"
    again = "a train leaves for Denver with 15 passengers and 7 bags of 25 lb each; how heavy are all the bags that Peter took"
    mixed = "We went to Rome and 12 and 13 and Paris then 12 and 14 to see the old town with Anna and 15 dogs"
    wrong = mixed.replace("12", "5", 1).replace("12", "6", 1)
    clean = "The weather was fine and nobody asked a question about trains or bags in the whole of that long summer"
    texts = odd_texts + ["Intro words. " + item + " End of it.", "Well then, " + again + "? Yes.", clean, wrong, item[: len(item) // 4]]
    n = len(odd_texts)
    bench = spark.createDataFrame([(1, item, 0), (2, mixed, 0), (3, None, 0), (4, "", 0), (5, "too short", 0), (None, item, 0), (1, item, 0)], "item_id long, text string, slots int")
    df = docs(spark, texts + [texts[n]], [*range(len(texts)), n])
    got = {(r["doc_id"], r["item_id"]): r["reparameterised"] for r in contamination(df, bench).collect()}
    assert got == {(n, 1): False, (n + 1, 1): True}
    kept = drop_contaminated(df, bench)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == set(range(len(texts))) - {n, n + 1}
    assert contamination(df.limit(0), bench).collect() == [] and contamination(df, bench.limit(0)).collect() == []


def test_decontamination_equals_search_for_planted_passages(spark):
    from helpweave.llm.op7 import op7_decontamination

    d, b = (spark.read.parquet(f"{SMALL}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    want = {(x["doc_id"], y["item_id"]) for x in d for y in b if y["text"] in (x["text"] or "")}
    got = {(r["doc_id"], r["item_id"]) for r in op7_decontamination(spark, SMALL).collect()}
    assert want and got == want


# --- op8 ---------------------------------------------------------------------------------
def brute_bytes(texts, width):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[k : k + width] for t in raw for k in range(len(t) - width + 1))
    out = Counter()
    for t in raw:
        gone = np.zeros(len(t) + 1, int)
        for k in range(len(t) - width + 1):
            if seen[t[k : k + width]] > 1:
                gone[k] += 1
                gone[k + width] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out[(len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("width, together", [(100, 50_000), (100, 2), (400, 50_000)])
def test_repeated_bytes_equal_brute_force(spark, odd_texts, width, together):
    from helpweave.llm.repeats import drop_repeated_bytes

    rng = random.Random(13)
    pieces = [sentence(rng, n) for n in (14, 17, 18, 19, 20, 70, 90)]
    texts = odd_texts + [" ".join(rng.choice(pieces) for _ in range(5)) + sentence(rng, 3) for _ in range(20)]
    df = docs(spark, texts, [None, *range(len(texts) - 1)]).repartition(3)
    done = drop_repeated_bytes(df, width, together)
    assert done.columns[: len(df.columns)] == df.columns
    got = Counter((r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in done.collect())
    assert got == brute_bytes(texts, width) and sum(k[1] for k in got) > 1000
    assert drop_repeated_bytes(df.limit(0)).collect() == []


# --- op10 --------------------------------------------------------------------------------
def test_url_rules_and_segmentation(spark):
    from helpweave.llm.op10 import RULES
    from helpweave.llm.urls import Segmenter, judge_urls

    urls = {1: "http://a.org/x", 2: "https://EXAMPLE.org/es/1?q", 3: "http://www.example.org/en/12", 4: "http://example.org/en/2", 5: "http://x.com/fr/a#b", 6: "http://x.com/de/a",
            7: "http://notorg/de/", 8: None, 9: "no scheme", 10: "http://a.org", 11: "://", 12: "http://x.com?/fr/", 13: "ftp://h:80/p?a://b"}
    df = spark.createDataFrame([(k, v, "<title>cheap pills town</title>" if k % 2 else None, "x") for k, v in urls.items()], "page_id long, url string, html string, rule string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in judge_urls(df, RULES).collect()}
    assert {k: v[2] for k, v in got.items()} == {1: "org/", 2: "example.org/es/", 3: "example.org/en/1", 4: "org/", 5: "com/fr/", 6: "com/de/", 7: None, 8: None, 9: None, 10: None, 11: None, 12: None, 13: None}
    assert [got[k][3] for k in (1, 2, 3, 4, 5, 6)] == ["allow", "block", "block", "allow", "allow", "block"]
    assert got[2][:2] == ("example.org", "/es/1") and got[8][:2] == got[9][:2] == got[11][:2] == ("", "") and got[12][:2] == ("x.com", "") and got[13][:2] == ("h:80", "/p")
    assert all(v[3] in ("allow", "block") for v in got.values())
    assert Segmenter({"cheap": 5, "pills": 4, "pill": 3, "s": 1}).split("cheappills") == ["cheap", "pills"]
    assert judge_urls(df.limit(0), RULES).collect() == []


# --- pipeline ------------------------------------------------------------------------------
def test_pipeline_stages_against_brute_force(spark):
    import corpus_pipeline as p
    from helpweave.llm.bpe import tokenizer_path
    from helpweave.session import materialize
    from tokenizers import Tokenizer

    given = spark.read.parquet(f"{SMALL}/documents.parquet")
    step = dict(p.STAGES)
    rows = {r["doc_id"]: r["text"] for r in given.collect()}

    def run(name, df):
        out = materialize(step[name](spark, df, SMALL))
        return out, {r["doc_id"]: r for r in out.collect()}

    a, kept = run("toxicity", given)
    assert a.columns == given.columns and set(kept) <= set(rows)
    before = {i: r["text"] for i, r in kept.items()}
    b, kept = run("minhash_near_dedup", a)
    assert set(kept) == {i for i, v in brute_near(list(before.items()), 5).items() if v[2]} and b.columns == given.columns
    before = {i: r["text"] for i, r in kept.items()}
    c, kept = run("substring_dedup", b)
    want = brute_passages(list(before.items()), 50)
    assert {i: " ".join(w.decode() for w in words_of(r["text"])) for i, r in kept.items()} == {i: v[2] for i, v in want.items()}
    assert all(r["n_chars"] == len(r["text"]) for i, r in kept.items() if want[i][1]) and c.columns == given.columns
    before = {i: r["text"] for i, r in kept.items()}
    d, kept = run("benchmark_decontamination", c)
    bench = [r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    assert set(kept) == {i for i, t in before.items() if not any(x in t for x in bench)} and d.columns == given.columns
    e, out = run("bpe_encoding", d)
    tok = Tokenizer.from_file(tokenizer_path(spark))
    assert all(out[i]["ids"] == tok.encode(r["text"], add_special_tokens=False).ids and out[i]["decoded_matches"] for i, r in kept.items())
    assert len(out) == len(kept) and p.run(spark, SMALL).count() == len(out)


def test_pipeline_stages_on_odd_rows(spark, odd_texts):
    import corpus_pipeline as p

    texts = odd_texts + [odd_texts[5], None]
    rows = [(i if i != 3 else None, t, "en", None if i % 3 else "src0", None if t is None else len(t)) for i, t in enumerate(texts)] + [(5, odd_texts[5], "en", "src0", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in p.STAGES:
        out = stage(spark, df, SMALL)
        assert out.count() > 0 and stage(spark, df.limit(0), SMALL).collect() == []
        df = df if "ids" in out.columns else out
