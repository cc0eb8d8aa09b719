import math
import random

import pytest
from pyspark.sql import functions as F

from helpweave.functions import text as tx
from helpweave.operators import compound, evaluate as ev, extract as ex, ground, quality as ql, retrieval as rt, similarity as sim
from helpweave.session import materialize
from helpweave.sources import readers as rd, store as st

PHRASES = ["Screen flickers", "Battery draining fast", "Battery not charging", "How do I turn on Dark mode", "How do I turn off Dark mode",
           "Phone is lagging", "Speaker crackling during a call", "Wifi stopped working", "Camera is blurry"]


def make_complaints(spark, n=150, seed=1):
    rng = random.Random(seed)
    rows = [(i, " and ".join(rng.sample(PHRASES, rng.choice([1, 1, 2]))) + rng.choice(["", " again", " on my S20", "!!"])) for i in range(n)]
    return spark.createDataFrame(rows, "complaint_id long, query string")


def test_tiled_join_equals_brute_force_whatever_the_tile_size(spark):
    c = make_complaints(spark)
    store = materialize(st.make_store(make_complaints(spark, 80, 2).select(F.col("complaint_id").alias("seq"), "query")))
    small = {(r[0], r[1]) for r in sim.match_semantic(c, store, rows=7).select("complaint_id", "seq").collect()}
    large = {(r[0], r[1]) for r in sim.match_semantic(c, store, rows=4096).select("complaint_id", "seq").collect()}
    from helpweave.functions import intent

    p = sim.with_keys(tx.with_embedding(c, "query"))
    p = p.select("complaint_id", F.col("vec").alias("pv"), *[F.col(f).alias("p_" + f) for f in intent.SIGNATURE_FIELDS])
    s = store.select("seq", F.col("vec").alias("sv"), *[F.col(f).alias("s_" + f) for f in intent.SIGNATURE_FIELDS])
    pairs = p.join(s, F.round(tx.dot("pv", "sv"), 9) >= 0.82).where(intent.gate("p_", "s_"))
    best = pairs.groupBy("complaint_id").agg(F.max(F.struct(F.round(tx.dot("pv", "sv"), 9).alias("v"), (-F.col("seq")).alias("n"))).alias("b"))
    want = {(r[0], -r[1]) for r in best.select("complaint_id", "b.n").collect()}
    assert small == large == want


def test_variant_prefix_filter_is_lossless(spark):
    c = make_complaints(spark)
    v = make_complaints(spark, 60, 3).select((F.col("complaint_id") % 20).alias("plan_id"), F.col("complaint_id").alias("seq"), F.col("query").alias("text"))
    vocab = spark.createDataFrame([("camera",), ("battery",)], "term string")
    got = {(r["complaint_id"], r["seq"], round(r["similarity"], 6)) for r in sim.match_by_variant(c, v, vocab).collect()}
    cut = {(r["complaint_id"], r["seq"], round(r["similarity"], 6)) for r in sim.match_by_variant(c, v, vocab, rows=5).collect()}
    assert cut == got
    from helpweave.functions import intent

    idf = {r["term"]: r["idf"] for r in sim.plan_idf(v)[0].collect()}

    def side(df, key, text):
        df = tx.with_embedding(intent.with_signature(df, text), text).withColumns({"toks": tx.lexical_tokens(text), "cmd": intent.command_polarity(text)})
        return [r.asDict() | {"id": r[key], "text": r[text]} for r in df.orderBy(key).collect()]

    def lex(t):
        w = {}
        for x in t:
            w[x] = w.get(x, 0) + idf.get(x, 1.0)
        n = math.sqrt(sum(x * x for x in w.values())) or 1
        return {k: x / n for k, x in w.items()}

    def compatible(a, b):
        if a["polarity"] != b["polarity"]:
            return True
        if "General" not in (a["domain"], b["domain"]) and a["domain"] != b["domain"]:
            return False
        if {a["symptom"], b["symptom"]} in ({"drain", "not_charging"}, {"blank", "flicker"}, {"slow", "damage"}):
            return False
        return "none" in (a["trigger"], b["trigger"]) or a["trigger"] == b["trigger"]

    want = set()
    keys = side(v, "seq", "text")
    for p in side(c, "complaint_id", "query"):
        best = None
        for k in keys:
            la, lb = lex(p["toks"]), lex(k["toks"])
            s = round(0.5 * sum(x * y for x, y in zip(p["vec"], k["vec"])) + 0.5 * sum(x * lb.get(t, 0) for t, x in la.items()), 9)
            fa, fb = ({t for t in x["toks"] if t in ("camera", "battery")} for x in (p, k))
            if s < 0.6 or (best and s <= best[0]) or (p["cmd"] and k["cmd"] and p["cmd"] != k["cmd"]) or not compatible(p, k) or (fa - fb and fb - fa):
                continue
            best = (s, k["id"])
        if best:
            want.add((p["id"], best[1], round(best[0], 6)))
    assert got == want


def test_article_pruning_equals_full_scoring(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words, weights=[60 - j for j in range(60)], k=rng.randint(5, 60)))) for i in range(120)], "doc_id long, text string")
    queries = spark.createDataFrame([(i, " ".join(rng.choices(words, k=rng.randint(1, 6)))) for i in range(40)] + [(90, "w0 w1"), (91, "zzz")], "qid long, text string")
    index = rt.build_index(docs)
    pairs = {(r["qid"], r["doc"]): (r["bm25"], r["cosine"]) for r in rt.score_terms(rt.query_terms(queries, index), index).collect()}
    full = set()
    for q in {q for q, _ in pairs}:
        mine = {d: v for (p, d), v in pairs.items() if p == q}
        peak = max(b for b, _ in mine.values())
        score = {d: 0.5 * (b / (peak + 1e-9) if peak > 0 else b) + 0.5 * c for d, (b, c) in mine.items()}
        best = min(mine, key=lambda d: (-round(score[d], 9), d))
        if mine[best][1] >= 0.14 and mine[best][0] > 0:
            full.add((q, best, round(score[best], 8)))
    pruned = {(r["qid"], r["doc"], round(r["score"], 8)) for r in rt.retrieve_articles(queries, index, min_cosine=0.14).collect()}
    assert pruned == full and len(full) > 30


def test_compound_matching(spark):
    store = materialize(st.make_store(spark.createDataFrame([(0, "Screen flickers"), (1, "battery dies fast")], "seq long, query string")))
    c = spark.createDataFrame([(1, "Screen flickers and battery dies fast"), (2, "Screen flickers and camera is blurry"), (3, "screen flickers!"), (4, "camera is blurry")], "complaint_id long, query string")
    summary, plans = compound.match_compound(c, store)
    got = {r["complaint_id"]: (r["hit_type"], r["missing"]) for r in summary.collect()}
    assert got[1] == ("full_compositional", "")
    assert got[2] == ("partial_compositional", "camera is blurry")
    assert got[3][0] == "full_exact"
    assert got[4][0] is None
    assert {(r["complaint_id"], r["seq"]) for r in plans.collect()} >= {(1, 0), (1, 1), (2, 0), (3, 0)}


def test_redundant_clauses_merge(spark):
    df = spark.createDataFrame([(1, "Phone is lagging and very slow"), (2, "Screen flickers and battery draining fast")], "complaint_id long, query string")
    got = {}
    for r in compound.decompose(df).collect():
        got.setdefault(r["query"], []).append((r["clause_pos"], r["domain"]))
    assert len(got["Phone is lagging and very slow"]) == 1
    assert sorted(got["Screen flickers and battery draining fast"]) == [(0, "Display"), (1, "Battery")]


def test_grounding_prunes_invented_steps(spark):
    articles = spark.createDataFrame([(1, "To resolve flickering, navigate to Display settings and toggle off Adaptive Brightness.")], "article_id long, text string")
    steps = ["Open Settings.", "Tap on Display.", "Toggle off Adaptive Brightness.", "Format internal storage partition.", "Execute factory firmware wipe."]
    plan = spark.createDataFrame([(7, 1, int(i > 2), "A", 0, i, s) for i, s in enumerate(steps)], "plan_id long, article_id long, action_pos int, action_name string, group_pos int, step_pos int, step string")
    kept, coverage, provenance = ground.filter_grounded(plan, articles, 0.15)
    assert {r["step_pos"] for r in kept.collect()} == {0, 1, 2}
    assert coverage.first()["coverage"] == 0.6 and provenance.count() == 5


@pytest.mark.parametrize("signals,want", [((1.0, 1.0, 1.0, 1.0), 1.0), ((0.0, 0.0, 0.0, 0.0), 0.0), ((0.8, 1.0, 0.9, 0.7), 0.86), ((2.0, 1.0, 1.0, -1.0), 0.85)])
def test_confidence(spark, signals, want):
    df = spark.createDataFrame([signals], "g double, v double, r double, p double")
    assert df.select(ev.confidence("g", "v", "r", "p")).first()[0] == pytest.approx(want)


def test_step_caps_and_dedupe(spark):
    lines = ["## Big"] + [f"Tap button number {i}." for i in range(9)] + ["## Again", "Tap button number 8.", "Tap button number 1."]
    df = spark.createDataFrame([(1, "\n".join(lines))], "article_id long, content string")
    got = [(r["action_pos"], r["step"]) for r in ex.extract_actions(df).orderBy("action_pos", "step_pos").collect()]
    assert [s for a, s in got if a == 0] == [f"Tap button number {i}." for i in range(6)]
    # button 8 was cut off by the cap, so it is not a duplicate later; button 1 is.
    assert [s for a, s in got if a == 1] == ["Tap button number 8."]


def test_at_most_eight_actions(spark):
    text = "\n".join(f"## Part {i}\nTap the item {i} now." for i in range(12))
    df = spark.createDataFrame([(1, text)], "article_id long, content string")
    assert ex.extract_actions(df).select("action_pos").distinct().count() == 8


def test_repair_is_idempotent_and_valid(spark):
    rows = [(1, "Steps to perform screen", "Screen Display Flicker Issue", 1.7, 0, "factory reset", "this will erase https://x.example/a all the data", "critical", 0, 0, "Reset phone at www.x.example now.", "demo://a", None),
            (1, "Steps to perform screen", "Screen Display Flicker Issue", 1.7, 1, "contact us", "lowers the display intensity", "manual", 0, 0, "Visit a shop.", "demo://b", None)]
    schema = "plan_id long, goal string, title string, score double, action_pos int, action_name string, description string, category string, group_pos int, step_pos int, step string, link string, check_link string"
    fixed = materialize(ql.repair_plans(spark.createDataFrame(rows, schema)))
    got = {r["action_pos"]: r for r in fixed.collect()}
    assert got[1]["category"] == "critical" and got[0]["link"] is None and got[0]["title"] == "Screen display flicker" and got[0]["score"] == 1.0
    assert got[0]["goal"] == "Follow these steps to perform this Screen Troubleshooting"
    assert ql.validate_plans(fixed).where("severity = 'error'").count() == 0
    again = ql.repair_plans(fixed)
    assert sorted(map(str, again.select(*fixed.columns).collect())) == sorted(map(str, fixed.collect()))
    ql.raise_if_invalid(fixed)


def test_near_miss_pairs_are_rejected_by_the_gate(spark):
    pairs = spark.createDataFrame([(1, "How do I turn on Dark Mode?", "How do I turn off Dark Mode?"), (2, "My phone battery is draining fast", "My phone battery is not charging"),
                                   (3, "Screen flickers!", "screen flickers")], "pair_id long, query_a string, query_b string")
    vocab = spark.createDataFrame([("timeout",)], "term string")
    got = {r["pair_id"]: r for r in ev.probe_pairs(pairs, vocab).collect()}
    assert not got[1]["hit_gated"] and not got[2]["hit_gated"] and not got[1]["hit_variant"]
    assert got[3]["hit_gated"] and got[3]["hit_cosine"] and got[3]["hit_variant"]


def test_latency_exact_and_sketch(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 101)], "ms double")
    r = ev.latency_report(df, "ms").first()
    assert (r["p50"], r["p95"], r["n"]) == (50.0, 96.0, 100) or (r["p50"], r["p95"]) == (50.0, 95.0)


def test_readers(spark, tmp_path):
    (tmp_path / "lines.txt").write_text(" one \n\n two\n")
    assert [r[0] for r in rd.read_complaints(spark, str(tmp_path / "lines.txt")).collect()] == ["one", "two"]
    (tmp_path / "a.json").write_text('{"responses":[{"id":"a1","siis_response":{"title":"T"}},{"original_query":"q"}]}')
    got = rd.read_articles(spark, str(tmp_path / "a.json")).orderBy("seq").collect()
    assert (got[0]["id"], got[0]["title"], got[0]["content"], got[1]["original_query"]) == ("a1", "T", "", "q")
    (tmp_path / "c.json").write_text('{"deeplinks":[{"id":"x","deeplink":"s://1","description":"d","message":"m"},{"id":"p","deeplink":"s://dummy_positive","description":"","message":""},{"id":"x","deeplink":"s://2","description":"d2","message":"m2","validation":{"deeplink":"v","key":"k"}}]}')
    cat = rd.read_catalog(spark, str(tmp_path / "c.json"))
    rows = {r["id"]: r for r in cat.collect()}
    assert len(rows) == 2 and rows["x"]["deeplink"] == "s://2" and rows["x"]["v_key"] == "k"
    assert tuple(rd.catalog_scheme(cat).first()) == ("s", "s://dummy_positive")
    (tmp_path / "l.json").write_text('{"scenarios":[{"id":"s1","steps":["a"]},{"id":"s2","steps":[]}]}')
    assert rd.read_labels(spark, str(tmp_path / "l.json"), "scenarios", "id:string,steps:array<string>").count() == 2


def test_row_ids_are_consecutive(spark):
    ids = [r["row_id"] for r in rd.with_row_id(spark.range(0, 50, 1, 7)).collect()]
    assert sorted(ids) == list(range(50))


def test_store_versions(spark, tmp_path):
    s = st.make_store(spark.createDataFrame([(1, "Screen flickers"), (0, "screen  FLICKERS!")], "seq long, query string"))
    folder = str(tmp_path / "store")
    st.write_version(s, folder, 0)
    assert st.read_store(spark, folder).select("seq").collect()[0][0] == 0
    st.clear_store(spark, folder)
    assert st.read_store(spark, folder).count() == 0 and st.latest_version(spark, folder) == 1


def test_critical_actions_are_not_repeated(spark):
    rows = [(1, 0, 0, "Adjust", "auto"), (1, 0, 1, "Restart Device", "critical"), (1, 1, 0, "Saver", "auto"), (1, 1, 1, " restart device", "critical")]
    df = spark.createDataFrame(rows, "complaint_id long, goal_pos int, action_pos int, action_name string, category string")
    assert sorted((r["goal_pos"], r["action_pos"]) for r in compound.dedupe_critical(df).collect()) == [(0, 0), (0, 1), (1, 0)]


def test_custom_embedding(spark):
    flag = lambda w: (lambda c: F.array(F.lower(c).contains(w).cast("double"), (~F.lower(c).contains(w)).cast("double")))
    embed = flag("battery")
    store = materialize(st.make_store(spark.createDataFrame([(0, "Battery draining"), (1, "Camera blurry")], "seq long, query string"), embed=embed))
    c = spark.createDataFrame([(5, "battery is empty"), (6, "photo looks odd")], "complaint_id long, query string")
    got = {r["complaint_id"]: r["seq"] for r in sim.match_semantic(c, store, gated=False, embed=embed).collect()}
    assert got == {5: 0, 6: 1}


def test_word_products_equal_sums_over_words(monkeypatch):
    import numpy as np
    import pandas as pd

    monkeypatch.setattr(sim, "WORD_COLUMNS", 3)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(15)]
    side = lambda n: [sorted(rng.sample(words, rng.randint(0, 6))) for _ in range(n)]
    a, b = side(9), side(12)
    wa, wb = ([[rng.random() for _ in x] for x in s] for s in (a, b))
    got = sim._lexical_matrix(pd.Series(a), pd.Series(wa), pd.Series(b), pd.Series(wb))
    want = [[sum(u * v for t, u in zip(x, p) for r, v in zip(y, q) if t == r) for y, q in zip(b, wb)] for x, p in zip(a, wa)]
    assert np.allclose(got, want)
    clash = sim._features_clash(pd.Series(a), pd.Series(b))
    assert (clash == [[bool(set(x) - set(y)) and bool(set(y) - set(x)) for y in b] for x in a]).all()
    assert sim._lexical_matrix(pd.Series([[], []]), pd.Series([[], []]), pd.Series([["x"]]), pd.Series([[1.0]])).tolist() == [[0.0], [0.0]]
