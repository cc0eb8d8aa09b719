"""Cases in which results once differed from the rules they stand for."""

import json

from pyspark.sql import functions as F

from helpweave.functions import text as tx
from helpweave.operators import extract as ex, layout, quality as ql, similarity as sim
from helpweave.plans.answer import answered_actions
from helpweave.sources import readers as rd, store as st

STEP = "plan_id long, goal string, title string, score double, action_pos int, action_name string, description string, category string, group_pos int, step_pos int, step string, link string, check_link string"
HEAD = ("Follow these steps to perform this Screen Troubleshooting", "Screen flicker", 0.5)
ACTION = ("Restart Device", "It will clear temporary glitches by restarting", "auto")


def found(spark, rows):
    got = ql.validate_plans(spark.createDataFrame(rows, STEP)).collect()
    return sorted((r["plan_id"], r["rule"], r["severity"]) for r in got)


def test_a_bad_link_counts_once_per_group(spark):
    rows = [(1, *HEAD, 0, *ACTION, 0, s, "Tap Display", "http://x.example.com", None) for s in range(3)]
    rows += [(1, *HEAD, 0, *ACTION, 1, 0, "Tap Display", "http://x.example.com", "www.example.com")]
    assert found(spark, rows) == [(1, "check_link_url", "error"), (1, "link_url", "error"), (1, "link_url", "error")]


def test_empty_groups_and_plans_without_actions(spark):
    rows = [
        (1, *HEAD, 0, *ACTION, 0, 0, "Tap Display", None, None), (1, *HEAD, 0, *ACTION, 1, None, None, None, None),  # an empty group beside a filled one
        (2, *HEAD, 0, *ACTION, None, None, None, None, None),  # an action without groups
        (3, *HEAD, None, None, None, None, None, None, None, None, None),  # no action at all
    ]
    assert found(spark, rows) == [(1, "empty_group", "error"), (3, "no_actions", "warning")]


def test_invalid_full_payloads_are_rejected(spark):
    good = {"goal": "g", "title": "t", "score": 0.5, "actions": [{"actionName": "a", "description": "d", "category": "auto", "stepGroups": [{"steps": ["s"]}]}]}
    wrong = json.loads(json.dumps(good))
    wrong["actions"][0]["category"] = "wrong"
    nameless = json.loads(json.dumps(good))
    del nameless["actions"][0]["actionName"]
    rows = [(i, json.dumps(x)) for i, x in enumerate([good, wrong, nameless])]
    steps, _, rejected = rd.ingest_model_outputs(spark.createDataFrame(rows, "plan_id long, raw string"))
    assert {r["plan_id"] for r in steps.collect()} == {0} and {r["plan_id"] for r in rejected.collect()} == {1, 2}


def test_articles_are_unwrapped_at_any_depth(spark):
    inner = {"title": "T", "content": "C"}
    for _ in range(5):
        inner = {"siis_response": inner}
    rows = [(0, json.dumps(inner)), (1, "plain"), (2, json.dumps({"siis_response": "text"})), (3, None), (4, json.dumps({"title": "x"}))]
    got = rd.normalize_requests(spark.createDataFrame(rows, "id int, article string"), "article").orderBy("id").collect()
    assert [(r["title"], r["content"]) for r in got] == [("T", "C"), ("", "plain"), ("", "text"), (None, None), ("x", "")]


def test_sentences_keep_digits_that_equal_their_place(one):
    assert one(tx.grounding_sentences, "00 first 00. 11 tries help 1. 2 + 2 = 22") == ["00 first 00.", "11 tries help 1.", "2 + 2 = 22"]


def test_runs_inside_words_of_other_letters_are_no_tokens(one):
    assert sorted(one(tx.grounding_tokens, "a café wi-fi -x9- naïve tap2")) == ["tap2", "wi-fi", "x9"]


def test_vectors_of_other_lengths_or_none_match_nothing(spark):
    p = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", [1.0, 0.0, 0.0]), (3, "a", None), (4, "b", [0.0, 1.0])], "qid long, block string, vec array<double>")
    s = spark.createDataFrame([(7, "a", [1.0, 0.0]), (8, "a", None), (9, "b", [0.0, 1.0, 0.0])], "seq long, block string, vec array<double>")
    for rows in (1, 64):
        assert [(r["qid"], r["seq"]) for r in sim.best_in_block(p, s, 0.5, rows=rows).collect()] == [(1, 7)]


def test_unsigned_stored_rows_take_the_signature_of_their_text(spark):
    rows = spark.createDataFrame([(1, "Screen flickers"), (2, "Battery not charging")], "seq long, query string")
    store = st.make_store(rows)
    bare = store.withColumn("has_signature", F.lit(False))
    for f in ("domain", "component", "symptom", "polarity", "trigger"):
        bare = bare.withColumn(f, F.lit(None).cast("string"))
    asked = spark.createDataFrame([(5, "Screen flickers !!")], "complaint_id long, query string")
    assert [r["seq"] for r in sim.match_semantic(asked, bare).collect()] == [r["seq"] for r in sim.match_semantic(asked, store).collect()] == [1]


def test_contents_that_differ_in_case_are_two_articles(spark):
    text = "# Screen issue\n## Restart the phone\nPlease restart the phone. First, turn on Dark Mode."
    rows = [(1, "Screen flickers", "Screen", text, "same"), (2, "Screen flickers", "Screen", text.replace("turn on Dark Mode", "TURN ON DARK MODE"), "same")]
    got = ex.extract_plans(spark.createDataFrame(rows, "complaint_id long, query string, title string, content string, fingerprint string"))
    steps = {i: {r["step"] for r in got.collect() if r["plan_id"] == i} for i in (1, 2)}
    assert steps[1] and steps[1] != steps[2]


def test_links_of_the_pipeline_reach_the_results(spark):
    rows = [(1, *HEAD, 0, *ACTION, 0, s, f"Tap {s}", "demo://a", "demo://v") for s in range(2)]
    df = spark.createDataFrame(rows, STEP).withColumns({"link_description": F.lit("d"), "link_message": F.lit("m"), "link_type": F.lit("onURL")})
    group = layout.assemble_plans(df).first()["goal"]["actions"][0]["stepGroups"][0]
    assert group["steps"] == ["Tap 0", "Tap 1"] and group["validationDeeplink"]["deeplink"] == "demo://v"
    link = group["actionableDeeplink"]
    assert (link["deeplink"], link["description"], link["message"], link["originalType"]) == ("demo://a", "d", "m", "onURL")


def test_all_plans_of_a_compositional_answer_without_repeated_critical_actions(spark):
    answers = spark.createDataFrame([(1, [10, 20]), (2, [20]), (3, [])], "complaint_id long, seqs array<long>")
    actions = spark.createDataFrame([(10, 0, "Tap", "auto"), (10, 1, "Reset phone", "critical"), (20, 0, "Reset Phone ", "critical"), (20, 1, "Call", "manual")],
                                    "seq long, action_pos int, action_name string, category string")
    got = sorted((r["complaint_id"], r["goal_pos"], r["action_pos"]) for r in answered_actions(answers, actions).collect())
    assert got == [(1, 0, 0), (1, 0, 1), (1, 1, 1), (2, 0, 0), (2, 0, 1)]


def test_release_deletes_what_was_materialised(spark):
    from helpweave.session import materialize, release

    kept = materialize(spark.range(3))
    assert kept.count() == 3 and release(spark) >= 1 and release(spark) == 0


def test_a_local_session_without_a_checkpoint_folder_gets_one_of_its_own(spark):
    from helpweave import session as s

    class Conf:
        def get(self, key, default=None):
            return default

    class Bare:
        conf, sparkContext = Conf(), spark.sparkContext

    first = s.checkpoint_dir(Bare())
    assert first == s.checkpoint_dir(Bare())
    df = spark.range(3)
    df.write.parquet(f"{first}/three")
    assert spark.read.parquet(f"{first}/three").count() == 3


def test_row_ids_follow_files_and_bytes(spark, tmp_path):
    from helpweave.sources import readers as rd

    folder = tmp_path / "lines"
    folder.mkdir()
    want = []
    for name, n in (("f0.txt", 40), ("f1.txt", 3000), ("f2.txt", 5)):
        lines = [f"{name} line {i} " + "x" * (i % 50) for i in range(n)]
        (folder / name).write_text("\n".join(lines) + "\n")
        want += lines
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size in ("4096", "134217728"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "100")
            scan = spark.read.text(str(folder))
            got = {r["row_id"]: r["value"] for r in rd.with_row_id(scan).collect()}
            assert [got[i] for i in range(len(want))] == want
            kept = rd.with_row_id(scan.where("value NOT LIKE '%line 7 %'"))
            assert [r["value"] for r in kept.orderBy("row_id").collect()] == [w for w in want if "line 7 " not in w]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert rd.with_row_id(spark.range(0)).collect() == []
