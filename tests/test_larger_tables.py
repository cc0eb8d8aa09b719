"""Shuffles and repeated work that larger tables do not forgive."""

SMALL = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plan_layout_shuffles_narrow_rows_once(spark):
    from helpweave.checks.q_quality import plan_steps
    from helpweave.operators.layout import assemble_plans

    plan = plan_of(assemble_plans(plan_steps(spark, SMALL)))
    assert plan.count("Exchange ") == 2 and "Broadcast" not in plan


def test_sentences_of_articles_are_counted_where_they_are_made(spark):
    from helpweave.checks.q_text import b13

    assert plan_of(b13(spark, SMALL)).count("Exchange ") == 1


def test_equal_contents_are_extracted_once(spark, monkeypatch):
    from helpweave.operators import extract as ex

    text = "# Screen\nOpen Settings. Tap Display.\n## Battery\nRestart the phone. Charge it for one hour."
    df = spark.createDataFrame([(i, text if i % 2 else text.upper()) for i in range(20)] + [(20, None), (20, text)], "article_id long, content string")
    made, actions = [], ex._actions
    monkeypatch.setattr(ex, "_actions", lambda rows, *names: made.append(rows.count()) or actions(rows, *names))
    got = sorted(map(tuple, ex.extract_actions(df).collect()))
    assert made == [2]
    assert got == sorted(map(tuple, actions(df, "article_id", "content").collect()))


def test_vectors_are_compared_in_large_tiles(spark, monkeypatch):
    from helpweave.checks.q_match import u1
    from helpweave.operators import similarity as sim

    tiles, tiled = [], sim._tiled
    monkeypatch.setattr(sim, "_tiled", lambda p, s, rows: tiles.append(rows) or tiled(p, s, rows))
    u1(spark, SMALL)
    assert min(tiles) >= sim.TILE_ROWS


def test_answers_are_planned_in_parts(spark):
    """The driver's memory follows the size of the plans, so no plan holds the steps before it."""
    from pyspark.sql import functions as F

    from helpweave.operators import resolve as rs
    from helpweave.plans.answer import cold_plans
    from helpweave.session import materialize
    from helpweave.sources.fixtures import derived

    seen = spark._jsparkSession.sharedState().statusStore()
    before = seen.executionsCount()
    articles = derived(spark, SMALL, "articles").where("article_id < 20")
    requests = materialize(articles.select(F.col("article_id").alias("complaint_id"), F.col("original_query").alias("query"), "title", "content"))
    index, entries = rs.catalog_index(materialize(derived(spark, SMALL, "catalog")))
    steps, scored = cold_plans(requests, index, entries)
    assert scored.count() == 20 and steps.count() > 20
    assert "Exchange" not in plan_of(scored) and "Exchange" not in plan_of(steps)
    made = seen.executionsList()
    sizes = [len(made.apply(i).physicalPlanDescription()) for i in range(made.size()) if made.apply(i).executionId() >= before]
    assert max(sizes) < 150_000


def test_driver_lets_go_of_finished_stages(spark, monkeypatch):
    from pyspark.sql import functions as F

    from helpweave.operators import resolve as rs
    from helpweave.plans import answer
    from helpweave.session import materialize, tidy
    from helpweave.sources.fixtures import derived

    seen = []
    monkeypatch.setattr(answer, "tidy", lambda s: seen.append(1) or tidy(s))
    articles = derived(spark, SMALL, "articles").where("article_id < 2")
    requests = materialize(articles.select(F.col("article_id").alias("complaint_id"), F.col("original_query").alias("query"), "title", "content"))
    index, entries = rs.catalog_index(materialize(derived(spark, SMALL, "catalog")))
    steps, scored = answer.cold_plans(requests, index, entries)
    assert scored.count() == 2 and steps.count() > 2 and len(seen) >= 4


def test_plans_are_split_by_their_errors_in_one_pass(spark, monkeypatch):
    from helpweave.operators import quality as ql

    goal = "Follow these steps to perform this Screen Troubleshooting"
    head = (goal, "Screen flicker", 0.5)
    step = lambda plan, action, name, category, pos, text, link=None, check=None, head=head: (
        plan, *head, action, name, "It will clear temporary glitches by restarting", category, 0, pos, text, link, check)
    rows = [
        step("good", 0, "Adjust Brightness", "auto", 0, "Open Settings."), step("good", 1, "Restart", "critical", 0, "Restart the phone."),
        step("leak", 0, "Adjust Brightness", "auto", 0, "Open Settings.", "see www.example.com"), step("leak", 0, "Adjust Brightness", "auto", 1, "Tap Display"),
        step("check", 0, "Adjust Brightness", "critical", 0, "Open Settings.", None, "http://x.example.com/1"),
        step("manual", 0, "visit a center", "manual", 0, "Open Settings.", "http://x.example.com/1"),
        step("kind", 0, "Restart", "other", 0, "Open Settings."), step("bare", 0, "Restart", "auto", 0, None), step("none", 0, "Restart", None, 0, "Open Settings."),
        step("odd", 0, "Restart", "auto", 0, "It <a href=x> blinks.", head=(None, None, None)), step("void", None, None, None, None, None),
        step("url", 0, "Restart", "auto", 0, "www.example.com"), step(None, 0, "Restart", "other", 0, "Open Settings."),
    ]
    fields = "plan_id string, goal string, title string, score double, action_pos int, action_name string, description string, category string, group_pos int, step_pos int, step string, link string, check_link string"
    steps = spark.createDataFrame(rows, fields)
    repaired = ql.repair_plans(steps)
    bad = {r["plan_id"] for r in ql.validate_plans(repaired).where("severity = 'error'").collect()} - {None}
    assert {"leak", "check", "kind", "bare", "url"} <= bad and "good" not in bad and "manual" not in bad
    written, write = [], ql.materialize
    monkeypatch.setattr(ql, "materialize", lambda df: written.append(plan_of(df)) or write(df))
    kept, rejected = ql.repair_then_split(steps)
    assert len(written) == 1 and written[0].count("Exchange ") == 1 and "Join" not in plan_of(kept) + plan_of(rejected)
    assert kept.columns == rejected.columns == repaired.columns
    text = lambda df: sorted(map(repr, df.collect()))
    assert text(kept.unionByName(rejected)) == text(repaired)
    assert {r["plan_id"] for r in rejected.collect()} == bad and bad.isdisjoint(r["plan_id"] for r in kept.collect())
