"""Extraction of plans from articles."""

from __future__ import annotations

from pyspark.sql import functions as F

from helpweave import lexicons as lx
from helpweave.checks import sqltext as q
from helpweave.checks.registry import query, with_tables
from helpweave.functions import text as tx
from helpweave.operators import extract as ex
from helpweave.sources.fixtures import derived


@query(
    "c2_split_sections",
    with_tables(
        """SELECT article_id, heading, trim(body) AS body FROM (SELECT article_id, '' AS heading, 'I understand you are having trouble with ' || l || '.' AS body FROM a
 UNION ALL SELECT article_id, 'Adjust ' || l, 'Please go to Settings, tap ' || p || ', and then tap ' || l || '. First, turn on ' || l || '. This usually helps.' FROM a
 UNION ALL SELECT article_id, 'Force a restart', 'Press and hold the Power button for 20 seconds. If it stays off, charge the device for one hour.' FROM a WHERE article_id % 3 = 0
 UNION ALL SELECT article_id, 'Factors affecting ' || l, 'Remove the screen protector and test again. See https://example.com/help for more.' FROM a WHERE article_id % 3 = 1
 UNION ALL SELECT article_id, 'Contact support', 'You can visit a local service center. First, turn on ' || l || '.' FROM a) s""",
        "articles", extra="a AS (SELECT article_id, regexp_extract(title, '^(.*) issue', 1) AS l, regexp_extract(content, 'tap ([^,]*), and', 1) AS p FROM articles)",
    ),
)
def c2(spark, sf):
    return ex.split_sections(derived(spark, sf, "articles")).select("article_id", "heading", tx.strip("body").alias("body"))


_A = "a AS (SELECT article_id, original_query, title, regexp_extract(title, '^(.*) issue', 1) AS l, regexp_extract(content, 'tap ([^,]*), and', 1) AS p FROM articles)"
_STEPS = """steps AS (SELECT article_id, 'Go to Settings, tap ' || p || ', and then tap ' || l || '.' AS step, 1 AS sec, 0 AS step_pos FROM a
 UNION ALL SELECT article_id, 'Turn on ' || l || '.', 1, 1 FROM a
 UNION ALL SELECT article_id, 'Press and hold the Power button for 20 seconds.', 2, 0 FROM a WHERE article_id % 3 = 0
 UNION ALL SELECT article_id, 'Remove the screen protector and test again.', 2, 0 FROM a WHERE article_id % 3 = 1
 UNION ALL SELECT article_id, 'Visit a local service center.', 3, 0 FROM a)"""


@query("c3_extract_steps", with_tables("SELECT article_id, step, CASE WHEN sec = 1 AND step_pos = 1 THEN 2 ELSE 1 END AS n FROM steps", "articles", extra=_A + ", " + _STEPS))
def c3(spark, sf):
    secs = ex.split_sections(derived(spark, sf, "articles")).withColumn("ss", tx.step_sentences("body"))
    sentences = secs.select("article_id", F.explode_outer("ss").alias("sentence"))
    return sentences.withColumn("step", ex.to_imperative("sentence")).where("step IS NOT NULL").groupBy("article_id", "step").agg(F.count("*").alias("n"))


@query("w10_step_dedupe", with_tables("SELECT article_id, step, step_pos FROM steps", "articles", extra=_A + ", " + _STEPS))
def w10(spark, sf):
    return ex.extract_actions(derived(spark, sf, "articles")).select("article_id", "step", "step_pos")


_cat = lambda h, b: (
    f"CASE WHEN {q.count_phrases(h, lx.CRITICAL_TERMS)} > 0 OR {q.count_phrases(b, lx.CRITICAL_BODY_TERMS)} > 0 THEN 'critical' "
    f"WHEN {q.count_phrases(h, lx.MANUAL_TERMS)} > 0 OR {q.count_phrases(b, lx.MANUAL_TERMS)} > {q.count_phrases(b, lx.AUTO_TERMS)} THEN 'manual' "
    f"WHEN {q.count_phrases(b, lx.AUTO_TERMS)} > 0 THEN 'auto' ELSE 'manual' END"
)


@query("c4_categorize", with_tables(f"SELECT group_id, step_pos, {_cat('lower(category)', 'lower(step)')} AS category FROM step_groups", "step_groups"))
def c4(spark, sf):
    return derived(spark, sf, "step_groups").select("group_id", "step_pos", ex.categorize("category", "step").alias("category"))


@query(
    "c5_guard_category",
    with_tables(f"SELECT plan_id, action_pos, CASE WHEN r = 'critical' THEN r WHEN category = 'auto' AND r = 'manual' AND NOT contains(lower(description), 'settings') THEN 'manual' ELSE category END AS category FROM (SELECT *, {_cat('lower(action_name)', 'lower(description)')} AS r FROM plans) t", "plans"),
)
def c5(spark, sf):
    return derived(spark, sf, "plans").select("plan_id", "action_pos", ex.guard_category("action_name", "description", "category").alias("category"))


def _rule(x):
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains({x}, {q.lit(k)})" for k in keys) + f" THEN {q.lit(d)}" for keys, d in lx.DESCRIPTION_RULES) + " END"


@query(
    "c6_known_description",
    with_tables(f"SELECT article_id, coalesce({_rule('lower(title)')}, {_rule(chr(40) + 'lower(title) || chr(32) || lower(content)' + chr(41))}) AS description FROM articles", "articles"),
)
def c6(spark, sf):
    return derived(spark, sf, "articles").select("article_id", ex.known_description("title", "content").alias("description"))


_ACTIONS = f"""acts AS (SELECT article_id, 1 AS sec, 'Adjust ' || l AS action_name, 'It will adjust ' || lower(l) AS description, 'auto' AS category FROM a
 UNION ALL SELECT article_id, 2, 'Force a Restart', 'It will clear temporary glitches by restarting', 'critical' FROM a WHERE article_id % 3 = 0
 UNION ALL SELECT article_id, 2, 'Remove the Screen Protector', 'It will remove accessories blocking touch input', 'manual' FROM a WHERE article_id % 3 = 1
 UNION ALL SELECT article_id, 3, 'Contact Support', 'It will connect you with Samsung repair', 'manual' FROM a)"""


@query(
    "c7_action_names",
    with_tables(f"SELECT article_id, array_to_string([upper(left(w, 1)) || substr(w, 2) for w in string_split(action_name, ' ')], ' ') AS action_name FROM acts WHERE sec = 1 UNION ALL SELECT article_id, action_name FROM acts WHERE sec > 1", "articles", extra=_A + ", " + _ACTIONS),
)
def c7(spark, sf):
    return ex.extract_actions(derived(spark, sf, "articles")).select("article_id", "action_pos", "action_name").distinct().drop("action_pos")


def _topic(part: int) -> str:
    i = part
    sym = " ".join(f"WHEN s = {q.lit(k)} THEN {q.lit(v[i])}" for k, v in lx.SYMPTOM_TOPICS.items())
    com = " ".join(f"WHEN c = {q.lit(k)} THEN {q.lit(v[i])}" for k, v in lx.COMPONENT_TOPICS.items())
    made = ("array_to_string([upper(left(w, 1)) || substr(w, 2) for w in ws], ' ')" if i == 0
            else "upper(left(lower(ws[1]), 1)) || substr(lower(array_to_string(ws[1:2], ' ')), 2) || ' issue'")
    return f"CASE {sym} {com} WHEN len(ws) = 0 OR len(ws) > 5 THEN {q.lit(lx.DEFAULT_TOPIC[i])} ELSE {made} END"


_TOPICS = rf"""tops AS (SELECT article_id, {_topic(0)} AS topic, {_topic(1)} AS title FROM (SELECT article_id, {q.first_phrase('original_query', lx.SYMPTOM_PHRASES)} AS s, {q.first_phrase('original_query', lx.COMPONENT_PHRASES)} AS c,
  {q.words(f"regexp_replace(title, {q.lit('(?i)' + lx.TITLE_DEVICE_PHRASE)}, '')")} AS ws FROM articles) t)"""


@query("c8_topic_and_title", with_tables("SELECT * FROM tops", "articles", extra=_TOPICS))
def c8(spark, sf):
    t = derived(spark, sf, "articles").withColumn("t", ex.topic_and_title("original_query", "title"))
    return t.select("article_id", "t.topic", "t.title")


def requests(spark, sf):
    a = derived(spark, sf, "articles")
    return a.select(F.col("article_id").alias("complaint_id"), F.col("original_query").alias("query"), "title", "content", tx.article_fingerprint("title", "content").alias("fingerprint"))


@query(
    "x8_extract_plans",
    with_tables(
        """SELECT steps.article_id AS plan_id, 'Follow these steps to perform this ' || topic || ' Troubleshooting' AS goal, tops.title AS title, CASE WHEN acts.sec = 1 THEN array_to_string([upper(left(w, 1)) || substr(w, 2) for w in string_split(action_name, ' ')], ' ') ELSE action_name END AS action_name,
  dense_rank() OVER (PARTITION BY steps.article_id ORDER BY sec) - 1 AS action_pos, description, category, step_pos, step FROM steps JOIN acts USING (article_id, sec) JOIN tops USING (article_id)""",
        "articles", extra=_A + ", " + _STEPS + ", " + _ACTIONS + ", " + _TOPICS,
    ),
)
def x8(spark, sf):
    return ex.extract_plans(requests(spark, sf)).select("plan_id", "goal", "title", "action_name", "action_pos", "description", "category", "step_pos", "step")


@query("c13_correct_model_plans")
def c13(spark, sf):
    from helpweave.checks.q_quality import plan_steps

    req = derived(spark, sf, "plans").select("plan_id").distinct().select(F.col("plan_id").alias("complaint_id"), F.lit("Screen flickers").alias("query"), F.lit("Phone help").alias("title"))
    return ex.correct_model_plans(plan_steps(spark, sf), req).select("plan_id", "action_pos", "step_pos", "title", "category", "description")


@query(
    "x11_choose_plans",
    with_tables("SELECT article_id AS plan_id, article_id % 2 = 0 AS from_model, CASE WHEN article_id % 2 = 0 THEN 1 ELSE (SELECT count(*) FROM steps s WHERE s.article_id = a.article_id) END AS n FROM a", "articles", extra=_A + ", " + _STEPS),
)
def x11(spark, sf):
    req = requests(spark, sf)
    rules = ex.extract_plans(req)
    model = req.where("complaint_id % 2 = 0").select(F.col("complaint_id").alias("plan_id"), F.lit("Open Settings.").alias("step"))
    return ex.choose_plans(model, rules).groupBy("plan_id", "from_model").agg(F.count("*").alias("n"))
