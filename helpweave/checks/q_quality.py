"""Plan layout (A9), rules and repair (V), ordering (W7-W9), pass rate."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helpweave import lexicons as lx
from helpweave.checks import sqltext as q
from helpweave.checks.registry import query, with_tables
from helpweave.operators import layout, quality as ql
from helpweave.sources.fixtures import derived

STEPS_SQL = """steps AS MATERIALIZED (SELECT plan_id, goal, title, min(score) OVER (PARTITION BY plan_id) AS score, action_pos - 1 AS action_pos, action_name, description, category,
  0 AS group_pos, s AS step_pos, CASE (action_pos + s) % 4 WHEN 0 THEN 'Open Settings.' WHEN 1 THEN 'See www.example.com first.' WHEN 2 THEN 'Your phone restarts.' ELSE 'Tap Display' END AS step,
  CASE WHEN partkey % 2 = 0 THEN 'demo://act/' || partkey END AS link, CASE WHEN partkey % 50 = 0 THEN 'http://x.example.com/' || partkey END AS check_link
FROM plans CROSS JOIN (SELECT unnest([0, 1]) AS s) k)"""


def plan_steps(spark, sf):
    # two steps of each line; rows come sorted by plan, so the least score needs no second reading
    low = F.min("score").over(Window.partitionBy("plan_id"))
    p = derived(spark, sf, "plans").withColumn("score", low).withColumn("step_pos", F.explode(F.array(F.lit(0), F.lit(1))))
    k = (F.col("action_pos") + F.col("step_pos")) % 4
    step = F.when(k == 0, "Open Settings.").when(k == 1, "See www.example.com first.").when(k == 2, "Your phone restarts.").otherwise("Tap Display")
    return p.select(
        "plan_id", "goal", "title", "score", (F.col("action_pos") - 1).alias("action_pos"), "action_name", "description", "category",
        F.lit(0).alias("group_pos"), "step_pos", step.alias("step"),
        F.when(F.col("partkey") % 2 == 0, F.concat(F.lit("demo://act/"), "partkey")).alias("link"),
        F.when(F.col("partkey") % 50 == 0, F.concat(F.lit("http://x.example.com/"), "partkey")).alias("check_link"),
    )


# --- SQL predicates -------------------------------------------------------------------
_up = lambda w: f"(upper(left({w}, 1)) = left({w}, 1) AND lower(left({w}, 1)) <> left({w}, 1))"
_cl = lambda w: rf"regexp_replace({w}, '[^a-zA-Z0-9_]', '', 'g')"
_ABBR, _MINOR = q.lst(lx.word_list(lx.ABBREVIATIONS)), q.lst(lx.word_list(lx.MINOR_WORDS))
_VERBS = q.lst(lx.word_list(lx.RULE_VERBS))
GOAL = rf"regexp_matches(trim(goal), {q.lit('(?i)' + lx.GOAL_PATTERN)})"


def title_sql(x):
    ws = q.words(x)
    return f"(len({ws}) IN (2, 3) AND {_up(f'({ws})[1]')} AND len([w for w in ({ws})[2:] if NOT list_contains({_ABBR}, lower({_cl('w')})) AND {_up(_cl('w'))}]) = 0)"


def name_sql(x):
    return f"(len({q.words(x)}) > 0 AND len([1 for w, i in [{_cl('y')} for y in {q.words(x)}] if w <> '' AND (i = 1 OR NOT list_contains({_MINOR}, lower(w))) AND regexp_matches(w, '^[A-Za-z]') AND NOT {_up('w')}]) = 0)"


def case_title(x):
    return f"array_to_string([CASE WHEN i = 1 OR NOT list_contains({_MINOR}, lower(w)) THEN upper(left(w, 1)) || lower(substr(w, 2)) ELSE lower(w) END for w, i in {q.words(x)}], ' ')"


def _by_value(name: str, column: str, expr: str, fn):
    """Register a rule over the distinct values of one plan column, with its row count."""
    def run(spark, sf):
        return derived(spark, sf, "plans").groupBy(column).agg(F.count("*").alias("n")).withColumn("ok", fn(column))

    query(name, with_tables(f"SELECT {column}, count(*) AS n, {expr} AS ok FROM plans GROUP BY {column}", "plans"))(run)


_by_value("v1_goal_syntax", "goal", GOAL, ql.goal_ok)
_by_value("v2_title_format", "title", title_sql("title"), ql.title_ok)
_by_value("v3_action_name", "action_name", name_sql("action_name"), ql.name_ok)
_by_value("v4_description", "description", "description LIKE 'It will%'", ql.description_ok)


@query(
    "v5_step_format",
    with_tables(f"SELECT step, count(*) AS n, {q.contains_urls('step')} AS leak, list_contains({_VERBS}, lower({_cl(f'({q.words(chr(115)+chr(116)+chr(101)+chr(112))})[1]')})) AS verb FROM steps GROUP BY step", "plans", extra=STEPS_SQL),
)
def v5(spark, sf):
    from helpweave.functions.text import contains_urls

    return plan_steps(spark, sf).groupBy("step").agg(F.count("*").alias("n")).withColumns({"leak": contains_urls("step"), "verb": ql.step_verb_known("step")})


@query("v6_manual_link", with_tables("SELECT plan_id, action_pos FROM steps WHERE category = 'manual' AND link IS NOT NULL GROUP BY plan_id, action_pos", "plans", extra=STEPS_SQL))
def v6(spark, sf):
    return ql.action_level(plan_steps(spark, sf)).where("category = 'manual' AND linked").select("plan_id", "action_pos")


@query("v7_score_range", with_tables("SELECT score BETWEEN 0 AND 1 AS ok, count(*) AS n FROM plans GROUP BY 1", "plans"))
def v7(spark, sf):
    return derived(spark, sf, "plans").groupBy(ql.score_ok("score").alias("ok")).agg(F.count("*").alias("n"))


_REPORT = f"""plan AS (SELECT DISTINCT plan_id, goal, title, score FROM steps),
act AS (SELECT plan_id, action_pos, any_value(action_name) AS action_name, any_value(description) AS description, any_value(category) AS category, bool_or(link IS NOT NULL) AS linked FROM steps GROUP BY plan_id, action_pos),
ord AS (SELECT plan_id, min(action_pos) AS action_pos FROM (SELECT *, max((category = 'critical')::INT) OVER (PARTITION BY plan_id ORDER BY action_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM act) t WHERE seen = 1 AND category <> 'critical' GROUP BY plan_id),
report AS MATERIALIZED (
 SELECT plan_id, 'goal_syntax' AS rule, 'error' AS severity, NULL::INT AS action_pos, NULL::INT AS step_pos FROM plan WHERE NOT {GOAL}
 UNION ALL SELECT plan_id, 'title_format', 'error', NULL, NULL FROM plan WHERE NOT {title_sql('title')}
 UNION ALL SELECT plan_id, 'score_range', 'error', NULL, NULL FROM plan WHERE NOT score BETWEEN 0 AND 1
 UNION ALL SELECT plan_id, 'action_name_format', 'error', action_pos, NULL FROM act WHERE NOT {name_sql('action_name')}
 UNION ALL SELECT plan_id, 'description_format', 'error', action_pos, NULL FROM act WHERE description NOT LIKE 'It will%'
 UNION ALL SELECT plan_id, 'description_length', 'warning', action_pos, NULL FROM act WHERE description LIKE 'It will%' AND len({q.words('description')}) NOT BETWEEN 4 AND 20
 UNION ALL SELECT plan_id, 'manual_link', 'error', action_pos, NULL FROM act WHERE category = 'manual' AND linked
 UNION ALL SELECT plan_id, 'name_url', 'error', action_pos, NULL FROM act WHERE {q.contains_urls('action_name')}
 UNION ALL SELECT plan_id, 'description_url', 'error', action_pos, NULL FROM act WHERE {q.contains_urls('description')}
 UNION ALL SELECT plan_id, 'action_ordering', 'error', action_pos, NULL FROM ord
 UNION ALL SELECT plan_id, 'step_url', 'error', action_pos, step_pos FROM steps WHERE {q.contains_urls('step')}
 UNION ALL SELECT plan_id, 'step_verb', 'warning', action_pos, step_pos FROM steps WHERE NOT {q.contains_urls('step')} AND NOT list_contains({_VERBS}, lower({_cl(f'({q.words(chr(115)+chr(116)+chr(101)+chr(112))})[1]')}))
 UNION ALL SELECT plan_id, 'check_link_url', 'error', action_pos, NULL FROM (SELECT DISTINCT plan_id, action_pos, group_pos FROM steps WHERE check_link IS NOT NULL) c)"""


@query("v8_url_leaks", with_tables("SELECT rule, count(*) AS n FROM report WHERE rule LIKE '%url' GROUP BY rule", "plans", extra=STEPS_SQL + ", " + _REPORT))
def v8(spark, sf):
    return ql.validate_plans(plan_steps(spark, sf)).where("rule LIKE '%url'").groupBy("rule").agg(F.count("*").alias("n"))


@query("v9_validation_report", with_tables("SELECT * FROM report", "plans", extra=STEPS_SQL + ", " + _REPORT))
def v9(spark, sf):
    return ql.validate_plans(plan_steps(spark, sf))


@query(
    "g6_pass_rate",
    with_tables("SELECT plan_id, count(CASE WHEN severity = 'error' THEN 1 END) AS errors, round(greatest(0, 1 - 0.15 * count(CASE WHEN severity = 'error' THEN 1 END)), 6) AS pass_rate FROM (SELECT DISTINCT plan_id FROM steps) p LEFT JOIN report USING (plan_id) GROUP BY plan_id", "plans", extra=STEPS_SQL + ", " + _REPORT),
)
def g6(spark, sf):
    return ql.plan_validity(plan_steps(spark, sf)).select("plan_id", "errors", F.round("pass_rate", 6).alias("pass_rate"))


_FIXED_DESC = "CASE description WHEN 'this will help' THEN 'It will help for this issue' WHEN 'see www.example.com for help' THEN 'It will see for help' ELSE description END"
_FIXED_TITLE = "CASE title WHEN 'Screen Display Flicker Issue' THEN 'Screen display flicker' WHEN 'flicker' THEN 'Flicker issue' ELSE title END"
_FIXED = f"""fixed AS MATERIALIZED (SELECT plan_id, dense_rank() OVER (PARTITION BY plan_id ORDER BY (category = 'critical')::INT, action_pos) - 1 AS action_pos, step_pos,
  CASE WHEN {GOAL} THEN goal ELSE 'Follow these steps to perform this Screen Troubleshooting' END AS goal, {_FIXED_TITLE} AS title, round(greatest(0, least(1, score)), 6) AS score,
  CASE WHEN {name_sql('action_name')} THEN action_name ELSE {case_title('action_name')} END AS action_name, {_FIXED_DESC} AS description, category,
  {q.scrub('step')} AS step, CASE WHEN category <> 'manual' THEN link END AS link, CASE WHEN category <> 'manual' THEN check_link END AS check_link FROM steps)"""
_FIXED_COLS = ["plan_id", "action_pos", "step_pos", "goal", "title", "score", "action_name", "description", "category", "step", "link", "check_link"]


@query("v10_repair_plans", with_tables("SELECT * FROM fixed", "plans", extra=STEPS_SQL + ", " + _FIXED))
def v10(spark, sf):
    return ql.repair_plans(plan_steps(spark, sf)).withColumn("score", F.round("score", 6)).select(*_FIXED_COLS)


@query(
    "v11_scrub_plans",
    with_tables(f"SELECT plan_id, action_pos, step_pos, {q.scrub('description')} AS description, {q.scrub('step')} AS step FROM steps", "plans", extra=STEPS_SQL),
)
def v11(spark, sf):
    return ql.scrub_plans(plan_steps(spark, sf)).select("plan_id", "action_pos", "step_pos", "description", "step")


@query("v12_repair_then_keep", with_tables("SELECT plan_id, bool_or(check_link IS NOT NULL) AS rejected FROM fixed GROUP BY plan_id", "plans", extra=STEPS_SQL + ", " + _FIXED))
def v12(spark, sf):
    kept, rejected = ql.repair_then_split(plan_steps(spark, sf))
    return kept.select("plan_id", F.lit(False).alias("rejected")).distinct().unionByName(rejected.select("plan_id", F.lit(True).alias("rejected")).distinct())


@query("v13_reset_links", with_tables("SELECT count(*) AS n, 0 AS linked FROM steps", "plans", extra=STEPS_SQL))
def v13(spark, sf):
    return ql.reset_links(plan_steps(spark, sf)).agg(F.count("*").alias("n"), F.count("link").alias("linked"))


@query(
    "w7_order_actions",
    with_tables("SELECT plan_id, action_name, category, row_number() OVER (PARTITION BY plan_id ORDER BY CASE category WHEN 'auto' THEN 0 WHEN 'critical' THEN 2 ELSE 1 END, action_pos) - 1 AS action_pos FROM plans", "plans"),
)
def w7(spark, sf):
    return ql.order_actions(derived(spark, sf, "plans")).select("plan_id", "action_name", "category", "action_pos")


@query(
    "w8_critical_last",
    with_tables("SELECT plan_id, action_pos AS old_pos, row_number() OVER (PARTITION BY plan_id ORDER BY (category = 'critical')::INT, action_pos) - 1 AS action_pos FROM plans", "plans"),
)
def w8(spark, sf):
    return ql.critical_last(derived(spark, sf, "plans"), keep="old_pos").select("plan_id", "old_pos", "action_pos")


@query(
    "w9_ordering_violations",
    with_tables("SELECT plan_id, action_pos FROM (SELECT *, max((category = 'critical')::INT) OVER (PARTITION BY plan_id ORDER BY action_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM plans) t WHERE seen = 1 AND category <> 'critical'", "plans"),
)
def w9(spark, sf):
    return ql.ordering_broken(derived(spark, sf, "plans")).where("misplaced").select("plan_id", "action_pos")


_BACK = ["plan_id", "goal", "title", "action_pos", "action_name", "description", "category", "group_pos", "step_pos", "step", "link", "check_link"]


@query("a9_layout_round_trip", with_tables(f"SELECT {', '.join('dense_rank() OVER (PARTITION BY plan_id ORDER BY action_pos) - 1 AS action_pos' if c == 'action_pos' else c for c in _BACK)} FROM steps", "plans", extra=STEPS_SQL))
def a9(spark, sf):
    back = layout.flatten_plans(layout.assemble_plans(plan_steps(spark, sf)))
    return back.withColumns({"link": F.col("link_struct.deeplink"), "check_link": F.col("check_struct.deeplink")}).select(*_BACK)
