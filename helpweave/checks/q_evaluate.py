"""Grounding (J12, X6, X7, G3), scores and reports (G5-G13), probes and state checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from helpweave import lexicons as lx
from helpweave.checks import sqltext as q
from helpweave.checks.q_quality import STEPS_SQL, plan_steps
from helpweave.checks.registry import query, with_tables
from helpweave.operators import evaluate as ev, ground
from helpweave.session import table
from helpweave.sources.fixtures import derived


def _r6(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.round(c, 6))
    return df


# --- grounding ------------------------------------------------------------------------
def article_texts(spark, sf):
    return derived(spark, sf, "articles").select("article_id", F.concat("title", F.lit(". "), "content").alias("text"))


def article_steps(spark, sf):
    s = derived(spark, sf, "step_groups")
    return s.select(F.col("group_id").alias("plan_id"), F.col("group_id").alias("article_id"), (F.col("step_pos") > 2).cast("int").alias("action_pos"),
                    F.concat(F.lit("Action "), (F.col("step_pos") > 2).cast("int")).alias("action_name"), F.lit(0).alias("group_pos"), "step_pos", "step", "category")


_GROUND = rf"""sents AS (SELECT article_id, i - 1 AS sentence_pos, ss[i] AS sentence FROM (SELECT article_id, ss, unnest(range(1, len(ss) + 1)) AS i FROM (
  SELECT article_id, [trim(p) for p in string_split(regexp_replace({q.squash("title || '. ' || content")}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) if len(trim(p)) > 3] AS ss FROM articles) a) b),
st AS MATERIALIZED (SELECT article_id, sentence_pos, sentence, {q.grounding('sentence')} AS tk FROM sents),
sg AS MATERIALIZED (SELECT group_id AS plan_id, step_pos, step, {q.grounding('step')} AS tk FROM step_groups),
pairs AS (SELECT plan_id, step_pos, step, sentence_pos, sentence, len({q.common('sg.tk', 'st.tk')}) AS n, len(sg.tk) AS a, len(st.tk) AS b FROM sg JOIN st ON st.article_id = sg.plan_id),
sc AS (SELECT *, least(1.0, round(0.75 * n / a + 0.25 * n / (a + b - n), 9)) AS overlap FROM pairs WHERE n > 0),
best AS MATERIALIZED (SELECT sg.plan_id, sg.step_pos, sg.step, coalesce(max(overlap), 0) AS overlap, arg_max(sc.sentence, (overlap, -sentence_pos)) AS sentence
  FROM sg LEFT JOIN sc USING (plan_id, step_pos) GROUP BY sg.plan_id, sg.step_pos, sg.step)"""


@query("j12_ground_steps", with_tables("SELECT plan_id AS article_id, step, round(overlap, 6) AS overlap, sentence FROM best", "articles", "step_groups", extra=_GROUND))
def j12(spark, sf):
    found = ground.ground_steps(article_steps(spark, sf), article_texts(spark, sf))
    return _r6(found, "overlap").select("article_id", "step", "overlap", "sentence")


@query("x6_filter_grounded", with_tables("SELECT plan_id, step_pos, step FROM best WHERE overlap >= 0.2", "articles", "step_groups", extra=_GROUND))
def x6(spark, sf):
    return ground.filter_grounded(article_steps(spark, sf), article_texts(spark, sf))[0].select("plan_id", "step_pos", "step")


@query("g3_grounding_coverage", with_tables("SELECT plan_id, round(avg((overlap >= 0.15)::INT), 3) AS coverage FROM best GROUP BY plan_id", "articles", "step_groups", extra=_GROUND))
def g3(spark, sf):
    return ground.filter_grounded(article_steps(spark, sf), article_texts(spark, sf), lx.GROUNDING_PIPELINE_THRESHOLD)[1]


@query(
    "x7_ungrounded_fallback",
    with_tables(
        """SELECT plan_id, step FROM best WHERE overlap >= 0.6 UNION ALL SELECT plan_id, 'Review ' || title FROM (SELECT DISTINCT plan_id FROM best) p JOIN articles ON article_id = plan_id
  WHERE plan_id NOT IN (SELECT plan_id FROM best WHERE overlap >= 0.6)""",
        "articles", "step_groups", extra=_GROUND,
    ),
)
def x7(spark, sf):
    steps = article_steps(spark, sf)
    kept, _, _ = ground.filter_grounded(steps, article_texts(spark, sf), 0.6)
    backup = derived(spark, sf, "articles").select(F.col("article_id").alias("plan_id"), F.concat(F.lit("Review "), "title").alias("step"))
    return ground.with_fallback(kept.select("plan_id", "step"), steps, backup)


# --- confidence -----------------------------------------------------------------------
_CONF = "(round_even(100 * greatest(0, least(1, 0.4 * greatest(0, least(1, grounding_coverage)) + 0.3 * greatest(0, least(1, validator_pass_rate)) + 0.15 * greatest(0, least(1, retrieval_margin)) + 0.15 * path_alignment)), 0) / 100)"


def _scored(spark, sf):
    c = derived(spark, sf, "calibration")
    return c.withColumn("confidence", ev.confidence("grounding_coverage", "validator_pass_rate", "retrieval_margin", "path_alignment"))


@query("g5_confidence", with_tables(f"SELECT case_id, line, retrieval_margin, {_CONF} AS confidence FROM calibration", "calibration"))
def g5(spark, sf):
    return _scored(spark, sf).select("case_id", "line", "retrieval_margin", "confidence")


@query(
    "g7_calibration_error",
    with_tables(f"SELECT round(sum(n * abs(acc - conf)) / sum(n), 6) AS ece, sum(n) AS n FROM (SELECT least(floor(c * 10), 9) AS bin, count(*) AS n, avg(label) AS acc, avg(c) AS conf FROM (SELECT {_CONF} AS c, label FROM calibration) a GROUP BY 1) b", "calibration"),
)
def g7(spark, sf):
    return _r6(ev.calibration_error(_scored(spark, sf)), "ece")


_SCR = "(expected_id = predicted_id)"


@query(
    "g8_eval_screens",
    with_tables(
        f"""SELECT category, round(coalesce(avg(CASE WHEN expected_id IS NOT NULL THEN coalesce({_SCR}, false)::INT END), 0), 6) AS screen_accuracy,
  round(coalesce(avg(CASE WHEN expected_id IS NOT NULL THEN (NOT coalesce({_SCR}, false) AND expected_page <> predicted_page)::INT END), 0), 6) AS parent_menu_error_rate,
  round(coalesce(avg(CASE WHEN category = 'manual' THEN (predicted_id IS NULL)::INT END), 1), 6) AS manual_compliance, count(*) AS n_scenarios,
  round(avg(CASE WHEN expected_id IS NOT NULL AND category = 'auto' THEN CASE WHEN coalesce({_SCR}, false) THEN 2 WHEN expected_page <> predicted_page THEN 1 ELSE 0 END END), 6) AS relevance
FROM eval_predictions GROUP BY category""",
        "eval_predictions",
    ),
)
def g8(spark, sf):
    out = ev.eval_screens(derived(spark, sf, "eval_predictions"), ["category"])
    return _r6(out, "relevance", "screen_accuracy", "parent_menu_error_rate", "manual_compliance")


@query("g8b_failing_scenarios", with_tables(f"SELECT scenario_id FROM eval_predictions WHERE expected_id IS NOT NULL AND NOT coalesce({_SCR}, false)", "eval_predictions"))
def g8b(spark, sf):
    return ev.failing_scenarios(derived(spark, sf, "eval_predictions"))


_ASTOP = q.lst(lx.word_list(lx.ACCURACY_STOP_WORDS))
_as = lambda x: q.minus(q.plain_stems(x), _ASTOP)


def _accuracy_steps(spark, sf):
    return article_steps(spark, sf).withColumn("category", F.when((F.col("category") == "critical") & (F.col("action_pos") == 0), "critical").otherwise("auto"))


@query(
    "g9_step_accuracy",
    with_tables(
        f"""SELECT a.article_id AS plan_id, round(coalesce(list_avg([g for g in gs if g is not null]), 0), 6) AS grounding, round(CASE WHEN len(hs) = 0 THEN 1 ELSE (len({q.common('hs', 'ps')}) / len(hs) >= 0.5)::INT END::DOUBLE, 6) AS completeness,
  CASE WHEN plan_id % 5 = 4 THEN 0.0 ELSE 1.0 END AS ordering
FROM (SELECT article_id, {_as('content')} AS ar, {_as('title')} AS hs FROM articles) a
JOIN (SELECT group_id AS plan_id, list({_as('step')}) AS ss, list_distinct(flatten(list({_as("step || ' Action'")}))) AS ps FROM step_groups GROUP BY group_id) p ON p.plan_id = a.article_id,
LATERAL (SELECT [CASE WHEN len(s) > 0 THEN (len([x for x in s if list_contains(ar, x)]) / len(s) >= 0.5)::INT END for s in ss] AS gs) l""",
        "articles", "step_groups",
    ),
)
def g9(spark, sf):
    a = derived(spark, sf, "articles")
    heads = a.select("article_id", F.lit(0).alias("heading_pos"), F.col("title").alias("heading"))
    out = ev.step_accuracy(_accuracy_steps(spark, sf), a.select("article_id", F.col("content").alias("text")), heads)
    return _r6(out, "grounding", "completeness")


# --- links and state ------------------------------------------------------------------
_LINKS = "SELECT plan_id, action_pos, CASE WHEN partkey % 7 = 0 THEN 'bixby://dummy_positive' ELSE 'demo://act/' || partkey || '/page' END AS link FROM plans"


def _links(spark, sf):
    p = derived(spark, sf, "plans")
    return p.select("plan_id", "action_pos", F.when(F.col("partkey") % 7 == 0, lx.PLACEHOLDER_URI).otherwise(F.concat(F.lit("demo://act/"), "partkey", F.lit("/page"))).alias("link"))


@query("j13_link_integrity", with_tables(f"SELECT * FROM ({_LINKS}) l WHERE link NOT LIKE '%://dummy_positive' AND link NOT IN (SELECT deeplink FROM catalog)", "plans", "catalog"))
def j13(spark, sf):
    return ev.check_link_integrity(_links(spark, sf), derived(spark, sf, "catalog"))


@query("j14_link_to_entry", with_tables(f"SELECT l.*, c.id AS entry_id FROM ({_LINKS}) l LEFT JOIN catalog c ON c.deeplink = l.link", "plans", "catalog"))
def j14(spark, sf):
    return ev.link_to_entry(_links(spark, sf), derived(spark, sf, "catalog"))


_EXP = """SELECT plan_id, action_pos, plan_id % 150 AS device_id, 'key' || (partkey % 25) AS skey, CASE action_pos % 4 WHEN 0 THEN 'boolean' WHEN 1 THEN 'integer' WHEN 2 THEN 'str' ELSE 'boolean' END AS result_type,
  CASE action_pos % 3 WHEN 0 THEN 'equal' WHEN 1 THEN 'greater' ELSE 'less' END AS condition, CASE action_pos % 4 WHEN 1 THEN '5' WHEN 3 THEN 'False' ELSE 'True' END AS value FROM plans"""


@query(
    "j15_device_state",
    with_tables(
        f"""SELECT e.plan_id, e.action_pos, CASE WHEN coalesce(CASE result_type
   WHEN 'boolean' THEN CASE condition WHEN 'equal' THEN coalesce(lower(s.value) = 'true', false) = (lower(e.value) = 'true') WHEN 'greater' THEN coalesce(lower(s.value) = 'true', false)::INT > (lower(e.value) = 'true')::INT ELSE coalesce(lower(s.value) = 'true', false)::INT < (lower(e.value) = 'true')::INT END
   WHEN 'integer' THEN CASE condition WHEN 'equal' THEN try_cast(s.value AS DOUBLE) = try_cast(e.value AS DOUBLE) WHEN 'greater' THEN try_cast(s.value AS DOUBLE) > try_cast(e.value AS DOUBLE) ELSE try_cast(s.value AS DOUBLE) < try_cast(e.value AS DOUBLE) END
   ELSE CASE condition WHEN 'equal' THEN s.value = e.value WHEN 'greater' THEN s.value > e.value ELSE s.value < e.value END END, false) THEN 'skip' ELSE 'change' END AS status
FROM ({_EXP}) e LEFT JOIN device_state s ON s.device_id = e.device_id AND s.skey = e.skey""",
        "plans", "device_state",
    ),
)
def j15(spark, sf):
    p = derived(spark, sf, "plans")
    k = F.col("action_pos") % 4
    exp = p.select(
        "plan_id", "action_pos", (F.col("plan_id") % 150).alias("device_id"), F.concat(F.lit("key"), F.col("partkey") % 25).alias("skey"),
        F.when(k == 1, "integer").when(k == 2, "str").otherwise("boolean").alias("result_type"),
        F.when(F.col("action_pos") % 3 == 0, "equal").when(F.col("action_pos") % 3 == 1, "greater").otherwise("less").alias("condition"),
        F.when(k == 1, "5").when(k == 3, "False").otherwise("True").alias("value"),
    )
    return ev.check_device_state(exp, derived(spark, sf, "device_state")).select("plan_id", "action_pos", "status")


# --- probes ---------------------------------------------------------------------------
_PAIRS = "SELECT DISTINCT a.query AS query_a, b.query AS query_b FROM complaints a JOIN complaints b ON b.complaint_id = a.complaint_id + 1"
_W = 1.2876820724517808  # ln(2 / 1.5) + 1
_PROBE = f"""pairs AS MATERIALIZED ({_PAIRS}), t AS MATERIALIZED (SELECT DISTINCT query, {q.embedding('query')} AS vec, {q.lexical('query')} AS tk, {q.command('query')} AS command, {q.normalize('query')} AS nq, {q.signature('query')} FROM (SELECT DISTINCT query FROM complaints) d),
feat AS (SELECT ['camera', 'timeout', 'battery', 'wifi'] AS f),
j AS (SELECT query_a, query_b, a.tk AS ta, b.tk AS tb, round(list_cosine_similarity(a.vec, b.vec), 9) AS cosine, {q.gate_reason('a.', 'b.')} AS why, coalesce(a.command = b.command, true) AS cmd, a.nq = b.nq AS eq, f
  FROM pairs JOIN t a ON a.query = query_a JOIN t b ON b.query = query_b, feat),
w AS (SELECT *, [len([1 for y in ta if y = x]) * {_W} for x in list_distinct(ta)] AS wa, [len([1 for y in tb if y = x]) * CASE WHEN list_contains(ta, x) THEN {_W} ELSE 1 END for x in list_distinct(tb)] AS wb,
  [len([1 for y in ta if y = x]) * len([1 for y in tb if y = x]) * {_W} * {_W} for x in list_distinct(ta) if list_contains(tb, x)] AS ab FROM j),
s AS (SELECT *, round(0.5 * cosine + 0.5 * coalesce(list_sum(ab) / (sqrt(list_sum([z * z for z in wa])) * sqrt(list_sum([z * z for z in wb]))), 0), 9) AS blended,
  [x for x in f if list_contains(ta, x)] AS fa, [x for x in f if list_contains(tb, x)] AS fb FROM w),
probe AS (SELECT query_a, query_b, cosine, blended, eq OR cosine >= 0.85 AS hit_cosine, why IS NULL AND (eq OR cosine >= 0.82) AS hit_gated,
  blended >= 0.6 AND cmd AND coalesce(why, 'polarity') = 'polarity' AND NOT (len({q.minus('fa', 'fb')}) > 0 AND len({q.minus('fb', 'fa')}) > 0) AS hit_variant FROM s)"""


@query("j16_probe_pairs", with_tables("SELECT query_a, query_b, round(cosine, 6) AS cosine, round(blended, 6) AS blended, hit_cosine, hit_gated, hit_variant FROM probe", "complaints", extra=_PROBE))
def j16(spark, sf):
    c = derived(spark, sf, "complaints")
    nxt = c.select((F.col("complaint_id") - 1).alias("complaint_id"), F.col("query").alias("query_b"))
    pairs = c.select("complaint_id", F.col("query").alias("query_a")).join(nxt, "complaint_id").groupBy("query_a", "query_b").agg(F.min("complaint_id").alias("pair_id"))
    vocab = table(spark, sf, "region").select(F.explode(F.array(*[F.lit(w) for w in ("camera", "timeout", "battery", "wifi")])).alias("term")).distinct()
    return _r6(ev.probe_pairs(pairs, vocab).drop("pair_id"), "cosine", "blended")


@query(
    "j17_probe_paraphrases",
    with_tables("SELECT a.o_custkey AS scenario_id, a.o_orderkey AS paraphrase_id, a.o_orderkey % 4 <> 0 AS hit, a.o_orderkey % 4 <> 0 AND a.o_orderpriority = s.p AS right FROM orders a JOIN (SELECT o_custkey, min(o_orderpriority) AS p FROM orders GROUP BY o_custkey) s USING (o_custkey)"),
)
def j17(spark, sf):
    o = table(spark, sf, "orders")
    plan = F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority"))
    answers = o.select(F.col("o_custkey").alias("scenario_id"), F.col("o_orderkey").alias("paraphrase_id"), plan.alias("plan_id"))
    scenarios = o.groupBy(F.col("o_custkey").alias("scenario_id")).agg(F.min("o_orderpriority").alias("plan_id"))
    return ev.probe_paraphrases(answers, scenarios)


# --- reports --------------------------------------------------------------------------
@query(
    "g10_compliance_report",
    with_tables(
        rf"""SELECT (SELECT count(*) FROM pl) AS rows, (SELECT sum(regexp_matches(goal, '^Follow these steps to perform this .+ (Troubleshooting|Configuration)\.?$')::INT + (len(string_split(title, ' ')) BETWEEN 2 AND 3)::INT + (score BETWEEN 0 AND 1)::INT) FROM pl)
   + (SELECT sum((description LIKE 'It will%' AND len(string_split(description, ' ')) BETWEEN 5 AND 7)::INT) FROM ac) AS rules_ok,
  (SELECT 3 * count(*) FROM pl) + (SELECT count(*) FROM ac) AS rules_total, (SELECT count(DISTINCT plan_id) FROM steps WHERE step LIKE '%www%' OR description LIKE '%www%' OR check_link LIKE 'http%' OR (action_pos + step_pos) % 9 = 4) AS leaks,
  (SELECT count(*) FROM pl) AS schema,
  (SELECT sum(linked::INT) FROM ac) AS links, (SELECT sum((linked AND lk IN (SELECT deeplink FROM catalog))::INT) FROM ac) AS links_ok,
  (SELECT sum((category = 'auto')::INT) FROM ac) AS auto, (SELECT sum((category = 'auto' AND linked)::INT) FROM ac) AS auto_linked,
  (SELECT sum((n BETWEEN 8 AND 10)::INT) FROM (SELECT plan_id, count(DISTINCT step_pos * 10 + action_pos) AS n FROM steps GROUP BY plan_id) v) AS variations_ok""",
        "plans", "catalog",
        extra=STEPS_SQL + """, pl AS (SELECT DISTINCT plan_id, goal, title, score FROM steps),
ac AS (SELECT plan_id, action_pos, any_value(description) AS description, any_value(category) AS category, bool_or(link IS NOT NULL) AS linked, max(link) AS lk FROM steps GROUP BY plan_id, action_pos)""",
    ),
)
def g10(spark, sf):
    s = plan_steps(spark, sf)
    told = F.when((F.col("action_pos") + F.col("step_pos")) % 9 == 4, " see www.example.com").otherwise("")
    v = s.select("plan_id", F.concat((F.col("step_pos") * 10 + F.col("action_pos")).cast("string"), told).alias("text"))
    return ev.compliance_report(s, derived(spark, sf, "catalog"), v)


_RANK = "greatest(1, least(n, round_even({p} / 100.0 * n + 0.5, 0)::BIGINT))"


@query(
    "g11_latency_percentiles",
    f"""SELECT event_type, min(CASE WHEN rn >= {_RANK.format(p=50)} THEN value END) AS p50, min(CASE WHEN rn >= {_RANK.format(p=95)} THEN value END) AS p95, any_value(n) AS n
FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events) t GROUP BY event_type""",
)
def g11(spark, sf):
    return ev.latency_report(table(spark, sf, "events"), "value", by=["event_type"])


@query(
    "g12_hit_report",
    "SELECT event_type AS path, round(avg((event_id % 3 <> 0)::INT), 6) AS hit_rate, round(avg(CASE WHEN event_id % 3 <> 0 THEN (event_id % 5 <> 0)::INT END), 6) AS right_rate, round(avg(value / 1000), 6) AS mean_cost, count(*) AS n FROM events GROUP BY event_type",
)
def g12(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("path"), (F.col("event_id") % 3 != 0).alias("hit"), (F.col("event_id") % 5 != 0).alias("right"), (F.col("value") / 1000).alias("cost_usd"))
    return _r6(ev.hit_report(e, ["path"]), "hit_rate", "right_rate", "mean_cost")


@query(
    "g13_mapping_ablation",
    f"""SELECT variant, round(avg(correct::INT), 6) AS accuracy, round(avg(cost), 6) AS mean_cost, min(CASE WHEN rn >= {_RANK.format(p=95)} THEN ms END) AS p95, any_value(n) AS n FROM (
 SELECT *, row_number() OVER (PARTITION BY variant ORDER BY ms) AS rn, count(*) OVER (PARTITION BY variant) AS n FROM (
  SELECT 'hybrid' AS variant, o_custkey % 9 <> 0 AS correct, o_totalprice AS ms, 0.0 AS cost FROM orders UNION ALL SELECT 'terms', o_custkey % 2 = 0, o_totalprice / 2, o_totalprice / 1000000 FROM orders) a) b GROUP BY variant""",
)
def g13(spark, sf):
    o = table(spark, sf, "orders")
    hybrid = o.select(F.col("o_orderkey").alias("scenario_id"), (F.col("o_custkey") % 9 != 0).alias("correct"), F.col("o_totalprice").alias("ms"), F.lit(0.0).alias("cost_usd"))
    terms = o.select(F.col("o_orderkey").alias("scenario_id"), (F.col("o_custkey") % 2 == 0).alias("correct"), (F.col("o_totalprice") / 2).alias("ms"), (F.col("o_totalprice") / 1e6).alias("cost_usd"))
    return _r6(ev.ablation({"hybrid": hybrid, "terms": terms}), "accuracy", "mean_cost")


@query(
    "b24_price_calls",
    """SELECT model, round(sum((q * i + p * o) / 1e6), 6) AS cost, count(*) AS n FROM (SELECT CASE l_returnflag WHEN 'A' THEN 'gemini-2.5-flash' WHEN 'N' THEN 'mistral-small-latest' ELSE 'other' END AS model,
  CASE l_returnflag WHEN 'A' THEN 0.30 WHEN 'N' THEN 0.10 ELSE 0 END AS i, CASE l_returnflag WHEN 'A' THEN 2.50 WHEN 'N' THEN 0.30 ELSE 0 END AS o, l_quantity * 100 AS q, l_quantity AS p FROM lineitem) t GROUP BY model""",
)
def b24(spark, sf):
    li = table(spark, sf, "lineitem")
    model = F.when(F.col("l_returnflag") == "A", "gemini-2.5-flash").when(F.col("l_returnflag") == "N", "mistral-small-latest").otherwise("other")
    calls = li.select(model.alias("model"), (F.col("l_quantity") * 100).alias("input_tokens"), F.col("l_quantity").alias("output_tokens"))
    return _r6(ev.price_calls(calls).groupBy("model").agg(F.sum("cost_usd").alias("cost"), F.count("*").alias("n")), "cost")


@query("x12_union_scenarios", "SELECT o_orderkey AS scenario_id, false AS unseen FROM orders UNION ALL SELECT c_custkey, true FROM customer")
def x12(spark, sf):
    return ev.union_scenarios(table(spark, sf, "orders").select(F.col("o_orderkey").alias("scenario_id")), table(spark, sf, "customer").select(F.col("c_custkey").alias("scenario_id")))


@query("c12_fallback_label", with_tables("SELECT case_id, line, CASE WHEN line = 7 THEN 'no_siis_context' WHEN line = 6 THEN 'no_match' WHEN grounding_coverage < 0.25 THEN 'low_confidence' END AS fallback FROM (SELECT DISTINCT case_id, line, grounding_coverage FROM calibration) c", "calibration"))
def c12(spark, sf):
    c = derived(spark, sf, "calibration").select("case_id", "line", "grounding_coverage").distinct()
    label = ev.fallback_label(F.col("line") != 7, F.when(F.col("line") == 6, 0).otherwise(F.col("line")), F.col("grounding_coverage"))
    return c.select("case_id", "line", label.alias("fallback"))
