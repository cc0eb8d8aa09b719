"""Sources, paraphrases, contract, tiered answering and streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from helpweave import lexicons as lx, schemas
from helpweave.checks import sqltext as q
from helpweave.checks.q_match import BASE, nearest, probes, store
from helpweave.checks.registry import query, with_tables
from helpweave.functions import paraphrase as pp, sqlfunctions, text as tx
from helpweave.plans.answer import Knowledge, answer
from helpweave.session import checkpoint_dir, table
from helpweave.sources import readers as rd, store as st
from helpweave.sources.fixtures import derived
from helpweave.sources.planlog import PlanLog
from helpweave.streaming import jobs


def scratch(spark, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


# --- sources --------------------------------------------------------------------------
@query("a1_read_complaints", "SELECT line AS query, count(*) AS n FROM (SELECT trim(unnest(string_split(text, chr(10)))) AS line FROM conversations WHERE role = 'user') t WHERE line <> '' GROUP BY line")
def a1(spark, sf):
    folder = scratch(spark, "lines")
    table(spark, sf, "conversations").where("role = 'user'").select(F.col("text").alias("value")).write.text(folder)
    return rd.read_complaints(spark, folder).groupBy("query").agg(F.count("*").alias("n"))


_REQ = """CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '   ' WHEN 2 THEN 'Plain ' || p_name WHEN 3 THEN '{"title":"' || p_name || '","content":"text"}' ELSE '{"siis_response":{"content":"' || p_name || '"}}' END"""


@query(
    "a5_normalize_requests",
    "SELECT p_partkey, CASE p_partkey % 5 WHEN 2 THEN '' WHEN 3 THEN p_name WHEN 4 THEN '' END AS title, CASE p_partkey % 5 WHEN 2 THEN 'Plain ' || p_name WHEN 3 THEN 'text' WHEN 4 THEN p_name END AS content FROM part",
)
def a5(spark, sf):
    raw = table(spark, sf, "part").select("p_partkey", F.expr(_REQ).alias("siis_response"))
    return rd.normalize_requests(raw).select("p_partkey", "title", "content")


@query(
    "a6_align_by_row",
    "SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS row_id, c_custkey || ' ' || c_name AS line, 'S' || c_custkey AS other FROM customer",
)
def a6(spark, sf):
    """Two line files read back in file order, written in different numbers of files."""
    c = table(spark, sf, "customer")
    lines, others = scratch(spark, "lines"), scratch(spark, "others")
    for text, parts, path in ((F.concat_ws(" ", "c_custkey", "c_name"), 7, lines), (F.concat(F.lit("S"), "c_custkey"), 3, others)):
        c.select("c_custkey", text.alias("value")).repartitionByRange(parts, "c_custkey").sortWithinPartitions("c_custkey").select("value").write.text(path)
    left = rd.with_row_id(spark.read.text(lines)).withColumnRenamed("value", "line")
    return rd.align_by_row(left, rd.with_row_id(spark.read.text(others)).withColumnRenamed("value", "other"))


_RAW = """CASE p_partkey % 4 WHEN 0 THEN 'Sure! ```json' || chr(10) || '{"topic":"' || p_name || ' troubleshooting","title":"","actions":[{"name":"Check","desc":"","cat":"AUTO","steps":["Open Settings."," "]},{"name":"Empty","steps":[]},{"name":"","desc":"It will help","cat":"odd","steps":["Tap Display."]}],"variations":["a","b"]}' || chr(10) || '```'
 WHEN 1 THEN 'Here: {"goal":"G ' || p_name || '","title":"T","score":0.5,"actions":[{"actionName":"N","description":"D","category":"critical","stepGroups":[{"steps":["One.","Two."]}]}]} done'
 WHEN 2 THEN 'no json at all' ELSE '{"topic": "x", "actions": [' END"""


@query(
    "a7_ingest_model_outputs",
    """SELECT p_partkey AS plan_id, 'Follow these steps to perform this ' || p_name || ' Troubleshooting' AS goal, p_name || ' issue' AS title, 0 AS action_pos, 'Check' AS action_name, 'It will help resolve this issue' AS description, 'auto' AS category, 'Open Settings.' AS step FROM part WHERE p_partkey % 4 = 0
 UNION ALL SELECT p_partkey, 'Follow these steps to perform this ' || p_name || ' Troubleshooting', p_name || ' issue', 1, 'Follow These Steps', 'It will help', 'manual', 'Tap Display.' FROM part WHERE p_partkey % 4 = 0
 UNION ALL SELECT p_partkey, 'G ' || p_name, 'T', 0, 'N', 'D', 'critical', unnest(['One.', 'Two.']) FROM part WHERE p_partkey % 4 = 1""",
)
def a7(spark, sf):
    raw = table(spark, sf, "part").select(F.col("p_partkey").alias("plan_id"), F.expr(_RAW.replace("||", "||")).alias("raw"))
    steps, _, _ = rd.ingest_model_outputs(raw)
    return steps.select("plan_id", "goal", "title", "action_pos", "action_name", "description", "category", "step")


@query("a7b_rejected_outputs", "SELECT p_partkey AS plan_id FROM part WHERE p_partkey % 4 > 1")
def a7b(spark, sf):
    raw = table(spark, sf, "part").select(F.col("p_partkey").alias("plan_id"), F.expr(_RAW).alias("raw"))
    return rd.ingest_model_outputs(raw)[2].select("plan_id")


_JSON = """CASE p_partkey % 6 WHEN 0 THEN '{"contexts":[{"goal":"g","title":"t","score":0.5,"actions":[{"actionName":"a","description":"d","stepGroups":[{"steps":["s"]}],"category":"auto"}]}]}'
 WHEN 1 THEN '{"contexts":[{"title":"t","score":0.5,"actions":[]}]}' WHEN 2 THEN '{"contexts":[{"goal":"g","title":"t","score":0.5,"actions":[{"actionName":"a","description":"d","stepGroups":[],"category":"wrong"}]}]}'
 WHEN 3 THEN '{}' WHEN 4 THEN '{"contexts":[{"goal":"g","title":"t","score":"high","actions":[]}]}' ELSE '{"contexts":[{"goal":"g","title":"t","score":1,"actions":[{"actionName":"a","description":"d","stepGroups":[{"steps":["s"],"validationDeeplink":{"deeplink":"x","key":"k","condition":"odd"}}]}]}]}' END"""


@query("v14_contract_check", "SELECT p_partkey, p_partkey % 6 IN (0, 3) AS valid FROM part")
def v14(spark, sf):
    return rd.check_contract(table(spark, sf, "part").select("p_partkey", F.expr(_JSON).alias("raw")), "p_partkey", "raw")


# --- paraphrases ----------------------------------------------------------------------
@query("b22_expand_variants")
def b22(spark, sf):
    c = derived(spark, sf, "complaints").select("query").distinct()
    return pp.variant_rows(c.withColumn("v", pp.expand_variants("query", F.lit("Blank Screen"))), "query", "v")


_SUP = "[p_name, upper(p_name), 'see http://x.y', ' padded ', p_type, p_brand, p_type || ' a', p_type || ' b', p_type || ' c', p_type || ' d', p_type || ' e', p_type || ' f']"


@query(
    "b23_merge_variants",
    f"""SELECT p_partkey, i - 1 AS pos, m[i] AS text FROM (SELECT p_partkey, m, unnest(range(1, len(m) + 1)) AS i FROM (SELECT p_partkey, k[1:10] AS m FROM (
 SELECT p_partkey, [t for t, i in ts if list_position([lower(x) for x in ts], lower(t)) = i AND lower(t) <> lower(p_type || ' c')] AS k FROM (
 SELECT p_partkey, p_type, [trim(t) for t in {_SUP} if NOT contains(lower(t), 'http')] AS ts FROM part) a) b) c) d""",
)
def b23(spark, sf):
    t = F.col("p_type")
    sup = F.array("p_name", F.upper("p_name"), F.lit("see http://x.y"), F.lit(" padded "), t)
    gen = F.array("p_brand", *[F.concat(t, F.lit(" " + x)) for x in "abcdef"])
    p = table(spark, sf, "part").withColumn("v", pp.merge_variants(sup, gen, F.concat(t, F.lit(" c"))))
    return pp.variant_rows(p, "p_partkey", "v")


# --- SQL functions --------------------------------------------------------------------
@query("u3_sql_functions", with_tables(f"SELECT complaint_id, {q.normalize('query')} AS nq, {q.contains_urls('query')} AS leak, {q.polarity('query')} AS polarity FROM complaints", "complaints"))
def u3(spark, sf):
    sqlfunctions.register(spark)
    return spark.sql("SELECT complaint_id, normalize_query(query) AS nq, contains_urls(query) AS leak, signature(query).polarity AS polarity FROM {c}", c=derived(spark, sf, "complaints"))


# --- answering ------------------------------------------------------------------------
def knowledge(spark, sf) -> Knowledge:
    c = derived(spark, sf, "complaints")
    arts = derived(spark, sf, "articles")
    n = arts.count()
    s = store(spark, sf)
    fp = arts.select("article_id", tx.article_fingerprint("title", "content").alias("fingerprint"))
    stored = c.withColumn("article_id", F.col("user_id") % n).join(fp, "article_id").groupBy("fingerprint", "query").agg(F.min("complaint_id").alias("seq"))
    variants = s.select(F.col("seq").alias("plan_id"), (F.col("seq") * 2).alias("seq"), F.col("query").alias("text")).unionByName(
        s.select(F.col("seq").alias("plan_id"), (F.col("seq") * 2 + 1).alias("seq"), F.concat(F.lit("My "), F.lower("query")).alias("text")))
    return Knowledge(s, stored, variants, arts, derived(spark, sf, "catalog"))


def open_complaints(spark, sf):
    """Complaints with, for every third one, the article of their user; and label complaints."""
    arts = derived(spark, sf, "articles")
    n = arts.count()
    # some ask for two things at once, so that clauses have to be matched one by one
    both = F.when(F.col("complaint_id") % 3 == 1, F.concat("query", F.lit("; Battery draining fast"))).otherwise(F.col("query"))
    p = probes(spark, sf).withColumn("query", both).select("complaint_id", "query", F.when(F.col("complaint_id") % 3 == 0, F.col("user_id") % n).alias("article_id"))
    own = arts.select((F.col("article_id") + 100_000_000).alias("complaint_id"), F.concat(F.lit("Trouble with "), F.regexp_replace("original_query", " does not work", "")).alias("query"), F.lit(None).cast("long").alias("article_id"))
    return p.unionByName(own).join(arts.select("article_id", "title", "content"), "article_id", "left").drop("article_id")


@query("x9_answer")
def x9(spark, sf):
    answers, _ = answer(open_complaints(spark, sf), knowledge(spark, sf))
    return answers


# --- streaming ------------------------------------------------------------------------
def event_stream(spark, sf):
    """The events table as a stream of complaints."""
    src = spark.readStream.schema(schemas.EVENTS).parquet(f"{sf}/events*.parquet")
    e = F.col("event_id")
    base = F.element_at(tx.array_of(["Screen flickers", "My display goes black after the update", "Battery draining fast", "Battery not charging",
                                     "How do I turn on Dark mode", "How do I turn off Dark mode", "Phone is lagging", "Speaker crackling during a call"]), (e % 8 + 1).cast("int"))
    more = F.element_at(tx.array_of(["very slow", "battery dies fast", "wifi stopped working", "camera is blurry"]), (F.col("user_id") % 4 + 1).cast("int"))
    tail = F.when(F.col("event_type") == "error", " !!").when(F.col("event_type") == "view", F.concat(F.lit(" on my S"), F.col("user_id") % 25)).otherwise("")
    text = F.concat(base, F.when(e % 3 == 0, "").otherwise(F.concat(F.when(e % 3 == 1, " and ").otherwise("; "), more)), tail)
    return src.select(e.alias("complaint_id"), "ts", "user_id", "event_type", "value", text.alias("query"))


@query(
    "t1_stream_answers",
    with_tables(
        f"""SELECT complaint_id, coalesce(e.seq, n.seq) AS seq, CASE WHEN e.seq IS NOT NULL THEN 'exact' WHEN n.seq IS NOT NULL THEN 'semantic' END AS hit_type FROM complaints JOIN sig a USING (query)
  LEFT JOIN (SELECT a.query, s.seq FROM sig a JOIN store s ON s.normalized = a.normalized WHERE {q.gate_reason('a.', 's.')} IS NULL) e USING (query)
  LEFT JOIN ({nearest(True, lx.GATED_MIN)}) n USING (query)""",
        "complaints", extra=BASE,
    ),
)
def t1(spark, sf):
    out = scratch(spark, "answers")
    jobs.run_available(event_stream(spark, sf), "append", jobs.stream_answers(store(spark, sf), out), scratch(spark, "cp"))
    return spark.read.parquet(f"{out}/batch=*").select("complaint_id", "seq", "hit_type")


@query("t2_stream_write_back", with_tables(f"SELECT sha256(normalized) AS query_hash, min(complaint_id) AS seq FROM complaints JOIN sig USING (query) GROUP BY normalized", "complaints", extra=BASE))
def t2(spark, sf):
    out = scratch(spark, "store")
    jobs.run_available(event_stream(spark, sf).withColumn("seq", F.col("complaint_id")), "append", jobs.stream_write_back(spark, out), scratch(spark, "cp"))
    return PlanLog(spark, out, first_stays=True).read().select("query_hash", "seq")


@query("t3_access_counters", with_tables("SELECT sha256(normalized) AS query_hash, count(*) AS hits, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen FROM complaints JOIN sig USING (query) GROUP BY normalized", "complaints", extra=BASE))
def t3(spark, sf):
    out = scratch(spark, "counts")
    jobs.run_available(jobs.access_counts(event_stream(spark, sf)), "update", jobs.batch_files(out), scratch(spark, "cp"))
    return jobs.last_state(spark, out, ["query_hash"]).select("query_hash", "hits", F.date_format("last_accessed_at", "yyyy-MM-dd HH:mm:ss").alias("last_seen"))


@query("t4_repeat_suppression", with_tables("SELECT DISTINCT normalized FROM complaints JOIN sig USING (query)", "complaints", extra=BASE))
def t4(spark, sf):
    out = scratch(spark, "once")
    jobs.run_available(jobs.suppress_repeats(event_stream(spark, sf), "60 days"), "append", jobs.batch_files(out), scratch(spark, "cp"))
    return spark.read.parquet(f"{out}/batch=*").select("normalized")


@query(
    "t5_telemetry_windows",
    "SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, event_type AS path, count(*) AS requests, sum((event_id % 3 <> 0)::INT) AS hits, round(sum(value / 1000), 6) AS cost_usd FROM events GROUP BY 1, 2",
)
def t5(spark, sf):
    out = scratch(spark, "telemetry")
    s = event_stream(spark, sf).select("ts", F.col("event_type").alias("path"), (F.col("complaint_id") % 3 != 0).alias("hit"), (F.col("value") / 1000).alias("cost_usd"), F.col("value").alias("ms"))
    jobs.run_available(jobs.telemetry(s, "1 day", "31 days"), "update", jobs.batch_files(out), scratch(spark, "cp"))
    last = jobs.last_state(spark, out, ["w", "path"])
    return last.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "path", "requests", "hits", F.round("cost_usd", 6).alias("cost_usd"))


@query(
    "t6_complaint_sessions",
    with_tables(
        f"""SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts, count(*) AS n, array_to_string(list_sort(list_distinct(list(domain))), ',') AS domains FROM (
 SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts, complaint_id) AS s FROM (SELECT c.*, sig.domain, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, complaint_id) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS o FROM complaints c JOIN sig USING (query)) a) b GROUP BY user_id, s""",
        "complaints", extra=BASE,
    ),
)
def t6(spark, sf):
    out = scratch(spark, "sessions")
    jobs.run_available(jobs.sessions(event_stream(spark, sf), "2 hours", "1 hour"), "complete", jobs.batch_files(out), scratch(spark, "cp"))
    s = jobs.last_state(spark, out, ["user_id", "w"])
    fmt = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return s.select("user_id", fmt("first_ts"), fmt("last_ts"), "n", F.array_join("domains", ",").alias("domains"))


@query(
    "a8_write_results",
    with_tables("SELECT plan_id, title, count(DISTINCT action_pos) AS actions, count(DISTINCT CASE WHEN partkey % 2 = 0 THEN action_pos END) AS linked FROM plans GROUP BY plan_id, title", "plans"),
)
def a8(spark, sf):
    from helpweave.checks.q_quality import plan_steps
    from helpweave.operators.layout import assemble_plans

    folder = scratch(spark, "results")
    rd.write_results(assemble_plans(plan_steps(spark, sf)), folder)
    back = spark.read.schema(f"plan_id long, goal {schemas.GOAL}").json(folder)
    linked = F.filter("goal.actions", lambda a: F.exists(a["stepGroups"], lambda g: g["actionableDeeplink"]["deeplink"].isNotNull()))
    return back.select("plan_id", "goal.title", F.size("goal.actions").alias("actions"), F.size(linked).alias("linked"))


# --- documents of JSON --------------------------------------------------------------------
DOC_ROWS = 200


def write_documents(df, key: str, field: str, cell, folder: str) -> None:
    """JSON documents of ``DOC_ROWS`` keys each, one per file: ``{field: [cell, ...]}`` in order of ``key``."""
    bucket = F.floor(F.col(key) / DOC_ROWS)
    rows = df.groupBy(bucket.alias("b")).agg(F.array_sort(F.collect_list(F.struct(key, cell.alias("cell")))).alias("r"))
    text = rows.select(F.to_json(F.struct(F.transform("r", lambda x: x["cell"]).alias(field))).alias("value"))
    text.write.option("maxRecordsPerFile", 1).text(folder)


@query(
    "a2_read_articles",
    with_tables(
        "SELECT CAST(article_id AS VARCHAR) AS id, CASE WHEN article_id % 4 = 0 THEN '' ELSE original_query END AS original_query, title, CASE WHEN article_id % 3 = 0 THEN '' ELSE content END AS content,"
        f" CAST(row_number() OVER (PARTITION BY article_id // {DOC_ROWS} ORDER BY article_id) - 1 AS INT) AS seq FROM articles", "articles"),
)
def a2(spark, sf):
    a, folder = derived(spark, sf, "articles"), scratch(spark, "articles")
    body = F.struct("title", F.when(F.col("article_id") % 3 != 0, F.col("content")).alias("content"))
    cell = F.struct(F.col("article_id").cast("string").alias("id"), F.when(F.col("article_id") % 4 != 0, F.col("original_query")).alias("original_query"), body.alias("siis_response"))
    write_documents(a, "article_id", "responses", cell, folder)
    return rd.read_articles(spark, folder)


@query(
    "a3_read_catalog",
    with_tables(
        "SELECT id, deeplink, description, message, originalType, v_deeplink, v_key, v_condition,"
        f" 2 * (row_number() OVER (PARTITION BY seq // {DOC_ROWS} ORDER BY seq) - 1) AS seq FROM catalog", "catalog"),
)
def a3(spark, sf):
    """Every entry stands twice in its document; the second, the true one, counts at the place of the first."""
    c, folder = derived(spark, sf, "catalog"), scratch(spark, "catalog")
    check = F.struct(F.col("v_deeplink").alias("deeplink"), F.col("v_key").alias("key"), F.col("v_result_type").alias("resultType"), F.col("v_condition").alias("condition"), F.col("v_value").alias("value"))
    both = F.array(*[F.struct("id", "deeplink", d.alias("description"), "message", "originalType", check.alias("validation")) for d in (F.lit("old"), F.col("description"))])
    rows = c.groupBy(F.floor(F.col("seq") / DOC_ROWS).alias("b")).agg(F.array_sort(F.collect_list(F.struct("seq", both.alias("cells")))).alias("r"))
    rows.select(F.to_json(F.struct(F.flatten(F.transform("r", lambda x: x["cells"])).alias("deeplinks"))).alias("value")).write.option("maxRecordsPerFile", 1).text(folder)
    return rd.read_catalog(spark, folder).select("id", "deeplink", "description", "message", "originalType", "v_deeplink", "v_key", "v_condition", "seq")


@query("a10_read_labels", with_tables("SELECT scenario_id, category, expected_id FROM eval_predictions", "eval_predictions"))
def a10(spark, sf):
    e, folder = derived(spark, sf, "eval_predictions"), scratch(spark, "labels")
    write_documents(e, "scenario_id", "scenarios", F.struct("scenario_id", "category", "expected_id"), folder)
    return rd.read_labels(spark, folder, "scenarios", "scenario_id:long,category:string,expected_id:string")
