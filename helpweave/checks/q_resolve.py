"""Catalog, screens and links."""

from __future__ import annotations

from pyspark.sql import functions as F

from helpweave import lexicons as lx
from helpweave.checks import sqltext as q
from helpweave.checks.q_retrieval import catalog_sql
from helpweave.checks.registry import query, with_tables
from helpweave.functions import text as tx
from helpweave.operators import resolve as rs
from helpweave.session import table
from helpweave.sources.fixtures import _PART_LABEL, derived


@query("a4_resolvable_entries", with_tables("SELECT id FROM catalog WHERE originalType <> 'updateURL'", "catalog"))
def a4(spark, sf):
    c = derived(spark, sf, "catalog")
    marked = c.withColumn("deeplink", F.when(F.col("originalType") == "updateURL", F.concat(F.lit("x"), F.lit(lx.PLACEHOLDER_SUFFIX))).otherwise(F.col("deeplink")))
    return rs.resolvable(marked).select("id")


@query("c10_entry_level", with_tables("SELECT id, CASE originalType WHEN 'onClickURL' THEN 'page' ELSE CASE WHEN originalType IS NULL THEN 'read_only' ELSE 'leaf' END END AS level FROM catalog", "catalog"))
def c10(spark, sf):
    return derived(spark, sf, "catalog").select("id", rs.entry_level("originalType").alias("level"))


@query(
    "c11_infer_validation",
    with_tables("SELECT id, CASE originalType WHEN 'onURL' THEN 'True' WHEN 'offURL' THEN 'False' END AS value, CASE originalType WHEN 'onURL' THEN false WHEN 'offURL' THEN true END AS inferred FROM catalog", "catalog"),
)
def c11(spark, sf):
    v = rs.infer_validation("v_deeplink", "v_key", "v_result_type", "v_condition", "v_value", "originalType")
    return derived(spark, sf, "catalog").withColumn("v", v).select("id", "v.value", "v.inferred")


def step_lists(spark, sf):
    steps = derived(spark, sf, "step_groups")
    return steps.groupBy("group_id", "category").agg(F.transform(F.array_sort(F.collect_list(F.struct("step_pos", "step"))), lambda s: s["step"]).alias("steps"))


_GRP = f"""part_label AS (SELECT * FROM {_PART_LABEL} pl),
grp AS MATERIALIZED (SELECT p_partkey AS group_id, CASE p_partkey % 5 WHEN 3 THEN 'manual' WHEN 4 THEN 'critical' ELSE 'auto' END AS category,
  CASE WHEN p_partkey % 3 = 0 THEN [page, label] ELSE [page] END AS labels,
  (CASE p_partkey % 3 WHEN 1 THEN ['Turn on ' || label || '.'] WHEN 2 THEN ['Turn off ' || label || '.'] ELSE [] END)
   || [CASE p_partkey % 4 WHEN 0 THEN 'Bake a chocolate cake.' ELSE 'Adjust the ' || lower(label) || ' value.' END] AS acts,
  'Open Settings. Tap ' || page || '. ' || CASE p_partkey % 3 WHEN 0 THEN 'Tap on ' WHEN 1 THEN 'Turn on ' ELSE 'Turn off ' END || label || '. '
   || CASE p_partkey % 4 WHEN 0 THEN 'Bake a chocolate cake.' ELSE 'Adjust the ' || lower(label) || ' value.' END AS text FROM part_label)"""


@query("c9_split_steps", with_tables("SELECT group_id, array_to_string(labels, '|') AS labels, array_to_string(acts, '|') AS acts FROM grp", extra=_GRP))
def c9(spark, sf):
    return step_lists(spark, sf).select("group_id", F.array_join(rs.navigation_labels("steps"), "|").alias("labels"), F.array_join(rs.action_steps("steps"), "|").alias("acts"))


@query(
    "b21_placeholder_texts",
    with_tables(
        """SELECT group_id, array_to_string((string_split('Opens the ' || labels[-1] || ' screen in Settings', ' '))[1:7], ' ') AS description,
  array_to_string((string_split('Open ' || labels[-1] || ' in device Settings', ' '))[1:7], ' ') AS message FROM grp""",
        extra=_GRP,
    ),
)
def b21(spark, sf):
    return step_lists(spark, sf).withColumn("p", rs.placeholder_texts("steps", F.lit("Adjust it"))).select("group_id", "p.description", "p.message")


_LEAF = q.lst(lx.word_list(lx.LEAF_STOP_WORDS))
_minus, _common = q.minus, q.common
_SCREEN = f"""{_GRP}, {catalog_sql(40)},
ent AS MATERIALIZED (SELECT seq AS doc, id, deeplink, description, message, originalType, lower(description) AS dl, lower(message) AS ml, {q.link_polarity("(description || ' ' || message)")} AS pol,
  {_minus(q.stems('message'), _LEAF)} AS om, {_minus(q.stems('description'), _LEAF)} AS od, list_distinct(regexp_extract_all(regexp_replace(lower(message), '^view ', ''), '[a-z]+')) AS pw FROM catalog),
lists AS MATERIALIZED (SELECT text, any_value(labels) AS labels, any_value(acts) AS acts, array_to_string(any_value(acts), ' ') AS acttext, min(group_id) AS rep FROM grp GROUP BY text),
r0 AS (SELECT l.*, {q.stems('acttext')} AS ast, r.rank, r.score, r.c AS raw, e.*, coalesce(originalType <> 'onClickURL', false) AS is_leaf,
  list_max([CASE WHEN contains(dl, lower(x)) OR contains(ml, lower(x)) THEN i ELSE 0 END for x, i in labels]) AS at_label FROM lists l JOIN ranked r ON r.qid = l.rep AND r.rank <= 40 JOIN ent e ON e.doc = r.doc),
r1 AS (SELECT *, CASE WHEN max(at_label) OVER w > 0 THEN labels[max(at_label) OVER w] ELSE labels[-1] END AS crumb FROM r0 WINDOW w AS (PARTITION BY rep)),
r2 AS (SELECT *, {q.stems('crumb')} AS cs, contains(dl, lower(crumb)) OR contains(ml, lower(crumb)) AS mentions,
  is_leaf AND len(acts) > 0 AND ((len(om) > 0 AND len({_minus('om', 'ast')}) = 0) OR (len(od) > 0 AND len({_minus('od', 'ast')}) = 0)) AS named FROM r1),
r3 AS (SELECT *, max(CASE WHEN mentions OR named THEN score END) OVER w AS fs, max(CASE WHEN mentions OR named THEN raw END) OVER w AS fr,
  max(CASE WHEN rank = 1 THEN score END) OVER w AS ts, max(CASE WHEN rank = 1 THEN raw END) OVER w AS tr FROM r2 WINDOW w AS (PARTITION BY rep)),
r4 AS (SELECT *, fs IS NOT NULL AND NOT (round(ts - fs, 9) > 0.3 AND round(tr - fr, 9) > 0.15) AS anchored FROM r3),
r5 AS (SELECT *, NOT anchored OR mentions OR named AS onp, {_minus('om', 'cs')} AS own FROM r4),
r6 AS (SELECT *, onp AND coalesce(originalType = 'onClickURL', false) AS page_ok, onp AND is_leaf AND len(acts) > 0 AND (len(own) = 0 OR len({_common('own', 'ast')}) >= least(2, len(own))) AS sup,
  len({_minus('pw', "regexp_extract_all(lower(crumb), '[a-z]+')")}) AS extra, len({_minus('od', 'cs')}) AS unexpl, {q.link_polarity("CASE WHEN acttext <> '' THEN acttext ELSE text END")} AS want FROM r5),
r7 AS (SELECT *, arg_min(CASE WHEN sup THEN score END, CASE WHEN sup THEN rank END) OVER w AS fl, max(CASE WHEN page_ok THEN score END) OVER w AS tp FROM r6 WINDOW w AS (PARTITION BY rep)),
r8 AS (SELECT *, page_ok AND (anchored OR round(tp - score, 9) <= 0.05) AS near, sup AND round(abs(fl - score), 9) <= 0.02 AND pol = want AS twin FROM r7),
pk AS (SELECT rep, text, any_value(anchored) AS anchored, len(any_value(acts)) AS na, any_value(crumb) AS crumb,
  arg_min(doc, (extra, unexpl, CASE WHEN anchored THEN -round(score, 9) ELSE 0 END, rank)) FILTER (WHERE near) AS pg,
  coalesce(arg_min(doc, rank) FILTER (WHERE twin), arg_min(doc, rank) FILTER (WHERE sup)) AS lf, arg_min(doc, rank) FILTER (WHERE onp) AS hd FROM r8 GROUP BY rep, text),
ps AS (SELECT pk.*, p.score AS psc, l.score AS lsc FROM pk LEFT JOIN r8 p ON p.rep = pk.rep AND p.doc = pg LEFT JOIN r8 l ON l.rep = pk.rep AND l.doc = lf),
dec AS (SELECT *, anchored AND na > 1 AND pg IS NOT NULL AS guard, CASE WHEN anchored AND na > 1 AND pg IS NOT NULL THEN pg WHEN lf IS NOT NULL AND (pg IS NULL OR round(lsc, 9) >= round(psc, 9)) THEN lf WHEN pg IS NOT NULL THEN pg ELSE hd END AS doc FROM ps),
screens AS MATERIALIZED (SELECT d.text, d.crumb, d.guard, r.doc, r.id, r.deeplink, r.description, r.message, r.originalType, r.score, r.raw, r.mentions FROM dec d JOIN r8 r ON r.rep = d.rep AND r.doc = d.doc)"""


def _screens(spark, sf):
    index, entries = rs.catalog_index(derived(spark, sf, "catalog"))
    lists = step_lists(spark, sf).groupBy("steps").agg(F.min("group_id").alias("qid"))
    return rs.resolve_screens(lists, index, entries), lists


@query(
    "x3_resolve_screens",
    with_tables("SELECT (SELECT min(group_id) FROM grp WHERE grp.text = s.text) AS qid, doc, originalType = 'onClickURL' AS is_page, guard, crumb AS breadcrumb, round(score, 6) AS score, round(raw, 6) AS raw_cosine, CASE WHEN mentions THEN 1.0 ELSE 0.3 END AS path_value FROM screens s", "catalog", "step_groups", extra=_SCREEN),
)
def x3(spark, sf):
    found, _ = _screens(spark, sf)
    return found.withColumns({c: F.round(c, 6) for c in ("score", "raw_cosine")}).drop("anchored", "page_doc", "leaf_doc")


def _choice(column: str, alias: str) -> str:
    return with_tables(f"SELECT (SELECT min(group_id) FROM grp WHERE grp.text = pk.text) AS qid, {column} AS {alias} FROM pk", "catalog", "step_groups", extra=_SCREEN)


@query("e13_filter_distrust", _choice("anchored", "anchored"))
def e13(spark, sf):
    return _screens(spark, sf)[0].select("qid", "anchored")


@query("w4_polarity_leaf", _choice("lf", "leaf_doc"))
def w4(spark, sf):
    return _screens(spark, sf)[0].select("qid", "leaf_doc")


@query("w5_best_page", _choice("pg", "page_doc"))
def w5(spark, sf):
    return _screens(spark, sf)[0].select("qid", "page_doc")


_BIND = f"""{_SCREEN}, b0 AS (SELECT g.*, s.id, s.deeplink, s.message, coalesce(s.raw, 0) AS raw, s.crumb, s.mentions, s.doc, {_minus(q.stems("coalesce(s.message, '')"), _LEAF)} AS lab,
  {_minus(q.stems("coalesce(s.message, '')"), q.lst(lx.word_list(lx.LEAF_STOP_WORDS + ' ' + lx.GESTURE_WORDS)))} AS glab, {q.stems("(g.text || ' Adjust it')")} AS ws FROM grp g LEFT JOIN screens s ON s.text = g.text AND g.category <> 'manual'),
b1 AS (SELECT *, doc IS NOT NULL AND raw >= 0.05 AND (raw >= 0.3 OR (len(glab) > 0 AND len({_common('glab', 'ws')}) >= least(2, len(glab)))) AS ok FROM b0),
bound AS MATERIALIZED (SELECT *, CASE WHEN category = 'manual' THEN 'manual_no_deeplink' WHEN category = 'critical' THEN CASE WHEN ok AND raw >= 0.1 AND len(lab) > 0 AND len({_minus('lab', 'ws')}) = 0 THEN 'matched' ELSE 'critical_no_screen' END
  WHEN ok THEN 'matched' ELSE 'dummy_positive' END AS status FROM b1)"""


def groups_to_bind(spark, sf):
    g = step_lists(spark, sf)
    return g.select((F.col("group_id") / 4).cast("long").alias("plan_id"), (F.col("group_id") % 4).cast("int").alias("action_pos"), F.lit(0).alias("group_pos"),
                    F.lit("Adjust it").alias("action_name"), "category", "steps")


def _bound(spark, sf):
    index, entries = rs.catalog_index(derived(spark, sf, "catalog"))
    return rs.bind_links(groups_to_bind(spark, sf), index, entries)


_LINK = "CASE status WHEN 'matched' THEN deeplink WHEN 'dummy_positive' THEN 'bixby://dummy_positive' END"


@query(
    "x4_bind_links",
    with_tables(f"SELECT group_id // 4 AS plan_id, group_id % 4 AS action_pos, status, {_LINK} AS link, round(raw, 6) AS raw_cosine FROM bound", "catalog", "step_groups", extra=_BIND),
)
def x4(spark, sf):
    return _bound(spark, sf).select("plan_id", "action_pos", "status", "link", F.round("raw_cosine", 6).alias("raw_cosine"))


@query(
    "g4_link_signals",
    with_tables(
        """SELECT group_id // 4 AS plan_id, round(coalesce(avg(CASE status WHEN 'matched' THEN least(1, raw / 0.3) WHEN 'dummy_positive' THEN 0.5 * least(1, raw / 0.3) END), 1), 3) AS retrieval_margin,
  round(coalesce(avg(CASE status WHEN 'matched' THEN CASE WHEN mentions THEN 1.0 ELSE 0.3 END WHEN 'dummy_positive' THEN 0.5 END), 1), 3) AS path_alignment,
  count(CASE WHEN status = 'matched' THEN 1 END) AS bound, count(CASE WHEN status = 'dummy_positive' THEN 1 END) AS dummy_positive FROM bound GROUP BY group_id // 4""",
        "catalog", "step_groups", extra=_BIND,
    ),
)
def g4(spark, sf):
    return rs.link_signals(_bound(spark, sf))


@query("e6_link_confidence", with_tables("SELECT status, count(*) AS n FROM bound GROUP BY status", "catalog", "step_groups", extra=_BIND))
def e6(spark, sf):
    return _bound(spark, sf).groupBy("status").agg(F.count("*").alias("n"))


_MERGE_SRC = "SELECT plan_id, action_pos, 0 AS group_pos, action_name, CASE WHEN partkey % 3 = 0 THEN 'demo://act/a' WHEN partkey % 3 = 1 THEN 'bixby://dummy_positive' ELSE 'demo://act/b' END AS link FROM plans"


@query(
    "x2_merge_same_screen",
    with_tables(
        f"""SELECT plan_id, run AS action_pos, row_number() OVER (PARTITION BY plan_id, run ORDER BY action_pos) - 1 AS group_pos, first(action_name) OVER (PARTITION BY plan_id, run ORDER BY action_pos) AS action_name, link FROM (
 SELECT *, sum(o) OVER (PARTITION BY plan_id ORDER BY action_pos) - 1 AS run FROM (SELECT *, CASE WHEN link = lag(link) OVER (PARTITION BY plan_id ORDER BY action_pos) AND link NOT LIKE '%dummy_positive' THEN 0 ELSE 1 END AS o FROM ({_MERGE_SRC}) a) b) c""",
        "plans",
    ),
)
def x2(spark, sf):
    p = derived(spark, sf, "plans")
    k = F.col("partkey") % 3
    link = F.when(k == 0, "demo://act/a").when(k == 1, lx.PLACEHOLDER_URI).otherwise("demo://act/b")
    return rs.merge_same_screen(p.select("plan_id", "action_pos", F.lit(0).alias("group_pos"), "action_name", link.alias("link")))


@query(
    "x5_resolve_plans",
    with_tables(
        f"""SELECT plan_id, dense_rank() OVER (PARTITION BY plan_id ORDER BY w, run) - 1 AS action_pos, row_number() OVER (PARTITION BY plan_id, run ORDER BY action_pos) - 1 AS group_pos, link, cat AS category FROM (
 SELECT *, CASE cat WHEN 'auto' THEN 0 WHEN 'critical' THEN 2 ELSE 1 END AS w FROM (SELECT *, first(category) OVER (PARTITION BY plan_id, run ORDER BY action_pos) AS cat FROM (
 SELECT *, sum(o) OVER (PARTITION BY plan_id ORDER BY action_pos) - 1 AS run FROM (SELECT *, CASE WHEN link = lag(link) OVER (PARTITION BY plan_id ORDER BY action_pos) AND link NOT LIKE '%dummy_positive' THEN 0 ELSE 1 END AS o
  FROM (SELECT group_id // 4 AS plan_id, group_id % 4 AS action_pos, category, {_LINK} AS link FROM bound) a) b) c) d) e""",
        "catalog", "step_groups", extra=_BIND,
    ),
)
def x5(spark, sf):
    g = groups_to_bind(spark, sf).withColumn("step_pos", F.lit(0))
    index, entries = rs.catalog_index(derived(spark, sf, "catalog"))
    steps = g.select("plan_id", "action_pos", "group_pos", "action_name", F.lit("It will help").alias("description"), "category", F.posexplode_outer("steps").alias("step_pos", "step"))
    groups, _ = rs.resolve_plans(steps, index, entries)
    return groups.select("plan_id", "action_pos", "group_pos", "link", "category")


# --- label and path predicates over (group, entry) rows of one key -----------------------
_NEAR = f"""{_GRP}, ge AS (SELECT g.group_id, g.acts, g.text, c.id, c.description, c.message, c.originalType, {_minus(q.stems('c.message'), _LEAF)} AS lab, {_minus(q.stems('c.description'), _LEAF)} AS dlab,
  {_minus(q.stems('c.message'), q.lst(lx.word_list(lx.LEAF_STOP_WORDS + ' ' + lx.GESTURE_WORDS)))} AS glab, {q.stems('g.text')} AS ws, {q.stems("array_to_string(g.acts, ' ')")} AS ast, g.labels[1] AS page
  FROM grp g JOIN part_label p ON p.p_partkey = g.group_id JOIN catalog c ON c.label = p.label AND c.page = p.page)"""


def _group_entries(spark, sf):
    lab = table(spark, sf, "part").select(
        F.col("p_partkey").alias("group_id"),
        F.concat(F.initcap(F.substring("p_name", 1, 1)), F.substring("p_name", 2, 1000), F.lit(" "), F.lower("p_type")).alias("label"),
        F.concat(F.substring("p_type", 1, 1), F.lower(F.substring("p_type", 2, 1000))).alias("page"))
    g = step_lists(spark, sf).join(lab, "group_id").join(derived(spark, sf, "catalog"), ["label", "page"])
    return g.withColumns({"ms": tx.stems("message"), "ds": tx.stems("description"), "ws": tx.stems(F.array_join("steps", " ")), "ast": tx.stems(F.array_join(rs.action_steps("steps"), " "))})


def _predicate(name, sql, build):
    def run(spark, sf):
        return _group_entries(spark, sf).select("group_id", "id", build().alias("ok"))

    query(name, with_tables(f"SELECT group_id, id, {sql} AS ok FROM ge", "catalog", extra=_NEAR))(run)


_predicate("e7_label_supported", f"len(glab) > 0 AND len({_common('glab', 'ws')}) >= least(2, len(glab))", lambda: rs.supports(rs.label_parts("ms", lx.GESTURE_WORDS), F.col("ws"), False))
_predicate("e8_label_covered", f"len(lab) > 0 AND len({_minus('lab', 'ws')}) = 0", lambda: rs.covers(rs.label_parts("ms"), F.col("ws")))
_predicate("e9_leaf_named", f"originalType <> 'onClickURL' AND ((len(lab) > 0 AND len({_minus('lab', 'ast')}) = 0) OR (len(dlab) > 0 AND len({_minus('dlab', 'ast')}) = 0))",
           lambda: (rs.entry_level("originalType") == "leaf") & rs.leaf_named(rs.label_parts("ms"), rs.label_parts("ds"), F.col("ast")))
_predicate("e10_leaf_supported", f"len({_minus('lab', q.stems('page'))}) = 0 OR len({_common(_minus('lab', q.stems('page')), 'ast')}) >= least(2, len({_minus('lab', q.stems('page'))}))",
           lambda: rs.supports(F.array_except(rs.label_parts("ms"), tx.stems("page")), F.col("ast"), True))
_predicate("e12_breadcrumb_contained", "contains(lower(description), lower(page)) OR contains(lower(message), lower(page))",
           lambda: rs.mentions("description", "message", "page"))


@query("e14_path_alignment", with_tables("SELECT group_id, id, CASE WHEN group_id % 6 = 0 THEN 0.6 WHEN contains(lower(description), lower(page)) OR contains(lower(message), lower(page)) THEN 1.0 ELSE 0.3 END AS path_value FROM ge", "catalog", extra=_NEAR))
def e14(spark, sf):
    g = _group_entries(spark, sf)
    crumb = F.when(F.col("group_id") % 6 != 0, F.col("page"))
    has = rs.mentions("description", "message", "page")
    return g.select("group_id", "id", rs.path_alignment(crumb, has).alias("path_value"))


@query("w6_breadcrumb", with_tables("SELECT (SELECT min(group_id) FROM grp WHERE grp.text = s.text) AS qid, crumb AS breadcrumb FROM screens s", "catalog", "step_groups", extra=_SCREEN))
def w6(spark, sf):
    return _screens(spark, sf)[0].select("qid", "breadcrumb")


@query("e11_critical_links", with_tables("SELECT group_id // 4 AS plan_id, group_id % 4 AS action_pos, status FROM bound WHERE category = 'critical'", "catalog", "step_groups", extra=_BIND))
def e11(spark, sf):
    return _bound(spark, sf).where("category = 'critical'").select("plan_id", "action_pos", "status")
