"""Input tables derived from the star-schema tables by plain SQL.

``{one(...)}`` marks a row expansion that Spark spells ``explode(array(..))`` and other engines
``unnest([..])``; everything else is portable, so both sides see the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from helpweave.session import deal, table

_PART_LABEL = """(SELECT p_partkey,
    concat(upper(substr(p_name,1,1)), substr(p_name,2), ' ', lower(p_type)) AS label,
    concat(substr(p_type,1,1), lower(substr(p_type,2))) AS page FROM part)"""


def _complaints(one) -> str:
    return """SELECT event_id AS complaint_id, ts, user_id,
  concat(
    CASE event_id % 8 WHEN 0 THEN 'Screen flickers' WHEN 1 THEN 'My display goes black after the update'
      WHEN 2 THEN 'Battery draining fast' WHEN 3 THEN 'Battery not charging' WHEN 4 THEN 'How do I turn on Dark mode'
      WHEN 5 THEN 'How do I turn off Dark mode' WHEN 6 THEN 'Phone is lagging' ELSE 'Speaker crackling during a call' END,
    CASE event_id % 3 WHEN 0 THEN '' ELSE
      concat(CASE event_id % 3 WHEN 1 THEN ' and ' ELSE '; ' END,
        CASE user_id % 4 WHEN 0 THEN 'very slow' WHEN 1 THEN 'battery dies fast' WHEN 2 THEN 'wifi stopped working' ELSE 'camera is blurry' END) END,
    CASE event_type WHEN 'error' THEN ' !!' WHEN 'view' THEN concat(' on my S', cast(user_id % 25 AS STRING)) ELSE '' END) AS query
FROM events"""


def _catalog(one) -> str:
    return f"""SELECT concat('CE-', cast(p_partkey AS STRING), '-', kind) AS id,
  concat('demo://act/', cast(p_partkey AS STRING), '/', kind) AS deeplink,
  CASE kind WHEN 'on' THEN concat('Enables ', label, ' via the ', page, ' settings page')
    WHEN 'off' THEN concat('Disables ', label, ' via the ', page, ' settings page')
    WHEN 'set' THEN concat('Updates ', label, ' to the specified value')
    ELSE concat('Opens the ', label, ' settings page') END AS description,
  CASE kind WHEN 'on' THEN concat('Enable ', label) WHEN 'off' THEN concat('Disable ', label)
    WHEN 'set' THEN concat('Adjust ', label) ELSE concat('View ', label) END AS message,
  CASE kind WHEN 'on' THEN 'onURL' WHEN 'off' THEN 'offURL' WHEN 'set' THEN 'updateURL' WHEN 'page' THEN 'onClickURL' END AS originalType,
  '' AS qna_description, label, page,
  concat('demo://val/', cast(p_partkey AS STRING)) AS v_deeplink, label AS v_key,
  CASE kind WHEN 'on' THEN 'boolean' END AS v_result_type, CASE kind WHEN 'on' THEN 'equal' END AS v_condition,
  CASE kind WHEN 'on' THEN 'True' END AS v_value, p_partkey * 10 + CASE kind WHEN 'on' THEN 0 WHEN 'off' THEN 1 WHEN 'page' THEN 2 ELSE 3 END AS seq
FROM (SELECT p_partkey, label, page, {one("'on'", "'off'", "'page'", "'set'")} AS kind
      FROM (SELECT min(p_partkey) AS p_partkey, label, page FROM {_PART_LABEL} q GROUP BY label, page) p) k"""


def _step_groups(one) -> str:
    return f"""SELECT p_partkey AS group_id, step_pos,
  CASE step_pos WHEN 1 THEN 'Open Settings.' WHEN 2 THEN concat('Tap ', page, '.')
    WHEN 3 THEN CASE p_partkey % 3 WHEN 0 THEN concat('Tap on ', label, '.') WHEN 1 THEN concat('Turn on ', label, '.') ELSE concat('Turn off ', label, '.') END
    ELSE CASE p_partkey % 4 WHEN 0 THEN 'Bake a chocolate cake.' ELSE concat('Adjust the ', lower(label), ' value.') END END AS step,
  CASE p_partkey % 5 WHEN 3 THEN 'manual' WHEN 4 THEN 'critical' ELSE 'auto' END AS category
FROM (SELECT p_partkey, label, page, {one("1", "2", "3", "4")} AS step_pos FROM {_PART_LABEL} p) k"""


def _articles(one) -> str:
    return f"""SELECT p_partkey AS article_id, concat(label, ' issue on a phone') AS title, concat(label, ' does not work') AS original_query,
  concat('Phones ', label, ' (Settings): # ', label, ' issue', chr(10), 'I understand you are having trouble with ', label, '.', chr(10),
   '## Step 1: Adjust ', label, chr(10), 'Please go to Settings, tap ', page, ', and then tap ', label, '. First, turn on ', label, '. This usually helps.', chr(10),
   CASE p_partkey % 3 WHEN 0 THEN concat('### 2. Force a restart', chr(10), 'Press and hold the Power button for 20 seconds. If it stays off, charge the device for one hour.', chr(10))
     WHEN 1 THEN concat('## Factors affecting ', label, chr(10), 'Remove the screen protector and test again. See https://example.com/help for more.', chr(10)) ELSE '' END,
   '## Contact support', chr(10), 'You can visit a local service center. First, turn on ', label, '.') AS content
FROM {_PART_LABEL} p"""


def _plans(one) -> str:
    return """SELECT o_orderkey AS plan_id, l_linenumber AS action_pos,
  CASE o_orderkey % 4 WHEN 0 THEN 'Follow these steps to perform this Screen Troubleshooting'
     WHEN 1 THEN 'Follow these steps to perform this Battery Configuration' WHEN 2 THEN 'Steps to perform Screen'
     ELSE 'follow these steps to perform this Audio troubleshooting' END AS goal,
  CASE o_orderkey % 5 WHEN 0 THEN 'Screen flicker' WHEN 1 THEN 'Screen Display Flicker Issue' WHEN 2 THEN 'flicker'
     WHEN 3 THEN 'Slow Wi-Fi' ELSE 'Blank screen issue' END AS title,
  CASE l_linenumber % 3 WHEN 0 THEN 'Adjust Screen Brightness' WHEN 1 THEN 'force a restart' ELSE 'Visit a Service Center' END AS action_name,
  CASE l_returnflag WHEN 'A' THEN 'It will clear temporary glitches by restarting' WHEN 'N' THEN 'this will help' ELSE 'see www.example.com for help' END AS description,
  CASE l_linestatus WHEN 'O' THEN 'auto' ELSE CASE l_linenumber % 2 WHEN 0 THEN 'manual' ELSE 'critical' END END AS category,
  l_discount * 12 AS score, l_partkey AS partkey
FROM (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus,
        min(l_discount) AS l_discount, min(l_partkey) AS l_partkey FROM lineitem GROUP BY l_orderkey, l_linenumber) li
JOIN orders ON l_orderkey = o_orderkey"""


def _calibration(one) -> str:
    return """SELECT l_orderkey AS case_id, l_linenumber AS line, CAST(l_discount * 10 AS DOUBLE) AS grounding_coverage,
  CAST(1.0 - l_tax * 5 AS DOUBLE) AS validator_pass_rate, CAST(l_quantity / 50.0 AS DOUBLE) AS retrieval_margin,
  CAST(CASE l_linestatus WHEN 'O' THEN 0.6 ELSE 1.0 END AS DOUBLE) AS path_alignment,
  CASE l_returnflag WHEN 'R' THEN 0 ELSE 1 END AS label FROM lineitem"""


def _eval_predictions(one) -> str:
    return """SELECT o_orderkey AS scenario_id, CASE o_orderkey % 10 WHEN 9 THEN 'manual' ELSE 'auto' END AS category,
  CASE o_orderkey % 10 WHEN 9 THEN NULL ELSE o_orderpriority END AS expected_id,
  CASE WHEN o_custkey % 7 = 0 THEN NULL WHEN o_custkey % 5 = 0 THEN 'other' ELSE o_orderpriority END AS predicted_id,
  o_orderkey % 2 = 0 AS expected_page, (o_orderkey + o_custkey) % 2 = 0 AS predicted_page
FROM orders"""


def _device_state(one) -> str:
    return """SELECT user_id AS device_id, concat('key', cast(event_id % 20 AS STRING)) AS skey,
  max(CASE WHEN value > 20 THEN 'true' ELSE 'false' END) AS value
FROM events GROUP BY user_id, concat('key', cast(event_id % 20 AS STRING))"""


_SQL: dict[str, tuple[Callable, list[str]]] = {
    "complaints": (_complaints, ["events"]),
    "catalog": (_catalog, ["part"]),
    "step_groups": (_step_groups, ["part"]),
    "articles": (_articles, ["part"]),
    "plans": (_plans, ["orders", "lineitem"]),
    "calibration": (_calibration, ["lineitem"]),
    "eval_predictions": (_eval_predictions, ["orders"]),
    "device_state": (_device_state, ["events"]),
}


def derived(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One derived table as a DataFrame."""
    build, needs = _SQL[name]
    text = build(lambda *items: f"explode(array({', '.join(items)}))").replace("{", "{{").replace("}", "}}")
    for need in needs:
        text = text.replace(f"FROM {need}", f"FROM {{{need}}}").replace(f"JOIN {need} ", f"JOIN {{{need}}} {need} ")
    tables = {need: table(spark, folder, need) for need in needs}
    if "part" in tables:
        # long texts are made from few bytes of a part, so its rows are dealt before, by key: what divides the rows of a part needs no other shuffle
        tables["part"] = deal(tables["part"], tables["part"].count(), "p_partkey", task_rows=50_000)
    if name == "plans":
        # dealt by plan while the rows are narrow: grouping, the join and whatever divides the rows of a plan later need no other shuffle
        rows = 2 * tables["lineitem"].count()
        used = ["l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_discount", "l_partkey"]
        tables["lineitem"] = deal(tables["lineitem"].select(*used), rows, "l_orderkey", task_rows=100_000)
        tables["orders"] = deal(tables["orders"].select("o_orderkey"), rows, "o_orderkey", task_rows=100_000).hint("merge")
    return spark.sql(text, **tables)


def derived_sql(name: str) -> str:
    """The same derived table as SQL text for the side-by-side check."""
    return _SQL[name][0](lambda *items: f"unnest([{', '.join(items)}])")
