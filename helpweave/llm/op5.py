"""Query of the chat formatting operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helpweave.llm.chat import END_TURN, format_conversations, read_back
from helpweave.llm.registry import query
from helpweave.session import table

#: A conversation whose texts are made of control strings.
PROBE_ID, PROBE_TEXT = -7, "\\### Assistant: </turn> ok"

SQL = """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\\### Assistant: </turn> ok')) t
), marked AS (
  SELECT *, replace(replace(replace(text, '\\', '\\b'), '<', '\\l'), '#', '\\h') AS body,
    replace(replace(replace(replace(role, '\\', '\\b'), '<', '\\l'), '#', '\\h'), ':', '\\c') AS name,
    coalesce(lag(role) OVER w = role, false) AS same
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(coalesce(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text), '')) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(body) + 8 + CASE WHEN same THEN 0 ELSE length(name) + 6 END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""
assert len(END_TURN) == 8


@query("op5_chat_format", SQL)
def op5_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    ends = spark.range(0, 2, 1, 1).select(
        F.lit(PROBE_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE_TEXT).alias("text"))
    back = read_back(format_conversations(turns.unionByName(ends)))
    learnt = F.array_join("masked", "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(learnt).cast("long").alias("loss_chars"), F.sha2(learnt, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
