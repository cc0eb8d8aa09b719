"""Query of substring dedup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helpweave.llm.registry import query
from helpweave.llm.substring import drop_repeats
from helpweave.session import table

SQL = r"""
WITH w AS MATERIALIZED (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS MATERIALIZED (
  SELECT doc_id, unnest(range(1, len(w) - 48)) AS p, w FROM w WHERE len(w) >= 50
), h AS MATERIALIZED (SELECT doc_id, p, md5_number(array_to_string(w[p:p + 49], ' ')) AS h FROM s
), d AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY h) AS m FROM h) WHERE doc_id > m
), g AS (SELECT doc_id, list_distinct(flatten(list(range(p, p + 50)))) AS gone FROM d GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w.w ELSE [w.w[i] FOR i IN range(1, len(w.w) + 1) IF NOT list_contains(gone, i)] END, ' ')) AS kept_sha256
FROM w LEFT JOIN g ON w.doc_id = g.doc_id
"""


@query("op2_substring_dedup", SQL)
def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    return drop_repeats(documents, 50).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
