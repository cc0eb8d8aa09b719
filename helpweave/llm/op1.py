"""Query of embedding near-dedup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from helpweave.llm.embeddings import near_vectors
from helpweave.llm.registry import query
from helpweave.session import table

SQL = """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e,
    label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok
  FROM embeddings
), links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE a.ok AND b.ok AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  SELECT a AS id, a AS to_id FROM links UNION SELECT reach.id, links.b FROM reach JOIN links ON reach.to_id = links.a
)
SELECT v.vec_id, coalesce(l.n, 0) AS n_links, coalesce(r.c, v.vec_id) AS component_id, coalesce(r.c, v.vec_id) = v.vec_id AS kept
FROM v LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) l ON v.vec_id = l.a
LEFT JOIN (SELECT id, min(to_id) AS c FROM reach GROUP BY id) r ON v.vec_id = r.id
"""


@query("op1_embedding_dedup", SQL)
def op1_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(table(spark, folder, "embeddings"))
