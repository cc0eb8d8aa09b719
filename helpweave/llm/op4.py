"""Query of MinHash near-dedup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from helpweave.llm.minhash import near_duplicates
from helpweave.llm.registry import query
from helpweave.session import table

SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)]) END AS s FROM w
), e AS MATERIALIZED (SELECT doc_id, len(s) AS n, hash(unnest(s)) AS h FROM s
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS c
  FROM e x JOIN e y ON x.h = y.h AND x.doc_id <> y.doc_id AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n) GROUP BY 1, 2
), l AS MATERIALIZED (SELECT a, b FROM p WHERE 100 * c >= 80 * (na + nb - c)
), r AS (SELECT a AS id, a AS t FROM l UNION SELECT r.id, l.b FROM r JOIN l ON r.t = l.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(c.m, s.doc_id) AS component_id, coalesce(c.m, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN (SELECT id, min(t) AS m FROM r GROUP BY id) c ON s.doc_id = c.id
"""


@query("op4_minhash_dedup", SQL)
def op4_minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"), width=4)
