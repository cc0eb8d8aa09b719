"""Query of repeated byte strings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helpweave.llm.registry import query
from helpweave.llm.repeats import drop_repeated_bytes
from helpweave.session import table

SQL = """
WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS MATERIALIZED (SELECT r, p, md5_number(substr(x, 2 * p + 1, 800)) AS h FROM (SELECT r, x, unnest(range(0, len(x) // 2 - 399)) AS p FROM d WHERE len(x) >= 800) u),
dup AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY h) AS c FROM w) t WHERE c > 1),
opened AS (SELECT r, p, CASE WHEN p - lag(p) OVER (PARTITION BY r ORDER BY p) <= 400 THEN 0 ELSE 1 END AS o FROM dup),
island AS (SELECT r, p, sum(o) OVER (PARTITION BY r ORDER BY p) AS g FROM opened),
spans AS MATERIALIZED (SELECT r, min(p) AS a, max(p) + 400 AS z FROM island GROUP BY r, g),
pieces AS (SELECT r, lag(z, 1, 0) OVER (PARTITION BY r ORDER BY a) AS f, a AS t FROM spans UNION ALL SELECT r, max(z), NULL FROM spans GROUP BY r),
kept AS (SELECT r, string_agg(CASE WHEN t IS NULL THEN substr(x, 2 * f + 1) ELSE substr(x, 2 * f + 1, 2 * (t - f)) END, '' ORDER BY f) AS k FROM pieces JOIN d USING (r) GROUP BY r),
lost AS (SELECT r, sum(z - a) AS n, count(*) AS c FROM spans GROUP BY r)
SELECT doc_id, len(x) // 2 AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(c, 0) AS n_spans, sha256(unhex(coalesce(k, x))) AS kept_sha256
FROM d LEFT JOIN lost USING (r) LEFT JOIN kept USING (r)
"""


@query("op8_suffix_dedup", SQL)
def op8_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    return drop_repeated_bytes(documents, 400).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
