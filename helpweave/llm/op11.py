"""Query of document fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from helpweave.llm.fingerprints import compare_with_next
from helpweave.llm.registry import query
from helpweave.session import table


@query("op11_fingerprints")
def op11_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return compare_with_next(table(spark, folder, "documents"))
