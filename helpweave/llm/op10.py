"""Query of the URL filter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from helpweave.llm.registry import query
from helpweave.llm.urls import judge_urls
from helpweave.session import table

RULES = [
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
]


@query("op10_url_filter")
def op10_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return judge_urls(table(spark, folder, "pages"), RULES)
