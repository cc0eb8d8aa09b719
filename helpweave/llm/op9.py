"""Query of the quality classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helpweave.llm.labelled import held_out
from helpweave.llm.quality import score_quality, train_quality
from helpweave.llm.registry import query
from helpweave.session import table


@query("op9_quality")
def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    model = train_quality(documents, table(spark, folder, "labels"))
    return score_quality(documents, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
