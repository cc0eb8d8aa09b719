"""Query of the toxicity classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helpweave.llm.labelled import held_out
from helpweave.llm.registry import query
from helpweave.llm.toxicity import score_toxicity, train_toxicity
from helpweave.session import table


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    model = train_toxicity(documents, table(spark, folder, "labels"))
    return score_toxicity(documents, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
