"""Query of cross-tokenizer alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from helpweave.llm.align import Alignment
from helpweave.llm.bpe import tokenizer_path
from helpweave.llm.registry import query
from helpweave.session import table


@query("op13_tokenizer_alignment")
def op13_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    found = Alignment(table(spark, folder, "documents"), tokenizer_path(spark), tokenizer_path(spark, "piece_bpe_32k.model"))
    return found.scores().withColumnRenamed("key", "doc_id")
