"""Query of BPE encoding and decoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from helpweave.llm.bpe import decode, encode, tokenizer_path
from helpweave.llm.registry import query
from helpweave.session import table


@query("op6_bpe")
def op6_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = tokenizer_path(spark)
    return decode(encode(table(spark, folder, "documents").select("doc_id", "text"), path), path, digests=True)
