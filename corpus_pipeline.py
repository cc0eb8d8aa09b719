"""Corpus cleaning pipeline: five stages over ``documents``, each written as Parquet and reread by the next.

    run(spark, "/data/folder")
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helpweave.llm.bpe import decode, encode, tokenizer_path
from helpweave.llm.decontaminate import drop_contaminated
from helpweave.llm.minhash import near_duplicates
from helpweave.llm.substring import drop_repeats
from helpweave.llm.toxicity import score, train_toxicity
from helpweave.session import materialize, table


def _columns(docs: DataFrame, names: list[str]) -> DataFrame:
    return docs.select(*[F.col(f"`{n}`") for n in names])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labelled documents of the input folder."""
    model = train_toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return _columns(score(docs, model, into="toxicity_of_text").where("toxicity_of_text < 0.5"), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one of least id (five words, similarity 0.8).

    Of rows that repeat a kept id one stays, the one of least text; rows without an id stay.
    """
    found = near_duplicates(docs.select("doc_id", "text"), width=5)
    out = found.where("NOT kept").select("doc_id").distinct()
    kept = docs.join(out, "doc_id", "left_anti")
    # rows of one id: only where ids repeat, which the groups of exact copies do not show
    again = kept.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id")
    names = docs.columns
    single = kept.join(again, "doc_id", "left_anti")
    several = kept.join(again, "doc_id").groupBy("doc_id").agg(F.min_by(F.struct(*[F.col(f"`{n}`") for n in names]), F.coalesce("text", F.lit(""))).alias("row")).select("row.*")
    return _columns(single, names).unionByName(_columns(several, names))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that an earlier document has are cut; ``n_chars`` follows the text. All documents stay."""
    done = drop_repeats(docs, width=50, joined=False)
    n = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return _columns(done.withColumn("n_chars", n), docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, n_tokens, ids, decoded_matches`` of every document that is left.

    ``decoded_matches`` says that decoding the ids gives the text back.
    """
    path = tokenizer_path(spark)
    # written between, so that no task needs two Python workers at once: they stay, with their memory, through the stages of later runs
    done = materialize(encode(docs.select("doc_id", "lang", "source", "text", F.md5(F.coalesce("text", F.lit(""))).alias("sum")), path))
    back = decode(done, path, into="decoded", keep=True)
    return back.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.md5("decoded") == F.col("sum")).alias("decoded_matches"))


STAGES = [
    ("toxicity", toxicity),
    ("minhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", decontamination),
    ("bpe_encoding", tokens),
]

#: The trained classifier cannot be said in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a Parquet table in the session's shared folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
