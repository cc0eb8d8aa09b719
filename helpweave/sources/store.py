"""Plan store as versioned parquet directories (upsert, read, access counts)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helpweave.functions import intent
from helpweave.functions.text import normalize_query, query_hash, with_embedding

KEEP_OLD = ["vec", *intent.SIGNATURE_FIELDS]


def make_store(rows: DataFrame, text: str = "query", embed=None) -> DataFrame:
    """Store rows from ``seq, query``: one per normalised query, the lowest ``seq`` wins."""
    keyed = rows.withColumn("normalized", normalize_query(text)).groupBy("normalized").agg(F.min(F.struct("seq", F.col(text).alias("query"))).alias("r"))
    out = keyed.select("r.seq", "r.query", "normalized").withColumn("query_hash", query_hash("normalized"))
    out = intent.with_signature(out, "query").withColumn("has_signature", F.lit(True))
    return out.withColumn("vec", embed(F.col("query"))) if embed else with_embedding(out, "query")


def upsert_plans(store: DataFrame, updates: DataFrame) -> DataFrame:
    """New store version: payload replaced, old embedding and signature kept when the new one is null.

    Both sides: query_hash, query, normalized, payload, vec, signature columns, created_at,
    last_accessed_at, hit_count. ``updates`` has at most one row per hash.
    """
    fields = [c for c in store.columns if c != "query_hash"]
    old = store.select("query_hash", *[F.col(c).alias("o_" + c) for c in fields])
    new = updates.select("query_hash", *[F.col(c).alias("n_" + c) for c in fields])
    both = old.join(new, "query_hash", "full_outer")
    is_new = F.col("o_created_at").isNull()
    updated = F.col("n_created_at").isNotNull()

    def pick(c):
        if c in ("query", "normalized", "created_at", "hit_count", "seq"):
            return F.coalesce("o_" + c, "n_" + c)
        if c == "payload":
            return F.when(updated, F.col("n_payload")).otherwise(F.col("o_payload"))
        if c in KEEP_OLD or c == "has_signature":
            return F.coalesce("n_" + c, "o_" + c)
        return F.when(updated, F.col("n_" + c)).otherwise(F.col("o_" + c))

    return both.select("query_hash", *[F.when(is_new, F.col("n_" + c)).otherwise(pick(c)).alias(c) for c in fields])


def apply_access_counts(store: DataFrame, matches: DataFrame) -> DataFrame:
    """Add hash matches (query_hash, ts) to the counters, whatever the gate said afterwards."""
    seen = matches.groupBy("query_hash").agg(F.count("*").alias("_n"), F.max("ts").alias("_ts"))
    return (
        store.join(seen, "query_hash", "left")
        .withColumn("hit_count", F.col("hit_count") + F.coalesce("_n", F.lit(0)))
        .withColumn("last_accessed_at", F.coalesce(F.greatest("last_accessed_at", "_ts"), "last_accessed_at"))
        .drop("_n", "_ts")
    )


def write_version(store: DataFrame, folder: str, version: int) -> str:
    """Write a new immutable version; readers of older versions are not disturbed."""
    path = f"{folder}/version={version:010d}"
    store.write.mode("overwrite").parquet(path)
    return path


def _versions(spark: SparkSession, folder: str) -> list[str]:
    """Complete versions (those with a success marker), oldest first."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [s.getPath().toString() for s in fs.listStatus(root)]
    return sorted(n for n in names if "version=" in n and fs.exists(jvm.org.apache.hadoop.fs.Path(n + "/_SUCCESS")))


def latest_version(spark: SparkSession, folder: str) -> int:
    found = _versions(spark, folder)
    return int(found[-1].rsplit("=", 1)[1]) if found else -1


def read_store(spark: SparkSession, folder: str, only_embedded: bool = False) -> DataFrame:
    """Latest version; ``only_embedded`` leaves out rows that cannot take part in similarity."""
    df = spark.read.parquet(_versions(spark, folder)[-1])
    return df.where("vec IS NOT NULL") if only_embedded else df


def clear_store(spark: SparkSession, folder: str) -> str:
    """Make an empty version the latest one."""
    return write_version(read_store(spark, folder).limit(0), folder, latest_version(spark, folder) + 1)
