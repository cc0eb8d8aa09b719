"""Structured Streaming jobs: answering, store upkeep, counters, repeats, telemetry, sessions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helpweave.functions import intent
from helpweave.functions.text import normalize_query, query_hash
from helpweave.operators.similarity import match_cached
from helpweave.sources import store as st
from helpweave.sources.planlog import PlanLog


# --- stream transformations (they also run on a batch table) -----------------------------
def access_counts(stream: DataFrame, text: str = "query", ts: str = "ts") -> DataFrame:
    """Matches per query hash and the last time of each."""
    return stream.groupBy(query_hash(normalize_query(text)).alias("query_hash")).agg(F.count("*").alias("hits"), F.max(ts).alias("last_accessed_at"))


def suppress_repeats(stream: DataFrame, horizon: str, text: str = "query", ts: str = "ts") -> DataFrame:
    """Each normalised query passes once within the horizon."""
    return stream.withColumn("normalized", normalize_query(text)).withWatermark(ts, horizon).dropDuplicatesWithinWatermark(["normalized"])


def telemetry(stream: DataFrame, size: str, late: str, slide: str | None = None, ts: str = "ts") -> DataFrame:
    """Requests, hits, cost and latency percentiles per time window and path (``path, hit, cost_usd, ms``)."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return stream.withWatermark(ts, late).groupBy(w.alias("w"), "path").agg(
        F.count("*").alias("requests"), F.sum(F.col("hit").cast("int")).alias("hits"), F.sum("cost_usd").alias("cost_usd"),
        F.percentile_approx("ms", 0.5).alias("p50"), F.percentile_approx("ms", 0.95).alias("p95"))


def sessions(stream: DataFrame, gap: str, late: str, user: str = "user_id", text: str = "query", ts: str = "ts") -> DataFrame:
    """Complaint sessions per user: how many, which domains, from when to when."""
    signed = stream.withColumn("domain", intent.domain(text))
    return signed.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), user).agg(
        F.count("*").alias("n"), F.array_sort(F.collect_set("domain")).alias("domains"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


# --- sinks ----------------------------------------------------------------------------
def run_available(stream: DataFrame, mode: str, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process everything that is there in micro-batches, then stop."""
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start()
    q.awaitTermination()


def batch_files(folder: str) -> Callable[[DataFrame, int], None]:
    """Idempotent sink: one directory per batch, replaced if the batch is repeated."""
    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/batch={batch:08d}")
    return write


def last_state(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    """Latest emitted row per key over all batches."""
    df = spark.read.option("basePath", folder).parquet(f"{folder}/batch=*")
    rest = [c for c in df.columns if c not in keys and c != "batch"]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r"))
    return best.select(*keys, "r.*")


def stream_answers(store: DataFrame, folder: str, threshold: float | None = None) -> Callable[[DataFrame, int], None]:
    """Batch function: match each micro-batch of complaints to a store snapshot."""
    def answer(df: DataFrame, batch: int) -> None:
        found = match_cached(df.select("complaint_id", "query"), store, threshold)
        out = df.select("complaint_id").join(found, "complaint_id", "left")
        out.write.mode("overwrite").parquet(f"{folder}/batch={batch:08d}")
    return answer


def stream_write_back(spark: SparkSession, folder: str, compact_every: int = 16) -> Callable[[DataFrame, int], None]:
    """Batch function: add newly answered complaints to the plan log in ``folder``; the first answer of a query stays.

    A batch writes its own rows and nothing else; a repeated batch is left out. Every ``compact_every`` batches the buckets with many pieces are compacted.
    """
    log = PlanLog(spark, folder, first_stays=True)

    def write(df: DataFrame, batch: int) -> None:
        log.append(st.make_store(df.select("seq", "query")), batch)
        if (batch + 1) % compact_every == 0:
            log.compact()
    return write
