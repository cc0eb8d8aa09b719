"""The plan log against repeated upserts, and what a batch costs."""

import os
import random

import pytest
from pyspark.sql import functions as F

from helpweave.sources import store as st
from helpweave.sources.planlog import PlanLog

SHAPE = ("query_hash string, query string, normalized string, payload string, vec array<double>, polarity string, domain string, symptom string, trigger string, "
         "has_signature boolean, created_at long, last_accessed_at long, hit_count long")


def batch_rows(rng, n, keys, at):
    rows = []
    for k in rng.sample(range(keys), n):
        signed = rng.random() < 0.6
        sign = [f"p{at}", "Display", "none", f"t{k}"] if signed else [None] * 4
        rows.append((f"h{k}", f"q{k} {at}", f"n{k}", rng.choice([None, f"plan {at}"]), [float(at), 1.0] if signed else None, *sign, signed or None, at, 10 * at, rng.choice([0, None])))
    return rows


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def same(a, b):
    b = b.select(*a.columns)
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_log_equals_repeated_upserts(spark, tmp_path):
    rng = random.Random(9)
    folder, want = str(tmp_path / "log"), None
    for n in range(6):
        rows = spark.createDataFrame(batch_rows(rng, 40, 90, n), SHAPE)
        want = rows if want is None else st.upsert_plans(want, rows)
        want = spark.createDataFrame(want.collect(), SHAPE)
        log = PlanLog(spark, folder, buckets=4)  # a new process each time
        assert log.append(rows, n) and not log.append(rows.limit(3), n)
        assert same(log.read(), want)
        if n == 3:
            assert log.compact(least=9) == [] and sorted(log.compact(least=3)) == [0, 1, 2, 3]
            assert same(log.read(), want) and log.vacuum() == 16 and same(log.read(), want)
    log.compact(least=2)
    assert same(log.read(), want) and log.compact(least=2) == []
    log.vacuum()
    pieces = sorted(os.listdir(f"{folder}/data"))
    assert len(pieces) == 1 and len([f for f in os.listdir(f"{folder}/manifest") if f.endswith(".json") and not f.startswith(".")]) == 1
    picked = [f"h{k}" for k in (1, 5, 33)] + ["none"]
    assert same(log.read(picked), want.where(F.col("query_hash").isin(picked)))


def test_a_batch_costs_what_it_holds(spark, tmp_path):
    folder = str(tmp_path / "log")
    log = PlanLog(spark, folder, buckets=4, first_stays=True)
    log.append(spark.range(50_000).select(F.md5(F.col("id").cast("string")).alias("query_hash"), F.col("id").alias("seq")), 0)
    log.append(spark.range(49_990, 50_010).select(F.md5(F.col("id").cast("string")).alias("query_hash"), (F.col("id") + 1_000_000).alias("seq")), 1)
    assert size(f"{folder}/data/piece=2") < 0.02 * size(f"{folder}/data/piece=0")
    assert log.read().count() == 50_010 and log.read().where("seq >= 1000000").count() == 10
    assert sorted(log.compact(2)) == [0, 1, 2, 3] and log.read().where("seq >= 1000000").count() == 10


def test_an_unfinished_batch_is_not_seen(spark, tmp_path):
    folder = str(tmp_path / "log")
    log = PlanLog(spark, folder)
    with pytest.raises(FileNotFoundError):
        log.read()
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "query_hash string, seq long")
    log._write(rows, 0)  # lost before its commit
    assert log.manifest()["batch"] == -1
    assert log.append(rows.where("seq = 1"), 0) and [r["query_hash"] for r in log.read().collect()] == ["a"]
    assert log.append(rows.limit(0), 1) and log.read().count() == 1
