"""Groups and keys that hold most rows: equal results, and no task that holds them whole."""

import random

from pyspark.sql import functions as F

from helpweave.operators import evaluate as ev, ground


def nearest_rank(values, p):
    values = sorted(values)
    k = max(1, min(len(values), round(p / 100 * len(values) + 0.5)))
    return values[k - 1]


def test_percentiles_of_a_group_of_most_rows(spark):
    rng = random.Random(1)
    rows = [("big" if rng.random() < 0.9 else rng.choice(["a", "b", None]), round(rng.lognormvariate(3, 1), 3)) for _ in range(20_000)] + [("one", 5.0), ("two", 1.0), ("two", 2.0)]
    df = spark.createDataFrame(rows, "path string, ms double")
    got = {r["path"]: (r["p50"], r["p95"], r["p99"], r["n"]) for r in ev.latency_report(df, "ms", (50, 95, 99), ["path"]).collect()}
    groups = {}
    for g, v in rows:
        groups.setdefault(g, []).append(v)
    assert got == {g: (*(nearest_rank(v, p) for p in (50, 95, 99)), len(v)) for g, v in groups.items()}
    whole = ev.latency_report(df, "ms").first()
    assert (whole["p50"], whole["p95"], whole["n"]) == (nearest_rank([v for _, v in rows], 50), nearest_rank([v for _, v in rows], 95), len(rows))
    assert ev.latency_report(df.limit(0), "ms", (50,), ["path"]).collect() == []


def test_percentile_ranges_spread_the_large_group(spark):
    df = spark.range(50_000).select(F.when(F.col("id") % 10 > 0, "big").otherwise("small").alias("path"), (F.hash("id") % 100_000).cast("double").alias("ms"))
    counts = df.groupBy("path", "ms").agg(F.count("*").alias("c"))
    parts = counts.repartitionByRange(8, "path", "ms").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert max(r["count"] for r in parts) < 0.3 * counts.count()


def test_grounding_an_article_that_has_most_steps(spark):
    rng = random.Random(2)
    words = ["tap", "display", "toggle", "brightness", "battery", "open", "settings", "mode", "network", "reset"]
    sentence = lambda: " ".join(rng.choices(words, k=6)).capitalize() + "."
    articles = spark.createDataFrame([(i, " ".join(sentence() for _ in range(12))) for i in range(3)], "article_id long, text string")
    steps = [(0 if rng.random() < 0.9 else rng.choice([1, 2, 7]), f"{sentence()[:-1]} number {i}.") for i in range(900)] + [(0, "zzz."), (0, None)]
    steps = spark.createDataFrame(steps, "article_id long, step string")
    shape = ["article_id", "step", "overlap", "sentence_pos", "sentence"]
    whole = ground.ground_steps(steps, articles).select(*shape)
    dealt = ground.ground_steps(steps, articles, part_steps=50).select(*shape)
    assert whole.exceptAll(dealt).count() == 0 and dealt.exceptAll(whole).count() == 0
    assert dealt.where("overlap > 0").count() > 500


def made_wide(df):
    """Broadcasts that were not asked for."""
    plan = df._jdf.queryExecution()
    return plan.executedPlan().toString().count("BroadcastHashJoin") - plan.optimizedPlan().toString().count("strategy=broadcast")


def test_texts_made_from_a_small_file_are_not_broadcast(spark, tmp_path):
    spark.range(2000).write.parquet(str(tmp_path / "ids"))
    ids = spark.read.parquet(str(tmp_path / "ids"))
    articles = ids.select(F.col("id").alias("article_id"), F.repeat(F.lit("Tap Display, then tap Battery. "), 40).alias("text"))
    steps = ids.select(F.col("id").alias("plan_id"), F.col("id").alias("article_id"), F.lit(0).alias("action_pos"), F.lit("Act").alias("action_name"), F.lit(0).alias("group_pos"),
                       F.lit(0).alias("step_pos"), F.lit("Tap Battery.").alias("step"), F.lit("auto").alias("category"))
    kept, coverage, _ = ground.filter_grounded(steps, articles)
    # those that are left hold one row per article of many steps
    found = ground.ground_steps(steps, articles)
    assert made_wide(found) == made_wide(kept) == made_wide(coverage) == 0
    heads = articles.select("article_id", F.lit(0).alias("heading_pos"), F.lit("Display Battery").alias("heading"))
    assert made_wide(ev.step_accuracy(steps, articles, heads)) == 0
    assert coverage.where("coverage = 1").count() == 2000


def test_rows_of_a_task_do_not_grow_with_the_input(spark):
    from helpweave.operators import quality as ql
    from helpweave.session import deal

    n = spark.sparkContext.defaultParallelism
    ids = spark.range(1000).select(F.col("id").alias("plan_id"))
    assert deal(ids, 1000, task_rows=10).rdd.getNumPartitions() == 100 and deal(ids, 10).rdd.getNumPartitions() == n
    empty = F.lit(None).cast("string")
    steps = ids.select("plan_id", *[F.lit("x").alias(c) for c in ("goal", "title", "action_name", "description", "category", "step")], F.lit(0.5).alias("score"),
                       *[F.lit(0).alias(c) for c in ("action_pos", "group_pos", "step_pos")], empty.alias("link"), empty.alias("check_link"))
    found = ql.validate_plans(deal(steps, 1000, "plan_id", task_rows=10))
    # the windows keep the given partitions
    assert found.rdd.getNumPartitions() == 100 and found.where("rule = 'goal_syntax'").count() == 1000
