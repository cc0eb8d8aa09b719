"""Scores, accuracy metrics and reports over result tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helpweave import lexicons as lx
from helpweave.functions import intent, text as tx
from helpweave.functions.text import accuracy_stems, col, dot
from helpweave.session import materialize


# --- confidence -----------------------------------------------------------------------
def confidence(grounding, validator, retrieval, path, weights: dict[str, float] = lx.SCORE_WEIGHTS):
    """Weighted mean of four signals, each clamped to [0, 1]; weights need not sum to one."""
    total = sum(weights.values())
    parts = {"grounding": grounding, "validator": validator, "retrieval": retrieval, "path": path}
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    raw = sum((weights.get(k, lx.SCORE_WEIGHTS[k]) / total) * clamp(col(c)) for k, c in parts.items())
    # rint of the scaled value follows the binary value, where decimal half-up would not
    return F.rint(clamp(raw) * 100) / 100


def calibration_error(scored: DataFrame, conf: str = "confidence", label: str = "label", bins: int = 10) -> DataFrame:
    """Expected calibration error over equal-width bins; the top bin is closed."""
    b = F.least(F.floor(F.col(conf) * bins), F.lit(bins - 1)).cast("int")
    per_bin = scored.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(label).alias("acc"), F.avg(conf).alias("conf"))
    total = F.sum("n")
    return per_bin.agg((F.sum(F.col("n") * F.abs(F.col("acc") - F.col("conf"))) / total).alias("ece"), total.alias("n"))


def fallback_label(has_article, n_actions, score):
    return (
        F.when(~col(has_article), "no_siis_context").when(F.coalesce(col(n_actions), F.lit(0)) == 0, "no_match")
        .when(col(score) < lx.LOW_CONFIDENCE, "low_confidence")
    )


# --- screens --------------------------------------------------------------------------
def eval_screens(predictions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Accuracy, parent-menu errors, manual compliance and mean relevance (2, 1 or 0)."""
    scored = F.col("expected_id").isNotNull()
    right = F.coalesce(F.col("expected_id") == F.col("predicted_id"), F.lit(False))
    wrong_level = F.coalesce(~right & (F.col("expected_page") != F.col("predicted_page")), F.lit(False))
    relevance = F.when(right, 2.0).when(wrong_level, 1.0).otherwise(0.0)
    manual = F.col("category") == "manual"
    return predictions.groupBy(*(by or [])).agg(
        F.coalesce(F.avg(F.when(scored, right.cast("double"))), F.lit(0.0)).alias("screen_accuracy"),
        F.coalesce(F.avg(F.when(scored, wrong_level.cast("double"))), F.lit(0.0)).alias("parent_menu_error_rate"),
        F.coalesce(F.avg(F.when(manual, F.col("predicted_id").isNull().cast("double"))), F.lit(1.0)).alias("manual_compliance"),
        F.avg(F.when(scored & (F.col("category") == "auto"), relevance)).alias("relevance"),
        F.count("*").alias("n_scenarios"),
    )


def failing_scenarios(predictions: DataFrame) -> DataFrame:
    """Ids of scored scenarios whose screen is wrong."""
    return predictions.where(F.col("expected_id").isNotNull() & ~F.coalesce(F.col("expected_id") == F.col("predicted_id"), F.lit(False))).select("scenario_id")


def check_link_integrity(links: DataFrame, catalog: DataFrame) -> DataFrame:
    """Links that are neither in the catalog nor placeholders."""
    known = catalog.select(F.col("deeplink").alias("link")).distinct()
    return links.where(F.col("link").isNotNull() & ~F.col("link").endswith(lx.PLACEHOLDER_SUFFIX)).join(known, "link", "left_anti")


def link_to_entry(links: DataFrame, catalog: DataFrame) -> DataFrame:
    """Catalog id of each link; the first entry wins when several share one link."""
    first = catalog.groupBy(F.col("deeplink").alias("link")).agg(F.min(F.struct("seq", "id")).alias("e")).select("link", F.col("e.id").alias("entry_id"))
    return links.join(first, "link", "left")


# --- device state ---------------------------------------------------------------------
def check_device_state(expectations: DataFrame, state: DataFrame) -> DataFrame:
    """Is the expected state already there? ``expectations``: plan_id, device_id, skey, result_type,
    condition, value; ``state``: device_id, skey, value. A missing boolean counts as off."""
    joined = expectations.join(state.withColumnRenamed("value", "actual"), ["device_id", "skey"], "left")
    want, have = F.col("value"), F.col("actual")
    as_bool = lambda c: F.lower(c) == "true"
    num = lambda c: c.try_cast("double")

    def compared(a, b):
        return F.when(F.col("condition") == "greater", a > b).when(F.col("condition") == "less", a < b).otherwise(a == b)

    met = (
        F.when(F.col("result_type") == "boolean", compared(F.coalesce(as_bool(have), F.lit(False)).cast("int"), as_bool(want).cast("int")))
        .when(F.col("result_type").isin("integer", "float"), compared(num(have), num(want)))
        .otherwise(compared(have, want))
    )
    return joined.withColumn("status", F.when(F.coalesce(met, F.lit(False)), "skip").otherwise("change"))


# --- probes ---------------------------------------------------------------------------
def probe_pairs(pairs: DataFrame, vocabulary: DataFrame, thresholds=(lx.SEMANTIC_MIN, lx.GATED_MIN, lx.VARIANT_MIN_SIMILARITY)) -> DataFrame:
    """Would the second text hit a store that holds only the first? One row per pair, no join of texts.

    With a single stored plan every term of the first text has document frequency 1 of 1, so its
    idf is one constant; other terms weigh 1.
    """
    import math

    known_weight = math.log(2 / 1.5) + 1.0
    df = tx.with_embedding(tx.with_embedding(pairs, "query_a", "_va"), "query_b", "_vb")
    df = intent.with_signature(intent.with_signature(df, "query_a", "_a_"), "query_b", "_b_")
    df = df.withColumns({"_ta": tx.lexical_tokens("query_a"), "_tb": tx.lexical_tokens("query_b")})
    # Setting words of both texts by one join per text word, not by a collected vocabulary.
    words = df.select("pair_id", F.explode_outer(F.array_distinct(F.concat("_ta", "_tb"))).alias("term")).join(vocabulary, "term", "left_semi")
    feats = words.groupBy("pair_id").agg(F.collect_set("term").alias("_f"))
    df = df.join(feats, "pair_id", "left").withColumn("_f", F.coalesce("_f", F.array().cast("array<string>")))
    df = df.withColumns({"_ca": intent.command_polarity("query_a"), "_cb": intent.command_polarity("query_b"), "_cos": F.round(dot("_va", "_vb"), 9)})

    def weight(side):
        def of(t):
            tf = F.size(side) - F.size(F.array_remove(side, t))
            return tf * F.when(F.array_contains(F.col("_ta"), t), F.lit(known_weight)).otherwise(F.lit(1.0))
        return of

    wa, wb = weight(F.col("_ta")), weight(F.col("_tb"))
    square = lambda ts, w: F.aggregate(F.array_distinct(ts), F.lit(0.0), lambda s, t: s + w(t) * w(t))
    both = F.aggregate(F.array_intersect("_ta", "_tb"), F.lit(0.0), lambda s, t: s + wa(t) * wb(t))
    df = df.withColumns({"_na": square(F.col("_ta"), wa), "_nb": square(F.col("_tb"), wb), "_ab": both})
    lexical = F.when((F.col("_na") > 0) & (F.col("_nb") > 0), F.col("_ab") / F.sqrt(F.col("_na") * F.col("_nb"))).otherwise(0.0)
    fa, fb = F.array_intersect("_f", "_ta"), F.array_intersect("_f", "_tb")
    conflict = (F.size(F.array_except(fa, fb)) > 0) & (F.size(F.array_except(fb, fa)) > 0)
    equal = tx.normalize_query("query_a") == tx.normalize_query("query_b")
    blended = F.round(0.5 * F.col("_cos") + 0.5 * lexical, 9)
    return df.select(
        *pairs.columns, F.col("_cos").alias("cosine"), blended.alias("blended"),
        (equal | (F.col("_cos") >= thresholds[0])).alias("hit_cosine"),
        (intent.gate("_a_", "_b_") & (equal | (F.col("_cos") >= thresholds[1]))).alias("hit_gated"),
        ((blended >= thresholds[2]) & ~intent.command_conflict("_ca", "_cb") & intent.relaxed_gate("_a_", "_b_") & ~conflict).alias("hit_variant"),
    )


def probe_report(probed: DataFrame, by: list[str]) -> DataFrame:
    return probed.groupBy(*by).agg(F.count("*").alias("n"), *[F.avg(F.col(c).cast("double")).alias(c) for c in ("hit_cosine", "hit_gated", "hit_variant")])


def probe_paraphrases(answers: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Paraphrase answers against their scenario's plan: hit flag and right-plan flag."""
    plan = scenarios.select("scenario_id", F.col("plan_id").alias("own_plan"))
    return answers.join(plan, "scenario_id", "left").select(
        "scenario_id", "paraphrase_id", F.col("plan_id").isNotNull().alias("hit"),
        F.coalesce(F.col("plan_id") == F.col("own_plan"), F.lit(False)).alias("right"),
    )


# --- step accuracy --------------------------------------------------------------------
def step_accuracy(steps: DataFrame, articles: DataFrame, headings: DataFrame) -> DataFrame:
    """Grounding, heading coverage and ordering per plan, each in [0, 1].

    ``steps``: plan_id, article_id, action_pos, action_name, category, step; ``articles``:
    article_id, text; ``headings``: article_id, heading. Stems meet by joins, not by packing
    the whole article into one row. These joins are merges, because stems outgrow the file their texts are made from.
    """
    words = articles.withColumn("st", accuracy_stems("text")).withColumn("stem", F.explode_outer("st")).select("article_id", "stem").where("stem IS NOT NULL")
    s = steps.select("plan_id", "article_id", "step").distinct()
    counts = steps.groupBy("plan_id", "article_id", "step").agg(F.count("*").alias("times"))
    step_stems = s.withColumn("st", accuracy_stems("step")).select("plan_id", "article_id", "step", F.size("st").alias("n"), F.explode_outer("st").alias("stem")).where("stem IS NOT NULL")
    met = step_stems.join(words.withColumn("m", F.lit(1)).hint("merge"), ["article_id", "stem"], "left").groupBy("plan_id", "article_id", "step", "n").agg(F.count("m").alias("met"))
    grounding = met.join(counts.hint("merge"), ["plan_id", "article_id", "step"]).groupBy("plan_id").agg(
        (F.sum(F.when(F.col("met") / F.col("n") >= 0.5, F.col("times")).otherwise(0)) / F.sum("times")).alias("grounding"))
    own = steps.select("plan_id", F.explode_outer(F.concat(accuracy_stems("step"), accuracy_stems("action_name"))).alias("stem")).where("stem IS NOT NULL").distinct()
    heads = headings.withColumn("st", accuracy_stems("heading")).select("article_id", "heading_pos", F.size("st").alias("n"), F.explode_outer("st").alias("stem")).where("stem IS NOT NULL")
    of_plan = steps.select("plan_id", "article_id").distinct().join(heads.hint("merge"), "article_id")
    covered = of_plan.join(own.withColumn("m", F.lit(1)).hint("merge"), ["plan_id", "stem"], "left").groupBy("plan_id", "heading_pos", "n").agg(F.count("m").alias("met"))
    completeness = covered.groupBy("plan_id").agg(F.avg((F.col("met") / F.col("n") >= 0.5).cast("double")).alias("completeness"))
    critical = F.col("category") == "critical"
    order = steps.groupBy("plan_id").agg(F.min(F.when(critical, F.col("action_pos"))).alias("c"), F.max(F.when(~critical, F.col("action_pos"))).alias("o"))
    order = order.select("plan_id", F.when(F.col("o") > F.col("c"), 0.0).otherwise(1.0).alias("ordering"))
    return order.join(grounding.hint("merge"), "plan_id", "left").join(completeness.hint("merge"), "plan_id", "left").select(
        "plan_id", F.coalesce("grounding", F.lit(0.0)).alias("grounding"), F.coalesce("completeness", F.lit(1.0)).alias("completeness"), "ordering")


# --- reports --------------------------------------------------------------------------
def compliance_report(steps: DataFrame, catalog: DataFrame, variants: DataFrame) -> DataFrame:
    """One row of schema, rule, leak, link and paraphrase counts over a results table; links and paraphrases can leak too."""
    known = catalog.select(F.col("deeplink").alias("link")).distinct().withColumn("known", F.lit(1))
    plans = steps.groupBy("plan_id").agg(F.first("goal").alias("goal"), F.first("title").alias("title"), F.first("score").alias("score"))
    n_words = F.size(tx.words("title"))
    plan_checks = [F.col("goal").rlike(r"^Follow these steps to perform this .+ (Troubleshooting|Configuration)\.?$"), n_words.between(2, 3), F.col("score").between(0, 1)]
    p = plans.agg(F.count("*").alias("rows"), sum(F.sum(c.cast("long")) for c in plan_checks).alias("plan_ok"))
    actions = steps.groupBy("plan_id", "action_pos").agg(
        F.first("description").alias("description"), F.first("category").alias("category"), F.min(F.col("link").isNotNull().cast("int")).alias("all_linked"))
    ok = F.col("description").startswith("It will") & F.size(tx.words("description")).between(5, 7)
    auto = F.col("category") == "auto"
    a = actions.agg(F.count("*").alias("actions"), F.sum(ok.cast("long")).alias("action_ok"), F.sum(auto.cast("long")).alias("auto"),
                    F.sum((auto & (F.col("all_linked") == 1)).cast("long")).alias("auto_linked"))
    groups = steps.groupBy("plan_id", "action_pos", "group_pos").agg(F.first("link", ignorenulls=True).alias("link")).where("link IS NOT NULL").join(known, "link", "left")
    g = groups.agg(F.count("*").alias("links"), F.sum((F.col("known").isNotNull() | F.col("link").endswith(lx.PLACEHOLDER_SUFFIX)).cast("long")).alias("links_ok"))
    texts = [c for c in ("goal", "title", "action_name", "description", "step", "link", "check_link") if c in steps.columns]
    leak = tx.any_of([F.coalesce(tx.contains_urls(c) & F.col(c).isNotNull(), F.lit(False)) for c in texts])
    whole = F.col("goal").isNotNull() & F.col("title").isNotNull() & F.col("score").isNotNull()
    named = F.col("action_pos").isNull() | (F.col("action_name").isNotNull() & F.col("description").isNotNull() & F.coalesce(F.col("category").isin(*lx.CATEGORIES), F.lit(True)))
    said = variants.groupBy("plan_id").agg(F.max(tx.contains_urls("text").cast("int")).alias("said"))
    each = steps.groupBy("plan_id").agg(F.max(leak.cast("int")).alias("leak"), F.min((whole & named).cast("int")).alias("valid"))
    k = each.join(said, "plan_id", "left").agg(F.sum(F.greatest("leak", F.coalesce("said", F.lit(0)))).alias("leaks"), F.sum("valid").alias("schema"))
    v = variants.groupBy("plan_id").agg(F.countDistinct("text").alias("n")).agg(F.sum(F.col("n").between(8, 10).cast("long")).alias("variations_ok"))
    out = p.withColumn("k", F.lit(1))
    for part in (a, g, k, v):
        out = out.join(part.withColumn("k", F.lit(1)), "k")
    return out.select("rows", (F.col("plan_ok") + F.col("action_ok")).alias("rules_ok"), (3 * F.col("rows") + F.col("actions")).alias("rules_total"),
                      "schema", "leaks", "links", "links_ok", "auto", "auto_linked", "variations_ok")


def latency_report(calls: DataFrame, value: str, percentiles=(50, 95), by: list[str] | None = None, exact: bool = True) -> DataFrame:
    """Nearest-rank percentiles per group.

    Exact values come from counts per distinct value, dealt by ranges of group and value, so that a group of most rows is spread over many tasks. The counts of the
    ranges (one row per group and range) give the rank at which each range begins, and only the ranges that hold a wanted rank are summed value by value. A null value is the
    least. ``exact=False`` uses Spark's bounded-memory sketch.
    """
    by = by or []
    if not exact:
        return calls.groupBy(*by).agg(*[F.percentile_approx(value, p / 100).alias(f"p{p}") for p in percentiles], F.count("*").alias("n"))
    counts = calls.groupBy(*by, value).agg(F.count("*").alias("c"))
    width = int(calls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = counts.repartitionByRange(width, *by, value).select(F.struct(F.lit(0).alias("_"), *by).alias("g"), F.col(value).alias("v"), "c", F.spark_partition_id().alias("range"))
    dealt = materialize(dealt)
    ranges = dealt.groupBy("g", "range").agg(F.sum("c").alias("held"))
    one = Window.partitionBy("g")
    before = F.coalesce(F.sum("held").over(one.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.withColumn("before", before).withColumn("n", F.sum("held").over(one))
    rank = {p: F.greatest(F.lit(1), F.least(F.col("n"), F.bround(F.lit(p / 100) * F.col("n") + 0.5, 0).cast("long"))) for p in percentiles}
    ranges = ranges.withColumns({f"k{p}": k for p, k in rank.items()})
    wanted = ranges.where(reduce(lambda a, b: a | b, [F.col(f"k{p}").between(F.col("before") + 1, F.col("before") + F.col("held")) for p in percentiles]))
    upto = F.col("before") + F.sum("c").over(Window.partitionBy("g", "range").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    rows = dealt.join(wanted, ["g", "range"]).withColumn("upto", upto)
    found = rows.groupBy("g").agg(*[F.min(F.when(F.col("upto") >= F.col(f"k{p}"), F.col("v"))).alias(f"p{p}") for p in percentiles], F.first("n").alias("n"))
    return found.select(*[F.col("g")[c].alias(c) for c in by], *[f"p{p}" for p in percentiles], "n")


def hit_report(answers: DataFrame, by: list[str]) -> DataFrame:
    """Hit rate, right-plan rate among hits, mean cost and count per group."""
    hit = F.col("hit").cast("double")
    return answers.groupBy(*by).agg(
        F.avg(hit).alias("hit_rate"), F.avg(F.when(F.col("hit"), F.col("right").cast("double"))).alias("right_rate"),
        F.avg("cost_usd").alias("mean_cost"), F.count("*").alias("n"))


def ablation(variants: dict[str, DataFrame]) -> DataFrame:
    """Accuracy, P95 and mean cost per tagged variant; each has scenario_id, correct, ms, cost_usd."""
    tagged = None
    for name, df in variants.items():
        part = df.select(F.lit(name).alias("variant"), "scenario_id", "correct", "ms", "cost_usd")
        tagged = part if tagged is None else tagged.unionByName(part)
    rates = tagged.groupBy("variant").agg(F.avg(F.col("correct").cast("double")).alias("accuracy"), F.avg("cost_usd").alias("mean_cost"))
    return rates.join(latency_report(tagged, "ms", (95,), ["variant"]), "variant")


def price_calls(calls: DataFrame, prices=lx.MODEL_PRICES) -> DataFrame:
    """List-price cost of model calls; an unknown model costs nothing. ``prices`` may be a table."""
    if not isinstance(prices, DataFrame):
        prices = calls.sparkSession.createDataFrame(list(prices), "model string, usd_in double, usd_out double")
    joined = calls.join(prices, "model", "left")
    cost = (F.col("input_tokens") * F.coalesce("usd_in", F.lit(0.0)) + F.col("output_tokens") * F.coalesce("usd_out", F.lit(0.0))) / 1e6
    return joined.withColumn("cost_usd", cost).drop("usd_in", "usd_out")


def union_scenarios(known: DataFrame, unseen: DataFrame) -> DataFrame:
    return known.withColumn("unseen", F.lit(False)).unionByName(unseen.withColumn("unseen", F.lit(True)))
