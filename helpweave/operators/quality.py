"""Rule checks and deterministic repair over the long plan layout.

A plan table has one row per step: ``plan_id, goal, title, score, action_pos, action_name,
description, category, group_pos, step_pos, step, link, check_link``. Action-level jobs take the
same table without the step columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helpweave import lexicons as lx
from helpweave.functions import text as tx
from helpweave.functions.text import col, let, one_of
from helpweave.session import materialize


def _is_upper_initial(w) -> Column:
    c = F.substring(w, 1, 1)
    return (F.upper(c) == c) & (F.lower(c) != c)


def _clean(w) -> Column:
    return F.regexp_replace(w, r"(?U)[^\w]", "")


# --- predicates -----------------------------------------------------------------------
def goal_ok(goal) -> Column:
    return tx.strip(F.coalesce(col(goal), F.lit(""))).rlike("(?i)" + lx.GOAL_PATTERN.replace("(.+)", r"(.*\S.*)"))


def title_ok(title) -> Column:
    def check(ws):
        later = F.slice(ws, 2, 2)
        return (
            F.size(ws).isin(2, 3)
            & _is_upper_initial(F.get(ws, F.lit(0)))
            & F.forall(later, lambda w: one_of(F.lower(_clean(w)), lx.ABBREVIATIONS) | ~_is_upper_initial(_clean(w)))
        )

    return F.coalesce(let(tx.words(F.coalesce(col(title), F.lit(""))), check), F.lit(False))


def name_ok(name) -> Column:
    def check(ws):
        fine = F.transform(
            ws,
            lambda w, i: (w == "") | ((i > 0) & one_of(F.lower(w), lx.MINOR_WORDS)) | ~w.rlike(r"^\p{L}") | _is_upper_initial(w),
        )
        return (F.size(ws) > 0) & F.forall(fine, lambda x: x)

    return let(F.transform(tx.words(F.coalesce(col(name), F.lit(""))), _clean), check)


def description_ok(description) -> Column:
    return tx.strip(F.coalesce(col(description), F.lit(""))).startswith("It will")


def description_length_odd(description) -> Column:
    return let(F.size(tx.words(col(description))), lambda n: (n < 4) | (n > 20))


def step_verb_known(step) -> Column:
    return one_of(F.lower(_clean(F.coalesce(F.get(tx.words(col(step)), F.lit(0)), F.lit("")))), lx.RULE_VERBS)


def score_ok(score) -> Column:
    return col(score).between(0.0, 1.0)


def ordering_broken(actions: DataFrame) -> DataFrame:
    """Flag non-critical actions that come after a critical one."""
    before = Window.partitionBy("plan_id").orderBy("action_pos").rowsBetween(Window.unboundedPreceding, -1)
    critical = (F.col("category") == "critical").cast("int")
    return actions.withColumn("misplaced", (F.coalesce(F.max(critical).over(before), F.lit(0)) == 1) & (critical == 0))


# --- report ---------------------------------------------------------------------------
def action_level(steps: DataFrame) -> DataFrame:
    linked = F.max(F.col("link").isNotNull()).alias("linked")
    return steps.groupBy("plan_id", "action_pos").agg(
        F.first("action_name").alias("action_name"), F.first("description").alias("description"),
        F.first("category").alias("category"), linked, F.count("step").alias("n_steps"),
    )


def _marked(steps: DataFrame) -> DataFrame:
    """Step rows with the first row of each plan, action and step group marked, and what the rules need to know of each of them.

    All windows divide the rows of one plan, so one shuffle and one sort serve every level.
    """
    levels = {"plan": ["plan_id"], "action": ["plan_id", "action_pos"], "group": ["plan_id", "action_pos", "group_pos"]}
    order = ["action_pos", "group_pos", "step_pos"]
    one = {k: Window.partitionBy(*keys) for k, keys in levels.items()}
    row = {k: F.row_number().over(one[k].orderBy(*order[len(keys) - 1 :])) == 1 for k, keys in levels.items()}
    earlier = one["plan"].orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    critical = (F.col("category") == "critical").cast("int")
    df = steps.withColumns({
        "first_of_plan": row["plan"], "first_of_action": row["action"] & F.col("action_pos").isNotNull(),
        "first_of_group": row["group"] & F.col("action_pos").isNotNull() & F.col("group_pos").isNotNull(),
        "n_actions": F.count("action_pos").over(one["plan"]), "linked": F.max(F.col("link").isNotNull()).over(one["action"]),
        "n_steps": F.count("step").over(one["group"]), "group_link": F.max("link").over(one["group"]), "group_check": F.max("check_link").over(one["group"]),
        "after_critical": F.coalesce(F.max(F.when(F.col("action_pos").isNotNull(), critical)).over(earlier), F.lit(0)) == 1,
    })
    misplaced = F.coalesce(F.col("after_critical") & (critical == 0) & F.col("action_pos").isNotNull(), F.lit(False))
    df = df.withColumn("misplaced", misplaced)
    return df.withColumn("first_misplaced", F.col("misplaced") & (F.coalesce(F.sum(F.col("misplaced").cast("int")).over(earlier), F.lit(0)) == 0))


def _rules() -> list[tuple[str, str, str, Column]]:
    """Level, name, severity and failure of every rule, over the rows of ``_marked``."""
    leak = lambda c: F.coalesce(tx.contains_urls(c) & F.col(c).isNotNull(), F.lit(False))
    return [
        ("plan", "goal_syntax", "error", ~goal_ok("goal")),
        ("plan", "title_format", "error", ~title_ok("title")),
        ("plan", "score_range", "error", ~F.coalesce(score_ok("score"), F.lit(False))),
        ("plan", "no_actions", "warning", F.col("n_actions") == 0),
        ("action", "action_name_format", "error", ~name_ok("action_name")),
        ("action", "description_format", "error", ~description_ok("description")),
        ("action", "description_length", "warning", description_ok("description") & description_length_odd("description")),
        ("action", "action_category", "error", ~F.coalesce(F.col("category").isin(*lx.CATEGORIES), F.lit(False))),
        ("action", "manual_link", "error", (F.col("category") == "manual") & F.col("linked")),
        ("action", "name_url", "error", tx.contains_urls("action_name")),
        ("action", "description_url", "error", tx.contains_urls("description")),
        ("order", "action_ordering", "error", F.col("first_misplaced")),
        ("group", "empty_group", "error", F.col("n_steps") == 0),
        ("group", "link_url", "error", leak("group_link")),
        ("group", "check_link_url", "error", leak("group_check")),
        ("step", "step_url", "error", tx.contains_urls("step")),
        ("step", "step_empty", "error", tx.strip("step") == ""),
        ("step", "step_verb", "warning", ~tx.contains_urls("step") & (tx.strip("step") != "") & ~step_verb_known("step")),
    ]


def _levels() -> dict[str, Column]:
    """Rows on which the rules of a level are checked."""
    return {"plan": F.col("first_of_plan"), "action": F.col("first_of_action"), "group": F.col("first_of_group"), "step": F.col("step").isNotNull(), "order": F.lit(True)}


def validate_plans(steps: DataFrame) -> DataFrame:
    """Every rule violation: ``plan_id, rule, severity, action_pos, step_pos``.

    Each rule is checked once per plan, action, step group or step, on the first row of it. Findings about groups (no steps, a web address as link) count once per
    group, and a plan's ordering is one finding, at its first misplaced action. A plan without actions has one warning and no finding below the plan; an action without
    groups has none about groups.
    """
    none = F.lit(None).cast("int")
    levels = _levels()

    def finding(level, rule, severity, failed):
        at = none if level == "plan" else F.col("action_pos").cast("int")
        return F.when(levels[level] & failed, F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), at.alias("action_pos"), (F.col("step_pos").cast("int") if level == "step" else none).alias("step_pos")))

    found = _marked(steps).select("plan_id", F.array_compact(F.array(*[finding(*c) for c in _rules()])).alias("found"))
    # outer explode: a plain one would push a copy of every check into a filter below it
    return found.select("plan_id", F.explode_outer("found").alias("v")).where("v IS NOT NULL").select("plan_id", "v.*")


def with_rejected(steps: DataFrame) -> DataFrame:
    """``steps`` with ``rejected``: whether ``validate_plans`` finds an error in the row's plan.

    Rules are cases of one condition, which Spark compiles (inside a list of findings they would be interpreted) and cuts into methods that the JVM compiles too (one
    long "or" is a single method beyond its limit). All windows divide a plan's rows. A row without ``plan_id`` belongs to no plan.
    """
    levels = _levels()
    broken = tx.first_case([(levels[level] & failed, F.lit(True)) for level, _, severity, failed in _rules() if severity == "error"], F.lit(False))
    found = _marked(steps).withColumn("_broken", broken)
    rejected = F.max("_broken").over(Window.partitionBy("plan_id")) & F.col("plan_id").isNotNull()
    return found.select(*steps.columns, rejected.alias("rejected"))


def plan_validity(steps: DataFrame) -> DataFrame:
    """Error and warning counts per plan, with the pass rate used by the score."""
    found = validate_plans(steps).groupBy("plan_id").agg(
        F.count(F.when(F.col("severity") == "error", 1)).alias("errors"),
        F.count(F.when(F.col("severity") == "warning", 1)).alias("warnings"),
    )
    out = steps.select("plan_id").distinct().join(found, "plan_id", "left").fillna(0, ["errors", "warnings"])
    return out.withColumn("is_valid", F.col("errors") == 0).withColumn("pass_rate", pass_rate(F.col("errors")))


def pass_rate(errors) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - lx.ERROR_PENALTY * col(errors))


def raise_if_invalid(steps: DataFrame) -> None:
    """Strict mode: fail the job when any plan has an error."""
    bad = validate_plans(steps).where("severity = 'error'").count()
    if bad:
        raise ValueError(f"{bad} rule violations")


# --- repair ---------------------------------------------------------------------------
def scrub_plans(steps: DataFrame) -> DataFrame:
    return steps.withColumns({c: tx.scrub_urls(c) for c in ("goal", "title", "action_name", "description", "step") if c in steps.columns})


def repair_goal(goal) -> Column:
    lead = F.regexp_replace(tx.strip(goal), "(?i)" + lx.GOAL_LEAD, "")
    topic = tx.strip(F.regexp_replace(lead, "(?i)" + lx.GOAL_TAIL, ""))
    topic = let(topic, lambda t: F.when(t == "", F.lit("Device")).otherwise(t))
    fixed = F.concat(F.lit("Follow these steps to perform this "), tx.title_case(topic), F.lit(" Troubleshooting"))
    return F.when(goal_ok(goal), col(goal)).otherwise(fixed)


def repair_title(title) -> Column:
    fitted = let(tx.fit_title(title), lambda t: F.when(title_ok(t), t).otherwise(tx.sentence_case(t)))
    return F.when(title_ok(title), tx.squash(title)).otherwise(fitted)


def repair_name(name) -> Column:
    return F.when(name_ok(name), col(name)).otherwise(tx.title_case(name))


def repair_description(description) -> Column:
    def prefixed(d):
        low = F.lower(d)
        rest = F.when(d == "", F.lit("resolve this issue")).otherwise(F.concat(F.lower(F.substring(d, 1, 1)), F.substring(d, 2, 1_000_000)))
        return (
            F.when(d.startswith("It will"), d)
            .when(low.startswith("it will"), F.concat(F.lit("It will"), F.substring(d, 8, 1_000_000)))
            .when(low.startswith("this will"), F.concat(F.lit("It will"), F.substring(d, 10, 1_000_000)))
            .otherwise(F.concat(F.lit("It will "), rest))
        )

    return tx.fit_description(let(tx.strip(description), prefixed))


def critical_last(actions: DataFrame, keep: str | None = None) -> DataFrame:
    """Renumber actions with the critical ones moved, in order, to the end."""
    w = Window.partitionBy("plan_id").orderBy((F.coalesce(F.col("category"), F.lit("manual")) == "critical").cast("int"), "action_pos")
    out = actions.withColumn("_pos", (F.dense_rank().over(w) - 1).cast("int"))
    if keep:
        out = out.withColumn(keep, F.col("action_pos"))
    return out.withColumn("action_pos", F.col("_pos")).drop("_pos")


def _once(df: DataFrame, keys: list[str], fixes: dict[str, Column]) -> DataFrame:
    """Columns that all rows of ``keys`` share, computed on their first row alone and given to all of them."""
    rows = Window.partitionBy(*keys)
    order = [c for c in ("action_pos", "group_pos", "step_pos") if c in df.columns and c not in keys]
    lead = F.row_number().over(rows.orderBy(*order)) == 1 if order else F.lit(True)
    df = df.withColumn("_lead", lead)
    df = df.withColumns({f"_{c}": F.when(F.col("_lead"), fix) for c, fix in fixes.items()})
    return df.withColumns({c: F.max(f"_{c}").over(rows) for c in fixes}).drop("_lead", *[f"_{c}" for c in fixes])


def repair_plans(steps: DataFrame) -> DataFrame:
    """Scrub, phrase, case, clamp, strip links of manual actions and move critical actions last.

    Texts of a plan or an action are repaired once, on its first row; all windows divide a plan's rows, so the plan is shuffled once.
    """
    manual = F.col("category") == "manual"
    clean = tx.scrub_urls
    df = _once(steps, ["plan_id"], {c: let(clean(c), f) for c, f in (("goal", repair_goal), ("title", repair_title))})
    df = _once(df, ["plan_id", "action_pos"], {c: let(clean(c), f) for c, f in (("action_name", repair_name), ("description", repair_description))})
    fixes = {"score": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score").cast("double")))}
    if "step" in df.columns:
        fixes["step"] = clean("step")
    for c in ("link", "check_link", "link_struct", "check_struct", "link_description", "link_message", "link_type"):
        if c in df.columns:
            fixes[c] = F.when(manual, None).otherwise(F.col(c))
    return critical_last(df.withColumns(fixes))


def repair_then_split(steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repaired plans that pass every rule, and the rest.

    Rules are checked where plans are repaired: their rows are shuffled once, by plan (not at all if they are dealt by plan), and written once.
    """
    repaired = materialize(with_rejected(repair_plans(steps)))
    return repaired.where("NOT rejected").drop("rejected"), repaired.where("rejected").drop("rejected")


def reset_links(steps: DataFrame) -> DataFrame:
    """Freshly extracted plans carry no links."""
    return steps.withColumns({c: F.lit(None).cast("string") for c in ("link", "check_link")})


def order_actions(actions: DataFrame) -> DataFrame:
    """Safe first: automatic, manual, critical; the given order inside each."""
    weight = F.coalesce(tx.first_case([(F.col("category") == c, n) for c, n in lx.CATEGORY_ORDER.items()], lx.CATEGORY_ORDER["manual"]), F.lit(1))
    w = Window.partitionBy("plan_id").orderBy(weight, "action_pos")
    return actions.withColumn("_pos", (F.dense_rank().over(w) - 1).cast("int")).withColumn("action_pos", F.col("_pos")).drop("_pos")
