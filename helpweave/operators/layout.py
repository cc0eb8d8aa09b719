"""Nested goals to the long layout and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helpweave import schemas

LONG = ["plan_id", "goal", "title", "score", "action_pos", "action_name", "description", "category", "group_pos", "step_pos", "step"]


def flatten_plans(goals: DataFrame) -> DataFrame:
    """``plan_id, goal struct`` to one row per step; empty groups and actions keep one row."""
    a = goals.select("plan_id", "goal.goal", "goal.title", "goal.score", F.posexplode_outer("goal.actions").alias("action_pos", "a"))
    g = a.select("plan_id", "goal", "title", "score", "action_pos", F.col("a.actionName").alias("action_name"), "a.description",
                 F.coalesce("a.category", F.lit("manual")).alias("category"), F.posexplode_outer("a.stepGroups").alias("group_pos", "g"))
    return g.select(*LONG[:8], "group_pos", F.col("g.actionableDeeplink").alias("link_struct"), F.col("g.validationDeeplink").alias("check_struct"),
                    F.posexplode_outer("g.steps").alias("step_pos", "step"))


def _struct_of(kind: str, source: dict[str, str], columns: list[str]):
    """Exchange struct of type ``kind`` from flat columns; null where its ``deeplink`` is."""
    fields = [f.split(":", 1) for f in kind[len("struct<"):-1].replace("map<string,string>", "map<string;string>").split(",")]
    cells = [
        (F.col(source[n]) if source.get(n) in columns else F.lit(None)).cast(t.replace(";", ",")).alias(n) for n, t in fields
    ]
    return F.when(F.col(source["deeplink"]).isNotNull(), F.struct(*cells))


def with_link_structs(steps: DataFrame) -> DataFrame:
    """Add ``link_struct`` and ``check_struct`` where only the flat columns of the pipeline are there."""
    out = steps
    if "link_struct" not in out.columns and "link" in out.columns:
        source = {"deeplink": "link", "description": "link_description", "message": "link_message", "originalType": "link_type"}
        out = out.withColumn("link_struct", _struct_of(schemas.LINK, source, out.columns))
    if "check_struct" not in out.columns and "check_link" in out.columns:
        source = {"deeplink": "check_link", "key": "check_key", "resultType": "check_result_type", "condition": "check_condition", "value": "check_value"}
        out = out.withColumn("check_struct", _struct_of(schemas.CHECK, source, out.columns))
    return out


def assemble_plans(steps: DataFrame) -> DataFrame:
    """One row per step to ``plan_id, goal struct``; order comes from the position columns.

    Links come from ``link_struct`` and ``check_struct``, or from the flat columns that the pipeline makes.
    """
    steps = with_link_structs(steps)
    links = [c for c in ("link_struct", "check_struct") if c in steps.columns]
    groups = steps.groupBy("plan_id", "action_pos", "group_pos").agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in ["goal", "title", "score", "action_name", "description", "category", *links]],
        F.array_sort(F.collect_list(F.when(F.col("step").isNotNull(), F.struct("step_pos", "step")))).alias("s"),
    )
    group = F.struct(
        "group_pos", F.transform("s", lambda x: x["step"]).alias("steps"),
        (F.col("link_struct") if "link_struct" in links else F.lit(None).cast("string")).alias("actionableDeeplink"),
        (F.col("check_struct") if "check_struct" in links else F.lit(None).cast("string")).alias("validationDeeplink"),
    )
    head = ["goal", "title", "score"]
    acts = groups.groupBy("plan_id", "action_pos").agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in [*head, "action_name", "description", "category"]],
        F.collect_list(F.when(F.col("group_pos").isNotNull(), group)).alias("g"),
    )
    by_pos = F.array_sort("g", lambda x, y: F.signum(x["group_pos"] - y["group_pos"]).cast("int"))
    acts = acts.withColumn("stepGroups", F.transform(by_pos, lambda x: F.struct(
        x["steps"].alias("steps"), x["validationDeeplink"].alias("validationDeeplink"), x["actionableDeeplink"].alias("actionableDeeplink"))))
    action = F.struct("action_pos", F.struct(F.col("action_name").alias("actionName"), "description", "stepGroups", "category").alias("a"))
    plans = acts.groupBy("plan_id").agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in head], F.collect_list(F.when(F.col("action_pos").isNotNull(), action)).alias("as"),
    )
    ordered = F.array_sort("as", lambda x, y: F.signum(x["action_pos"] - y["action_pos"]).cast("int"))
    return plans.select("plan_id", F.struct("goal", "title", F.transform(ordered, lambda x: x["a"]).alias("actions"), "score").alias("goal"))
