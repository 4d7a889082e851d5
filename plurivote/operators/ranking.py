"""Choosing epochs and runs from a score table (one row per model and epoch)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def best_epoch_with_ties(scores: DataFrame, metric: str, model: str = "model_name") -> DataFrame:
    """Every epoch that reaches its model's best value."""
    best = F.max(metric).over(Window.partitionBy(model))
    return scores.withColumn("_best", best).where(F.col(metric) == F.col("_best")).drop("_best")


def best_epoch_single(scores: DataFrame, metric: str, by: Sequence[str] = ("model_name",)) -> DataFrame:
    """One row per model: the best value, the earliest epoch on ties. No by: the best row of all."""
    row = F.struct(*scores.columns)
    best = F.max_by(row, F.struct(F.col(metric), -F.col("epoch_no"))).alias("_row")
    return scores.where(F.col(metric).isNotNull()).groupBy(*by).agg(best).select("_row.*")


def epoch_rank_both_metrics(scores: DataFrame, metric: str, other: str, model: str = "model_name") -> DataFrame:
    """Best epoch by one metric, with its standing on the other one."""
    per_model = Window.partitionBy(model)
    return (
        scores.withColumn(f"rank_{metric}", F.dense_rank().over(per_model.orderBy(F.desc(metric))))
        .withColumn(f"rank_{other}", F.dense_rank().over(per_model.orderBy(F.desc(other))))
        .where(F.col(f"rank_{metric}") == 1)
    )


def stage_registry(chosen: DataFrame, stage: str, next_stage: str) -> DataFrame:
    """Which saved epoch feeds which next stage."""
    return chosen.select(
        F.lit(next_stage).alias("stage"),
        "model_name",
        "model_epoch",
        F.concat_ws("/", F.lit(stage), "model_name", "model_epoch").alias("parent"),
    )


def lineage(registry: DataFrame, model: str = "model", parent: str = "parent") -> DataFrame:
    """Every model with all models it was trained on from, nearest first: ``model, ancestor, steps, is_first``.

    ``registry`` names each model's direct parent (null: trained from the beginning); it is as long as the list of
    models. A model is its own ancestor at 0 steps; a parent that is not registered ends the chain. A circle fails at the
    session's ``spark.sql.cteRecursionLevelLimit``.
    """
    spark = registry.sparkSession
    named = registry.select(F.col(model).alias("model"), F.col(parent).alias("parent"))
    chains = spark.sql(
        """WITH RECURSIVE chain(model, ancestor, above, steps) AS (
            SELECT model, model, parent, 0 FROM {registry}
            UNION ALL
            SELECT c.model, r.model, r.parent, c.steps + 1 FROM chain c JOIN {registry} r ON r.model = c.above)
        SELECT model, ancestor, steps, above IS NULL OR above NOT IN (SELECT model FROM {registry} WHERE model IS NOT NULL) AS is_first FROM chain""",
        registry=named,
    )
    return chains


def is_control(model: str = "model_name"):
    return F.col(model).rlike("control")


def better_than_control(candidates: DataFrame, control: DataFrame, metrics: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Rows above the best control value, counted per metric."""
    counts = [
        F.count(F.when(F.col(m) > control.select(F.max(m)).scalar(), 1)).alias(f"better_{m}") for m in metrics
    ]
    return candidates.groupBy(*by).agg(F.count(F.lit(1)).alias("candidates"), *counts)
