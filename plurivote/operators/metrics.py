"""Classification metrics, for any number of models in one grouped job.

Inputs are rows with a ``label`` and a ``pred`` column. All counts are plain sums,
so they are combined before the shuffle and only one row per group moves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plurivote.functions import scores as S
from plurivote.functions import text as T


def join_truth(predictions: DataFrame, truth: DataFrame, item: str = "item_id", label: str = "label") -> DataFrame:
    """Predictions with their label, aligned by item and not by position.

    Predictions without truth, and items a model never scored, have no row here;
    ``alignment`` counts both. Both sides are moved by item: the planner takes rows from an ``explode`` for as few as
    the items they were made of and would broadcast the predictions. A task holds its items' labels and streams the
    predictions past them, which are many times more and would have to be sorted and spilled in a merge.
    """
    return predictions.join(truth.select(item, label).hint("shuffle_hash"), item)


def alignment(predictions: DataFrame, truth: DataFrame, by: Sequence[str] = ("model_name", "epoch_no"), item: str = "item_id") -> DataFrame:
    """Per model: predictions with truth (``matched``), without (``no_truth``), and items it never scored (``missing``).

    An item counts once per model, however often it was scored. Join on this table to refuse models that are not complete.
    """
    items = truth.select(item).distinct()
    total = items.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    scored = predictions.select(*by, item).distinct().join(items.withColumn("_known", F.lit(True)), item, "left")
    counts = scored.groupBy(*by).agg(F.count("_known").alias("matched"), (F.count(F.lit(1)) - F.count("_known")).alias("no_truth"))
    return counts.withColumn("missing", total - F.col("matched"))


def _counts():
    pred, label = F.col("pred"), F.col("label")

    def rows(condition):
        return F.count(F.when(condition, 1))

    return [
        F.count(F.lit(1)).alias("n"),
        rows(pred == label).alias("_hit"),
        rows((pred == 1) & (label == 1)).alias("_tp"),
        rows((pred == 1) & (label != 1)).alias("_fp"),
        rows((pred != 1) & (label == 1)).alias("_fn"),
    ]


def _binary_columns():
    tp, fp, fn = F.col("_tp"), F.col("_fp"), F.col("_fn")
    return [
        S.ratio_or_zero(F.col("_hit"), F.col("n")).alias("accuracy"),
        S.precision(tp, fp).alias("precision"),
        S.recall(tp, fn).alias("recall"),
        S.f1(tp, fp, fn).alias("f1"),
    ]


def classification_metrics(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, and precision, recall and F1 of class 1 (0 where undefined)."""
    return df.groupBy(*by).agg(*_counts()).select(*by, "n", *_binary_columns())


def metrics_of_counts(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """The same from rows that already hold counts (``n, _hit, _tp, _fp, _fn``), added up per group."""
    sums = counts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("n", "_hit", "_tp", "_fp", "_fn")])
    return sums.select(*by, "n", *_binary_columns())


def per_class_counts(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """True positives, false positives and false negatives of every class."""
    cells = df.groupBy(*by, "label", "pred").agg(F.count(F.lit(1)).alias("_rows"))
    # Each (label, pred) cell counts once for its label and, on a miss, once for its prediction.
    hit = F.col("label") == F.col("pred")
    sides = F.array(
        F.struct(
            F.col("label").alias("class"),
            F.when(hit, F.col("_rows")).otherwise(0).alias("tp"),
            F.lit(0).cast("bigint").alias("fp"),
            F.when(hit, 0).otherwise(F.col("_rows")).cast("bigint").alias("fn"),
        ),
        F.struct(
            F.col("pred").alias("class"),
            F.lit(0).cast("bigint").alias("tp"),
            F.when(hit, 0).otherwise(F.col("_rows")).cast("bigint").alias("fp"),
            F.lit(0).cast("bigint").alias("fn"),
        ),
    )
    return (
        cells.select(*by, F.explode(sides).alias("_side"))
        .select(*by, "_side.*")
        .groupBy(*by, "class")
        .agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    )


def micro_metrics(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall and F1 from counts pooled over the classes."""
    pooled = per_class_counts(df, by).groupBy(*by).agg(
        F.sum("tp").alias("_tp"), F.sum("fp").alias("_fp"), F.sum("fn").alias("_fn")
    )
    tp, fp, fn = F.col("_tp"), F.col("_fp"), F.col("_fn")
    return pooled.select(
        *by,
        (tp + fn).alias("n"),
        S.ratio_or_zero(tp, tp + fn).alias("accuracy"),
        S.precision(tp, fp).alias("precision"),
        S.recall(tp, fn).alias("recall"),
        S.f1(tp, fp, fn).alias("f1"),
    )


def metric_average(num_labels: int) -> str:
    """Two classes score the positive one, more pool their counts."""
    return "micro" if num_labels > 2 else "binary"


def metrics(df: DataFrame, num_labels: int, by: Sequence[str] = ()) -> DataFrame:
    """The metrics that fit the number of classes."""
    pick = micro_metrics if metric_average(num_labels) == "micro" else classification_metrics
    return pick(df, by)


def batch_mean_metrics(df: DataFrame, batch: str, by: Sequence[str] = (), num_labels: int = 2) -> DataFrame:
    """Unweighted mean of per-batch metrics; a short last batch counts as much as a full one."""
    per_batch = metrics(df, num_labels, [*by, batch])
    return per_batch.groupBy(*by).agg(
        F.count(F.lit(1)).alias("batches"),
        *[F.avg(m).alias(m) for m in ("accuracy", "precision", "recall", "f1")],
    )


def cross_entropy(df: DataFrame, logits: str, label: str, by: Sequence[str] = (), batch: str | None = None) -> DataFrame:
    """Mean loss over rows (``loss``); with ``batch`` also the mean of batch means."""
    rows = df.select(*by, *([batch] if batch else []), S.row_cross_entropy(F.col(logits), F.col(label)).alias("_loss"))
    if batch is None:
        return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("_loss").alias("loss"))
    per_batch = rows.groupBy(*by, batch).agg(
        F.count(F.lit(1)).alias("_rows"), F.sum("_loss").alias("_sum"), F.avg("_loss").alias("_mean")
    )
    return per_batch.groupBy(*by).agg(
        F.sum("_rows").alias("n"),
        (F.sum("_sum") / F.sum("_rows")).alias("loss"),
        F.avg("_mean").alias("batch_mean_loss"),
    )


def confusion_matrix(
    df: DataFrame, classes: Sequence[int], by: Sequence[str] = (), labels: Sequence[int] | None = None
) -> DataFrame:
    """Rows per label, one ``pred_<class>`` count column per listed class, 0 where empty.

    Other predictions count in ``pred_other``, null ones in ``pred_null``. Every group has a row for
    every label in ``labels`` (by default ``classes``) and for labels that occur besides.
    """
    pred = F.col("pred")
    counts = [F.count(F.when(pred == c, 1)).alias(f"pred_{c}") for c in classes]
    counts.append(F.count(F.when(~pred.isin(*classes), 1)).alias("pred_other"))
    counts.append((F.count(F.lit(1)) - F.count("pred")).alias("pred_null"))
    counted = df.groupBy(*by, "label").agg(*counts)
    names = [c for c in counted.columns if c.startswith("pred_")]
    # A row of zeros for every label of every group, added to what was counted.
    wanted = F.explode(F.array(*[F.lit(c) for c in (labels or classes)]).cast(f"array<{dict(df.dtypes)['label']}>")).alias("label")
    groups = counted.select(*by).distinct() if by else df.sparkSession.range(1)
    zeros = groups.select(*by, wanted, *[F.lit(0).cast("bigint").alias(n) for n in names])
    return counted.unionByName(zeros).groupBy(*by, "label").agg(*[F.sum(n).alias(n) for n in names])


def evaluate_models(predictions: DataFrame, truth: DataFrame, num_labels: int = 2) -> DataFrame:
    """One result row per (model, epoch): test accuracy, test F1 and the epoch's tag."""
    scored = metrics(join_truth(predictions, truth), num_labels, ["model_name", "epoch_no"])
    return scored.select(
        "model_name",
        T.epoch_tag(F.col("epoch_no"), F.col("accuracy"), F.col("f1")).alias("model_epoch"),
        "epoch_no",
        F.col("accuracy").alias("test_accuracy"),
        F.col("f1").alias("test_f1"),
    )
