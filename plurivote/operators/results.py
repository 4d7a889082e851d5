"""Analysis of score tables, prediction rates and ensemble tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plurivote.functions import scores as S
from plurivote.functions import text as T
from plurivote.session import settle, small_side

METRICS = ("test_f1", "test_accuracy")


def with_display_name(scores: DataFrame, prefixes: Sequence[str], renames: dict[str, str]) -> DataFrame:
    """Add the model's family and the name shown for it."""
    family = T.model_family(F.col("model_name"))
    return scores.withColumn("model_cat", family).withColumn(
        "model_display_name", T.display_name(F.col("model_cat"), prefixes, renames)
    )


def sort_case_insensitive(df: DataFrame, column: str, *then: str) -> DataFrame:
    """Order by lower-cased name, then by the name itself and the given columns."""
    return df.orderBy(F.lower(column), column, *then)


def sorted_positions(df: DataFrame, column: str, *then: str) -> DataFrame:
    """Every row with its place in the case-insensitive order, counted from 1.

    The rows are sorted in range parts; a place is the part's offset and the place inside
    it, so no task sees more than its part.
    """
    ordered = settle(sort_case_insensitive(df, column, *then).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    parts = ordered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))  # one row per part
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = small_side(parts.select("_part", before.alias("_before")))
    place = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before") + 1
    return ordered.withColumn("_part", part).join(offsets, "_part").withColumn("position", place.cast("int")).drop("_id", "_part", "_before")


def round_scores(scores: DataFrame, columns: Sequence[str] = METRICS, places: int = 2) -> DataFrame:
    return scores.withColumns({c: S.round_scaled(F.col(c), places) for c in columns})


def score_summary_by_family(scores: DataFrame, family: str, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Least, largest and median score. The input has one row per model and epoch."""
    return scores.groupBy(family).agg(
        *[
            f(m).alias(f"{m}_{name}")
            for m in metrics
            for name, f in (("min", F.min), ("max", F.max), ("median", F.median))
        ]
    )


def score_lists_by_family(scores: DataFrame, family: str, metrics: Sequence[str] = METRICS) -> DataFrame:
    """All scores of a family as sorted arrays. The input has one row per model and epoch."""
    return scores.groupBy(family).agg(*[F.sort_array(F.collect_list(m)).alias(m) for m in metrics])


def means_and_deltas(groups: DataFrame, by: str, group: str, control: str, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Mean scores per group and their distance to the control group's mean.

    Sums of the control rows are kept beside the group's own, inside each ``by``.
    """
    means = groups.groupBy(by, group).agg(*[F.avg(m).alias(f"mean_{m}") for m in metrics])
    whole = Window.partitionBy(by)
    deltas = [
        (F.col(f"mean_{m}") - F.max(F.when(F.col(group) == control, F.col(f"mean_{m}"))).over(whole)).alias(f"delta_{m}")
        for m in metrics
    ]
    return means.select(by, group, *[f"mean_{m}" for m in metrics], *deltas)


def top_ensembles(leaderboard: DataFrame, metric: str, n: int = 10) -> DataFrame:
    """The n best rows; type and id decide between equal scores."""
    return leaderboard.orderBy(F.desc(metric), F.desc("ensemble_type"), "ensemble_id").limit(n)


def inducer_counts(ensembles: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """How often each family occurs in the given ensembles."""
    return ensembles.select(*by, F.explode("inducers").alias("inducer")).groupBy(*by, "inducer").agg(
        F.count(F.lit(1)).alias("ensembles")
    )


def prediction_rates(predictions: DataFrame, classes: Sequence[int] = (0, 1)) -> DataFrame:
    """Rows predicted as each listed class and their share in percent of all rows, per model and epoch.

    ``n`` counts every prediction, also null ones and those of classes that are not listed.
    """
    counts = predictions.groupBy("model_name", "epoch_no").agg(
        F.count(F.lit(1)).alias("n"), *[F.count(F.when(F.col("pred") == c, 1)).alias(f"count_{c}") for c in classes]
    )
    return counts.select(
        "*", *[(100.0 * F.col(f"count_{c}") / F.col("n")).alias(f"percent_{c}") for c in classes]
    )


# Bounds of the rate bands, in percent. The strict ones leave gaps.
STRICT_BANDS = (("0-19", None, 19.0), ("20-49", 20.0, 49.0), ("50-70", 50.0, 69.9), ("70+", 70.0, None))
WHOLE_BANDS = (("0-20", None, 20.0), ("20-50", 20.0, 50.0), ("50-70", 50.0, 70.0), ("70+", 70.0, None))


def rate_bands(rates: DataFrame, percent: str, strict: bool = True) -> DataFrame:
    """Models per band of a percentage, 0 for a band without one; values in no band (and nulls) count as ``unbanded``.

    Strict bands are closed on both sides with gaps between them; the whole ones are
    half open and leave no gap.
    """
    value = F.col(percent)

    def inside(low, high):
        test = value.isNotNull() if low is None else value >= low
        if high is not None:
            test = test & ((value <= high) if strict else (value < high))
        return test

    bands = STRICT_BANDS if strict else WHOLE_BANDS
    band = reduce(lambda rest, b: F.when(inside(b[1], b[2]), b[0]).otherwise(rest), reversed(bands), F.lit("unbanded"))
    names = [b[0] for b in bands] + ["unbanded"]
    counted = rates.agg(*[F.count(F.when(band == name, 1)).alias(f"_{i}") for i, name in enumerate(names)])
    rows = F.array(*[F.struct(F.lit(name).alias("band"), F.col(f"_{i}").alias("models")) for i, name in enumerate(names)])
    return counted.select(F.explode(rows).alias("_r")).select("_r.*")
