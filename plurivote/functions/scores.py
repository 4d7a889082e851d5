"""Numeric expressions for classification scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def argmax(values: Column) -> Column:
    """Position of the largest entry, the first one on ties."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def log_sum_exp(values: Column) -> Column:
    """log of the sum of exponentials, shifted by the maximum against overflow."""
    top = F.array_max(values).cast("double")
    return top + F.log(
        F.aggregate(values, F.lit(0.0), lambda total, v: total + F.exp(v.cast("double") - top))
    )


def row_cross_entropy(logits: Column, label: Column) -> Column:
    """Loss of one row."""
    return log_sum_exp(logits) - F.element_at(logits, label.cast("int") + 1).cast("double")


def ratio_or_zero(part: Column, whole: Column) -> Column:
    """part / whole as double, 0 when the whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def precision(tp: Column, fp: Column) -> Column:
    return ratio_or_zero(tp, tp + fp)


def recall(tp: Column, fn: Column) -> Column:
    return ratio_or_zero(tp, tp + fn)


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio_or_zero(2 * tp, 2 * tp + fp + fn)


def round_scaled(x: Column, places: int = 2) -> Column:
    """Scale, round half to even, scale back — what array libraries do."""
    return F.rint(x * float(10**places)) / float(10**places)


def round_decimal(x: Column, places: int = 2) -> Column:
    """Round the exact binary value, ties to even — what scalar rounding does.

    The scaled product may land on a half that the exact value misses (0.835 is a
    little below). Splitting x in two short halves makes both products exact, so
    the sign of the distance to the half decides.
    """
    scale = float(10**places)
    split = x * 134217729.0
    high = split - (split - x)
    low = x - high
    floor = F.floor(x * scale).cast("double")
    distance = (high * (2 * scale) - (2 * floor + 1)) + low * (2 * scale)
    even = F.pmod(floor, F.lit(2.0)) == 0
    up = (distance > 0) | ((distance == 0) & ~even)
    return F.when(up, floor + 1).otherwise(floor) / scale
