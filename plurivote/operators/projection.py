"""Column work on corpus tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plurivote.session import small_side


def rename_and_keep(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Keep the listed columns under their new names."""
    return df.select(*names).withColumnsRenamed(dict(names))


def label_column(df: DataFrame) -> str:
    """``label``, or ``labels`` where the table calls it so."""
    return "label" if "label" in df.columns else "labels"


def map_values(value: Column, mapping: Mapping) -> Column:
    """Look values up in a short fixed map; null where a value is not listed."""
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), value)


def cast_label(df: DataFrame, label: str) -> DataFrame:
    """Label text to bigint; text that is no number fails the job."""
    return df.withColumn(label, F.col(label).cast("bigint"))


def reindex_labels(df: DataFrame, label: str, into: str) -> DataFrame:
    """Add the label's index 0 … k-1 among the sorted labels that occur; null stays null.

    Losses index by it, so classes such as 1 … 8 or names need it first. The labels are a short list.
    """
    known = df.where(F.col(label).isNotNull()).select(label).distinct()
    ranked = small_side(known.select(F.col(label), (F.row_number().over(Window.orderBy(label)) - 1).alias(into)))
    return df.join(ranked, label, "left").select(*df.columns, into)


def single_label_rows(df: DataFrame, labels: str, label: str) -> DataFrame:
    """Rows with exactly one label, unwrapped."""
    return df.where(F.size(labels) == 1).withColumn(label, F.element_at(labels, 1))


def array_to_columns(df: DataFrame, values: str, n: int, prefix: str) -> DataFrame:
    """The first n entries as columns ``prefix0`` …; null where the array is shorter."""
    return df.select("*", *[F.get(values, i).alias(f"{prefix}{i}") for i in range(n)])


def null_rows(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())
