"""Corpus profiling: completeness, summaries, class counts, histograms, words."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plurivote.functions import text as T
from plurivote.session import settle, small_side


def profile_nonnull(df: DataFrame) -> DataFrame:
    """Per column: type, rows and non-null values, from one pass."""
    kinds = dict(df.dtypes)
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count(F.col(c)).alias(f"_c{i}") for i, c in enumerate(df.columns)]
    )
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), F.lit(kinds[c]).alias("data_type"), F.col(f"_c{i}").alias("non_null"))
            for i, c in enumerate(df.columns)
        ]
    )
    return counts.select(F.col("_rows").alias("rows"), F.explode(cells).alias("_c")).select("_c.*", "rows")


def _long_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per value; null and NaN are no values."""
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(F.explode(cells).alias("_c")).select("_c.*").where(F.col("value").isNotNull() & ~F.isnan("value"))


def value_counts_by_range(values: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Distinct values with their row counts, range-partitioned; ``_part`` follows the order.

    Settled, because a second evaluation would draw other range bounds.
    """
    counts = values.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_rows"))
    return settle(counts.repartitionByRange(*by, value).withColumn("_part", F.spark_partition_id()))


def exact_quantiles(parts: DataFrame, by: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """Exact quantiles with linear interpolation from ``value_counts_by_range``.

    Each part's total tells which part holds a rank, and only those parts are summed
    value by value, so neither a group nor a frequent value has to fit in one task.
    """
    by = list(by)
    in_order = Window.partitionBy(*by).orderBy("_part")
    totals = (
        parts.groupBy(*by, "_part")
        .agg(F.sum("_rows").alias("_in"))
        .withColumn("_before", F.sum("_in").over(in_order) - F.col("_in"))
        .withColumn("_all", F.sum("_in").over(Window.partitionBy(*by)))
    )
    place = F.array(*[F.lit(float(s)) for s in shares])
    wanted = (
        totals.withColumn("_share", F.explode(place))
        .withColumn("_at", F.col("_share") * (F.col("_all") - 1))
        .withColumn("_rank", F.explode(F.array(F.floor("_at"), F.ceil("_at"))))
        .where((F.col("_before") <= F.col("_rank")) & (F.col("_rank") < F.col("_before") + F.col("_in")))
        .select(*by, "_part", "_share", "_at", "_rank", "_before")
        .distinct()
    )
    running = Window.partitionBy(*by, "_part", "_share", "_rank").orderBy(value)
    hits = (
        parts.join(small_side(wanted), [*by, "_part"])
        .withColumn("_upto", F.col("_before") + F.sum("_rows").over(running))
        .where((F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_rows")))
    )
    low, high = F.min(value), F.max(value)
    part = F.first("_at") - F.floor(F.first("_at"))
    return hits.groupBy(*by, F.col("_share").alias("share")).agg((low + (high - low) * part).alias("quantile"))


def describe_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, least, exact quartiles and largest value per column.

    One pass over the rows: everything else comes from the counted distinct values. A column without
    a value has count 0 and nulls.
    """
    parts = value_counts_by_range(_long_values(df, columns), ["column_name"], "value")
    value, rows = F.col("value"), F.col("_rows")
    summary = small_side(
        parts.groupBy("column_name").agg(
            F.sum(rows).alias("count"),
            (F.sum(value * rows) / F.sum(rows)).alias("mean"),
            F.min(value).alias("min"),
            F.max(value).alias("max"),
        )
    )
    spread = (
        parts.join(summary.select("column_name", "mean"), "column_name")
        .groupBy("column_name")
        .agg(F.sqrt(F.try_divide(F.sum(rows * F.pow(value - F.col("mean"), 2)), F.sum(rows) - 1)).alias("std"))
    )
    quartiles = (
        exact_quantiles(parts, ["column_name"], "value", (0.25, 0.5, 0.75))
        .groupBy("column_name")
        .agg(*[F.max(F.when(F.col("share") == s, F.col("quantile"))).alias(n) for n, s in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75))])
    )
    names = F.explode(F.array(*[F.lit(c) for c in columns])).alias("column_name")
    every = df.sparkSession.range(1).select(names)
    found = every.join(summary, "column_name", "left").join(spread, "column_name", "left").join(quartiles, "column_name", "left")
    return found.select("column_name", F.coalesce("count", F.lit(0)).alias("count"), "mean", "std", "min", "q25", "q50", "q75", "max")


def label_distribution(df: DataFrame, *keys: str) -> DataFrame:
    """Rows per class (and split)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))


def distinct_labels(df: DataFrame, label: str) -> DataFrame:
    return df.select(label).distinct()


def length_outliers(df: DataFrame, length: Column, above: int, exactly: int) -> DataFrame:
    """Rows longer than ``above`` or of length ``exactly``, with the length and the reason.

    The length of a text is costly, so it is bound to a lambda and worked out once.
    """
    found = F.transform(
        F.array(length),
        lambda n: F.struct(n.alias("length"), F.when(n > above, "long").when(n == exactly, "short").alias("reason")),
    )
    return df.select("*", F.inline(F.filter(found, lambda f: f["reason"].isNotNull())))


def _slot(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Bin of equal width; the last one includes its right edge."""
    return F.least(F.lit(bins - 1), F.floor((value.cast("double") - low) / (high - low) * bins)).cast("int")


def equal_width_histogram(df: DataFrame, value: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Rows per bin between the least and the largest value, with the bin's left edge; all bins, also empty ones.

    If all values are equal the range is half a unit to either side.
    """
    ends = df.agg(F.min(value).cast("double").alias("least"), F.max(value).cast("double").alias("most"))
    half = F.when(F.col("least") == F.col("most"), 0.5).otherwise(0.0)
    edges = ends.select((F.col("least") - half).alias("low"), (F.col("most") + half).alias("high"))
    low, high = edges.select("low").scalar(), edges.select("high").scalar()
    binned = df.where(F.col(value).isNotNull()).select(*by, _slot(F.col(value), low, high, bins).alias("bin"))
    counted = binned.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("rows"))
    # Zeros for all bins of all groups, added to what was counted.
    groups = df.where(F.col(value).isNotNull()).select(*by).distinct() if by else edges.where("low IS NOT NULL").select()
    zeros = groups.select(*by, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), F.lit(0).cast("bigint").alias("rows"))
    width = (high - low) / bins
    return (
        counted.unionByName(zeros)
        .groupBy(*by, "bin")
        .agg(F.sum("rows").alias("rows"))
        .select(*by, "bin", (low + F.col("bin") * width).alias("left_edge"), "rows")
    )


def automatic_bins(df: DataFrame, value: str) -> int:
    """Number of equal bins for the non-null values: the finer of two published rules.

    Freedman and Diaconis' width is twice the quartile range over the cube root of the count, Sturges' the range over one
    plus the count's binary logarithm. Whole numbers get no bin narrower than one. From exact quartiles of counted values.
    """
    whole = dict(df.dtypes)[value] in ("tinyint", "smallint", "int", "bigint")
    parts = value_counts_by_range(_long_values(df, [value]), ["column_name"], "value")
    ends = parts.agg(F.sum("_rows").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")).first()
    if not ends["n"] or ends["low"] == ends["high"]:
        return 1
    found = {r["share"]: r["quantile"] for r in exact_quantiles(parts, ["column_name"], "value", (0.25, 0.75)).collect()}  # two rows
    reach = ends["high"] - ends["low"]
    widths = [reach / (math.log2(ends["n"]) + 1)]
    if found[0.75] > found[0.25]:
        widths.append(2 * (found[0.75] - found[0.25]) / ends["n"] ** (1 / 3))
    width = max(min(widths), 1.0) if whole else min(widths)
    return math.ceil(reach / width)


def duplicate_rows(df: DataFrame, id_col: str) -> DataFrame:
    """Rows whose content (all columns but the id) was seen under a lower id.

    Contents are compared to the microsecond and with nulls kept apart. Only the narrow keys
    are grouped: contents counted once drop out, the surplus ids are those above their content's
    least id, and the wide rows are picked by these few ids. A content that fills a
    third of the table is combined before the shuffle and never gathered in one task.
    """
    lossless = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"}
    content = F.sha2(F.to_json(F.struct(*[c for c in df.columns if c != id_col]), lossless), 256)
    keys = settle(df.select(id_col, content.alias("_content")))
    firsts = keys.groupBy("_content").agg(F.min(id_col).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    surplus = keys.join(firsts, "_content").where(F.col(id_col) > F.col("_first")).select(id_col)
    return df.join(surplus, id_col, "left_semi")


def top_words_by_class(df: DataFrame, label: str, word_list: Column, n: int = 20) -> DataFrame:
    """The n most frequent words of every class; the alphabet decides between equals."""
    counts = (
        df.select(label, F.explode(word_list).alias("word")).groupBy(label, "word").agg(F.count(F.lit(1)).alias("times"))
    )
    place = Window.partitionBy(label).orderBy(F.desc("times"), "word")
    return counts.withColumn("place", F.row_number().over(place)).where(F.col("place") <= n)


def cleaned_words(text: Column, stopwords: Sequence[str] = T.ENGLISH_STOPWORDS) -> Column:
    """Words of the cleaned text without the stop words (English by default)."""
    return T.remove_stopwords(T.words(T.clean_text(text)), stopwords)
