"""Corpus files and split tables."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SPLITS = ("train", "validation", "test")


# Texts keep their blanks at both ends, in either direction.
EXACT_CSV = {"header": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def read_csv(
    spark: SparkSession, path: str, schema: StructType | str, multi_line: bool = True, null_text: str | None = None
) -> DataFrame:
    """CSV with header and a given schema (no inference pass).

    Texts may hold line breaks, so a file is read by one task; write many files, or give
    ``multi_line=False`` where texts have no line breaks, which lets large files be split.
    An empty text reads as null, unless the file was written with a ``null_text``: then only that text is null.
    """
    reader = spark.read.schema(schema).options(**EXACT_CSV, mode="FAILFAST").option("multiLine", multi_line)
    if null_text is not None:
        reader = reader.option("nullValue", null_text)
    return reader.csv(path)


def write_csv(df: DataFrame, path: str, null_text: str | None = None) -> None:
    """CSV with header. With ``null_text`` for nulls, empty texts and nulls stay apart."""
    writer = df.write.mode("overwrite").options(**EXACT_CSV, quoteAll="false")
    if null_text is not None:
        writer = writer.option("nullValue", null_text)
    writer.csv(path)


def read_named_splits(
    spark: SparkSession, paths: Mapping[str, str], file_format: str = "parquet", schema: StructType | str | None = None
) -> DataFrame:
    """Files of a data set that comes with its own splits, as one table with ``split``."""
    reader = spark.read.format(file_format)
    if schema is not None:
        reader = reader.schema(schema)
    parts = [reader.load(path).withColumn("split", F.lit(name)) for name, path in paths.items()]
    return reduce(DataFrame.unionByName, parts)


def write_splits(df: DataFrame, path: str) -> None:
    """One folder per split, so that reading one split skips the others' files."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def read_splits(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """The whole split table, or one split of it."""
    df = spark.read.parquet(path)
    return df if split is None else df.where(F.col("split") == split)
