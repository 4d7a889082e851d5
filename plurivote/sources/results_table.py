"""Result tables: scores, predictions, ensembles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plurivote.functions import text as T
from plurivote.sources.tables import read_csv, write_csv

SCORES = "model_name string, model_epoch string, epoch_no int, test_accuracy double, test_f1 double"
RESULTS_CSV = "model_name string, model_epoch string, test_accuracy double, test_f1 double, predictions string"
ENSEMBLES_CSV = (
    "ensemble_id string, inducers string, inducers_spec string, dataset string, "
    "test_accuracy double, test_f1 double, ensemble_type string"
)


def append_results(rows: DataFrame, path: str, key: Sequence[str] = ("model_name", "epoch_no")) -> None:
    """Store rows by key; rows with a stored key replace it. Of rows with one key in a call one is stored.

    The table is partitioned by the key and a write replaces the partitions it has rows for when it is committed, so
    a job that is run again, and two writers of one key, leave one row. Nothing is read first.
    """
    unique = rows.dropDuplicates(list(key))
    unique.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*key).parquet(path)


def write_predictions(rows: DataFrame, table: str, buckets: int) -> None:
    """Store long predictions bucketed by item, so that joins and votes on the item need no shuffle.

    Give the truth table the same buckets and the two are joined in place.
    """
    rows.write.mode("overwrite").bucketBy(buckets, "item_id").sortBy("item_id").saveAsTable(table)


def read_results(spark: SparkSession, path: str, schema: str = SCORES) -> DataFrame:
    stored = spark.read.schema(schema).parquet(path)
    return stored.select(*spark.createDataFrame([], schema).columns)  # key columns come last from the folders


def scores_of(results: DataFrame) -> DataFrame:
    """Score part of a result file whose epochs are given as tags."""
    tag = T.parse_epoch_tag(F.col("model_epoch"))
    return results.select("model_name", "model_epoch", tag["epoch_no"].alias("epoch_no"), "test_accuracy", "test_f1")


def predictions_of(results: DataFrame) -> DataFrame:
    """Long predictions of a result file: list text to one row per position (0, 1, …)."""
    tag = T.parse_epoch_tag(F.col("model_epoch"))
    return results.select(
        "model_name",
        tag["epoch_no"].alias("epoch_no"),
        F.posexplode(T.list_from_text(F.col("predictions"))).alias("item_id", "pred"),
    ).withColumn("item_id", F.col("item_id").cast("bigint"))


def parse_ensembles(ensembles: DataFrame) -> DataFrame:
    """Ensemble file with its tuple texts read as arrays."""
    return ensembles.withColumns(
        {c: T.tuple_from_text(F.col(c)) for c in ("inducers", "inducers_spec") if c in ensembles.columns}
    )


def quoted(item):
    """A text in single quotes, with marks and backslashes inside escaped."""
    return F.concat(F.lit("'"), F.regexp_replace(item, r"(['\\])", r"\\$1"), F.lit("'"))


def tuple_text(items):
    """An array of strings as ``('a', 'b')``; ``tuple_from_text`` reads it back."""
    return F.concat(F.lit("("), F.array_join(F.transform(items, quoted), ", "), F.when(F.size(items) == 1, ",").otherwise(""), F.lit(")"))


def list_text(items):
    """An array of strings as ``['a', 'b']``."""
    return F.concat(F.lit("["), F.array_join(F.transform(items, quoted), ", "), F.lit("]"))


def write_results_csv(scores: DataFrame, predictions: DataFrame, path: str) -> None:
    """One row per model and epoch, its predictions as list text in the order of items.

    A model's predictions of one epoch are one cell of the file by its format.
    """
    lists = predictions.groupBy("model_name", "epoch_no").agg(F.array_sort(F.collect_list(F.struct("item_id", "pred"))).alias("_p"))
    texts = F.concat(F.lit("["), F.array_join(F.col("_p.pred").cast("array<string>"), ", ", "null"), F.lit("]"))
    rows = scores.join(lists, ["model_name", "epoch_no"]).select("model_name", "model_epoch", "test_accuracy", "test_f1", texts.alias("predictions"))
    write_csv(rows, path)


def read_results_csv(spark: SparkSession, path: str) -> DataFrame:
    """Result rows; ``scores_of`` and ``predictions_of`` read their parts."""
    return read_csv(spark, path, RESULTS_CSV, multi_line=False)


def write_ensembles_csv(ensembles: DataFrame, path: str) -> None:
    write_csv(ensembles.withColumns({c: tuple_text(F.col(c)) for c in ("inducers", "inducers_spec")}), path)


def read_ensembles_csv(spark: SparkSession, path: str) -> DataFrame:
    return parse_ensembles(read_csv(spark, path, ENSEMBLES_CSV, multi_line=False))


def model_epoch_listing(paths: DataFrame, path: str = "path") -> DataFrame:
    """Saved epochs from their paths ``folder/model/epoch``, in path order."""
    return (
        paths.select(
            F.col(path).alias("path"),
            T.path_part(F.col(path), 1).alias("model_name"),
            T.path_part(F.col(path), 2).alias("model_epoch"),
        )
        .distinct()
        .orderBy("path")
    )
