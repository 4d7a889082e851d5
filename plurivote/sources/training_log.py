"""Training logs: free text with one block of lines per epoch.

A record ends where a line starts with ``Epoch ``, so long files are split between
tasks and no file is ever held whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_START = "\nEpoch "
# The shapes of a log's lines.
HEAD = r"^(?:Epoch )?([0-9]+):"
PROGRESS = r"([0-9]+)/([0-9]+) \[([0-9:]+)<[^,]*,\s*([0-9.]+)(batch/s|s/batch)\]"
VALIDATION = r"Validation [0-9]+:[^\n]*?" + PROGRESS
NUMBER = r"\s*(-?[0-9.]+(?:[eE][-+]?[0-9]+)?|nan|inf)"
METRICS = {
    "train_loss": "Train loss",
    "val_loss": "Validation Loss",
    "val_accuracy": "Validation Accuracy",
    "val_f1": "Validation F1",
    "val_recall": "Validation Recall",
    "val_precision": "Validation Precision",
}
MODEL_SAVED = r"\* Model @ epoch [0-9]+ saved to ([^\n]+)"
CHECKPOINT_SAVED = r"\* Model checkpoint saved to ([^\n]+)"


def _found(text: Column, pattern: str, group: int, kind: str) -> Column:
    hit = F.regexp_extract(text, pattern, group)
    return F.when(hit != "", hit).cast(kind)


def _seconds(clock: Column) -> Column:
    """``mm:ss`` or ``h:mm:ss`` as seconds."""
    return F.aggregate(F.split(clock, ":"), F.lit(0).cast("bigint"), lambda total, part: total * 60 + part.cast("bigint"))


def _rate(text: Column, pattern: str) -> Column:
    """Batches per second from either unit."""
    value = _found(text, pattern, 4, "double")
    return F.when(F.regexp_extract(text, pattern, 5) == "s/batch", F.try_divide(F.lit(1.0), value)).otherwise(value)


def parse_blocks(blocks: DataFrame, text: str = "value") -> DataFrame:
    """Log blocks (and their file) as one row per epoch."""
    body = F.col(text)
    head = "^[^\\n]*?" + PROGRESS
    return (
        blocks.where(body.rlike(HEAD))
        .select(
            F.element_at(F.split("file", "/"), -2).alias("model_name"),
            _found(body, HEAD, 1, "int").alias("epoch_no"),
            _found(body, head, 2, "int").alias("batches"),
            _seconds(_found(body, head, 3, "string")).alias("seconds"),
            _rate(body, head).alias("batches_per_second"),
            _found(body, VALIDATION, 2, "int").alias("val_batches"),
            _seconds(_found(body, VALIDATION, 3, "string")).alias("val_seconds"),
            _rate(body, VALIDATION).alias("val_batches_per_second"),
            *[_found(body, title + ":" + NUMBER, 1, "double").alias(name) for name, title in METRICS.items()],
            F.trim(_found(body, MODEL_SAVED, 1, "string")).alias("model_path"),
            F.trim(_found(body, CHECKPOINT_SAVED, 1, "string")).alias("checkpoint_path"),
        )
        .withColumn("model_saved", F.col("model_path").isNotNull())
        .withColumn("checkpoint_saved", F.col("checkpoint_path").isNotNull())
    )


def read_training_logs(spark: SparkSession, path: str) -> DataFrame:
    """Epoch rows of all logs under ``path``; a log's folder is its model name."""
    blocks = spark.read.option("lineSep", BLOCK_START).option("recursiveFileLookup", True).text(path)
    return parse_blocks(blocks.select("value", F.col("_metadata.file_path").alias("file")))


def saved_epochs(logs: DataFrame) -> DataFrame:
    """Paths of the models the logs report as saved."""
    return logs.where("model_saved").select(F.col("model_path").alias("path"))
