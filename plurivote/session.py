"""Session set-up and the shared folder for cut lineage and scratch tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only when it was counted and holds at most this many narrow rows.
MAX_BROADCAST_ROWS = 20_000
# A side with wide rows (texts) is broadcast only when it was measured at most this large.
MAX_BROADCAST_BYTES = 64 * 1024 * 1024


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "plurivote") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("PLURIVOTE_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the one named in ``spark.checkpoint.dir``.

    Where the setting is empty a local session gets its own folder; a cluster
    session fails, because a machine-local folder would not be seen by the others.
    """
    folder = spark.conf.get("spark.checkpoint.dir", "") or ""
    context = spark.sparkContext
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="plurivote-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for a table that a later step reads back."""
    return f"{shared_folder(spark).rstrip('/')}/plurivote-{uuid.uuid4().hex}/{name}"


def settle(df: DataFrame) -> DataFrame:
    """Compute a table once and cut its lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def small_side(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES, short: bool = False) -> DataFrame:
    """Compute a narrow per-group table once, ready to be joined to wide rows.

    It is measured where it is computed. Up to both bounds its rows are held by the plan itself and
    broadcast. Beyond them it is settled in the shared folder and the join that uses it shuffles.
    ``short`` says that a row is a few numbers, keys and names: then no more than ``max_rows`` + 1 of them are
    fetched at once, and only a longer table is computed a second time.
    """
    if short:
        found = df.limit(max_rows + 1).toArrow()
        if found.num_rows > max_rows or found.nbytes > max_bytes:
            return settle(df)
        return F.broadcast(df.sparkSession.createDataFrame(found, schema=df.schema))
    held = df.persist()
    try:
        width = F.octet_length(F.to_json(F.struct("*"))) if df.columns else F.lit(0)
        size = held.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("rows"), F.sum(width).alias("bytes")).first()
        if size["rows"] > max_rows or (size["bytes"] or 0) > max_bytes:
            return settle(held)
        return F.broadcast(df.sparkSession.createDataFrame(held.toArrow(), schema=df.schema))
    finally:
        held.unpersist()


def spread_small(df: DataFrame) -> DataFrame:
    """Deal a small table out to all cores before costly work on its rows.

    A small file is one row group and would keep one core busy. A table that has a part for every
    core is returned as it is, unshuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
