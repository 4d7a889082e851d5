"""The shared folder, small sides and dealing out small inputs."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from plurivote import session


class Conf(dict):
    def set(self, key, value):
        self[key] = value


def fake(master, folder):
    seen = []
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: seen[-1] if seen else None, setCheckpointDir=seen.append)
    return SimpleNamespace(conf=Conf({"spark.checkpoint.dir": folder}), sparkContext=context), seen


def test_shared_folder_is_the_one_the_cluster_names():
    spark, seen = fake("yarn", "hdfs://shared/points")
    assert session.shared_folder(spark) == "hdfs://shared/points" and seen == ["hdfs://shared/points"]
    assert session.scratch_path(spark, "t").startswith("hdfs://shared/points/plurivote-")


def test_no_machine_local_folder_on_a_cluster():
    spark, seen = fake("spark://host:7077", "")
    with pytest.raises(RuntimeError):
        session.shared_folder(spark)
    local, seen = fake("local[2]", "")
    assert session.shared_folder(local) == seen[0] == local.conf["spark.checkpoint.dir"]


def plan(df):
    return df._jdf.queryExecution().analyzed().toString()


def test_small_side_beyond_its_bound_is_not_broadcast(spark):
    df = spark.range(30).groupBy((F.col("id") % 10).alias("k")).count()
    held, settled = session.small_side(df, 10), session.small_side(df, 9)
    assert "broadcast" in plan(held).lower() and "broadcast" not in plan(settled).lower()
    assert sorted(held.collect()) == sorted(settled.collect()) == sorted(df.collect())


def test_small_side_is_measured_in_bytes_too(spark):
    df = spark.range(10).withColumn("text", F.repeat(F.lit("x"), 100))
    assert "broadcast" in plan(session.small_side(df)).lower()
    assert "broadcast" not in plan(session.small_side(df, max_bytes=500)).lower()


def test_only_small_tables_are_dealt_out(spark):
    cores = spark.sparkContext.defaultParallelism
    assert session.spread_small(spark.range(100).coalesce(1)).rdd.getNumPartitions() == cores
    whole = spark.range(100).repartition(cores + 1)
    assert session.spread_small(whole) is whole
