"""Samples are exact, repeatable, disjoint and independent of the partitioning."""

import hashlib

import pytest
from pyspark.sql import functions as F

from plurivote.operators import sampling as S


def key(i, seed=1):
    return hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i


def table(spark, n=300, partitions=3):
    # Class 0 holds most rows, class 2 very few.
    label = F.when(F.col("id") % 50 == 0, 2).when(F.col("id") % 5 == 0, 1).otherwise(0)
    return spark.range(0, n, 1, partitions).withColumn("label", label).withColumn("text", F.concat(F.lit("t"), F.col("id")))


def in_order(rows):
    return sorted(rows, key=lambda r: key(r["id"]))


@pytest.fixture(params=[1, 4])
def partitions(request, spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_sample_n(spark, partitions):
    df = table(spark, partitions=partitions)
    want = {r["id"] for r in in_order(df.collect())[:37]}
    assert {r["id"] for r in S.sample_n(df, "id", 37).collect()} == want
    assert S.sample_n(df, "id", 0).count() == 0
    assert S.sample_n(df, "id", 300).count() == 300
    with pytest.raises(ValueError):
        S.sample_n(df, "id", 301)


def test_stratified(spark, partitions):
    df = table(spark, partitions=partitions)
    got = S.stratified_sample_n(df, "id", "label", 5).collect()
    for c in (0, 1, 2):
        rows = in_order([r for r in df.collect() if r["label"] == c])
        assert {r["id"] for r in got if r["label"] == c} == {r["id"] for r in rows[:5]}
    with pytest.raises(ValueError):
        S.stratified_sample_n(df, "id", "label", 7)


def test_undersample_equal_classes(spark):
    rows = S.undersample_balance(table(spark), "id", "label").groupBy("label").count().collect()
    assert {r["count"] for r in rows} == {6} and len(rows) == 3
    even = table(spark).where("label = 1")
    assert S.undersample_balance(even, "id", "label").count() == even.count()


def test_shuffle_order_is_dense(spark, partitions):
    df = table(spark, partitions=partitions)
    placed = sorted((r["position"], r["id"]) for r in S.shuffle_order(df, "id").collect())
    assert placed == [(i, r["id"]) for i, r in enumerate(in_order(df.collect()))]
    by_class = S.shuffle_order(df, "id", by=["label"]).collect()
    for c in (0, 1, 2):
        own = in_order([r for r in by_class if r["label"] == c])
        assert [r["position"] for r in own] == list(range(len(own)))


def test_split_covers_without_overlap(spark, partitions):
    df = table(spark, partitions=partitions)
    parts = S.assign_split(df, "id", 30, 0.2).collect()
    assert sorted(r["id"] for r in parts) == list(range(300))
    order = [r["split"] for r in in_order(parts)]
    assert order == ["test"] * 30 + ["validation"] * 60 + ["train"] * 210


def test_split_per_class_keeps_tiny_classes(spark):
    df = table(spark, 20)
    parts = S.assign_split(df, "id", 0.1, 0.1, label="label")
    assert parts.count() == 20
    assert parts.where("label = 2").collect()[0]["split"] == "train"


def test_null_labels_are_not_drawn(spark):
    df = table(spark).withColumn("label", F.when(F.col("label") != 2, F.col("label")))
    assert S.stratified_sample_n(df, "id", "label", 5).where("label is null").count() == 0
    assert S.assign_split(df, "id", 0.1, 0.1, label="label").count() == 300


def test_oversample_matches_plain_draws(spark, partitions):
    df = table(spark, partitions=partitions)
    rows = df.collect()
    got = S.oversample_balance(df, "id", "label").collect()
    most = sum(r["label"] == 0 for r in rows)
    assert [sum(r["label"] == c for r in got) for c in (0, 1, 2)] == [most] * 3
    assert sorted(r["id"] for r in got if r["label"] == 0) == sorted(r["id"] for r in rows if r["label"] == 0)
    for c in (1, 2):
        own = in_order([r for r in rows if r["label"] == c])
        for r in (r for r in got if r["label"] == c):
            draw = int(hashlib.md5(f"1:{c}:{r['draw']}".encode()).hexdigest()[:8], 16)
            assert r["id"] == own[draw % len(own)]["id"] and r["text"] == f"t{r['id']}"


def test_oversample_can_keep_the_originals(spark):
    got = S.oversample_balance(table(spark), "id", "label", keep_original=True)
    assert {r["count"] for r in got.groupBy("label").count().collect()} == {240}
    assert got.where("draw is null").select("id").distinct().count() == 300


def test_repeated_ids(spark):
    """The oversampled table is shuffled and sampled by id and draw; by id alone a cut inside a tie fails."""
    over = S.oversample_balance(table(spark), "id", "label").select("id", "label", "draw")
    ids = ["id", "draw"]
    positions = sorted(r["position"] for r in S.shuffle_order(over, ids).collect())
    assert positions == list(range(over.count()))
    for n in (1, 10, 57):
        got = S.sample_n(over, ids, n).collect()
        assert len(got) == n == len({(r["id"], r["draw"]) for r in got})
    twins = spark.createDataFrame([(1, "x")] * 6, "id int, t string")
    with pytest.raises(ValueError, match="repeats at a cut"):
        S.sample_n(twins, "id", 3)


def test_rows_without_a_label(spark):
    df = table(spark).withColumn("label", F.when(F.col("id") % 10 != 0, F.col("label")))
    for balance in ("over", "under", 3):
        got = S.three_way_split(df, "id", "label", 0.1, 0.1, balance=balance)
        assert got.where("label IS NULL").count() == 0
        assert {r["split"] for r in got.select("split").distinct().collect()} == {"train", "validation", "test"}


def test_test_split_without_labels(spark):
    rows = table(spark).select("id", "label").withColumn("split", F.when(F.col("id") % 4 == 0, "test").when(F.col("id") % 4 == 1, "validation").otherwise("train"))
    given = rows.withColumn("label", F.when(F.col("split") != "test", F.col("label")))
    got = S.hold_out_labelled(given, "id", "label", 0.2)
    counts = {r["split"]: r["count"] for r in got.groupBy("split").count().collect()}
    train = rows.where("split = 'train'").count()
    assert counts == {"test": int(train * 0.2), "train": train - int(train * 0.2), "validation": rows.where("split = 'validation'").count()}
    assert got.where("label IS NULL").count() == 0


def test_single_class_needs_no_draws(spark):
    df = table(spark).where("label = 1")
    assert S.oversample_balance(df, "id", "label").where("draw is not null").count() == 0


def test_three_way_split_does_not_leak(spark):
    got = S.three_way_split(table(spark), "id", "label", 0.1, 0.1, balance="over").collect()
    held = {r["id"] for r in got if r["split"] != "train"}
    train = {r["id"] for r in got if r["split"] == "train"}
    assert not held & train and len(held) == 60
    sizes = [sum(r["label"] == c and r["split"] == "train" for r in got) for c in (0, 1, 2)]
    assert len(set(sizes)) == 1
    fixed = S.three_way_split(table(spark), "id", "label", 0.1, 0.1, balance=3)
    assert fixed.where("split = 'train'").count() == 9


def test_more_classes_than_the_broadcast_bound(spark, monkeypatch):
    """Beyond the bound the cuts are joined by a shuffle; the rows are the same."""
    import plurivote.session as session

    df = spark.range(400).withColumn("label", F.col("id") % 40)
    want = {r["id"] for r in S.stratified_sample_n(df, "id", "label", 3).collect()}
    monkeypatch.setattr(S, "small_side", lambda side, **more: session.small_side(side, 10, **more))
    assert {r["id"] for r in S.stratified_sample_n(df, "id", "label", 3).collect()} == want
    assert len(want) == 120


def test_event_table_golden(spark):
    events = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    assert S.stratified_sample_n(events, "event_id", "event_type", 700).count() == 3500
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    over = S.oversample_balance(labels, "doc_id", "toxic").groupBy("toxic").count().collect()
    assert {r["count"] for r in over} == {348}
