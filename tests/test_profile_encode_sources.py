"""Profiles, encoding, files and logs."""

import hashlib
import os
import statistics

import pytest
from pyspark.sql import functions as F

from plurivote.operators import encode as ENC
from plurivote.operators import metrics as M
from plurivote.operators import models, profile as P, projection as PR
from plurivote.sources import results_table as R
from plurivote.sources import tables as TAB
from plurivote.sources import training_log as LOG


def test_profile_nonnull(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (None, None)], "i int, s string")
    assert {(r["column_name"], r["data_type"], r["non_null"], r["rows"]) for r in P.profile_nonnull(df).collect()} == {
        ("i", "int", 2, 3),
        ("s", "string", 1, 3),
    }


def plain_quantile(values, share):
    values = sorted(values)
    at = share * (len(values) - 1)
    low = int(at)
    high = min(low + 1, len(values) - 1)
    return values[low] + (values[high] - values[low]) * (at - low)


def test_exact_quantiles_with_a_heavy_value(spark):
    data = [("a", float(v)) for v in [7] * 50 + list(range(100))] + [("b", 1.0), ("b", 2.0), ("c", 5.0)]
    df = spark.createDataFrame(data, "g string, v double").repartition(5)
    got = {(r["g"], r["share"]): r["quantile"] for r in P.exact_quantiles(P.value_counts_by_range(df, ["g"], "v"), ["g"], "v", (0.0, 0.25, 0.5, 0.75, 1.0)).collect()}
    for g in "abc":
        own = [v for k, v in data if k == g]
        for s in (0.0, 0.25, 0.5, 0.75, 1.0):
            assert got[g, s] == pytest.approx(plain_quantile(own, s))


def test_describe(spark):
    values = [3.0, 1.0, 4.0, 1.0, 5.0]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    row = P.describe_numeric(df, ["v"]).first()
    assert (row["count"], row["min"], row["q50"], row["max"]) == (5, 1.0, 3.0, 5.0)
    assert row["std"] == pytest.approx(statistics.stdev(values))
    odd = spark.createDataFrame([(1.0, None), (float("nan"), None), (3.0, None)], "a double, b double")
    rows = {r["column_name"]: tuple(r)[1:] for r in P.describe_numeric(odd, ["a", "b"]).collect()}
    assert rows["a"][0] == 2 and rows["a"][1] == 2.0 and rows["a"][-1] == 3.0
    assert rows["b"] == (0, None, None, None, None, None, None, None)


def test_histograms(spark):
    df = spark.createDataFrame([(v,) for v in (0, 1, 2, 9, 10)], "v int")
    assert {r["bin"]: r["rows"] for r in P.equal_width_histogram(df, "v", 10).collect()} == {0: 1, 1: 1, 2: 1, 9: 2} | dict.fromkeys(range(3, 9), 0)
    same = spark.createDataFrame([(4,), (4,)], "v int")
    assert [tuple(r) for r in P.equal_width_histogram(same, "v", 10).where("rows > 0").collect()] == [(5, 4.0, 2)]
    by = spark.createDataFrame([("x", 0), ("x", 10), ("y", 5), ("z", None)], "k string, v int")
    assert {(r["k"], r["bin"]): r["rows"] for r in P.equal_width_histogram(by, "v", 2, ["k"]).collect()} == {("x", 0): 1, ("x", 1): 1, ("y", 0): 0, ("y", 1): 1}
    assert P.equal_width_histogram(same.limit(0), "v", 10).count() == 0


def test_duplicates_are_null_safe(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, None, "a"), (4, "a", "x"), (5, "a", None)], "id int, s string, t string")
    assert {r["id"] for r in P.duplicate_rows(df, "id").collect()} == {2, 5}
    times = spark.sql("SELECT 1 AS id, timestamp'2024-01-01 00:00:00.123456' AS t UNION ALL SELECT 2, timestamp'2024-01-01 00:00:00.123999' UNION ALL SELECT 3, timestamp'2024-01-01 00:00:00.123456'")
    assert [r["id"] for r in P.duplicate_rows(times, "id").collect()] == [3]


def test_top_words_ties(spark):
    df = spark.createDataFrame([(0, ["b", "a", "b", "c"]), (1, ["z"])], "label int, w array<string>")
    got = P.top_words_by_class(df, "label", F.col("w"), 2).orderBy("label", "place").collect()
    assert [(r["label"], r["word"], r["times"]) for r in got] == [(0, "b", 2), (0, "a", 1), (1, "z", 1)]


def test_projection(spark):
    df = spark.createDataFrame([("negative", [1, 2]), ("positive", [3]), ("other", [])], "c string, l array<int>")
    assert [r[0] for r in df.select(PR.map_values(F.col("c"), {"negative": 0, "positive": 1})).collect()] == [0, 1, None]
    assert [r["label"] for r in PR.single_label_rows(df, "l", "label").collect()] == [3]
    wide = PR.array_to_columns(df, "l", 2, "e").select("e0", "e1").collect()
    assert [tuple(r) for r in wide] == [(1, 2), (3, None), (None, None)]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        PR.cast_label(df, "c").collect()
    assert PR.label_column(df.withColumnRenamed("c", "labels")) == "labels"


def plain(text):
    """Word ids in plain Python."""
    return [int(hashlib.md5(f"word:{w}".encode()).hexdigest()[:8], 16) % ENC.WORD_IDS for w in (text or "").split()]


def test_token_encode(spark):
    texts = ["a short text", "", None, "word " * 400, "mark </s> é"]
    df = spark.createDataFrame([(i, t, i % 2) for i, t in enumerate(texts)], "item_id long, text string, label int")
    rows = ENC.token_encode(df, 64).orderBy("item_id").collect()
    for r, t in zip(rows, texts):
        assert r["input_ids"] == [ENC.BEGIN_ID, *plain(t)[:62], ENC.END_ID]
        assert r["attention_mask"] == [1] * len(r["input_ids"])
    sizes = ENC.token_lengths(df).orderBy("item_id").collect()
    assert [r["n_tokens"] for r in sizes] == [len(plain(t)) + 2 for t in texts]


def slow_fit(first, second, room):
    while first + second > room:
        if first > second:
            first -= 1
        else:
            second -= 1
    return first, second


def test_pair_truncation(spark):
    cases = [(a, b) for a in range(14) for b in range(14)]
    df = spark.createDataFrame(cases, "a int, b int")
    for room in (2, 3, 7, 12, 19):
        x, y = ENC.fit_pair(F.col("a"), F.col("b"), room)
        for r in df.select("a", "b", x.alias("x"), y.alias("y")).collect():
            assert (r["x"], r["y"]) == slow_fit(r["a"], r["b"], room)


def test_multiple_choice(spark):
    a = spark.createDataFrame([(1, "ctx", "He", ["e0", "e1", "e2", "e3"], 2)], "item_id long, ctx_a string, ctx_b string, endings array<string>, label long")
    b = spark.createDataFrame([(2, "long context " * 30, "why?", "a", "b", "c", "d " * 50, 0)], "item_id long, context string, question string, answer0 string, answer1 string, answer2 string, answer3 string, label long")
    first = ENC.multiple_choice_pairs(a)
    assert first.first()["options"] == ["He e0", "He e1", "He e2", "He e3"]
    split = a.select("item_id", "ctx_a", "ctx_b", *[F.col("endings")[i].alias(f"ending{i}") for i in range(4)], "label")
    assert ENC.multiple_choice_pairs(split).collect() == first.collect()
    with pytest.raises(ValueError):
        ENC.multiple_choice_pairs(a.select("item_id", "label"))
    rows = ENC.multiple_choice_encode(first.unionByName(ENC.multiple_choice_pairs(b)), 40).orderBy("item_id").collect()
    assert rows[0]["input_ids"][3] == [ENC.BEGIN_ID, *plain("ctx"), ENC.END_ID, ENC.END_ID, *plain("He e3"), ENC.END_ID]
    head = [*plain("long context " * 30), ENC.END_ID, ENC.END_ID, *plain("why?")]
    for ids, option in zip(rows[1]["input_ids"], ("a", "b", "c", "d " * 50)):
        tail = plain(option)
        x, y = slow_fit(len(head), len(tail), 36)
        assert ids == [ENC.BEGIN_ID, *head[:x], ENC.END_ID, ENC.END_ID, *tail[:y], ENC.END_ID]
    assert [len(m) for m in rows[1]["attention_mask"]] == [len(i) for i in rows[1]["input_ids"]]


def test_batches_and_padding(spark):
    df = spark.range(35).select(F.col("id").alias("item_id"), F.array_repeat(F.lit(7), (F.col("id") % 9 + 1).cast("int")).alias("input_ids"), F.lit(1).alias("label"))
    batches = ENC.make_batches(df, "item_id", 16)
    assert sorted(r["count"] for r in batches.groupBy("batch_id").count().collect()) == [3, 16, 16]
    padded = ENC.pad_batches(batches)
    longest = {r["batch_id"]: r["m"] for r in batches.groupBy("batch_id").agg(F.max(F.size("input_ids")).alias("m")).collect()}
    for r in padded.collect():
        used = r["item_id"] % 9 + 1
        assert r["input_ids"] == [7] * used + [ENC.PAD_ID] * (longest[r["batch_id"]] - used)
        assert r["attention_mask"] == [1] * used + [0] * (longest[r["batch_id"]] - used)
    matrices = ENC.collect_batches(padded).collect()
    assert all(len({len(x) for x in m["input_ids"]}) == 1 and len(m["label"]) == len(m["input_ids"]) for m in matrices)
    nested = df.limit(1).select("item_id", F.lit(0).alias("batch_id"), F.array(F.array(F.lit(1)), F.array(F.lit(1), F.lit(2))).alias("input_ids"))
    row = ENC.pad_batches(nested).first()
    assert row["input_ids"] == [[1, ENC.PAD_ID], [1, 2]] and row["attention_mask"] == [[1, 0], [1, 1]]
    waste = ENC.padding_waste(batches.withColumn("n", F.size("input_ids")), F.col("n"), 5).orderBy("batch_id").first()
    assert waste["fixed_cells"] == 80 and waste["batch_cells"] <= 80 and waste["used_cells"] <= waste["batch_cells"]


def test_csv_round_trip(spark, tmp_path):
    rows = [(1, 'quote " and, comma', 1), (2, "line\nbreak", None), (3, None, 0), (4, "back\\slash \"end\\\"", 1), (5, "", 0)]
    df = spark.createDataFrame(rows, "item_id long, text string, label int")
    TAB.write_csv(df, str(tmp_path / "c"))
    back = TAB.read_csv(spark, str(tmp_path / "c"), "item_id bigint, text string, label int")
    want = [(i, t or None, label) for i, t, label in rows]  # an empty text reads as null
    assert sorted(tuple(r) for r in back.collect()) == sorted(want)


def test_split_pruning(spark, tmp_path):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(TAB.SPLITS)], "item_id int, split string")
    TAB.write_splits(df, str(tmp_path / "s"))
    one = TAB.read_splits(spark, str(tmp_path / "s"), "test")
    assert [r["item_id"] for r in one.collect()] == [2]
    plan = one._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(split" in plan


def test_append_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "r")
    rows = spark.createDataFrame([("a", "E01", 1, 0.5, 0.5), ("a", "E02", 2, 0.6, 0.5)], R.SCORES)
    R.append_results(rows.limit(1), path)
    R.append_results(rows, path)
    R.append_results(rows, path)
    assert R.read_results(spark, path).count() == 2


def test_bucketed_predictions_join_in_place(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS buckets LOCATION '{tmp_path}/db'")
    rows = spark.range(200).selectExpr("'m' AS model_name", "1 AS epoch_no", "id AS item_id", "cast(id % 2 AS int) AS pred", "cast(id % 3 = 0 AS int) AS label")
    R.write_predictions(rows.drop("label"), "buckets.predictions", 4)
    R.write_predictions(rows.select("item_id", "label"), "buckets.truth", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = M.join_truth(spark.table("buckets.predictions"), spark.table("buckets.truth"))
        assert joined.count() == 200
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP DATABASE buckets CASCADE")


def test_result_files(spark, tmp_path):
    lines = ["model_name,model_epoch,test_accuracy,test_f1,predictions", 'a_01,E01_A0.5_F0.4,0.5,0.4,"[0, 1, 1]"']
    (tmp_path / "x.csv").write_text("\n".join(lines) + "\n")
    results = TAB.read_csv(spark, str(tmp_path / "x.csv"), R.RESULTS_CSV)
    assert [tuple(r) for r in R.scores_of(results).collect()] == [("a_01", "E01_A0.5_F0.4", 1, 0.5, 0.4)]
    assert [tuple(r) for r in R.predictions_of(results).collect()] == [("a_01", 1, 0, 0), ("a_01", 1, 1, 1), ("a_01", 1, 2, 1)]
    made = spark.createDataFrame([("ensemble_1", ["a", "b"], ["a_01", "b_01"], "d", 0.5, 0.25, "best-F1_three-model")], "ensemble_id string, inducers array<string>, inducers_spec array<string>, dataset string, test_accuracy double, test_f1 double, ensemble_type string")
    R.write_ensembles_csv(made, str(tmp_path / "e"))
    back = R.parse_ensembles(TAB.read_csv(spark, str(tmp_path / "e"), R.ENSEMBLES_CSV))
    assert back.collect() == made.collect()


def test_epoch_listing(spark):
    df = spark.createDataFrame([("s/b_01/E02_A0.5_F0.4",), ("s/b_01/E01_A0.5_F0.4",), ("s/a_01/E01_A0.1_F0.0",)], "path string")
    assert [(r["model_name"], r["model_epoch"][:3]) for r in R.model_epoch_listing(df).collect()] == [("a_01", "E01"), ("b_01", "E01"), ("b_01", "E02")]


BLOCK = """Epoch {e}: 100%|██████| 10/10 [{t}<00:00,  {r}]
\t Validation 3: 100%|██████| 4/4 [00:07<00:00,  5.01batch/s]

 \t - Train loss: 0.655496
\t - Validation Loss: 0.486875
\t - Validation Accuracy: 0.753125
\t - Validation F1: 0.414412
\t - Validation Recall: 0.381310
\t - Validation Precision: 0.547202 

\t * Model @ epoch {e} saved to runs/m_01/E0{e}_A0.75_F0.41
\t {s}

"""


def test_training_logs(spark, tmp_path):
    saved = "* Model checkpoint saved to runs/m_01/E01_A0.75_F0.41/checkpoint.pt"
    (tmp_path / "m_01").mkdir()
    text = (
        "some settings before the first epoch\n"
        + BLOCK.format(e=1, t="02:10", r="2.04batch/s", s=saved)
        + BLOCK.format(e=2, t="1:30:00", r="4.00s/batch", s="! Checkpoint Not Saved, Save Frequency: None, Epoch 2")
        + "# Missed log for Epoch 3\n\n"
        + BLOCK.format(e=4, t="00:59", r="3.5batch/s", s="! Checkpoint Not Saved this Epoch \n \t\tCheckpoint Directory: x \n \t\tEpoch 4")
    )
    (tmp_path / "m_01" / "training.txt").write_text(text)
    rows = LOG.read_training_logs(spark, str(tmp_path)).orderBy("epoch_no").collect()
    assert [(r["model_name"], r["epoch_no"], r["seconds"], r["batches_per_second"], r["checkpoint_saved"]) for r in rows] == [
        ("m_01", 1, 130, 2.04, True),
        ("m_01", 2, 5400, 0.25, False),
        ("m_01", 4, 59, 3.5, False),
    ]
    assert rows[0]["val_precision"] == 0.547202 and rows[0]["model_path"] == "runs/m_01/E01_A0.75_F0.41"
    assert LOG.saved_epochs(LOG.read_training_logs(spark, str(tmp_path))).count() == 3


def test_models_learn_and_reload(spark, tmp_path):
    rows = [(i, f"{'good fine' if i % 2 else 'bad poor'} word{i % 5}", i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "item_id long, text string, label int")
    scored = models.fit_and_score(df, df, "m", runs=(1,), epochs=(5,))
    assert scored.where("pred = label").count() == 60
    assert models.stacked_transfer(df, df, df, "t").where("pred = label").count() == 60
    curve = models.validation_curve(df, df, "m", (1, 5)).orderBy("epoch_no").collect()
    assert curve[1]["loss"] <= curve[0]["loss"]
    fitted = models.fit_text_model(df, 5)
    assert models.save_epoch(fitted, str(tmp_path), 1, 0.5, 0.25, every=2) is None
    path = models.save_epoch(fitted, str(tmp_path), 2, 0.753, 0.4, every=2)
    assert path.endswith("E02_A0.75_F0.4")
    again = models.score(models.load_epoch(path), df, "m", 2)
    assert again.where("pred = label").count() == 60
