"""Queries that write through a sink and read the result back, and the log reader."""

from __future__ import annotations

from pyspark.sql import functions as F

from plurivote.functions import text as T
from plurivote.operators import metrics as M
from plurivote.operators.sampling import assign_split
from plurivote.plans import inputs as I
from plurivote.plans.inputs import sql
from plurivote.plans.registry import query
from plurivote.session import scratch_path
from plurivote.sources import results_table as R
from plurivote.sources import tables as TAB
from plurivote.sources import training_log as LOG


_EDGED = "CASE doc_id % 4 WHEN 0 THEN '  ' || text || ' ' WHEN 1 THEN chr(9) || text WHEN 2 THEN '' ELSE text END AS text"


@query("src_csv", sql(f"SELECT doc_id, {_EDGED}, lang, toxic FROM partly", "partly"))
def src_csv(spark, sf_dir):
    """Texts with blanks at their ends, empty texts and nulls come back as they were."""
    path = scratch_path(spark, "corpus_csv")
    edged = F.expr(_EDGED.replace("chr(9)", "char(9)").removesuffix(" AS text")).alias("text")
    TAB.write_csv(I.partly_labelled(spark, sf_dir).select("doc_id", edged, "lang", "toxic"), path, null_text="\\N")
    return TAB.read_csv(spark, path, "doc_id bigint, text string, lang string, toxic int", null_text="\\N")


def _split_docs(spark, sf_dir):
    docs = I.table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return assign_split(docs, "doc_id", 0.1, 0.1)


_SPLITS = """SELECT doc_id, lang, text, CASE WHEN k <= floor(total * 0.1::DOUBLE) THEN 'test' WHEN k <= 2 * floor(total * 0.1::DOUBLE) THEN 'validation'
    ELSE 'train' END AS split FROM doc_rank"""


@query("src_splits", sql(_SPLITS, "doc_rank"))
def src_splits(spark, sf_dir):
    base = scratch_path(spark, "named_splits")
    _split_docs(spark, sf_dir).write.partitionBy("split").json(base)
    paths = {name: f"{base}/split={name}" for name in TAB.SPLITS}
    return TAB.read_named_splits(spark, paths, "json", "doc_id bigint, lang string, text string")


@query("split_write_roundtrip", sql(_SPLITS, "doc_rank"))
def split_write_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "splits")
    TAB.write_splits(_split_docs(spark, sf_dir), path)
    return TAB.read_splits(spark, path)


@query("split_read", sql(f"SELECT doc_id, lang, text FROM ({_SPLITS}) WHERE split = 'test'", "doc_rank"))
def split_read(spark, sf_dir):
    path = scratch_path(spark, "splits")
    TAB.write_splits(_split_docs(spark, sf_dir), path)
    return TAB.read_splits(spark, path, "test").drop("split")


@query("results_append", sql("SELECT model_name, model_epoch, epoch_no, test_accuracy, test_f1 FROM scores", "scores"))
def results_append(spark, sf_dir):
    """The control's rows, then all rows, then all again: every key is stored once."""
    path = scratch_path(spark, "results")
    scores = I.scores(spark, sf_dir)
    R.append_results(scores.where(F.col("model_name").contains("control")), path)
    R.append_results(scores, path)
    R.append_results(scores, path)
    return R.read_results(spark, path)


@query(
    "parse_list_column",
    sql(
        """SELECT item_id, epoch_no, count(*) AS entries, sum(pred)::BIGINT AS ones, max(CASE WHEN model_name = 'target-fam_c_02' THEN pred END) AS one_entry,
        count(DISTINCT family) AS families, min(family) AS first_family, min('fam''s ' || family) AS quoted FROM predictions GROUP BY item_id, epoch_no""",
        "predictions",
    ),
)
def parse_list_column(spark, sf_dir):
    """Lists and tuples kept as text, read back as arrays (one entry per model)."""
    rows = I.predictions(spark, sf_dir).groupBy("item_id", "epoch_no").agg(
        F.array_sort(F.collect_list(F.struct("model_name", "pred"))).alias("_p"),
        F.array_sort(F.collect_set("family")).alias("_f"),
    )
    texts = rows.select(
        "item_id",
        "epoch_no",
        F.concat(F.lit("["), F.array_join(F.col("_p.pred").cast("array<string>"), ", "), F.lit("]")).alias("predictions"),
        R.tuple_text(F.col("_f")).alias("inducers"),
        R.list_text(F.col("_p.model_name")).alias("models"),
        R.tuple_text(F.transform("_f", lambda f: F.concat(F.lit("fam's "), f))).alias("quoted"),
    )
    parsed = texts.select(
        "item_id",
        "epoch_no",
        T.list_from_text(F.col("predictions")).alias("p"),
        T.tuple_from_text(F.col("inducers")).alias("f"),
        T.list_from_text(F.col("models"), "string").alias("m"),
        T.tuple_from_text(F.col("quoted")).alias("q"),
    )
    return parsed.select(
        "item_id",
        "epoch_no",
        F.size("p").cast("bigint").alias("entries"),
        F.aggregate("p", F.lit(0).cast("bigint"), lambda total, x: total + x).alias("ones"),
        F.element_at("p", F.array_position("m", "target-fam_c_02").cast("int")).alias("one_entry"),
        F.size("f").cast("bigint").alias("families"),
        F.element_at("f", 1).alias("first_family"),
        F.element_at("q", 1).alias("quoted"),
    )


@query(
    "results_csv",
    sql(
        """SELECT s.model_name, s.model_epoch, s.test_accuracy, s.test_f1, s.epoch_no, row_number() OVER (PARTITION BY p.model_name, p.epoch_no ORDER BY item_id) - 1 AS item_id, pred
        FROM predictions p JOIN scores s USING (model_name, epoch_no)""",
        "predictions",
        "scores",
    ),
)
def results_csv(spark, sf_dir):
    """The result file with its list of predictions, written, read and spread again."""
    path = scratch_path(spark, "results_csv")
    R.write_results_csv(I.scores(spark, sf_dir), I.predictions(spark, sf_dir).select("model_name", "epoch_no", "item_id", "pred"), path)
    stored = R.read_results_csv(spark, path)
    return R.scores_of(stored).join(R.predictions_of(stored), ["model_name", "epoch_no"])


@query(
    "ensembles_csv",
    sql(
        f"""SELECT ensemble_id::VARCHAR AS ensemble_id, inducers, (SELECT string_agg(family || '_0' || run, ',' ORDER BY family, run) FROM member m, range(1, {I.RUNS + 1}) r(run)
        WHERE m.ensemble_id = board.ensemble_id) AS inducers_spec, 'toxic''s "test", 1' AS dataset, test_accuracy, test_f1, ensemble_type FROM board""",
        "board",
        "member",
    ),
)
def ensembles_csv(spark, sf_dir):
    """The ensemble file with its tuples, written and read again."""
    path = scratch_path(spark, "ensembles_csv")
    board = I.leaderboard(spark, sf_dir, I.scores(spark, sf_dir)).withColumn("dataset", F.lit('toxic\'s "test", 1'))
    R.write_ensembles_csv(board.select("ensemble_id", "inducers", "inducers_spec", "dataset", "test_accuracy", "test_f1", "ensemble_type"), path)
    return R.read_ensembles_csv(spark, path).withColumns({c: F.array_join(c, ",") for c in ("inducers", "inducers_spec")})


def _log_lines():
    """An epoch's block in the shape of a training log, from its metrics and row count."""
    batches = F.ceil(F.col("n") / 16)

    def clock(seconds):
        short = F.format_string("%02d:%02d", F.floor(seconds / 60) % 60, seconds % 60)
        return F.when(seconds < 3600, short).otherwise(F.concat(F.floor(seconds / 3600).cast("string"), F.lit(":"), short))

    seconds = F.col("count_1") * 7
    rate = F.when(F.col("epoch_no") % 2 == 1, F.format_string("%.2fbatch/s", F.lit(2.5))).otherwise("4.00s/batch")
    tag = T.epoch_tag(F.col("epoch_no"), F.col("accuracy"), F.col("f1"))
    folder = F.concat(F.lit("model_saves/"), F.col("model_name"), F.lit("/"), tag)

    def metric(title, value):
        return F.format_string(f"\t - {title}: %.6f", value)

    return F.concat_ws(
        "\n",
        F.format_string("Epoch %d: 100%%|####| %d/%d [%s<00:00,  %s]", "epoch_no", batches, batches, clock(seconds), rate),
        F.format_string("\t Validation %d: 100%%|####| %d/%d [%s<00:00,  5.00batch/s]", batches - 1, batches, batches, clock(F.col("n") % 60)),
        F.lit(""),
        metric("Train loss", 1 - F.col("accuracy")),
        metric("Validation Loss", 1 - F.col("f1")),
        metric("Validation Accuracy", F.col("accuracy")),
        metric("Validation F1", F.col("f1")),
        metric("Validation Recall", F.col("recall")),
        metric("Validation Precision", F.col("precision")),
        F.lit(""),
        F.format_string("\t * Model @ epoch %d saved to %s", "epoch_no", folder),
        F.when(F.col("model_name").contains("control"), F.format_string("\t * Model checkpoint saved to %s/checkpoint.pt", folder))
        .when(F.col("epoch_no") == 1, F.format_string("\t ! Checkpoint Not Saved, Save Frequency: None, Epoch %d", "epoch_no"))
        .otherwise(F.format_string("\t ! Checkpoint Directory: None, Save Frequency: None, Epoch %d", "epoch_no")),
        F.lit(""),
    )


@query(
    "training_log_metrics",
    sql(
        """SELECT r.model_name, r.epoch_no, ceil(n / 16.0)::INT AS batches, (7 * ones)::BIGINT AS seconds, CASE WHEN r.epoch_no % 2 = 1 THEN 2.5 ELSE 0.25 END::DOUBLE AS batches_per_second,
        (n % 60)::BIGINT AS val_seconds, printf('%.6f', 1 - accuracy)::DOUBLE AS train_loss, printf('%.6f', 1 - f1)::DOUBLE AS val_loss,
        printf('%.6f', accuracy)::DOUBLE AS val_accuracy, printf('%.6f', f1)::DOUBLE AS val_f1, printf('%.6f', recall)::DOUBLE AS val_recall,
        printf('%.6f', precision)::DOUBLE AS val_precision, 'model_saves/' || r.model_name || '/' || model_epoch AS model_path, true AS model_saved, r.family = 'control' AS checkpoint_saved,
        ceil(n / 16.0)::INT AS val_batches, 5.0::DOUBLE AS val_batches_per_second,
        CASE WHEN r.family = 'control' THEN 'model_saves/' || r.model_name || '/' || model_epoch || '/checkpoint.pt' END AS checkpoint_path
        FROM raw_scores r JOIN scores s USING (model_name, epoch_no)
        JOIN (SELECT model_name, epoch_no, sum(pred) AS ones FROM predictions GROUP BY ALL) USING (model_name, epoch_no)""",
        "scores",
        "raw_scores",
        "predictions",
    ),
)
def training_log_metrics(spark, sf_dir):
    """Logs of all models, written as text with one folder per model, then parsed."""
    by = ["model_name", "epoch_no"]
    rows = M.join_truth(I.predictions(spark, sf_dir), I.truth(spark, sf_dir))
    ones = rows.groupBy(*by).agg(F.count(F.when(F.col("pred") == 1, 1)).alias("count_1"))
    blocks = M.classification_metrics(rows, by).join(ones, by).select("model_name", "epoch_no", _log_lines().alias("value"))
    path = scratch_path(spark, "logs")
    # One text file per model with its epochs in order.
    logs = blocks.repartition("model_name").sortWithinPartitions("model_name", "epoch_no")
    logs.select(F.col("model_name").alias("run_name"), "value").write.partitionBy("run_name").text(path)
    parsed = LOG.read_training_logs(spark, path)
    return parsed.withColumn("model_name", F.regexp_replace("model_name", "^run_name=", ""))
