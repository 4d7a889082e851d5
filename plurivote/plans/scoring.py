"""Queries on predictions: metrics, epochs, ensembles, similarity, baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plurivote.functions import scores as S
from plurivote.functions import text as T
from plurivote.operators import baseline, edit_distance, ranking, results
from plurivote.operators import encode as ENC
from plurivote.operators import ensemble as E
from plurivote.operators import metrics as M
from plurivote.operators import similarity as SIM
from plurivote.plans import inputs as I
from plurivote.plans.inputs import sql
from plurivote.plans.registry import query
from plurivote.session import small_side

METRIC_COLUMNS = "accuracy, precision, recall, f1"


# ---- metrics ---------------------------------------------------------------


@query("argmax_class", sql("SELECT item_id, (list_position(logits, list_max(logits)) - 1)::INT AS pred FROM logits", "logits"))
def argmax_class(spark, sf_dir):
    return I.logits(spark, sf_dir).select("item_id", S.argmax(F.col("logits")).alias("pred"))


@query(
    "classification_metrics",
    sql(f"SELECT model_name, epoch_no, n, {METRIC_COLUMNS} FROM raw_scores", "raw_scores"),
)
def classification_metrics(spark, sf_dir):
    rows = M.join_truth(I.predictions(spark, sf_dir), I.truth(spark, sf_dir))
    return M.classification_metrics(rows, ["model_name", "epoch_no"])


_ARGMAX = "SELECT label, (list_position(logits, list_max(logits)) - 1)::INT AS pred FROM logits"


def _class_rows(spark, sf_dir) -> DataFrame:
    return I.logits(spark, sf_dir).select("item_id", "logits", "label", S.argmax(F.col("logits")).alias("pred"))


@query(
    "micro_metrics",
    sql(
        f""", sides AS (SELECT c.class, (label = class AND pred = class)::INT AS tp, (label <> class AND pred = class)::INT AS fp, (label = class AND pred <> class)::INT AS fn
            FROM ({_ARGMAX}), range(0, 10) c(class)), sums AS (SELECT sum(tp)::DOUBLE AS tp, sum(fp) AS fp, sum(fn) AS fn FROM sides)
        SELECT (tp + fn)::BIGINT AS n, tp / (tp + fn) AS accuracy, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2.0::DOUBLE * tp / (2 * tp + fp + fn) AS f1 FROM sums""",
        "logits",
    ),
)
def micro_metrics(spark, sf_dir):
    return M.metrics(_class_rows(spark, sf_dir), num_labels=10)


@query(
    "per_class_counts",
    sql(
        f"""SELECT c.class::INT AS class, sum((label = class AND pred = class)::INT)::BIGINT AS tp, sum((label <> class AND pred = class)::INT)::BIGINT AS fp,
        sum((label = class AND pred <> class)::INT)::BIGINT AS fn FROM ({_ARGMAX}), range(0, 10) c(class) GROUP BY 1""",
        "logits",
    ),
)
def per_class_counts(spark, sf_dir):
    return M.per_class_counts(_class_rows(spark, sf_dir))


@query(
    "confusion_matrix",
    sql(
        """SELECT f.family, f.label, count(p.item_id) FILTER (p.pred = 0) AS pred_0, count(p.item_id) FILTER (p.pred = 1) AS pred_1,
        count(p.item_id) FILTER (p.pred NOT IN (0, 1)) AS pred_other, count(p.item_id) FILTER (p.pred IS NULL) AS pred_null
        FROM (SELECT DISTINCT family, l.label FROM rough, (VALUES (0), (1), (2)) l(label)) f LEFT JOIN rough p USING (family, label) GROUP BY ALL""",
        "rough",
    ),
)
def confusion_matrix(spark, sf_dir):
    """With predictions outside the listed classes, null ones, and a class without truth."""
    rows = M.join_truth(I.rough_predictions(spark, sf_dir), I.truth(spark, sf_dir))
    return M.confusion_matrix(rows, (0, 1), ["family"], labels=(0, 1, 2))


_BATCHED = """SELECT item_id, (row_number() OVER (ORDER BY md5(concat_ws(':', '1', item_id)), item_id) - 1) // 16 AS batch_id FROM """


@query(
    "batch_mean_metrics",
    sql(
        f"""SELECT model_name, epoch_no, count(*) AS batches, round(avg(accuracy), 9) AS accuracy, round(avg(precision), 9) AS precision,
        round(avg(recall), 9) AS recall, round(avg(f1), 9) AS f1
        FROM ({I._metric_sql("model_name, epoch_no, batch_id", f"(SELECT * FROM predictions JOIN ({_BATCHED} truth) USING (item_id))")})
        GROUP BY model_name, epoch_no""",
        "predictions",
    ),
)
def batch_mean_metrics(spark, sf_dir):
    batches = ENC.make_batches(I.truth(spark, sf_dir), "item_id", 16).select("item_id", "label", "batch_id")
    # Moved by item as in ``join_truth``; the predictions are never broadcast.
    rows = I.predictions(spark, sf_dir).join(batches.hint("merge"), "item_id")
    means = M.batch_mean_metrics(rows, "batch_id", ["model_name", "epoch_no"])
    return means.withColumns(I.round9("accuracy", "precision", "recall", "f1"))


_LOSS = """SELECT item_id, list_max(logits)::DOUBLE + ln(list_sum(list_transform(logits, lambda v: exp(v::DOUBLE - list_max(logits)::DOUBLE))))
    - logits[label + 1]::DOUBLE AS loss FROM logits"""


@query(
    "cross_entropy",
    sql(
        f"""SELECT sum(rows)::BIGINT AS n, round(sum(total) / sum(rows), 9) AS loss, round(avg(mean), 9) AS batch_mean_loss FROM (
        SELECT batch_id, count(*) AS rows, sum(loss) AS total, avg(loss) AS mean
        FROM ({_LOSS}) JOIN ({_BATCHED} logits) USING (item_id) GROUP BY batch_id)""",
        "logits",
    ),
)
def cross_entropy(spark, sf_dir):
    rows = ENC.make_batches(I.logits(spark, sf_dir), "item_id", 16)
    return M.cross_entropy(rows, "logits", "label", batch="batch_id").withColumns(I.round9("loss", "batch_mean_loss"))


@query("evaluate_models", sql("SELECT model_name, model_epoch, epoch_no, test_accuracy, test_f1 FROM scores", "scores"))
def evaluate_models(spark, sf_dir):
    return M.evaluate_models(I.predictions(spark, sf_dir), I.truth(spark, sf_dir))


# ---- epochs and names --------------------------------------------------------


def _ties(spark, sf_dir):
    """Scores to one place, so that epochs of a model do tie."""
    return results.round_scores(I.scores(spark, sf_dir), places=1)


_TIES = """SELECT model_name, epoch_no, round_even(test_f1 * 10::DOUBLE, 0) / 10::DOUBLE AS test_f1,
    round_even(test_accuracy * 10::DOUBLE, 0) / 10::DOUBLE AS test_accuracy FROM scores"""


@query(
    "best_epoch_with_ties",
    sql(
        f"SELECT model_name, epoch_no, test_f1 FROM ({_TIES}) QUALIFY test_f1 = max(test_f1) OVER (PARTITION BY model_name)",
        "scores",
    ),
)
def best_epoch_with_ties(spark, sf_dir):
    return ranking.best_epoch_with_ties(_ties(spark, sf_dir), "test_f1").select("model_name", "epoch_no", "test_f1")


@query(
    "best_epoch_single",
    sql(
        f"""SELECT model_name, epoch_no, test_accuracy FROM ({_TIES})
        QUALIFY row_number() OVER (PARTITION BY model_name ORDER BY test_accuracy DESC, epoch_no) = 1""",
        "scores",
    ),
)
def best_epoch_single(spark, sf_dir):
    return ranking.best_epoch_single(_ties(spark, sf_dir), "test_accuracy").select(
        "model_name", "epoch_no", "test_accuracy"
    )


@query(
    "epoch_rank_both_metrics",
    sql(
        """SELECT model_name, model_epoch, r1 AS rank_test_f1, r2 AS rank_test_accuracy, 'model_saves/' || model_name || '/' || model_epoch AS parent FROM (
        SELECT *, dense_rank() OVER (PARTITION BY model_name ORDER BY test_f1 DESC)::INT AS r1,
        dense_rank() OVER (PARTITION BY model_name ORDER BY test_accuracy DESC)::INT AS r2 FROM scores) WHERE r1 = 1""",
        "scores",
    ),
)
def epoch_rank_both_metrics(spark, sf_dir):
    ranked = ranking.epoch_rank_both_metrics(I.scores(spark, sf_dir), "test_f1", "test_accuracy")
    parents = ranking.stage_registry(ranked, "model_saves", "target").select("model_name", "model_epoch", "parent")
    return ranked.join(parents, ["model_name", "model_epoch"]).select(
        "model_name", "model_epoch", "rank_test_f1", "rank_test_accuracy", "parent"
    )


@query(
    "stage_lineage",
    sql(
        """, ranked AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY model_name, epoch_no) AS k FROM scores)
        SELECT a.model_name || '/' || a.model_epoch AS model, b.model_name || '/' || b.model_epoch AS ancestor, (a.k - b.k)::INT AS steps, b.k = 1 AS is_first
        FROM ranked a JOIN ranked b ON a.family = b.family AND b.k <= a.k""",
        "scores",
    ),
)
def stage_lineage(spark, sf_dir):
    """Each run's epochs follow each other, and each run its family's run before: from every epoch back to the first."""
    scores = I.scores(spark, sf_dir).withColumn("family", T.model_family(F.col("model_name")))
    name = F.concat_ws("/", "model_name", "model_epoch")
    before = F.lag(name).over(Window.partitionBy("family").orderBy("model_name", "epoch_no"))
    return ranking.lineage(scores.select(name.alias("model"), before.alias("parent")))


@query(
    "prediction_alignment",
    sql(
        """SELECT model_name, epoch_no, count(*) FILTER (t.item_id IS NOT NULL) AS matched, count(*) FILTER (t.item_id IS NULL) AS no_truth,
        (SELECT count(*) FROM truth) - count(*) FILTER (t.item_id IS NOT NULL) AS missing FROM rough LEFT JOIN truth t USING (item_id) GROUP BY ALL""",
        "rough",
        "truth",
    ),
)
def prediction_alignment(spark, sf_dir):
    """What either side lacks, for models that left items out."""
    return M.alignment(I.rough_predictions(spark, sf_dir), I.truth(spark, sf_dir))


_DISPLAY = """SELECT *, regexp_replace(model_name, '_[0-9]+$', '') AS model_cat, CASE regexp_replace(regexp_replace(model_name, '_[0-9]+$', ''), '^target-', '')
    WHEN 'fam_b' THEN 'Fam_B-coarse' ELSE regexp_replace(regexp_replace(model_name, '_[0-9]+$', ''), '^target-', '') END AS model_display_name FROM scores"""


def _displayed(spark, sf_dir):
    return results.with_display_name(I.scores(spark, sf_dir), I.PREFIXES, I.RENAMES)


@query("model_family", sql(f"SELECT model_name, epoch_no, model_cat, model_display_name FROM ({_DISPLAY})", "scores"))
def model_family(spark, sf_dir):
    return _displayed(spark, sf_dir).select("model_name", "epoch_no", "model_cat", "model_display_name")


@query(
    "sort_case_insensitive",
    sql(
        f"""SELECT model_display_name, model_name, epoch_no,
        row_number() OVER (ORDER BY lower(model_display_name), model_display_name, model_name, epoch_no)::INT AS position FROM ({_DISPLAY})""",
        "scores",
    ),
)
def sort_case_insensitive(spark, sf_dir):
    """The order itself, made visible as a position (one row per model and epoch)."""
    named = _displayed(spark, sf_dir).select("model_display_name", "model_name", "epoch_no")
    return results.sorted_positions(named, "model_display_name", "model_name", "epoch_no")


@query(
    "epoch_tag_parse",
    sql(
        """SELECT model_name, model_epoch, regexp_extract(model_epoch, '^E([0-9]+)_A', 1)::INT AS epoch_no,
        regexp_extract(model_epoch, '_A([0-9.]+)_F', 1)::DOUBLE AS accuracy, regexp_extract(model_epoch, '_F([0-9.]+)$', 1)::DOUBLE AS f1 FROM scores""",
        "scores",
    ),
)
def epoch_tag_parse(spark, sf_dir):
    tagged = I.scores(spark, sf_dir).select(
        "model_name", T.epoch_tag(F.col("epoch_no"), F.col("test_accuracy"), F.col("test_f1")).alias("model_epoch")
    )
    return tagged.select("model_name", "model_epoch", T.parse_epoch_tag(F.col("model_epoch")).alias("_t")).select(
        "model_name", "model_epoch", "_t.*"
    )


@query(
    "round_scores",
    sql(
        """SELECT model_name, epoch_no, round_even(test_f1 * 100::DOUBLE, 0) / 100::DOUBLE AS test_f1,
        round_even(test_accuracy * 100::DOUBLE, 0) / 100::DOUBLE AS test_accuracy FROM scores""",
        "scores",
    ),
)
def round_scores(spark, sf_dir):
    return results.round_scores(I.scores(spark, sf_dir)).select("model_name", "epoch_no", "test_f1", "test_accuracy")


@query(
    "score_summary_by_family",
    sql(
        f"""SELECT model_display_name, min(f) AS test_f1_min, max(f) AS test_f1_max, round(median(f), 9) AS test_f1_median,
        min(a) AS test_accuracy_min, max(a) AS test_accuracy_max, round(median(a), 9) AS test_accuracy_median FROM (
        SELECT model_display_name, round_even(test_f1 * 100::DOUBLE, 0) / 100::DOUBLE AS f, round_even(test_accuracy * 100::DOUBLE, 0) / 100::DOUBLE AS a
        FROM ({_DISPLAY})) GROUP BY 1""",
        "scores",
    ),
)
def score_summary_by_family(spark, sf_dir):
    rounded = results.round_scores(_displayed(spark, sf_dir))
    summary = results.score_summary_by_family(rounded, "model_display_name")
    return summary.withColumns(I.round9("test_f1_median", "test_accuracy_median"))


@query(
    "score_lists_by_family",
    sql(
        f"""SELECT model_display_name, string_agg(printf('%.2f', f), ' ' ORDER BY f) AS test_f1, string_agg(printf('%.2f', a), ' ' ORDER BY a) AS test_accuracy FROM (
        SELECT model_display_name, round_even(test_f1 * 100::DOUBLE, 0) / 100::DOUBLE AS f, round_even(test_accuracy * 100::DOUBLE, 0) / 100::DOUBLE AS a
        FROM ({_DISPLAY})) GROUP BY 1""",
        "scores",
    ),
)
def score_lists_by_family(spark, sf_dir):
    lists = results.score_lists_by_family(results.round_scores(_displayed(spark, sf_dir)), "model_display_name")

    def shown(c):
        return F.array_join(F.transform(c, lambda x: F.format_string("%.2f", x)), " ").alias(c)

    return lists.select("model_display_name", shown("test_f1"), shown("test_accuracy"))


@query(
    "model_epoch_listing",
    sql("SELECT 'model_saves/' || model_name || '/' || model_epoch AS path, model_name, model_epoch FROM scores", "scores"),
)
def model_epoch_listing(spark, sf_dir):
    from plurivote.sources.results_table import model_epoch_listing as listing

    paths = I.scores(spark, sf_dir).select(F.concat_ws("/", F.lit("model_saves"), "model_name", "model_epoch").alias("path"))
    return listing(paths)


# ---- ensembles -----------------------------------------------------------------


@query("inducer_combinations", sql("SELECT ensemble_id, size, inducers FROM combos", "combos"))
def inducer_combinations(spark, sf_dir):
    return I.combinations(I.scores(spark, sf_dir)).withColumn("inducers", F.array_join("inducers", ","))


@query(
    "ensemble_membership",
    sql(
        "SELECT ensemble_id, size, family, family || '_0' || run AS model_name FROM member, range(1, 4) r(run)",
        "member",
    ),
)
def ensemble_membership(spark, sf_dir):
    scores = I.scores(spark, sf_dir)
    return E.ensemble_membership(I.combinations(scores), scores.where(~ranking.is_control()))


@query(
    "majority_vote",
    sql("SELECT selection, ensemble_id, size, item_id, pred, votes AS winning_votes FROM winners", "winners"),
)
def majority_vote(spark, sf_dir):
    scores = I.scores(spark, sf_dir)
    return E.majority_vote(I.picked(spark, sf_dir, scores), I.combinations(scores)).drop("ballots")


@query("ensemble_scores", sql("SELECT selection, ensemble_id, size, inducers, n, accuracy, f1 FROM ens JOIN combos USING (ensemble_id, size)", "ens", "combos"))
def ensemble_scores(spark, sf_dir):
    scored = I.ensemble_scores(spark, sf_dir, I.scores(spark, sf_dir))
    return scored.withColumn("inducers", F.array_join("inducers", ","))


_BOARD = "ensemble_id, inducers, test_accuracy, test_f1, ensemble_type, place"


@query(
    "ensemble_leaderboard",
    sql(
        f"""SELECT {_BOARD}, (SELECT string_agg(family || '_0' || run, ',' ORDER BY family, run) FROM member m, range(1, {I.RUNS + 1}) r(run)
        WHERE m.ensemble_id = board.ensemble_id) AS inducers_spec, 'toxic_test' AS dataset FROM board""",
        "board",
        "member",
    ),
)
def ensemble_leaderboard(spark, sf_dir):
    board = I.leaderboard(spark, sf_dir, I.scores(spark, sf_dir))
    board = board.withColumns({c: F.array_join(c, ",") for c in ("inducers", "inducers_spec")})
    return board.drop("selection")


_CUSTOM = ["target-FAM_A_01", "target-fam_a_02", "target-fam_a_03", "target-Fam_c_01", "target-fam_c_02"]
_CUSTOM_VOTE = f"""SELECT item_id, label, pred, votes FROM (
    SELECT p.item_id, p.label, p.pred, count(*) AS votes, row_number() OVER (PARTITION BY p.item_id ORDER BY count(*) DESC, p.pred) AS k
    FROM predictions p JOIN chosen c ON p.model_name = c.model_name AND p.epoch_no = c.epoch_no AND c.selection = 'best-F1'
    WHERE p.model_name IN ({", ".join("'" + m.lower() + "'" for m in _CUSTOM)}) GROUP BY p.item_id, p.label, p.pred) WHERE k = 1"""


def _custom(spark, sf_dir):
    chosen = E.chosen_epochs(I.scores(spark, sf_dir), {"best-F1": "test_f1"})
    return E.custom_ensemble(I.predictions(spark, sf_dir), chosen, _CUSTOM)


@query("custom_ensemble", sql(f"SELECT item_id, pred, votes AS winning_votes FROM ({_CUSTOM_VOTE})", "chosen", "predictions"))
def custom_ensemble(spark, sf_dir):
    return _custom(spark, sf_dir).select("item_id", "pred", "winning_votes")


@query(
    "custom_ensemble_scores",
    sql(f"SELECT n, accuracy, f1 FROM ({I._metric_sql('1', f'({_CUSTOM_VOTE})')})", "chosen", "predictions").replace(
        "SELECT 1, count(*)", "SELECT count(*)"
    ).replace("GROUP BY 1)", ")"),
)
def custom_ensemble_scores(spark, sf_dir):
    rows = M.join_truth(_custom(spark, sf_dir), I.truth(spark, sf_dir))
    return M.classification_metrics(rows).select("n", "accuracy", "f1")


@query(
    "ensemble_errors",
    sql(
        f"""SELECT item_id, pred, v.label, text FROM ({_CUSTOM_VOTE}) v JOIN corpus USING (item_id) WHERE pred <> v.label""",
        "chosen",
        "predictions",
        "corpus",
    ),
)
def ensemble_errors(spark, sf_dir):
    return E.ensemble_errors(_custom(spark, sf_dir), I.truth(spark, sf_dir), I.corpus(spark, sf_dir))


def _rough(spark, sf_dir):
    """Votes of the second epochs, with null, missing and third-class predictions."""
    rows = I.rough_predictions(spark, sf_dir).where((F.col("epoch_no") == 2) & ~ranking.is_control())
    return rows.select(F.lit("second").alias("selection"), "item_id", "model_name", "family", "pred")


_ROUGH_WINNERS = """SELECT v.selection, v.ensemble_id, v.size, v.item_id, t.label, v.pred, v.votes, v.ballots FROM (
    SELECT *, sum(votes) OVER (PARTITION BY selection, ensemble_id, item_id)::BIGINT AS ballots,
        row_number() OVER (PARTITION BY selection, ensemble_id, item_id ORDER BY votes DESC, pred) AS k
    FROM (SELECT p.selection, m.ensemble_id, m.size, p.item_id, p.pred, count(*) AS votes
        FROM member m JOIN rough_picked p USING (family) WHERE p.pred IS NOT NULL GROUP BY ALL)) v JOIN truth t USING (item_id) WHERE k = 1"""


@query(
    "majority_vote_rough",
    sql(f"SELECT selection, ensemble_id, size, item_id, pred::INT AS pred, votes AS winning_votes, ballots FROM ({_ROUGH_WINNERS})", "member", "rough_picked", "truth"),
)
def majority_vote_rough(spark, sf_dir):
    picked = _rough(spark, sf_dir)
    return E.majority_vote(picked, E.inducer_combinations(picked, I.SIZES))


@query(
    "ensemble_scores_rough",
    sql(
        f"""SELECT selection, ensemble_id, size, inducers, n, accuracy, f1 FROM
        ({I._metric_sql('selection, ensemble_id, size', f'({_ROUGH_WINNERS})')}) JOIN combos USING (ensemble_id, size)""",
        "member",
        "rough_picked",
        "truth",
        "combos",
    ),
)
def ensemble_scores_rough(spark, sf_dir):
    picked = _rough(spark, sf_dir)
    scored = E.ensemble_scores(picked, I.truth(spark, sf_dir), E.inducer_combinations(picked, I.SIZES))
    return scored.withColumn("inducers", F.array_join("inducers", ","))


# ---- analysis of results ---------------------------------------------------------


@query(
    "control_vs_target",
    sql(
        """SELECT CASE WHEN model_name LIKE '%control%' THEN 'control' ELSE 'target' END AS kind, count(*) AS epochs,
        min(test_f1) AS min_f1, max(test_f1) AS max_f1, min(test_accuracy) AS min_accuracy, max(test_accuracy) AS max_accuracy
        FROM scores GROUP BY 1""",
        "scores",
    ),
)
def control_vs_target(spark, sf_dir):
    kind = F.when(ranking.is_control(), "control").otherwise("target")
    return I.scores(spark, sf_dir).groupBy(kind.alias("kind")).agg(
        F.count(F.lit(1)).alias("epochs"),
        F.min("test_f1").alias("min_f1"),
        F.max("test_f1").alias("max_f1"),
        F.min("test_accuracy").alias("min_accuracy"),
        F.max("test_accuracy").alias("max_accuracy"),
    )


@query(
    "better_than_control",
    sql(
        """SELECT selection, count(*) AS candidates,
        sum((test_f1 > (SELECT max(test_f1) FROM scores WHERE family = 'control'))::INT)::BIGINT AS better_test_f1,
        sum((test_accuracy > (SELECT max(test_accuracy) FROM scores WHERE family = 'control'))::INT)::BIGINT AS better_test_accuracy
        FROM board GROUP BY selection""",
        "board",
        "scores",
    ),
)
def better_than_control(spark, sf_dir):
    scores = I.scores(spark, sf_dir)
    control = scores.where(ranking.is_control())
    return ranking.better_than_control(
        I.leaderboard(spark, sf_dir, scores), control, ["test_f1", "test_accuracy"], ["selection"]
    )


_TOP = "SELECT * FROM (SELECT *, row_number() OVER (ORDER BY {0} DESC, ensemble_type DESC, ensemble_id) AS top FROM board WHERE selection = '{1}') WHERE top <= 10"


def _top10(spark, sf_dir):
    board = small_side(I.leaderboard(spark, sf_dir, I.scores(spark, sf_dir)))
    parts = [
        results.top_ensembles(board.where(F.col("selection") == selection), metric) for selection, metric in I.SELECTIONS.items()
    ]
    return parts[0].unionByName(parts[1])


@query(
    "top10_ensembles",
    sql(
        f"SELECT {_BOARD} FROM ({_TOP.format('test_f1', 'best-F1')}) UNION ALL SELECT {_BOARD} FROM ({_TOP.format('test_accuracy', 'best-acc')})",
        "board",
    ),
)
def top10_ensembles(spark, sf_dir):
    top = _top10(spark, sf_dir).withColumn("inducers", F.array_join("inducers", ","))
    return top.select("ensemble_id", "inducers", "test_accuracy", "test_f1", "ensemble_type", "place")


@query(
    "inducer_counts",
    sql(
        f"""SELECT selection, inducer, count(*) AS ensembles FROM (
        SELECT selection, unnest(string_split(inducers, ',')) AS inducer FROM
        ({_TOP.format('test_f1', 'best-F1')} UNION ALL {_TOP.format('test_accuracy', 'best-acc')})) GROUP BY ALL""",
        "board",
    ),
)
def inducer_counts(spark, sf_dir):
    return results.inducer_counts(_top10(spark, sf_dir), ["selection"])


@query(
    "means_and_deltas",
    sql(
        """SELECT selection, kind, round(f, 9) AS mean_test_f1, round(a, 9) AS mean_test_accuracy,
        round(f - max(CASE kind WHEN 'control' THEN f END) OVER (PARTITION BY selection), 9) AS delta_test_f1,
        round(a - max(CASE kind WHEN 'control' THEN a END) OVER (PARTITION BY selection), 9) AS delta_test_accuracy FROM (
        SELECT selection, kind, avg(test_f1) AS f, avg(test_accuracy) AS a FROM (
            SELECT selection, CASE WHEN family = 'control' THEN 'control' ELSE 'target' END AS kind, test_f1, test_accuracy FROM (
                SELECT 'best-F1' AS selection, * FROM scores QUALIFY test_f1 = max(test_f1) OVER (PARTITION BY model_name)
                UNION ALL SELECT 'best-acc', * FROM scores QUALIFY test_accuracy = max(test_accuracy) OVER (PARTITION BY model_name))
            UNION ALL SELECT selection, ensemble_type, test_f1, test_accuracy FROM board) GROUP BY ALL)""",
        "scores",
        "board",
    ),
)
def means_and_deltas(spark, sf_dir):
    scores = I.scores(spark, sf_dir)
    groups = I.leaderboard(spark, sf_dir, scores).select("selection", F.col("ensemble_type").alias("kind"), "test_f1", "test_accuracy")
    kind = F.when(ranking.is_control(), "control").otherwise("target").alias("kind")
    for selection, metric in I.SELECTIONS.items():
        best = ranking.best_epoch_with_ties(scores, metric)
        groups = groups.unionByName(best.select(F.lit(selection).alias("selection"), kind, "test_f1", "test_accuracy"))
    means = results.means_and_deltas(groups, "selection", "kind", "control")
    return means.withColumns(I.round9("mean_test_f1", "mean_test_accuracy", "delta_test_f1", "delta_test_accuracy"))


_RATES = """SELECT model_name, epoch_no, count(*) AS n, sum((pred = 0)::INT)::BIGINT AS count_0, sum((pred = 1)::INT)::BIGINT AS count_1,
    100.0::DOUBLE * sum((pred = 0)::INT) / count(*) AS percent_0, 100.0::DOUBLE * sum((pred = 1)::INT) / count(*) AS percent_1
    FROM predictions GROUP BY model_name, epoch_no"""


@query("prediction_rates", sql(_RATES, "predictions"))
def prediction_rates(spark, sf_dir):
    return results.prediction_rates(I.predictions(spark, sf_dir))


@query(
    "rate_bands",
    sql(
        f""", p AS (SELECT percent_0 AS p FROM ({_RATES})), counted AS (
        SELECT 'strict' AS bands, CASE WHEN p <= 19 THEN '0-19' WHEN p BETWEEN 20 AND 49 THEN '20-49'
            WHEN p >= 50 AND p <= 69.9::DOUBLE THEN '50-70' WHEN p >= 70 THEN '70+' ELSE 'unbanded' END AS band, count(*) AS models FROM p GROUP BY ALL
        UNION ALL SELECT 'whole', CASE WHEN p < 20 THEN '0-20' WHEN p < 50 THEN '20-50' WHEN p < 70 THEN '50-70' WHEN p >= 70 THEN '70+' ELSE 'unbanded' END, count(*) FROM p GROUP BY ALL)
        SELECT a.bands, a.band, coalesce(c.models, 0) AS models FROM (VALUES ('strict', '0-19'), ('strict', '20-49'), ('strict', '50-70'), ('strict', '70+'), ('strict', 'unbanded'),
            ('whole', '0-20'), ('whole', '20-50'), ('whole', '50-70'), ('whole', '70+'), ('whole', 'unbanded')) a(bands, band) LEFT JOIN counted c USING (bands, band)""",
        "predictions",
    ),
)
def rate_bands(spark, sf_dir):
    rates = small_side(results.prediction_rates(I.predictions(spark, sf_dir)))
    strict = results.rate_bands(rates, "percent_0").select(F.lit("strict").alias("bands"), "band", "models")
    whole = results.rate_bands(rates, "percent_0", strict=False).select(F.lit("whole").alias("bands"), "band", "models")
    return strict.unionByName(whole)


# ---- similarity -------------------------------------------------------------------


def _pairs(spark, sf_dir):
    """Pair counts of the models' best epochs."""
    chosen = ranking.best_epoch_single(I.scores(spark, sf_dir), "test_f1").select("model_name", "epoch_no")
    chosen = small_side(chosen)
    rows = I.predictions(spark, sf_dir).join(chosen, ["model_name", "epoch_no"])
    return SIM.pair_counts(rows, [r["model_name"] for r in chosen.collect()])


@query(
    "pairwise_hamming",
    sql(
        """SELECT model_a, model_b, (n - same)::DOUBLE / n AS hamming, n - same AS differing, same::DOUBLE / n AS agreement FROM pairs""",
        "pairs",
    ),
)
def pairwise_hamming(spark, sf_dir):
    return SIM.hamming(_pairs(spark, sf_dir))


@query(
    "pairwise_counts_rough",
    sql(
        """SELECT a.model_name AS model_a, b.model_name AS model_b, count(*) AS n, sum((a.pred = b.pred)::INT)::BIGINT AS same,
        sum((a.pred = 1 AND b.pred = 1)::INT)::BIGINT AS both, sum((a.pred = 1 OR b.pred = 1)::INT)::BIGINT AS either
        FROM rough a JOIN rough b USING (item_id) WHERE a.epoch_no = 3 AND b.epoch_no = 3 AND a.pred IS NOT NULL AND b.pred IS NOT NULL GROUP BY ALL""",
        "rough",
    ),
)
def pairwise_counts_rough(spark, sf_dir):
    """Pairs over the items that both models scored."""
    return SIM.pair_counts(I.rough_predictions(spark, sf_dir).where("epoch_no = 3"))


@query("pairwise_jaccard", sql("SELECT model_a, model_b, both_one::DOUBLE / nullif(either_one, 0) AS jaccard FROM pairs", "pairs"))
def pairwise_jaccard(spark, sf_dir):
    return SIM.jaccard(_pairs(spark, sf_dir))


@query("pairwise_russell_rao", sql("SELECT model_a, model_b, (n - both_one)::DOUBLE / n AS russell_rao FROM pairs", "pairs"))
def pairwise_russell_rao(spark, sf_dir):
    return SIM.russell_rao(_pairs(spark, sf_dir))


@query(
    "pairwise_levenshtein",
    sql(
        """SELECT a.family, count(*) AS n, sum(levenshtein(a.seq, b.seq))::BIGINT AS edits, max(levenshtein(a.seq, b.seq))::INT AS max_edits
        FROM (SELECT item_id, family, string_agg(pred::VARCHAR, '' ORDER BY run, epoch_no) AS seq FROM predictions GROUP BY ALL) a
        JOIN (SELECT item_id, string_agg(pred::VARCHAR, '' ORDER BY run, epoch_no) AS seq FROM predictions WHERE family = 'control' GROUP BY ALL) b
        USING (item_id) WHERE a.family <> 'control' GROUP BY a.family""",
        "predictions",
    ),
)
def pairwise_levenshtein(spark, sf_dir):
    slots = [(run, epoch) for run in range(1, I.RUNS + 1) for epoch in range(1, I.EPOCHS + 1)]
    return SIM.family_levenshtein(I.predictions(spark, sf_dir), "control", slots)


@query(
    "model_levenshtein",
    sql(
        """, seqs AS (SELECT model_name, item_id // 64 AS block, string_agg(pred::VARCHAR, '' ORDER BY item_id) AS seq FROM best_f1 GROUP BY ALL)
        SELECT a.model_name, count(*) AS blocks, sum(length(a.seq))::BIGINT AS n, sum(levenshtein(a.seq, coalesce(b.seq, '')))::BIGINT AS edits
        FROM seqs a LEFT JOIN (SELECT * FROM seqs WHERE model_name = 'control_01') b USING (block) WHERE a.model_name <> 'control_01' GROUP BY a.model_name""",
        "best_f1",
    ),
)
def model_levenshtein(spark, sf_dir):
    chosen = small_side(ranking.best_epoch_single(I.scores(spark, sf_dir), "test_f1").select("model_name", "epoch_no"))
    rows = I.predictions(spark, sf_dir).join(chosen, ["model_name", "epoch_no"])
    return SIM.block_levenshtein(rows, "control_01")


@query(
    "vector_levenshtein",
    sql(
        """, seqs AS (SELECT model_name, string_agg(pred::VARCHAR, '' ORDER BY item_id) AS seq FROM best_f1 GROUP BY ALL)
        SELECT a.model_name, length(a.seq) AS n, length(b.seq) AS n_against, levenshtein(a.seq, b.seq) AS edits
        FROM seqs a, seqs b WHERE b.model_name = 'control_01' AND a.model_name <> 'control_01'""",
        "best_f1",
    ),
)
def vector_levenshtein(spark, sf_dir):
    chosen = small_side(ranking.best_epoch_single(I.scores(spark, sf_dir), "test_f1").select("model_name", "epoch_no"), short=True)
    rows = I.predictions(spark, sf_dir).join(chosen, ["model_name", "epoch_no"])
    return edit_distance.vector_levenshtein(rows, "control_01")


_MODELS = [
    ("" if family == "control" else "target-") + f"{family}_{run:02d}" for family in I.ERROR_RATES for run in range(1, I.RUNS + 1)
]


@query(
    "similarity_matrix",
    sql(
        "SELECT model_a, "
        + ", ".join(f"""max(CASE WHEN model_b = '{m}' AND model_a > model_b THEN (n - same)::DOUBLE / n END) AS "{m}" """ for m in _MODELS)
        + " FROM pairs WHERE model_a > model_b GROUP BY model_a",
        "pairs",
    ),
)
def similarity_matrix(spark, sf_dir):
    return SIM.similarity_matrix(SIM.hamming(_pairs(spark, sf_dir)), "hamming", _MODELS, masked=True)


@query(
    "similarity_summary",
    sql(
        """, cols AS (SELECT model_b, avg((n - same)::DOUBLE / n) AS m, median((n - same)::DOUBLE / n) AS d FROM pairs GROUP BY model_b),
        modes AS (SELECT d, count(*) AS times FROM cols GROUP BY d)
        SELECT round((SELECT avg(m) FROM cols), 9) AS grand_mean, round((SELECT median(d) FROM cols), 9) AS median_of_medians, round(d, 9) AS mode_of_medians
        FROM modes WHERE times = (SELECT max(times) FROM modes)""",
        "pairs",
    ),
)
def similarity_summary(spark, sf_dir):
    summary = SIM.similarity_summary(SIM.hamming(_pairs(spark, sf_dir)), "hamming")
    return summary.withColumns(I.round9("grand_mean", "median_of_medians", "mode_of_medians"))


# ---- random guessing ------------------------------------------------------------------

TRIALS = 5000


@query(
    "random_f1_baseline",
    sql(
        f""", words AS (SELECT label, block, ('0x' || substring(md5(concat_ws(':', '1', block, item_id)), 1, 8))::BIGINT AS word
            FROM truth, range(0, ({TRIALS} + 31) // 32) b(block)),
        trials AS (SELECT block * 32 + bit AS trial, count(*) AS n, sum((word >> bit) & 1) AS guessed, sum(label * ((word >> bit) & 1)) AS tp, sum(label) AS pos
            FROM words, range(0, 32) k(bit) GROUP BY 1)
        SELECT count(*) AS trials, round(avg(coalesce(2.0::DOUBLE * tp / nullif(guessed + pos, 0), 0)), 9) AS mean_f1,
        round(avg((n - guessed - pos + 2 * tp)::DOUBLE / n), 9) AS mean_accuracy FROM trials WHERE trial < {TRIALS}""",
        "truth",
    ),
)
def random_f1_baseline(spark, sf_dir):
    mean = baseline.random_f1_baseline(I.truth(spark, sf_dir), TRIALS)
    return mean.withColumns(I.round9("mean_f1", "mean_accuracy"))


@query(
    "random_f1_closed_form",
    sql(
        """SELECT p AS prevalence, p / (p + 0.5::DOUBLE) AS expected_f1, 0.5::DOUBLE AS expected_accuracy
        FROM (SELECT sum(label)::DOUBLE / count(*) AS p FROM truth)""",
        "truth",
    ),
)
def random_f1_closed_form(spark, sf_dir):
    return baseline.random_f1_closed_form(I.truth(spark, sf_dir))
