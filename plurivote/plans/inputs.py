"""Stand-ins for the corpora and result tables, derived from the test tables.

Every frame has a SQL twin in ``CTE``; ``sql(body, …)`` puts the needed ones in front.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plurivote.functions import text as T
from plurivote.functions.keys import hash32
from plurivote.functions.text import WHITE_SPACE
from plurivote.operators import ensemble as E
from plurivote.operators import metrics as M
from plurivote.operators import ranking
from plurivote.session import small_side, spread_small

# Fixed values of the predictions stand-in: each family's rate of wrong predictions.
ERROR_RATES = {
    "fam_a": 0.20,
    "fam_b": 0.22,
    "fam_c": 0.24,
    "fam_d": 0.26,
    "fam_e": 0.28,
    "fam_f": 0.30,
    "control": 0.25,
}
RUNS = 3
EPOCHS = 3
CLASSES = 10
SELECTIONS = {"best-F1": "test_f1", "best-acc": "test_accuracy"}
SIZES = (3, 5)
PREFIXES = ["target-"]
RENAMES = {"fam_b": "Fam_B-coarse"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items and their class: ``toxic`` of the labelled documents."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item_id"), F.col("toxic").alias("label"))
    return spread_small(labels)


def texts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Documents for work that is costly per text."""
    return spread_small(table(spark, sf_dir, "documents").select(*columns))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled texts, imbalanced and binary."""
    documents = texts(spark, sf_dir, "doc_id", "text")
    labels = table(spark, sf_dir, "labels")
    return documents.join(labels, "doc_id").select(
        F.col("doc_id").alias("item_id"), "text", F.col("toxic").alias("label")
    )


def partly_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; the label is null where there is none."""
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of 7 families × 3 runs × 3 epochs on every labelled item."""
    families = ", ".join(f"struct('{family}' AS fam, {error}D AS error)" for family, error in ERROR_RATES.items())
    rows = truth(spark, sf_dir).selectExpr("item_id", "label", f"inline(array({families}))")
    rows = rows.selectExpr("*", f"explode(sequence(1, {RUNS})) AS run")
    rows = rows.selectExpr("*", f"explode(sequence(1, {EPOCHS})) AS epoch_no")
    chance = hash32("p1", "fam", "run", "epoch_no", "item_id") / F.lit(4294967296.0)
    wrong = chance < F.col("error") + F.lit(0.01) * F.abs(F.col("epoch_no") - 2)
    family = F.expr("if(fam = 'control', fam, concat('target-', fam))")
    return rows.select(
        F.concat(family, F.lit("_0"), F.col("run").cast("string")).alias("model_name"),
        family.alias("family"),
        "run",
        "epoch_no",
        "item_id",
        F.when(wrong, 1 - F.col("label")).otherwise(F.col("label")).alias("pred"),
    )


def rough_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions with what a clean grid lacks: a third class, null predictions, items a model never
    scored, a run without its third epoch and a family of one run."""
    chance = hash32("rough", "model_name", "epoch_no", "item_id") % 20
    rows = predictions(spark, sf_dir).where(
        (chance != 0) & ~((F.col("model_name") == "target-fam_a_03") & (F.col("epoch_no") == 3)) & ~((F.col("family") == "target-fam_f") & (F.col("run") > 1))
    )
    return rows.withColumn("pred", F.when(chance == 1, None).when(chance.isin(2, 3, 4), 2).otherwise(F.col("pred")))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per model and epoch. Computed once: the table is as long as the model list."""
    return small_side(M.evaluate_models(predictions(spark, sf_dir), truth(spark, sf_dir)), short=True)


def combinations(scores_: DataFrame) -> DataFrame:
    """Ensembles of three and five target families, from the models that have scores."""
    target = scores_.where(~ranking.is_control())
    return E.inducer_combinations(target.select(T.model_family(F.col("model_name")).alias("family")), SIZES)


def picked(spark: SparkSession, sf_dir: str, scores_: DataFrame) -> DataFrame:
    """Predictions of the best epoch of every target model, by either rule."""
    return E.pick_predictions(predictions(spark, sf_dir), E.chosen_epochs(scores_, SELECTIONS))


def ensemble_scores(spark: SparkSession, sf_dir: str, scores_: DataFrame) -> DataFrame:
    return E.ensemble_scores(picked(spark, sf_dir, scores_), truth(spark, sf_dir), small_side(combinations(scores_), short=True))


def leaderboard(spark: SparkSession, sf_dir: str, scores_: DataFrame) -> DataFrame:
    """All ensembles with their scores and places (one row per ensemble)."""
    named = {"best-F1": "f1", "best-acc": "accuracy"}
    return E.ensemble_leaderboard(ensemble_scores(spark, sf_dir, scores_), named, "toxic_test", scores_.where(~ranking.is_control()))


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten-class logits: every entry of a vector counts, entry i for class i modulo 10.

    The entries are summed as whole millionths, so the order of addition does not matter.
    """
    millionths = F.transform("embedding", lambda v: F.rint(v.cast("double") * 1e6).cast("bigint"))

    def folded(i: int) -> F.Column:
        own = F.filter(millionths, lambda v, at: at % CLASSES == i)
        return F.aggregate(own, F.lit(0).cast("bigint"), lambda total, v: total + v) / F.lit(1e6)

    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("item_id"), F.array(*[folded(i) for i in range(CLASSES)]).alias("logits"), "label"
    )


def round9(*names: str):
    """Doubles that come from sums, to nine places."""
    return {n: F.round(n, 9) for n in names}


_VALUES = ", ".join(f"('{f}', {e}::DOUBLE)" for f, e in ERROR_RATES.items())
SPACE = WHITE_SPACE
WORDS = "list_filter(regexp_split_to_array(text, '" + SPACE + "'), lambda w: w <> '')"


def _metric_sql(by: str, source: str) -> str:
    return f"""SELECT {by}, count(*) AS n, sum((pred = label)::INT)::DOUBLE / count(*) AS accuracy,
    coalesce(sum((pred = 1 AND label = 1)::INT)::DOUBLE / nullif(sum((pred = 1)::INT), 0), 0) AS precision,
    coalesce(sum((pred = 1 AND label = 1)::INT)::DOUBLE / nullif(sum((label = 1)::INT), 0), 0) AS recall,
    coalesce(2.0::DOUBLE * sum((pred = 1 AND label = 1)::INT) / nullif(sum((pred = 1)::INT + (label = 1)::INT), 0), 0) AS f1
    FROM {source} GROUP BY {by}"""


# name: (needed CTEs, text)
CTE: dict[str, tuple[tuple[str, ...], str]] = {
    "truth": ((), "SELECT doc_id AS item_id, toxic AS label FROM labels"),
    "corpus": ((), "SELECT doc_id AS item_id, text, toxic AS label FROM documents JOIN labels USING (doc_id)"),
    "partly": ((), "SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)"),
    "fams": ((), f"SELECT * FROM (VALUES {_VALUES}) t(fam, err)"),
    "slots": (
        ("fams",),
        f"""SELECT fam, err, run::INT AS run, epoch_no::INT AS epoch_no,
        CASE WHEN fam = 'control' THEN fam ELSE 'target-' || fam END AS family
        FROM fams, range(1, {RUNS + 1}) r(run), range(1, {EPOCHS + 1}) e(epoch_no)""",
    ),
    "predictions": (
        ("truth", "slots"),
        """SELECT family || '_0' || run AS model_name, family, run, epoch_no, item_id, label,
        CASE WHEN ('0x' || substring(md5(concat_ws(':', 'p1', fam, run, epoch_no, item_id)), 1, 8))::BIGINT / 4294967296.0::DOUBLE
             < err + 0.01::DOUBLE * abs(epoch_no - 2) THEN 1 - label ELSE label END AS pred
        FROM truth, slots""",
    ),
    "rough": (
        ("predictions",),
        """SELECT model_name, family, run, epoch_no, item_id, label, CASE WHEN k = 1 THEN NULL WHEN k IN (2, 3, 4) THEN 2 ELSE pred END AS pred
        FROM (SELECT *, ('0x' || substring(md5(concat_ws(':', 'rough', model_name, epoch_no, item_id)), 1, 8))::BIGINT % 20 AS k FROM predictions)
        WHERE k <> 0 AND NOT (model_name = 'target-fam_a_03' AND epoch_no = 3) AND NOT (family = 'target-fam_f' AND run > 1)""",
    ),
    "rough_picked": (("rough",), "SELECT 'second' AS selection, * FROM rough WHERE epoch_no = 2 AND family <> 'control'"),
    "raw_scores": (("predictions",), _metric_sql("model_name, family, epoch_no", "predictions")),
    "scores": (
        ("raw_scores",),
        """SELECT model_name, family, epoch_no, accuracy AS test_accuracy, f1 AS test_f1,
        'E' || lpad(epoch_no::VARCHAR, 2, '0') || '_A' || printf('%.2f', accuracy)::DOUBLE::VARCHAR
            || '_F' || printf('%.2f', f1)::DOUBLE::VARCHAR AS model_epoch
        FROM raw_scores""",
    ),
    "chosen": (
        ("scores",),
        """SELECT selection, model_name, family, epoch_no FROM (
            SELECT 'best-F1' AS selection, *, row_number() OVER (PARTITION BY model_name ORDER BY test_f1 DESC, epoch_no) AS k FROM scores
            UNION ALL
            SELECT 'best-acc', *, row_number() OVER (PARTITION BY model_name ORDER BY test_accuracy DESC, epoch_no) FROM scores)
        WHERE k = 1 AND family <> 'control'""",
    ),
    "names": (("predictions",), "SELECT family, row_number() OVER (ORDER BY family) - 1 AS bit FROM (SELECT DISTINCT family FROM predictions WHERE family <> 'control')"),
    "member": (
        ("names",),
        """SELECT id::INT AS ensemble_id, bit_count(id)::INT AS size, family FROM range(0, (SELECT (2 ** count(*))::BIGINT FROM names)) m(id), names
        WHERE bit_count(id) IN (3, 5) AND (id >> bit) & 1 = 1""",
    ),
    "combos": (("member",), "SELECT ensemble_id, size, string_agg(family, ',' ORDER BY family) AS inducers FROM member GROUP BY ALL"),
    "votes": (
        ("chosen", "member", "predictions"),
        """SELECT c.selection, m.ensemble_id, m.size, p.item_id, p.pred, count(*) AS votes
        FROM member m JOIN chosen c USING (family) JOIN predictions p ON p.model_name = c.model_name AND p.epoch_no = c.epoch_no
        GROUP BY ALL""",
    ),
    "winners": (
        ("votes", "truth"),
        """SELECT v.*, t.label FROM (SELECT *, row_number() OVER (PARTITION BY selection, ensemble_id, item_id ORDER BY votes DESC, pred) AS k
            FROM votes) v JOIN truth t USING (item_id) WHERE k = 1""",
    ),
    "ens": (("winners",), _metric_sql("selection, ensemble_id, size", "winners")),
    "board": (
        ("ens", "combos"),
        """SELECT ensemble_id, inducers, accuracy AS test_accuracy, f1 AS test_f1, selection,
        selection || CASE size WHEN 3 THEN '_three-model' ELSE '_five-model' END AS ensemble_type,
        row_number() OVER (PARTITION BY selection, size ORDER BY CASE selection WHEN 'best-F1' THEN f1 ELSE accuracy END DESC, ensemble_id)::INT AS place
        FROM ens JOIN combos USING (ensemble_id, size)""",
    ),
    "best_f1": (
        ("scores", "predictions"),
        """SELECT p.* FROM predictions p JOIN (SELECT model_name, epoch_no, row_number() OVER (PARTITION BY model_name ORDER BY test_f1 DESC, epoch_no) AS k FROM scores) s
        USING (model_name, epoch_no) WHERE k = 1""",
    ),
    "pairs": (
        ("best_f1",),
        """SELECT a.model_name AS model_a, b.model_name AS model_b, count(*) AS n, sum((a.pred = b.pred)::INT)::BIGINT AS same,
        sum((a.pred = 1 AND b.pred = 1)::INT)::BIGINT AS both_one, sum((a.pred = 1 OR b.pred = 1)::INT)::BIGINT AS either_one
        FROM best_f1 a JOIN best_f1 b USING (item_id) GROUP BY ALL""",
    ),
    "logits": (
        (),
        f"""SELECT vec_id AS item_id, label, list_transform(range(0, {CLASSES}), lambda c: list_sum(list_transform(
            list_filter(range(0, len(embedding)), lambda i: i % {CLASSES} = c), lambda i: round_even(embedding[i + 1]::DOUBLE * 1e6, 0)::BIGINT))::DOUBLE / 1e6::DOUBLE) AS logits
        FROM embeddings""",
    ),
    "doc_rank": (
        (),
        "SELECT *, row_number() OVER (ORDER BY md5(concat_ws(':', '1', doc_id)), doc_id) AS k, count(*) OVER () AS total FROM documents",
    ),
}


def sql(body: str, *needs: str) -> str:
    """The statement with its CTEs in front, each once and in order of need."""
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in CTE[name][0]:
            visit(dep)
        if name not in order:
            order.append(name)

    for need in needs:
        visit(need)
    head = ", ".join(f"{n} AS MATERIALIZED ({CTE[n][1]})" for n in order)
    if not head:
        return body
    return f"WITH {head}{body}" if body.startswith(",") else f"WITH {head} {body}"
