"""Fitting and scoring text classifiers.

Stand-ins for fine-tuning a language model on one device, fitted on all rows in parallel: replicas, per-epoch
snapshots and weight transfer with the network of ``training``; whole pipelines of Spark ML to be saved and loaded.
``stacked_transfer`` hands the first task's probabilities to the second task as features.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plurivote.functions import scores as S
from plurivote.functions.keys import uniform
from plurivote.functions.text import epoch_tag
from plurivote.operators import metrics as M
from plurivote.operators import training as N
from plurivote.operators.encode import make_batches
from plurivote.session import settle, spread_small


def word_features(width: int = 1 << 12) -> Pipeline:
    """Words → hashed counts. Nothing to fit, so the counts are made once for all runs."""
    return Pipeline(
        stages=[
            RegexTokenizer(inputCol="text", outputCol="words", pattern=r"\s+"),
            HashingTF(inputCol="words", outputCol="hashed", numFeatures=width),
        ]
    )


def classifier(passes: int, features: str = "hashed", weight: str | None = None) -> LogisticRegression:
    """``weight`` names a column that says how often a row counts, in place of copies of the row."""
    made = LogisticRegression(featuresCol=features, labelCol="label", maxIter=passes, regParam=0.01)
    return made.setWeightCol(weight) if weight else made


def fit_text_model(train: DataFrame, passes: int, width: int = 1 << 12, weight: str | None = None) -> PipelineModel:
    """The whole model, from text to prediction, for saving and reuse."""
    return Pipeline(stages=[*word_features(width).getStages(), classifier(passes, weight=weight)]).fit(train)


def seen(run: int, share: float = 0.9) -> Column:
    """Does a replica see the row? A fixed draw per run and item."""
    return uniform(f"run{run}", "item_id") < share


def score(model, rows: DataFrame, model_name: str, epoch_no: int, keep: Sequence[str] = ()) -> DataFrame:
    """Long predictions with logits."""
    logits = vector_to_array("rawPrediction")
    return model.transform(rows).select(
        F.lit(model_name).alias("model_name"),
        F.lit(epoch_no).alias("epoch_no"),
        "item_id",
        S.argmax(logits).alias("pred"),
        logits.alias("logits"),
        F.col("label").cast("int").alias("label"),
        *keep,
    )


def fit_and_score(
    train: DataFrame,
    test: DataFrame,
    name: str,
    runs: Sequence[int] = (1, 2, 3),
    epochs: Sequence[int] = tuple(range(1, 11)),
    keep: Sequence[str] = (),
    steps: int = 2,
) -> DataFrame:
    """Predictions of every replica (``name_01`` …) after each of the ``epochs``.

    All replicas are trained once, in the same passes over the hashed rows; what they know after an epoch
    is kept, and all of it scores the test rows in one pass. A replica differs in its first weights and in the rows
    it sees (``seen``). ``train`` may have a ``weight`` column. Classes are 0 … the greatest label.
    """
    counts = F.col("weight").cast("double") if "weight" in train.columns else F.lit(1.0)
    each = [F.when(seen(run), counts).otherwise(0.0).alias(f"_run{run}") for run in runs]
    rows = settle(spread_small(N.features(train, keep=each)))
    classes = max(2, 1 + (rows.agg(F.max("label")).first()[0] or 0))
    kept = []
    networks = [N.new_network(classes, run) for run in runs]
    for trained, _ in N.train(rows, networks, max(epochs), [f"_run{run}" for run in runs], steps):
        kept += [(f"{name}_{run:02d}", n.epoch, n) for run, n in zip(runs, trained, strict=True) if n.epoch in epochs]
    return N.score(kept, N.features(test, keep=keep), keep)


def validation_curve(
    train: DataFrame, validation: DataFrame, name: str, epochs: Sequence[int] = tuple(range(1, 11)), batch_size: int = 16
) -> DataFrame:
    """Batch-mean metrics and loss on the validation rows after each epoch of one training run."""
    # Batches are cut on the ids; the texts are joined to them.
    batches = make_batches(validation.select("item_id"), "item_id", batch_size)
    rows = settle(fit_and_score(train, validation.join(batches, "item_id"), name, [1], epochs, ["batch_id"]))
    return curve_of(rows)


def curve_of(rows: DataFrame) -> DataFrame:
    """The curve from stored predictions with their ``batch_id``."""
    by = ["model_name", "epoch_no"]
    losses = M.cross_entropy(rows, "logits", "label", by).select(*by, "loss")
    return M.batch_mean_metrics(rows, "batch_id", by).join(losses, by)


def weight_transfer(
    first_train: DataFrame, train: DataFrame, test: DataFrame, name: str, first_epochs: int = 5, epochs: int = 5, steps: int = 2
) -> DataFrame:
    """Train on an intermediate task, carry the hidden layer over, make the head anew, train on the target.

    The tasks may differ in their classes. Predictions of the test rows after each epoch on the target.
    """

    def learn(rows: DataFrame, network: N.Network | None, number: int) -> list[N.Network]:
        counts = F.col("weight").cast("double") if "weight" in rows.columns else F.lit(1.0)
        held = settle(spread_small(N.features(rows, keep=[counts.alias("_weight")])))
        classes = max(2, 1 + (held.agg(F.max("label")).first()[0] or 0))
        start = N.new_network(classes) if network is None else N.with_new_head(network, classes)
        return [n[0] for n, _ in N.train(held, [start], number, ["_weight"], steps)]

    intermediate = learn(first_train, None, first_epochs)[-1]
    return N.score([(name, n.epoch, n) for n in learn(train, intermediate, epochs)], N.features(test))


def stacked_transfer(
    first_train: DataFrame, train: DataFrame, test: DataFrame, name: str, passes: int = 10
) -> DataFrame:
    """Fit on an intermediate task, then on the target with that model's probabilities as features.

    Texts are hashed once each; train tables may have a ``weight`` column.
    """
    words = word_features()
    both = VectorAssembler(inputCols=["hashed", "probability"], outputCol="features")

    def hashed(rows):
        weight = ["weight"] if "weight" in rows.columns else []
        return words.fit(rows).transform(rows).select("item_id", "label", "hashed", *weight)

    def fit(rows, features):
        held = rows.persist()
        try:
            return classifier(passes, features, "weight" if "weight" in held.columns else None).fit(held)
        finally:
            held.unpersist()

    first = fit(hashed(first_train), "hashed")

    def with_first(rows):
        weight = ["weight"] if "weight" in rows.columns else []
        return both.transform(first.transform(hashed(rows))).select("item_id", "label", "features", *weight)

    second = fit(with_first(train), "features")
    return score(second, with_first(test), name, passes)


def save_epoch(model: PipelineModel, folder: str, epoch_no: int, accuracy: float, f1: float, every: int | None = 1) -> str | None:
    """Save under ``folder/E01_A0.75_F0.41`` if the epoch is due; the path, or None."""
    if not every or epoch_no % every:
        return None
    spark = SparkSession.active()
    tag = spark.range(1).select(epoch_tag(F.lit(epoch_no), F.lit(float(accuracy)), F.lit(float(f1)))).first()[0]
    path = f"{folder.rstrip('/')}/{tag}"
    model.write().overwrite().save(path)
    return path


def load_epoch(path: str) -> PipelineModel:
    return PipelineModel.load(path)
