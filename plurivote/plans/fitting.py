"""Queries that fit models. Where the numbers have no SQL twin, rows are counted, or runs are held against each other."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from plurivote.operators import external, models
from plurivote.operators import metrics as M
from plurivote.operators import training as N
from plurivote.operators.sampling import three_way_split
from plurivote.plans import inputs as I
from plurivote.plans.inputs import sql
from plurivote.plans.registry import query
from plurivote.session import scratch_path, settle, spread_small


def _parts(spark, sf_dir, label: str):
    """Train (balanced), validation and test rows of a labelled corpus.

    The split is drawn on ids and labels alone; the texts are joined to its result.
    """
    items = I.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item_id"), F.col(label).alias("label"))
    parts = three_way_split(items, "item_id", "label", 0.2, 0.1, balance="over").select("item_id", "label", "split")
    # A text that was drawn often stands once, with its draws as weight.
    weighted = settle(parts.groupBy("item_id", "label", "split").agg(F.count(F.lit(1)).cast("double").alias("weight")))
    texts = I.texts(spark, sf_dir, "doc_id", "text").withColumnRenamed("doc_id", "item_id")
    return {
        name: texts.join(weighted.where(F.col("split") == name).drop("split"), "item_id")
        for name in ("train", "validation", "test")
    }


@query("fit_and_score")
def fit_and_score(spark, sf_dir):
    parts = _parts(spark, sf_dir, "toxic")
    scored = models.fit_and_score(parts["train"], parts["test"], "target-words")
    return M.classification_metrics(scored, ["model_name", "epoch_no"])


@query("stacked_transfer")
def stacked_transfer(spark, sf_dir):
    first = _parts(spark, sf_dir, "quality")["train"]
    parts = _parts(spark, sf_dir, "toxic")
    scored = models.stacked_transfer(first, parts["train"], parts["test"], "target-inter-quality_01")
    return scored.select("model_name", "epoch_no", "item_id", "pred", "label")


@query("weight_transfer")
def weight_transfer(spark, sf_dir):
    """Learn quality, carry the hidden layer to toxic, score the test rows after each epoch there."""
    first = _parts(spark, sf_dir, "quality")["train"]
    parts = _parts(spark, sf_dir, "toxic")
    scored = models.weight_transfer(first, parts["train"], parts["test"], "target-inter-quality_02")
    return scored.select("model_name", "epoch_no", "item_id", "pred", "label")


@query("validation_curve")
def validation_curve(spark, sf_dir):
    parts = _parts(spark, sf_dir, "toxic")
    return models.validation_curve(parts["train"], parts["validation"], "target-words")


@query(
    "training_resumed",
    sql(
        """SELECT epoch_no::INT AS epoch_no, (SELECT floor(count(*) * 0.2::DOUBLE)::BIGINT FROM truth) AS items, 0::BIGINT AS differing, true AS same_state
        FROM range(6, 11) e(epoch_no)""",
        "truth",
    ),
)
def training_resumed(spark, sf_dir):
    """Ten epochs in one run against five, a stored state, and five more: test rows whose logits differ."""
    parts = _parts(spark, sf_dir, "toxic")
    train = settle(spread_small(N.features(parts["train"], keep=["weight"])))
    through = [n[0] for n, _ in N.train(train, [N.new_network(2)], 10, ["weight"])]
    path = N.save_state(spark, through[4], scratch_path(spark, "state"))
    resumed = [n[0] for n, _ in N.train(train, [N.load_state(spark, path)], 5, ["weight"])]
    named = [(name, n.epoch, n) for name, run in (("through", through[5:]), ("resumed", resumed)) for n in run]
    scored = N.score(named, N.features(parts["test"]))
    each = scored.groupBy("epoch_no", "item_id").agg(F.count_distinct("logits").alias("kinds"), F.count(F.lit(1)).alias("runs"))
    same = F.create_map(*[x for a, b in zip(through[5:], resumed, strict=True) for x in (F.lit(a.epoch), F.lit(N.same_state(a, b)))])
    counted = each.groupBy("epoch_no").agg(F.count(F.lit(1)).alias("items"), F.count_if((F.col("kinds") > 1) | (F.col("runs") != 2)).alias("differing"))
    return counted.withColumn("same_state", F.coalesce(F.element_at(same, F.col("epoch_no")), F.lit(False)))


@query(
    "score_external",
    """WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
    means AS (SELECT label AS c, i, round_even(avg(x) * 1e4::DOUBLE, 0) / 1e4::DOUBLE AS m FROM e WHERE label IS NOT NULL GROUP BY label, i),
    half AS (SELECT c, sum(m * m) / 2 AS h FROM means GROUP BY c),
    logit AS (SELECT vec_id, c, sum(x * m) - any_value(h) AS v FROM e JOIN means USING (i) JOIN half USING (c) GROUP BY vec_id, c)
    SELECT 'class-means' AS model_name, 1::INT AS epoch_no, vec_id AS item_id, arg_max(c, v)::INT AS pred, round(max(v), 9) AS top FROM logit GROUP BY vec_id""",
)
def score_external(spark, sf_dir):
    """Nearest class mean of the embeddings, stored as a file and scored by workers that load it."""
    vectors = I.table(spark, sf_dir, "embeddings")
    width = vectors.agg(F.max(F.size("embedding"))).first()[0]
    entries = vectors.where("label IS NOT NULL").select("label", F.posexplode("embedding").alias("i", "x"))
    mean = (F.rint(F.avg(F.col("x").cast("double")) * 1e4) / 1e4).alias("m")
    means = np.zeros((10, width))  # one row per class
    for row in entries.groupBy("label", "i").agg(mean).collect():
        means[row["label"], row["i"]] = row["m"]
    path = external.save_arrays(f"{scratch_path(spark, 'model')}/means.npz", weights=means.T, bias=-(means * means).sum(axis=1) / 2)
    rows = vectors.select(F.col("vec_id").alias("item_id"), "embedding")
    scored = external.score_external(rows, path, external.linear_model, ["embedding"], [width], "class-means")
    return scored.select("model_name", "epoch_no", "item_id", "pred", F.round(F.array_max("logits"), 9).alias("top"))
