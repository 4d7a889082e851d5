"""Training that resumes, moves on and is scored, against plain Python; models of other libraries."""

import math
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from plurivote.operators import external, models
from plurivote.operators import training as N
from plurivote.session import scratch_path, settle

WIDTH, HIDDEN = 64, 4


def texts(n, classes=2, seed=1):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice("abcdefgh") + str(i % classes) * rng.randrange(2) for _ in range(rng.randrange(0, 12))), i % classes) for i in range(n)]


@pytest.fixture(scope="module")
def rows(spark):
    given = texts(300) + [(300, None, 1), (301, "a b c", None), (302, "x " * 20_000, 0)]
    return settle(N.features(spark.createDataFrame(given, "item_id long, text string, label int").repartition(5), WIDTH))


def last(rows, network, epochs, **more):
    return [n[0] for n, _ in N.train(rows, [network], epochs, **more)][-1]


@pytest.mark.parametrize("steps", [1, 3])
def test_resumed_run_equals_run_through(spark, rows, tmp_path, steps):
    start = N.new_network(2, 1, WIDTH, HIDDEN)
    through = last(rows, start, 6, steps=steps)
    half = last(rows, start, 3, steps=steps)
    stored = N.load_state(spark, N.save_state(spark, half, str(tmp_path / "E03")))
    assert N.same_state(half, stored) and stored.epoch == 3
    # Other partitions, other row order.
    resumed = last(rows.repartition(7).sortWithinPartitions(F.desc("item_id")), stored, 3, steps=steps)
    assert N.same_state(through, resumed) and resumed.epoch == 6 and resumed.step == 6 * steps
    assert not N.same_state(through, half)


def plain_step(network, given, rate):
    """One Adam step in plain Python floats, without any rounding of sums."""
    w = {k: v.copy() for k, v in network.weights.items()}
    slope = {k: np.zeros_like(v) for k, v in w.items()}
    loss = 0.0
    for ids, label in given:
        scale = 1 / math.sqrt(max(len(ids), 1))
        active = np.tanh(sum((w["hidden"][i] for i in ids), np.zeros(w["hidden"].shape[1])) * scale + w["hidden_bias"])
        logits = active @ w["head"] + w["head_bias"]
        chance = np.exp(logits - logits.max())
        chance /= chance.sum()
        loss -= math.log(chance[label])
        chance[label] -= 1
        back = (w["head"] @ chance) * (1 - active**2)
        slope["head"] += np.outer(active, chance)
        slope["head_bias"] += chance
        slope["hidden_bias"] += back
        for i in ids:
            slope["hidden"][i] += back * scale
    for k in w:
        g = slope[k] / len(given)
        w[k] -= rate * (0.1 * g / 0.1) / (np.sqrt(0.001 * g * g / 0.001) + 1e-8)
    return w, loss / len(given), {k: v / len(given) for k, v in slope.items()}


def test_step_follows_the_gradient(rows):
    start = N.new_network(2, 3, WIDTH, HIDDEN)
    given = [(r["ids"], r["label"]) for r in rows.where("label IS NOT NULL").collect()]
    (trained,), (loss,) = next(N.train(rows, [start], 1))
    _, plain_loss, slope = plain_step(start, given, N.RATE)
    assert loss == pytest.approx(plain_loss, abs=1e-5)
    for layer in N.LAYERS:
        found = trained.first[layer] / (1 - N.DECAYS[0])  # the first moment holds the gradient
        assert np.abs(found - slope[layer]).max() < 2e-3 * max(1e-3, np.abs(slope[layer]).max()) + 2e-5


def test_weight_is_copies(spark, rows):
    weighted = rows.withColumn("w", F.when(F.col("item_id") % 3 == 0, 2.0).when(F.col("item_id") % 3 == 1, 0.0).otherwise(1.0))
    copies = weighted.where("w > 0").withColumn("k", F.explode(F.expr("sequence(1, int(w))")))
    start = N.new_network(2, 1, WIDTH, HIDDEN)
    a, b = last(weighted, start, 2, weights=["w"]), last(copies, start, 2)
    assert all(np.allclose(a.weights[k], b.weights[k], atol=1e-4) for k in N.LAYERS)


def test_networks_learn_together_as_alone(rows):
    both = [N.new_network(2, 1, WIDTH, HIDDEN), N.new_network(2, 2, WIDTH, HIDDEN)]
    for trained, _ in N.train(rows, both, 2):
        pass
    assert all(N.same_state(a, last(rows, b, 2)) for a, b in zip(trained, both, strict=True))


def test_hidden_layer_moves_and_head_is_new(spark):
    first = N.features(spark.createDataFrame(texts(200, 3), "item_id long, text string, label int"), WIDTH)
    intermediate = last(settle(first), N.new_network(3, 1, WIDTH, HIDDEN), 2)
    moved = N.with_new_head(intermediate, 2)
    assert np.array_equal(moved.weights["hidden"], intermediate.weights["hidden"]) and np.array_equal(moved.weights["hidden_bias"], intermediate.weights["hidden_bias"])
    assert moved.classes == 2 and moved.epoch == moved.step == 0 and not moved.first["hidden"].any()
    assert moved.weights["hidden"] is not intermediate.weights["hidden"]


def test_weight_transfer_learns(spark):
    three = spark.createDataFrame([(i, f"{'low mid high'.split()[i % 3]} w{i % 5}", i % 3) for i in range(90)], "item_id long, text string, label int")
    two = spark.createDataFrame([(i, f"{'low mid high'.split()[i % 3]} w{i % 5}", int(i % 3 == 0)) for i in range(90)], "item_id long, text string, label int")
    found = models.weight_transfer(three, two, two, "m", 10, 10)
    assert found.where("epoch_no = 10 AND pred = label").count() == 90 and found.count() == 900


def test_scores_equal_plain_forward(spark, rows):
    network = last(rows, N.new_network(2, 1, WIDTH, HIDDEN), 1)
    for r in N.score([("m", 1, network)], rows).join(rows.select("item_id", "ids"), "item_id").collect():
        scale = 1 / math.sqrt(max(len(r["ids"]), 1))
        active = np.tanh(sum((network.weights["hidden"][i] for i in r["ids"]), np.zeros(HIDDEN)) * scale + network.weights["hidden_bias"])
        assert r["logits"] == pytest.approx(list(active @ network.weights["head"] + network.weights["head_bias"]))
    assert [zlib.crc32(b"word") % 64] == spark.createDataFrame([("word",)], "t string").select(N.hashed_words(F.col("t"), 64)).first()[0]


def test_no_rows_change_nothing(spark):
    none = N.features(spark.createDataFrame([], "item_id long, text string, label int"), WIDTH)
    start = N.new_network(2, 1, WIDTH, HIDDEN)
    moved = last(none, start, 2)
    assert all(np.array_equal(moved.weights[k], start.weights[k]) for k in N.LAYERS)


def test_curve_metrics_equal_sql(spark, tmp_path):
    """Ten rows from one run; the metrics follow from the stored predictions."""
    df = spark.createDataFrame([(i, t, label) for i, t, label in texts(200)], "item_id long, text string, label int")
    batches = df.select("item_id", (F.col("item_id") % 13).alias("batch_id"))
    stored = models.fit_and_score(df, df.join(batches, "item_id"), "m", [1], keep=["batch_id"])
    stored.write.parquet(str(tmp_path / "p"))
    curve = models.curve_of(spark.read.parquet(str(tmp_path / "p"))).orderBy("epoch_no").collect()
    plain = duckdb.sql(
        f"""WITH p AS (SELECT *, list_max(logits) AS top FROM '{tmp_path}/p/*.parquet'),
        b AS (SELECT epoch_no, batch_id, avg((pred = label)::INT) AS a, coalesce(2.0 * sum((pred = 1 AND label = 1)::INT) / nullif(sum((pred = 1)::INT) + sum((label = 1)::INT), 0), 0) AS f FROM p GROUP BY ALL),
        l AS (SELECT epoch_no, avg(top + ln(list_sum(list_transform(logits, lambda v: exp(v - top)))) - logits[label + 1]) AS loss FROM p GROUP BY ALL)
        SELECT epoch_no, avg(a), avg(f), any_value(loss) FROM b JOIN l USING (epoch_no) GROUP BY epoch_no ORDER BY epoch_no"""
    ).fetchall()
    assert [r["epoch_no"] for r in curve] == list(range(1, 11))
    for r, (_, accuracy, f1, loss) in zip(curve, plain, strict=True):
        assert (r["accuracy"], r["f1"], r["loss"]) == (pytest.approx(accuracy), pytest.approx(f1), pytest.approx(loss))
    assert curve[-1]["loss"] < curve[0]["loss"]


def test_external_model_equals_plain_loop(spark):
    rng = np.random.default_rng(2)
    weights, bias = rng.normal(size=(3, 4)), rng.normal(size=4)
    path = external.save_arrays(f"{scratch_path(spark, 'model')}/m.npz", weights=weights, bias=bias)
    given = [(i, [float(x) for x in rng.normal(size=3)]) for i in range(500)] + [(500, None), (501, [1.0, None, 2.0]), (502, [1.0]), (503, [])]
    df = spark.createDataFrame(given, "item_id long, v array<double>").repartition(4)
    found = {r["item_id"]: (r["pred"], r["logits"]) for r in external.score_external(df, path, external.linear_model, ["v"], [3], "m").collect()}
    assert len(found) == 504 and all(found[i] == (None, None) for i in range(500, 504))
    for i, v in given[:500]:
        plain = np.array(v) @ weights + bias
        assert found[i][0] == int(plain.argmax()) and found[i][1] == pytest.approx(list(plain))
