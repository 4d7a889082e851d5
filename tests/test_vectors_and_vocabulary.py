"""Edit distance in tiles, vocabularies, ancestors, automatic bins, and writers that meet."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from plurivote.operators import edit_distance as ED
from plurivote.operators import encode as ENC
from plurivote.operators import profile as P
from plurivote.operators import ranking
from plurivote.operators import vocabulary as V
from plurivote.sources import results_table as R


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_one_tile_is_the_whole_table():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ("".join(rng.choice("01") for _ in range(rng.randrange(1, 90))) for _ in range(2))
        up, lower, bottom = ED.tile(a, b, (1 << len(a)) - 1, 0, np.ones(len(b), dtype=np.int8))
        assert len(a) + int(bottom.sum()) == plain_distance(a, b) == len(b) + bin(up).count("1") - bin(lower).count("1")


@pytest.mark.parametrize("block", [9, 4096])
def test_tiles_give_the_whole_distance(spark, block):
    rng = random.Random(block)
    lengths = {"base": 21, "same": 21, "short": 3, "long": 40, "shifted": 20, "other": 21}
    rows, texts = [], {}
    for model, n in lengths.items():
        preds = texts["base"] if model == "same" else texts["base"][1:] if model == "shifted" else [rng.choice([0, 0, 1, 2, 11]) for _ in range(n)]
        texts[model] = preds
        # Ids far apart, so that numbering crosses parts; null predictions are no part of the vector.
        rows += [(model, i * 9_001 if model == "long" else i, p) for i, p in enumerate(preds)] + [(model, 10_000_000 + n, None)]
    df = spark.createDataFrame(rows, "model_name string, item_id long, pred int").repartition(4)
    found = {r["model_name"]: (r["n"], r["n_against"], r["edits"]) for r in ED.vector_levenshtein(df, "base", block).collect()}
    assert found == {m: (len(t), 21, plain_distance(t, texts["base"])) for m, t in texts.items() if m != "base"}
    assert found["same"][2] == 0 and found["shifted"][2] == 1


def test_distance_without_a_base(spark):
    df = spark.createDataFrame([("a", 1, 0), ("a", 2, 1), ("base", 1, None)], "model_name string, item_id long, pred int")
    assert [tuple(r) for r in ED.vector_levenshtein(df, "base").collect()] == [("a", 2, 0, 2)]


def test_size_estimates_stay_small_over_many_diagonals(spark, monkeypatch, capsys):
    """The planner's estimate for a diagonal must not be a product of those before it: its digits would fill the driver."""
    rng = random.Random(8)
    a, base = [rng.choice([0, 0, 1]) for _ in range(100)], [rng.choice([0, 0, 1]) for _ in range(80)]
    df = spark.createDataFrame([(m, i, p) for m, preds in (("a", a), ("base", base)) for i, p in enumerate(preds)], "model_name string, item_id long, pred int")
    powers, settle = [], ED.settle

    def measured(table):
        out = settle(table)
        out.explain(mode="cost")
        powers.append(max((int(x) for x in re.findall(r"sizeInBytes=[\d.]+E\+(\d+) B", capsys.readouterr().out)), default=0))
        assert powers[-1] < 100, powers
        return out

    monkeypatch.setattr(ED, "settle", measured)
    assert [tuple(r) for r in ED.vector_levenshtein(df, "base", 9).collect()] == [("a", 100, 80, plain_distance(a, base))]
    assert len(powers) > 12 + 9 - 1


def test_vocabulary_has_one_id_per_word(spark):
    rng = random.Random(1)
    texts = [(i, " ".join(rng.choice(["the", "of", "é", "日本", f"w{rng.randrange(200)}"]) for _ in range(rng.randrange(30))), i % 2) for i in range(200)] + [(900, None, 0), (901, " \t", 1)]
    df = spark.createDataFrame(texts, "item_id long, text string, label int").repartition(6)
    counts = {}
    for _, text, _ in texts:
        for w in (text or "").split():
            counts[w] = counts.get(w, 0) + 1
    ordered = sorted(counts, key=lambda w: (-counts[w], w.encode()))
    words = V.vocabulary(df)
    assert sorted((r["word_id"], r["word"], r["count"]) for r in words.collect()) == [(i, w, counts[w]) for i, w in enumerate(ordered)]
    place = {w: i for i, w in enumerate(ordered)}
    for frequent in (0, 3, 20_000):  # all words rare, some, none
        found = {r["item_id"]: r["ids"] for r in V.word_ids(df, words, frequent=frequent).collect()}
        assert found == {i: [place[w] for w in (t or "").split()] for i, t, _ in texts}
    short = {r["item_id"]: r for r in V.encode(df, words, 6).collect()}
    assert short[900]["input_ids"] == [ENC.BEGIN_ID, ENC.END_ID] and short[900]["attention_mask"] == [1, 1]
    first = [place[w] + V.FIRST_WORD for w in (texts[5][1] or "").split()]
    assert short[5]["input_ids"] == [ENC.BEGIN_ID, *first[:4], ENC.END_ID]
    assert V.vocabulary(df.limit(0)).count() == 0


def test_word_unknown_to_the_vocabulary(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "b")], "item_id long, text string")
    words = V.vocabulary(df.where("item_id = 2"))
    assert {r["item_id"]: r["ids"] for r in V.word_ids(df, words).collect()} == {1: [None, 0], 2: [0]}


def test_lineage(spark):
    rows = [("a", None), ("b", "a"), ("c", "b"), ("x", "gone"), ("y", "x")]
    found = sorted(tuple(r) for r in ranking.lineage(spark.createDataFrame(rows, "model string, parent string")).collect())
    assert found == [("a", "a", 0, True), ("b", "a", 1, True), ("b", "b", 0, False), ("c", "a", 2, True), ("c", "b", 1, False), ("c", "c", 0, False), ("x", "x", 0, True), ("y", "x", 1, True), ("y", "y", 0, False)]
    circle = spark.createDataFrame([("a", "b"), ("b", "a")], "model string, parent string")
    spark.conf.set("spark.sql.cteRecursionLevelLimit", "9")
    try:
        with pytest.raises(Exception, match="RECURSION"):
            ranking.lineage(circle).collect()
    finally:
        spark.conf.unset("spark.sql.cteRecursionLevelLimit")


@pytest.mark.parametrize("kind", ["int", "double"])
def test_automatic_bins_equal_the_published_rule(spark, kind):
    rng = np.random.default_rng(8)
    for values in (rng.gamma(2, 40, 3000), rng.normal(0, 1, 50), np.r_[np.zeros(90), np.ones(10) * 7], np.arange(6) * 100.0):
        values = np.floor(values).astype(np.int64) if kind == "int" else values
        df = spark.createDataFrame([(v,) for v in values.tolist()] + [(None,)], f"v {'bigint' if kind == 'int' else 'double'}")
        width = [np.ptp(values) / (np.log2(len(values)) + 1), 2 * np.subtract(*np.percentile(values, [75, 25])) / len(values) ** (1 / 3)]
        width = min(w for w in width if w > 0)
        assert P.automatic_bins(df, "v") == int(np.ceil(np.ptp(values) / (max(width, 1) if kind == "int" else width)))
    assert P.automatic_bins(df.where("v IS NULL"), "v") == 1 and P.automatic_bins(df.limit(1), "v") == 1


def test_writers_of_one_key_leave_one_row(spark, tmp_path):
    path = str(tmp_path / "results")
    row = lambda m, e, f1: (m, f"E{e:02d}", e, 0.5, f1)
    first = spark.createDataFrame([row("a", 1, 0.1), row("a", 2, 0.2), row("b b/c", 1, 0.3)], R.SCORES)
    R.append_results(first, path)
    R.append_results(spark.createDataFrame([row("a", 2, 0.9), row("c", 1, 0.4)], R.SCORES), path)
    R.append_results(first.where(F.col("model_name") == "b b/c"), path)
    assert sorted((r["model_name"], r["epoch_no"], r["test_f1"]) for r in R.read_results(spark, path).collect()) == [("a", 1, 0.1), ("a", 2, 0.9), ("b b/c", 1, 0.3), ("c", 1, 0.4)]
    assert R.read_results(spark, path).columns == ["model_name", "model_epoch", "epoch_no", "test_accuracy", "test_f1"]
