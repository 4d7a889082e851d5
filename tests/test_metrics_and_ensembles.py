"""Metrics, epochs, votes and similarity against plain Python."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from plurivote.operators import baseline, ranking, results
from plurivote.operators import ensemble as E
from plurivote.operators import metrics as M
from plurivote.operators import similarity as SIM


def pairs(spark, rows):
    return spark.createDataFrame(rows, "label int, pred int")


def test_binary_metrics(spark):
    row = M.classification_metrics(pairs(spark, [(1, 1), (1, 0), (0, 1), (0, 0), (0, 0)])).first()
    assert (row["n"], row["accuracy"], row["precision"], row["recall"], row["f1"]) == (5, 0.6, 0.5, 0.5, 0.5)


@pytest.mark.parametrize("rows", [[(1, 0)], [(0, 1)], [(0, 0)]])
def test_undefined_metrics_are_zero(spark, rows):
    row = M.classification_metrics(pairs(spark, rows)).first()
    assert (row["precision"], row["recall"], row["f1"]) == (0.0, 0.0, 0.0)


def test_micro_equals_accuracy(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(4), rng.randrange(4)) for _ in range(200)]
    row = M.metrics(pairs(spark, rows), num_labels=4).first()
    accuracy = sum(a == b for a, b in rows) / 200
    assert row["accuracy"] == row["precision"] == row["recall"] == row["f1"] == pytest.approx(accuracy)
    cells = {r["class"]: (r["tp"], r["fp"], r["fn"]) for r in M.per_class_counts(pairs(spark, rows)).collect()}
    for c in range(4):
        assert cells[c] == (
            sum(a == b == c for a, b in rows),
            sum(b == c != a for a, b in rows),
            sum(a == c != b for a, b in rows),
        )


def test_batch_means_do_not_weigh_rows(spark):
    df = spark.createDataFrame([(0, 1, 1), (0, 0, 0), (1, 1, 0)], "batch_id int, label int, pred int")
    row = M.batch_mean_metrics(df, "batch_id").first()
    assert (row["batches"], row["accuracy"], row["f1"]) == (2, 0.5, 0.5)


def test_confusion_matrix(spark):
    rows = M.confusion_matrix(pairs(spark, [(1, 1), (1, 0), (0, 0), (0, 0)]), (0, 1)).orderBy("label").collect()
    assert [tuple(r) for r in rows] == [(0, 2, 0, 0, 0), (1, 1, 1, 0, 0)]
    odd = M.confusion_matrix(pairs(spark, [(1, 2), (1, None), (3, 0)]), (0, 1)).orderBy("label").collect()
    assert [tuple(r) for r in odd] == [(0, 0, 0, 0, 0), (1, 0, 0, 1, 1), (3, 1, 0, 0, 0)]


def test_alignment_counts_what_a_join_drops(spark):
    preds = spark.createDataFrame([("a", 1, 1, 0), ("a", 1, 2, 1), ("a", 1, 2, 1), ("a", 1, 9, 1), ("b", 1, 9, 1)], "model_name string, epoch_no int, item_id long, pred int")
    truth = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "item_id long, label int")
    got = {r["model_name"]: (r["matched"], r["no_truth"], r["missing"]) for r in M.alignment(preds, truth).collect()}
    assert got == {"a": (2, 1, 1), "b": (0, 1, 3)}


SCORES = "model_name string, epoch_no int, test_f1 double, test_accuracy double"


def test_best_epochs(spark):
    df = spark.createDataFrame([("a_01", 1, 0.5, 0.6), ("a_01", 2, 0.5, 0.7), ("a_01", 3, 0.4, 0.9), ("b_01", 1, 0.1, 0.1)], SCORES)
    ties = {(r["model_name"], r["epoch_no"]) for r in ranking.best_epoch_with_ties(df, "test_f1").collect()}
    assert ties == {("a_01", 1), ("a_01", 2), ("b_01", 1)}
    single = {(r["model_name"], r["epoch_no"]) for r in ranking.best_epoch_single(df, "test_f1").collect()}
    assert single == {("a_01", 1), ("b_01", 1)}
    assert ranking.best_epoch_single(df, "test_f1", by=()).first()["epoch_no"] == 1
    ranks = {r["epoch_no"]: r["rank_test_accuracy"] for r in ranking.epoch_rank_both_metrics(df, "test_f1", "test_accuracy").where("model_name = 'a_01'").collect()}
    assert ranks == {1: 3, 2: 2}


def test_combinations(spark):
    df = spark.createDataFrame([(f,) for f in "cabfedaa"], "family string")
    got = E.inducer_combinations(df, (3, 5)).collect()
    want = [c for r in (3, 5) for c in itertools.combinations("abcdef", r)]
    assert sorted(tuple(r["inducers"]) for r in got) == sorted(want)
    for r in got:
        assert r["ensemble_id"] == sum(1 << "abcdef".index(f) for f in r["inducers"])
    runs = spark.createDataFrame([(f"{f}_{r:02d}",) for f in "abcdef" for r in ((1, 2, 3) if f != "b" else (7,))], "model_name string")
    members = E.ensemble_membership(E.inducer_combinations(df, (3,)), runs)
    assert members.count() == 20 * 9 - 10 * 2
    assert {r["model_name"] for r in members.where("family = 'a'").collect()} == {"a_01", "a_02", "a_03"}
    assert {r["model_name"] for r in members.where("family = 'b'").collect()} == {"b_07"}
    with pytest.raises(ValueError, match="without a run"):
        E.ensemble_membership(E.inducer_combinations(df, (3,)), runs.where("model_name <> 'b_07'"))


def test_combinations_of_many_families(spark):
    names = [f"f{i:03d}" for i in range(40)]
    df = spark.createDataFrame([(n,) for n in names], "family string")
    got = E.inducer_combinations(df, (1, 3, 99)).collect()
    assert sorted(tuple(r["inducers"]) for r in got) == sorted([c for r in (1, 3) for c in itertools.combinations(names, r)])
    assert len({r["ensemble_id"] for r in got}) == len(got)
    assert E.inducer_combinations(df, (0, 99)).count() == 0


@pytest.fixture(scope="module")
def voting(spark):
    rng = random.Random(7)
    rows = [
        ("best-F1", i, f"{f}_{run:02d}", f, rng.randrange(3))
        for i in range(40)
        for f in ("f1", "f2", "f3", "f'4")
        for run in (1, 2)
    ]
    picked = spark.createDataFrame(rows, "selection string, item_id long, model_name string, family string, pred int")
    truth = spark.createDataFrame([(i, rng.randrange(2)) for i in range(40)], "item_id long, label int")
    return rows, picked, truth


def plain_vote(rows, members, item):
    votes = [r[4] for r in rows if r[1] == item and r[3] in members]
    return max(sorted(set(votes)), key=votes.count)


def test_vote_ties_take_the_lowest_class(spark, voting):
    rows, picked, _ = voting
    combos = E.inducer_combinations(picked, (2, 3))
    members = {r["ensemble_id"]: r["inducers"] for r in combos.collect()}
    votes = E.majority_vote(picked, combos).collect()
    assert len(votes) == 40 * len(members)
    for v in votes:
        assert v["pred"] == plain_vote(rows, members[v["ensemble_id"]], v["item_id"])


def plain_votes(rows, members):
    """(selection, ensemble, item) → winner, ballots, winning votes."""
    made = {}
    for ensemble, families in members.items():
        for selection, item in {(r[0], r[1]) for r in rows}:
            votes = [r[4] for r in rows if (r[0], r[1]) == (selection, item) and r[3] in families and r[4] is not None]
            if votes:
                pred = max(sorted(set(votes)), key=votes.count)
                made[selection, ensemble, item] = (pred, len(votes), votes.count(pred))
    return made


@pytest.mark.parametrize("blocks", [(1 << 12, 1 << 10, 1 << 16), (3, 7, 11)])
def test_votes_equal_plain_counting(spark, voting, monkeypatch, blocks):
    """A third class, nulls, items some families never voted on, two selections, blocks of any size."""
    for name, value in zip(("BLOCK_ENSEMBLES", "BLOCK_ITEMS", "BLOCK_ROWS"), blocks, strict=True):
        monkeypatch.setattr(E, name, value)
    _, picked, truth = voting
    rough = picked.withColumn("pred", F.when(F.hash("item_id", "model_name") % 4 != 0, F.col("pred"))).where("item_id > 3 OR family = 'f1'")
    second = rough.where("item_id % 2 = 0").withColumn("selection", F.lit("best-acc"))
    votes = rough.unionByName(second)
    combos = E.inducer_combinations(votes, (1, 2, 3))
    members = {r["ensemble_id"]: r["inducers"] for r in combos.collect()}
    plain = plain_votes([tuple(r) for r in votes.collect()], members)
    got = E.majority_vote(votes, combos).collect()
    assert {(r["selection"], r["ensemble_id"], r["item_id"]): (r["pred"], r["ballots"], r["winning_votes"]) for r in got} == plain
    labels = dict(tuple(r) for r in truth.collect())
    scored = E.ensemble_scores(votes, truth, combos).collect()
    assert len(scored) == 28
    for r in scored:
        mine = [(p[0], labels[i]) for (s, e, i), p in plain.items() if (s, e) == (r["selection"], r["ensemble_id"])]
        tp, fp, fn = (sum(cond(p, t) for p, t in mine) for cond in (lambda p, t: p == t == 1, lambda p, t: p == 1 != t, lambda p, t: t == 1 != p))
        assert r["n"] == len(mine) and r["accuracy"] == sum(p == t for p, t in mine) / len(mine)
        assert r["f1"] == (2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0.0)


def test_many_ensembles_need_no_second_exchange(spark):
    """5,000 ensembles: the only wide move before the counts is the one on the item."""
    families = [f"m{i:02d}" for i in range(30)]
    rows = [("s", i, f"{f}_01", f, (i * 7 + k) % 2) for i in range(50) for k, f in enumerate(families)]
    picked = spark.createDataFrame(rows, "selection string, item_id long, model_name string, family string, pred int")
    truth = spark.createDataFrame([(i, i % 2) for i in range(50)], "item_id long, label int")
    combos = E.inducer_combinations(picked, (3, 4)).orderBy("ensemble_id").limit(5_000)
    scored = E.ensemble_scores(picked, truth, combos)
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [item_id") == 1 and "Generate" not in plan and "Aggregate [selection" in plan
    assert scored.count() == 5_000
    one = scored.orderBy("ensemble_id").first()
    assert one["accuracy"] == sum(p[0] == i % 2 for (_, _, i), p in plain_votes(rows, {0: one["inducers"]}).items()) / 50


@pytest.mark.parametrize("copies", [1, 200, 201])
def test_scores_do_not_depend_on_their_number(spark, copies):
    picked = spark.createDataFrame(
        [("s", 1, "a_01", "a", 2), ("s", 1, "b_01", "b", 2), ("s", 1, "c_01", "c", 0), ("s", 2, "a_01", "a", None), ("s", 2, "b_01", "b", None), ("s", 2, "c_01", "c", 1)],
        "selection string, item_id long, model_name string, family string, pred int",
    )
    truth = spark.createDataFrame([(1, 0), (2, 1)], "item_id long, label int")
    one = E.inducer_combinations(picked, (3,))
    many = one.crossJoin(spark.range(copies)).select(F.col("id").cast("int").alias("ensemble_id"), "size", "inducers")
    assert {(r["n"], r["accuracy"]) for r in E.ensemble_scores(picked, truth, many).collect()} == {(2, 0.5)}


def test_vote_of_copies_is_that_model(spark):
    rows = [("s", i, f"a_{run:02d}", "a", i % 2) for i in range(6) for run in (1, 2, 3)]
    picked = spark.createDataFrame(rows, "selection string, item_id long, model_name string, family string, pred int")
    got = E.majority_vote(picked, E.inducer_combinations(picked, (1,))).collect()
    assert all(r["pred"] == r["item_id"] % 2 and r["winning_votes"] == 3 for r in got)


def test_custom_ensemble_names(spark):
    preds = spark.createDataFrame([("Ab_01", 1, 5, 1), ("Ab_02", 1, 5, 0), ("c_01", 1, 5, 0)], "model_name string, epoch_no int, item_id long, pred int")
    chosen = preds.select(F.lit("s").alias("selection"), "model_name", "epoch_no")
    assert E.custom_ensemble(preds, chosen, ["AB_01", "ab_02", "C_01"]).first()["pred"] == 0
    with pytest.raises(ValueError, match="nobody"):
        E.custom_ensemble(preds, chosen, ["nobody_01"])


def vectors(spark, **named):
    rows = [(m, i, int(v)) for m, bits in named.items() for i, v in enumerate(bits)]
    return spark.createDataFrame(rows, "model_name string, item_id long, pred int").repartition(3)


def by_pair(df, value):
    return {(r["model_a"], r["model_b"]): r[value] for r in df.collect()}


def test_worked_vectors(spark):
    p = SIM.pair_counts(vectors(spark, x="010001001", y="001000001", z="110001000", o="000000000"))
    j = by_pair(SIM.jaccard(p), "jaccard")
    assert (j["x", "y"], j["x", "z"], j["y", "z"], j["o", "o"]) == (0.25, 0.5, 0.0, None)
    r = by_pair(SIM.russell_rao(p), "russell_rao")
    assert [r["x", "y"], r["x", "z"], r["y", "z"]] == pytest.approx([8 / 9, 7 / 9, 1.0])
    h = by_pair(SIM.hamming(p), "hamming")
    assert all(h[a, a] == 0 for a in "xyz") and all(h[a, b] == h[b, a] for a, b in h)
    q = SIM.pair_counts(vectors(spark, a="1100010011111", b="0100010010000"))
    row = SIM.hamming(q).where("model_a = 'a' and model_b = 'b'").first()
    assert row["hamming"] == pytest.approx(5 / 13) and row["differing"] == 5
    cells = SIM.similarity_matrix(SIM.hamming(p), "hamming", ["x", "y", "z"], masked=True)
    shown = {r["model_a"]: r.asDict() for r in cells.collect()}
    assert shown["y"]["x"] is not None and shown["y"]["z"] is None


def test_levenshtein(spark):
    def arr(s):
        return F.array(*[F.lit(int(c)) for c in s])

    x, y, z = "010001001", "001000001", "110001000"
    row = spark.range(1).select(*[SIM.sequence_levenshtein(arr(a), arr(b)) for a, b in ((x, y), (x, z), (y, z), (x, x))]).first()
    assert tuple(row) == (2, 2, 4, 0)
    wide = spark.range(1).select(SIM.sequence_levenshtein(F.array(F.lit(1), F.lit(0)), F.array(F.lit(10)))).first()
    assert wide[0] == 2


def test_block_levenshtein(spark):
    df = vectors(spark, a="1100010011111", b="0100010010000", c="11")
    got = {r["model_name"]: (r["blocks"], r["n"], r["edits"]) for r in SIM.block_levenshtein(df, "a", 64).collect()}
    assert got == {"b": (1, 13, 5), "c": (1, 2, 11)}
    blocks = {r["model_name"]: (r["blocks"], r["n"]) for r in SIM.block_levenshtein(df, "a", 5).collect()}
    assert blocks == {"b": (3, 13), "c": (1, 2)}


def test_named_models_and_blocks(spark, monkeypatch):
    df = vectors(spark, m1="1100", m2="1010", m3="0111", m4="0001")

    def counts(**kw):
        return {(r["model_a"], r["model_b"]): tuple(r)[2:] for r in SIM.pair_counts(df, **kw).collect()}

    whole = counts()
    assert counts(models=["m1", "m2"]) == {k: v for k, v in whole.items() if set(k) <= {"m1", "m2"}}
    monkeypatch.setattr(SIM, "BLOCK_MODELS", 3)
    assert counts() == whole
    monkeypatch.setattr(SIM, "BLOCK_MODELS", 1)
    assert counts() == whole and len(whole) == 16


def test_pairs_with_many_classes_and_gaps(spark):
    rng = random.Random(5)
    rows = [(f"m{m}", i, rng.randrange(4)) for m in range(5) for i in range(60) if rng.random() < 0.8]
    df = spark.createDataFrame(rows, "model_name string, item_id long, pred int")
    got = {(r["model_a"], r["model_b"]): (r["n"], r["same"], r["both"], r["either"]) for r in SIM.pair_counts(df).collect()}
    seen = {}
    for m, i, v in rows:
        seen.setdefault(m, {})[i] = v
    for a, b in itertools.product(seen, seen):
        shared = seen[a].keys() & seen[b].keys()
        pair = [(seen[a][i], seen[b][i]) for i in shared]
        assert got[a, b] == (
            len(pair),
            sum(u == v for u, v in pair),
            sum(u == v == 1 for u, v in pair),
            sum(u == 1 or v == 1 for u, v in pair),
        )


def test_similarity_summary_keeps_all_modes(spark):
    df = spark.createDataFrame(
        [(a, b, v) for b, vs in {"p": (0.1, 0.3), "q": (0.4, 0.6)}.items() for a, v in zip("pq", vs)], "model_a string, model_b string, h double"
    )
    rows = SIM.similarity_summary(df, "h").orderBy("mode_of_medians").collect()
    assert [r["mode_of_medians"] for r in rows] == pytest.approx([0.2, 0.5])
    assert rows[0]["grand_mean"] == pytest.approx(0.35) and rows[0]["median_of_medians"] == pytest.approx(0.35)


def test_random_guess_tends_to_the_closed_form(spark):
    truth = spark.range(1400).select(F.col("id").alias("item_id"), (F.col("id") % 7 == 0).cast("int").alias("label"))
    mean = baseline.random_f1_baseline(truth, trials=500).first()
    expected = baseline.random_f1_closed_form(truth).first()["expected_f1"]
    assert mean["trials"] == 500
    assert expected == pytest.approx(1 / 7 / (1 / 7 + 0.5))
    assert mean["mean_f1"] == pytest.approx(expected, abs=0.005) and mean["mean_accuracy"] == pytest.approx(0.5, abs=0.005)
    assert baseline.random_guess_trials(truth, 1).count() == 1


def test_rate_bands(spark):
    rates = spark.createDataFrame([(v,) for v in (19.0, 19.5, 20.0, 49.0, 49.5, 50.0, 69.9, 69.95, 70.0, 100.0)], "p double")
    strict = {r["band"]: r["models"] for r in results.rate_bands(rates, "p").collect()}
    assert strict == {"0-19": 1, "20-49": 2, "50-70": 2, "70+": 2, "unbanded": 3}
    whole = {r["band"]: r["models"] for r in results.rate_bands(rates, "p", strict=False).collect()}
    assert whole == {"0-20": 2, "20-50": 3, "50-70": 3, "70+": 2, "unbanded": 0}
    none = {r["band"]: r["models"] for r in results.rate_bands(rates.limit(0), "p").collect()}
    assert none == {"0-19": 0, "20-49": 0, "50-70": 0, "70+": 0, "unbanded": 0}


def test_sorted_positions(spark):
    df = spark.createDataFrame([(c, i) for i, c in enumerate("bAaBcaC")], "name string, i int").repartition(3)
    got = [(r["name"], r["i"]) for r in sorted(results.sorted_positions(df, "name", "i").collect(), key=lambda r: r["position"])]
    assert got == [("A", 1), ("a", 2), ("a", 5), ("B", 3), ("b", 0), ("C", 6), ("c", 4)]


def test_means_and_deltas(spark):
    df = spark.createDataFrame([("s", "control", 0.4, 0.7), ("s", "control", 0.6, 0.9), ("s", "x", 0.7, 0.9)], "s string, g string, test_f1 double, test_accuracy double")
    row = results.means_and_deltas(df, "s", "g", "control").where("g = 'x'").first()
    assert row["delta_test_f1"] == pytest.approx(0.2) and row["delta_test_accuracy"] == pytest.approx(0.1)


def test_control_golden(spark):
    """Counts of the shared predictions stand-in, worked out once in both engines."""
    from plurivote.plans import inputs as I

    sf = "/root/testdata/sf0.01"
    ones = I.predictions(spark, sf).where("model_name = 'control_01' and pred = 1").groupBy("epoch_no").count().collect()
    assert {r["epoch_no"]: r["count"] for r in ones} == {1: 145, 2: 113, 3: 137}
    scores = {(r["model_name"], r["epoch_no"]): r for r in I.scores(spark, sf).collect()}
    assert round(scores["control_01", 2]["test_accuracy"], 4) == 0.7594 and round(scores["control_01", 2]["test_f1"], 4) == 0.4146
    assert round(scores["control_02", 2]["test_accuracy"], 4) == 0.7669 and round(scores["control_02", 2]["test_f1"], 4) == 0.4561


def exploded_predictions(spark):
    """Truth of 20 items, and predictions made of it by an ``explode``, which the planner takes for as few rows."""
    truth = spark.range(20).select(F.col("id").alias("item_id"), (F.col("id") % 2).cast("int").alias("label"))
    made = truth.select("item_id", F.col("label").alias("pred"), F.explode(F.sequence(F.lit(1), F.lit(63))).alias("epoch_no"))
    return made.withColumn("model_name", F.lit("a")), truth


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_predictions_are_never_broadcast_to_the_truth(spark):
    preds, truth = exploded_predictions(spark)
    joined = M.join_truth(preds, truth)
    assert "BroadcastHashJoin" not in plan_of(joined) and joined.where("pred = label").count() == 20 * 63
    assert "BroadcastHashJoin" not in plan_of(M.evaluate_models(preds, truth))


def test_predictions_are_not_sorted_for_their_truth(spark):
    """A task holds its items' labels; predictions, and texts of wrong votes, stream by. Repeated and null items as in any join."""
    preds, truth = exploded_predictions(spark)
    plan = plan_of(M.join_truth(preds, truth))
    assert "ShuffledHashJoin" in plan and "BuildRight" in plan and "Sort " not in plan
    odd = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (50, 1)], "item_id bigint, label int")
    got = M.join_truth(preds.where("epoch_no = 1").unionByName(preds.where("epoch_no = 1").withColumn("item_id", F.lit(None).cast("bigint"))), odd)
    assert sorted((r["item_id"], r["pred"], r["label"]) for r in got.collect()) == [(1, 1, 0), (1, 1, 1)]

    votes = truth.select("item_id", F.lit(1).alias("pred"))
    corpus = truth.select("item_id", F.concat(F.lit("text "), "item_id").alias("text"), "label")
    errors = E.ensemble_errors(votes, truth, corpus)
    assert "Sort " not in plan_of(errors)
    assert sorted(tuple(r) for r in errors.collect()) == [(i, 1, 0, f"text {i}") for i in range(0, 20, 2)]


def test_predictions_are_never_broadcast_to_the_batches(spark, tmp_path):
    from plurivote.plans import scoring

    spark.createDataFrame([(i, 0, i % 2) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found = scoring.batch_mean_metrics(spark, str(tmp_path))
    assert "SortMergeJoin [item_id" in plan_of(found)  # the batches themselves may come from small broadcast tables
    assert {r["batches"] for r in found.collect()} == {3} and found.count() == 63
