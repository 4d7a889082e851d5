"""Majority-vote ensembles over every combination of model families.

Families enter an ensemble whole, so votes are first added up per item and family. The votes of all
ensembles are those sums times a matrix that says which family is in which ensemble; a task multiplies its own items.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from plurivote.functions import text as T
from plurivote.operators.metrics import join_truth, metrics_of_counts
from plurivote.operators.ranking import is_control
from plurivote.session import small_side

BLOCK_ENSEMBLES = 1 << 12  # ensembles whose votes a task adds up at once
BLOCK_ITEMS = 1 << 10
BLOCK_ROWS = 1 << 16  # votes that leave a task at once
MASK_FAMILIES = 31  # up to so many families an ensemble's id is their bit mask


def _subset(number: Column, families: int, size: int) -> Column:
    """Positions (from 0) of the subset with this number among all subsets of ``size``, in lexicographic order.

    Walks over the families once: those subsets that take the next one come first.
    """
    with_next = F.array(*[F.array(*[F.lit(comb(families - 1 - i, left - 1) if left else 0) for left in range(size + 1)]) for i in range(families)])
    start = F.struct(number.alias("number"), F.lit(size).alias("left"), F.array().cast("array<int>").alias("taken"))

    def step(state: Column, i: Column) -> Column:
        block = F.get(F.get(with_next, i), state["left"])
        take = (state["left"] > 0) & (state["number"] < block)
        return F.struct(
            F.when(take | (state["left"] == 0), state["number"]).otherwise(state["number"] - block).alias("number"),
            F.when(take, state["left"] - 1).otherwise(state["left"]).alias("left"),
            F.when(take, F.concat(state["taken"], F.array(i))).otherwise(state["taken"]).alias("taken"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(families - 1)), start, step)["taken"]


def inducer_combinations(families: DataFrame, sizes: Sequence[int], family: str = "family") -> DataFrame:
    """All subsets of the distinct families with the wanted sizes, made in parallel from their numbers.

    ``ensemble_id`` is the subset's bit mask over the sorted family names; with more than
    ``MASK_FAMILIES`` families, where a mask no longer fits, its number over all sizes in their order.
    """
    spark = families.sparkSession
    # The names are a list of models' families, as short as the list of models.
    names = sorted(r[0] for r in families.select(F.col(family)).distinct().collect())
    known = F.array(*[F.lit(name) for name in names]).cast("array<string>")
    masks = len(names) <= MASK_FAMILIES
    parts, before = [], 0
    for size in sorted(set(sizes)):
        if not 0 < size <= len(names):
            continue
        subsets = spark.range(comb(len(names), size)).select("id", _subset(F.col("id"), len(names), size).alias("_at"))
        mask = F.aggregate("_at", F.lit(0), lambda total, i: total + F.call_function("shiftleft", F.lit(1), i))
        ensemble_id = mask.cast("int") if masks else F.col("id") + F.lit(before)
        parts.append(
            subsets.select(ensemble_id.alias("ensemble_id"), F.lit(size).alias("size"), F.transform("_at", lambda i: F.get(known, i)).alias("inducers"))
        )
        before += comb(len(names), size)
    if not parts:
        kind = "int" if masks else "bigint"
        return spark.createDataFrame([], f"ensemble_id {kind}, size int, inducers array<string>")
    return reduce(DataFrame.unionByName, parts)


def _runs(combinations: DataFrame, models: DataFrame) -> DataFrame:
    """Run names per family, from the models that exist; a family without a run fails."""
    runs = models.select("model_name", T.model_family(F.col("model_name")).alias("family")).distinct()
    runs = small_side(runs.groupBy("family").agg(F.array_sort(F.collect_list("model_name")).alias("_models")), short=True)
    missing = combinations.select(F.explode("inducers").alias("family")).distinct().join(runs, "family", "left_anti").limit(5).collect()
    if missing:
        raise ValueError(f"families without a run: {sorted(r['family'] for r in missing)}")
    return runs


def ensemble_membership(combinations: DataFrame, models: DataFrame) -> DataFrame:
    """One row per ensemble and member run. ``models`` has the ``model_name`` of every run there is."""
    members = combinations.select("ensemble_id", "size", F.explode("inducers").alias("family"))
    return members.join(_runs(combinations, models), "family").select("ensemble_id", "size", "family", F.explode("_models").alias("model_name"))


def chosen_epochs(scores: DataFrame, selections: dict[str, str]) -> DataFrame:
    """The single best epoch of every target model, once per selection rule.

    ``selections`` maps a name such as ``best-F1`` to the metric it maximises.
    """
    best = scores.where(~is_control()).groupBy("model_name").agg(
        F.array(
            *[
                F.struct(
                    F.lit(name).alias("selection"),
                    F.max_by("epoch_no", F.struct(F.col(metric), -F.col("epoch_no"))).alias("epoch_no"),
                )
                for name, metric in selections.items()
            ]
        ).alias("_best")
    )
    return best.select("model_name", F.explode("_best").alias("_b")).select("_b.selection", "model_name", "_b.epoch_no")


def pick_predictions(predictions: DataFrame, chosen: DataFrame) -> DataFrame:
    """Predictions of the chosen epochs with their selection and family."""
    named = chosen.select("selection", "model_name", "epoch_no", T.model_family(F.col("model_name")).alias("family"))
    return (
        predictions.select("model_name", "epoch_no", "item_id", "pred")
        .join(small_side(named, short=True), ["model_name", "epoch_no"])
        .select("selection", "item_id", "model_name", "family", "pred")
    )


def vote_winner(votes: DataFrame, by: Sequence[str]) -> DataFrame:
    """Class with the most votes per group, the lowest class on ties."""
    return votes.groupBy(*by).agg(
        F.max_by("pred", F.struct(F.col("votes"), -F.col("pred"))).alias("pred"),
        F.sum("votes").alias("ballots"),
        F.max("votes").alias("winning_votes"),
    )


class _Ensembles:
    """The ensembles as a list of member families, held by the driver and shipped to the tasks in blocks.

    Families and selection rules are short lists; ``classes`` are those that occur, in ascending order.
    """

    def __init__(self, picked: DataFrame, combinations: DataFrame):
        rows = combinations.select("ensemble_id", "inducers").toArrow()
        members = rows.column("inducers").combine_chunks()
        self.ids = rows.column("ensemble_id").to_numpy()
        names = members.flatten().to_pylist()
        self.families = sorted(set(names))
        place = {f: i for i, f in enumerate(self.families)}
        self.family = np.array([place[f] for f in names], dtype=np.int32)
        self.bounds = np.concatenate([[0], np.cumsum(members.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        seen = picked.agg(F.collect_set("selection").alias("selections"), F.collect_set("pred").alias("classes")).first()
        self.selections, self.classes = sorted(seen["selections"]), sorted(seen["classes"])

    def blocks(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of ensembles and the matrix that holds 1 where a family (row) is in an ensemble (column)."""
        made = []
        for low in range(0, len(self.ids), BLOCK_ENSEMBLES):
            high = min(low + BLOCK_ENSEMBLES, len(self.ids))
            column = np.repeat(np.arange(high - low), np.diff(self.bounds[low : high + 1]))
            holds = np.zeros((len(self.families), high - low), dtype=np.float32)
            holds[self.family[self.bounds[low] : self.bounds[high]], column] = 1
            made.append((self.ids[low:high], holds))
        return made

    def items(self, picked: DataFrame) -> DataFrame:
        """One row per item with the votes of its models: the one shuffle of a vote."""
        names = [F.array(F.lit(s), F.lit(f)) for s in self.selections for f in self.families]
        slot = F.array_position(F.array(*names).cast("array<array<string>>"), F.array("selection", "family")) - 1
        voted = F.array_position(F.array(*[F.lit(c) for c in self.classes]).cast(f"array<{dict(picked.dtypes)['pred']}>"), F.col("pred")) - 1
        votes = picked.where("pred IS NOT NULL").select("item_id", slot.cast("int").alias("slot"), voted.cast("int").alias("voted"))
        return votes.where("slot >= 0").groupBy("item_id").agg(F.collect_list(F.struct("slot", "voted")).alias("votes"))

    def tallies(self, blocks):
        """For an Arrow batch: rows, selection, ids of a block of ensembles, winning class, its votes and all votes."""
        shape = (len(self.selections), len(self.families), len(self.classes))

        def run(batch: pa.RecordBatch):
            for start in range(0, batch.num_rows, BLOCK_ITEMS):
                part = batch.slice(start, BLOCK_ITEMS)
                votes, n = part.column("votes"), part.num_rows
                flat = votes.flatten()
                row = np.repeat(np.arange(n), votes.value_lengths().to_numpy(zero_copy_only=False))
                at = (row * shape[0] * shape[1] + flat.field("slot").to_numpy()) * shape[2] + flat.field("voted").to_numpy()
                counts = np.bincount(at, minlength=n * shape[0] * shape[1] * shape[2]).reshape(n, *shape).astype(np.float32)
                for s in range(shape[0]):
                    for ids, holds in blocks:
                        totals = np.stack([counts[:, s, :, c] @ holds for c in range(shape[2])])
                        # The first of the largest is the lowest class.
                        yield part, s, ids, totals.argmax(axis=0), totals.max(axis=0), totals.sum(axis=0)

        return run


def majority_vote(picked: DataFrame, combinations: DataFrame) -> DataFrame:
    """Vote of every ensemble on every item: winner (the lowest class on ties), its votes, and all votes.

    A null prediction is no vote; an ensemble without a vote on an item has no row there. Votes are added up per item
    and family, and these sums times the membership matrix are the ensembles' votes: one shuffle, on the item.
    """
    known = _Ensembles(picked, combinations)
    kinds = dict(picked.dtypes) | dict(combinations.dtypes)
    schema = f"selection string, ensemble_id {kinds['ensemble_id']}, item_id {kinds['item_id']}, pred {kinds['pred']}, ballots bigint, winning_votes bigint"
    if not len(known.ids) or not known.classes:
        found = picked.sparkSession.createDataFrame([], schema)
    else:
        tallied, classes, selections = known.tallies(known.blocks()), np.array(known.classes), known.selections
        kind = to_arrow_type(picked.schema["pred"].dataType)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, s, ids, winner, most, ballots in tallied(batch):
                    row, column = np.nonzero(most > 0)
                    for low in range(0, len(row), BLOCK_ROWS):
                        r, c = row[low : low + BLOCK_ROWS], column[low : low + BLOCK_ROWS]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([selections[s]] * len(r), pa.string()),
                                pa.array(ids[c]),
                                part.column("item_id").take(pa.array(r)),
                                pa.array(classes[winner[r, c]]).cast(kind),
                                pa.array(ballots[r, c].astype(np.int64)),
                                pa.array(most[r, c].astype(np.int64)),
                            ],
                            names=["selection", "ensemble_id", "item_id", "pred", "ballots", "winning_votes"],
                        )

        found = known.items(picked).mapInArrow(run, schema)
    sizes = small_side(combinations.select("ensemble_id", "size"), short=True)
    return found.join(sizes, "ensemble_id").select("selection", "ensemble_id", "size", "item_id", "pred", "ballots", "winning_votes")


def ensemble_scores(picked: DataFrame, truth: DataFrame, combinations: DataFrame) -> DataFrame:
    """Accuracy and F1 of every ensemble over the items it votes on.

    The votes of single ensembles are never made into rows: a task adds up the score counts of its own items
    and gives out one row per ensemble, for any number of ensembles.
    """
    known = _Ensembles(picked, combinations)
    kinds = dict(combinations.dtypes)
    schema = f"selection string, ensemble_id {kinds['ensemble_id']}, n bigint, _hit bigint, _tp bigint, _fp bigint, _fn bigint"
    if not len(known.ids) or not known.classes:
        counts = picked.sparkSession.createDataFrame([], schema)
    else:
        tallied, classes, selections = known.tallies(known.blocks()), np.array(known.classes, dtype=np.float64), known.selections

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple[int, int], list] = {}
            for batch in batches:
                for part, s, ids, winner, most, _ in tallied(batch):
                    label = part.column("label").cast(pa.float64()).to_numpy(zero_copy_only=False)[:, None]
                    voted, pred = most > 0, classes[winner]
                    one, other = voted & (pred == 1), (label != 1) & ~np.isnan(label)
                    found = [voted, voted & (pred == label), one & (label == 1), one & other, voted & ~one & (label == 1)]
                    held = sums.setdefault((s, int(ids[0])), [ids, np.zeros((5, len(ids)), dtype=np.int64)])
                    held[1] += np.stack([x.sum(axis=0) for x in found])
            for (s, _), (ids, total) in sums.items():
                some = np.flatnonzero(total[0])
                columns = [pa.array([selections[s]] * len(some), pa.string()), pa.array(ids[some]), *[pa.array(x[some]) for x in total]]
                yield pa.RecordBatch.from_arrays(columns, names=["selection", "ensemble_id", "n", "_hit", "_tp", "_fp", "_fn"])

        counts = join_truth(known.items(picked), truth).mapInArrow(run, schema)
    scored = metrics_of_counts(counts, ["selection", "ensemble_id"])
    named = small_side(combinations.select("ensemble_id", "size", "inducers"), short=True)
    return scored.join(named, "ensemble_id").select("selection", "ensemble_id", "size", "inducers", "n", "accuracy", "f1")


SIZE_WORDS = {3: "three", 5: "five"}


def ensemble_leaderboard(scored: DataFrame, metrics: dict[str, str], dataset: str, models: DataFrame) -> DataFrame:
    """The result table: type, members, scores, and the place inside each type.

    ``metrics`` maps each selection to the score that ranks its ensembles; ``models`` has the
    ``model_name`` of every run that voted.
    """
    word = reduce(
        lambda rest, kv: F.when(F.col("size") == kv[0], kv[1]).otherwise(rest), SIZE_WORDS.items(), F.col("size").cast("string")
    )
    ranked_by = reduce(
        lambda rest, kv: F.when(F.col("selection") == kv[0], F.col(kv[1])).otherwise(rest), metrics.items(), F.lit(None)
    )
    place = Window.partitionBy("ensemble_type").orderBy(F.desc("_ranked_by"), "ensemble_id")
    # The votes are counted once; members, places and the board itself are made from the scores.
    scored = small_side(scored, short=True)
    members = ensemble_membership(scored.select("ensemble_id", "size", "inducers").distinct(), models)
    spec = members.groupBy("ensemble_id").agg(F.array_sort(F.collect_list("model_name")).alias("inducers_spec"))
    scored = scored.join(small_side(spec, short=True), "ensemble_id")
    return (
        scored.withColumn("ensemble_type", F.concat(F.col("selection"), F.lit("_"), word, F.lit("-model")))
        .withColumn("_ranked_by", ranked_by)
        .withColumn("place", F.row_number().over(place))
        .select(
            "ensemble_id",
            "inducers",
            "inducers_spec",
            F.lit(dataset).alias("dataset"),
            F.col("accuracy").alias("test_accuracy"),
            F.col("f1").alias("test_f1"),
            "ensemble_type",
            "selection",
            "place",
        )
    )


def custom_ensemble(predictions: DataFrame, chosen: DataFrame, members: Sequence[str]) -> DataFrame:
    """Vote of a hand-picked list of runs. Names match in any case; unknown names raise."""
    wanted = {m.lower() for m in members}
    known = chosen.withColumn("_key", F.lower("model_name")).where(F.col("_key").isin(*wanted))
    found = {r[0] for r in known.select("_key").distinct().collect()}
    if found != wanted:
        raise ValueError(f"unknown models: {sorted(wanted - found)}")
    picked = pick_predictions(predictions, known.drop("_key"))
    votes = picked.groupBy("selection", "item_id", "pred").agg(F.count(F.lit(1)).alias("votes"))
    return vote_winner(votes, ["selection", "item_id"])


def ensemble_errors(votes: DataFrame, truth: DataFrame, corpus: DataFrame, first: int | None = None) -> DataFrame:
    """Wrong votes with their text; ``first`` keeps the report to the lowest item ids."""
    wrong = join_truth(votes, truth).where(F.col("pred") != F.col("label")).select("item_id", "pred", "label")
    if first is not None:
        wrong = wrong.orderBy("item_id").limit(first)
    # A task holds its wrong votes; the texts stream by and are not sorted.
    return wrong.hint("shuffle_hash").join(corpus.select("item_id", "text"), "item_id")
