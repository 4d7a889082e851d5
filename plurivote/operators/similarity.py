"""How alike the models' predictions are.

All pairwise measures come from four counts per model pair. They are entries of
matrix products X'X over the item × model table, so each task multiplies its own
items in Arrow batches and gives out one M × M matrix; the pairs of an item are
never written out. Levenshtein distance is taken row by row on short sequences.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plurivote.session import settle

BLOCK_MODELS = 1_000  # a task multiplies two blocks of models at a time


def _pair_counter(models: int, split: int | None = None):
    """Counts of all pairs, or with ``split`` of the pairs of a model before it and one behind it."""
    schema = pa.schema([(n, pa.int64()) for n in ("a", "b", "n", "same", "both", "ones_a", "ones_b")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, same, both, ones = (np.zeros((models, models), dtype=np.int64) for _ in range(4))
        for batch in batches:
            votes = batch.column("votes")
            lengths = np.diff(votes.offsets.to_numpy())
            flat = votes.flatten()
            model = flat.field("model").to_numpy(zero_copy_only=False)
            pred = flat.field("pred").to_numpy(zero_copy_only=False)
            table = np.zeros((batch.num_rows, models), dtype=np.float32)
            row = np.repeat(np.arange(batch.num_rows), lengths)
            present = table.copy()
            present[row, model] = 1
            seen += (present.T @ present).astype(np.int64)
            for value in np.unique(pred):
                mask = pred == value
                one = table.copy()
                one[row[mask], model[mask]] = 1
                together = (one.T @ one).astype(np.int64)
                same += together
                if value == 1:
                    both += together
                    ones += (one.T @ present).astype(np.int64)
        if split is None:
            a, b = np.triu_indices(models)
        else:
            a, b = (x.ravel() for x in np.meshgrid(np.arange(split), np.arange(split, models), indexing="ij"))
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (a, b, seen[a, b], same[a, b], both[a, b], ones[a, b], ones.T[a, b])], schema=schema
        )

    return count


def _products(items: DataFrame, counter) -> DataFrame:
    return items.mapInArrow(counter, "a long, b long, n long, same long, both long, ones_a long, ones_b long")


def _block_product(items: DataFrame, low: int, size: int, other: int, more: int) -> DataFrame:
    """Counts inside one block of models (``more`` = 0), or between two blocks."""
    def local(v: Column) -> Column:
        inside = (v["model"] >= low) & (v["model"] < low + size)
        return F.struct(F.when(inside, v["model"] - low).otherwise(v["model"] - other + size).cast("int").alias("model"), v["pred"].alias("pred"))

    def wanted(v: Column) -> Column:
        return ((v["model"] >= low) & (v["model"] < low + size)) | ((v["model"] >= other) & (v["model"] < other + more))

    votes = items.select(F.transform(F.filter("votes", wanted), local).alias("votes"))
    found = _products(votes, _pair_counter(size + more, size if more else None))
    b = F.when(F.col("b") < size, F.col("b") + low).otherwise(F.col("b") - size + other)
    return found.withColumns({"a": F.col("a") + low, "b": b})


def pair_counts(predictions: DataFrame, models: Sequence[str] | None = None) -> DataFrame:
    """For every ordered pair of models, over the items both predicted: items ``n``,
    equal predictions ``same``, both 1 ``both``, at least one 1 ``either``.

    ``predictions`` holds one row per (model_name, item_id). ``models`` limits the pairs to the named
    models and spares the pass that looks the names up. Any number of models: beyond
    ``BLOCK_MODELS`` the product is taken for two blocks of models at a time.
    """
    if models is None:
        models = [r[0] for r in predictions.select("model_name").distinct().collect()]
    names = sorted(models)
    known = F.array(*[F.lit(n) for n in names]).cast("array<string>")
    # One entry per model, so an item's list is as long as the model list.
    items = (
        predictions.where(F.col("pred").isNotNull())
        .select("item_id", (F.array_position(known, F.col("model_name")) - 1).cast("int").alias("model"), F.col("pred").cast("int"))
        .where("model >= 0")
        .groupBy("item_id")
        .agg(F.collect_list(F.struct("model", "pred")).alias("votes"))
        .select("votes")
    )
    starts = list(range(0, max(1, len(names)), BLOCK_MODELS))
    if len(starts) > 1:
        items = settle(items)
    parts = []
    for i, low in enumerate(starts):
        size = min(BLOCK_MODELS, len(names) - low)
        for other in starts[i:]:
            more = min(BLOCK_MODELS, len(names) - other) if other > low else 0
            parts.append(_block_product(items, low, size, other, more) if len(starts) > 1 else _products(items, _pair_counter(len(names))))
    sums = reduce(DataFrame.unionByName, parts).groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "same", "both", "ones_a", "ones_b")])
    name = lambda i: F.element_at(known, (F.col(i) + 1).cast("int"))
    upper = sums.select(
        name("a").alias("model_a"),
        name("b").alias("model_b"),
        "n",
        "same",
        "both",
        (F.col("ones_a") + F.col("ones_b") - F.col("both")).alias("either"),
    )
    # The other half of the matrix is the same table with the names swapped.
    both_ways = F.when(F.col("model_a") == F.col("model_b"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))
    flipped = upper.withColumn("_flip", F.explode(both_ways))
    return flipped.select(
        F.when(F.col("_flip"), F.col("model_b")).otherwise(F.col("model_a")).alias("model_a"),
        F.when(F.col("_flip"), F.col("model_a")).otherwise(F.col("model_b")).alias("model_b"),
        "n",
        "same",
        "both",
        "either",
    )


def hamming(pairs: DataFrame) -> DataFrame:
    """Share and number of differing positions, and the agreement."""
    differ = F.col("n") - F.col("same")
    return pairs.select(
        "model_a",
        "model_b",
        (differ / F.col("n")).alias("hamming"),
        differ.alias("differing"),
        (F.col("same") / F.col("n")).alias("agreement"),
    )


def jaccard(pairs: DataFrame) -> DataFrame:
    """Shared ones over all ones; null for two vectors without a one."""
    return pairs.select("model_a", "model_b", F.try_divide(F.col("both"), F.col("either")).alias("jaccard"))


def russell_rao(pairs: DataFrame) -> DataFrame:
    """Share of positions that are not 1 in both."""
    return pairs.select("model_a", "model_b", ((F.col("n") - F.col("both")) / F.col("n")).alias("russell_rao"))


def similarity_matrix(pairs: DataFrame, value: str, models: list[str], masked: bool = False) -> DataFrame:
    """Matrix form for display: one column per model; ``masked`` blanks the upper triangle."""
    cells = pairs.where(F.col("model_a") > F.col("model_b")) if masked else pairs
    return cells.groupBy("model_a").pivot("model_b", models).agg(F.first(value))


def similarity_summary(pairs: DataFrame, value: str) -> DataFrame:
    """Mean of column means, median of column medians, and every mode of the medians."""
    columns = pairs.groupBy("model_b").agg(F.avg(value).alias("_mean"), F.median(value).alias("_median"))
    grand = columns.agg(
        F.avg("_mean").alias("grand_mean"),
        F.median("_median").alias("median_of_medians"),
        F.collect_list("_median").alias("_medians"),
    )
    counts = F.transform(
        F.array_distinct("_medians"),
        lambda m: F.struct(F.size(F.filter("_medians", lambda x: x == m)).alias("times"), m.alias("median")),
    )
    top = F.array_max(F.transform(counts, lambda c: c["times"]))
    modes = F.array_sort(F.transform(F.filter(counts, lambda c: c["times"] == top), lambda c: c["median"]))
    return grand.select("grand_mean", "median_of_medians", F.explode(modes).alias("mode_of_medians"))


def sequence_levenshtein(a: Column, b: Column) -> Column:
    """Edits between two arrays of classes 0, 1, 2 …: every class is one character, so 1, 0 is not 10."""

    def text(values: Column) -> Column:
        return F.array_join(F.transform(values, lambda v: F.chr(v.cast("bigint") + 48)), "")

    return F.levenshtein(text(a), text(b))


def block_levenshtein(predictions: DataFrame, against: str, block: int = 64) -> DataFrame:
    """Edits between each model's and one model's predictions, summed over blocks of ``block`` items.

    The predictions of a model are a sequence in the order of ``item_id``; edit distance takes the square
    of the length, so both sequences are cut at the same items (``item_id`` divided by ``block``) and
    compared block by block. Null predictions are left out. ``block`` bounds a sequence's length.
    """
    rows = predictions.where(F.col("pred").isNotNull()).select("model_name", F.floor(F.col("item_id") / block).alias("_block"), "item_id", "pred")
    sequences = (
        rows.groupBy("_block", "model_name")
        .agg(F.array_sort(F.collect_list(F.struct("item_id", "pred"))).alias("_s"))
        .select("_block", "model_name", F.col("_s.pred").alias("seq"))
    )
    base = sequences.where(F.col("model_name") == against).select("_block", F.col("seq").alias("base"))
    nothing = F.array().cast("array<int>")
    edits = sequence_levenshtein(F.coalesce(F.col("seq").cast("array<int>"), nothing), F.coalesce(F.col("base").cast("array<int>"), nothing))
    # A block that one of the two lacks counts with all its predictions.
    others = sequences.where(F.col("model_name") != against)
    return (
        others.join(base, "_block", "left")
        .select("model_name", F.size("seq").alias("_n"), edits.alias("_edits"))
        .groupBy("model_name")
        .agg(F.count(F.lit(1)).alias("blocks"), F.sum("_n").cast("bigint").alias("n"), F.sum("_edits").cast("bigint").alias("edits"))
    )


def family_levenshtein(predictions: DataFrame, against: str, runs: list[tuple[str, int]]) -> DataFrame:
    """Edits between each family's and one family's prediction sequence of an item
    (runs and epochs of one item; ``block_levenshtein`` compares two models over items).

    A sequence is the item's predictions over ``runs`` = ordered (run, epoch) slots.
    """
    slot = {r: i for i, r in enumerate(runs)}
    keys = F.array(*[F.lit(f"{run}:{epoch}") for run, epoch in slot])
    position = F.array_position(keys, F.concat_ws(":", "run", "epoch_no"))
    # Moved once by item: the sequences and the join below both keep that partitioning.
    sequences = (
        predictions.where(position > 0)
        .select("item_id", "family", position.alias("slot"), "pred")
        .repartition("item_id")
        .groupBy("item_id", "family")
        .agg(F.array_sort(F.collect_list(F.struct("slot", "pred"))).alias("_s"))
        .select("item_id", "family", F.col("_s.pred").alias("seq"))
    )
    own = sequences.where(F.col("family") != against)
    base = sequences.where(F.col("family") == against).select("item_id", F.col("seq").alias("base"))
    return (
        own.join(base, "item_id")
        .select("family", sequence_levenshtein(F.col("seq"), F.col("base")).alias("_edits"))
        .groupBy("family")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("_edits").cast("bigint").alias("edits"),
            F.max("_edits").alias("max_edits"),
        )
    )
