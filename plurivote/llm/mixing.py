"""Mixing sources to target weights by Pareto order sampling (operator 3).

Every source has a target in words. Inside a source a document's expected number of copies
is proportional to its inclusion weight, the bit length of its word count (a longer
document counts a little more), and never above the cap:

    copies = min(cap, rate(source) x weight),  with  sum(copies x words) = target

The whole part of ``copies`` is certain. The broken part ``p`` is an inclusion probability:
documents are ranked by random odds over inclusion odds, ``(u / (1 - u)) / (p / (1 - p))``,
and taken in that order until the words left in the source's target are used up. The sample
has a fixed size in words, and its last document is kept where that comes nearer.

No source is sorted as a whole. The rank is mapped to (0, 1) and cut in equal slices; words
are added up per source and slice, and only the slice that holds the cut is ordered. So a
source with a third of all rows is spread over all tasks until its cut slice is known.

Defined cases: null and empty texts have 0 words, are never taken, and a source of such rows
has target 0; null is a source of its own and stands last; rows that repeat an id share
its random number; equal ranks are taken in the order of ids; an empty table gives an empty
mix; null ids are drawn like one more id; extra columns are left alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plurivote.session import settle, small_side

WORD = r"[^\x20\x09-\x0D]+"
SLICES = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def size_class(size: Column) -> Column:
    """Bit length of the word count: 1 for 1, 2 for 2 and 3, 3 for 4 to 7, … It is also the inclusion weight."""
    return F.length(F.bin(size)).cast("int")


def draw(doc_id: Column, seed: int) -> Column:
    """The document's random number in (0, 1)."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null"))), 12)
    return (bits + 0.5) / float(1 << 52)


def number_sources(sizes: DataFrame) -> DataFrame:
    """Sources with their place in code point order, null last, counted over sorted parts."""
    ordered = sizes.orderBy(F.col("source").asc_nulls_last()).withColumn("_id", F.monotonically_increasing_id())
    ordered = settle(ordered)
    part = F.shiftright("_id", 33)
    parts = ordered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))  # one row per part
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before")
    return ordered.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn("place", place).drop("_part", "_id", "_before")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """``source, source_size, target``: shares by weight; what is above the cap is dealt to the others."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    numbered = settle(number_sources(sizes).select("source", "source_size", weight.alias("_weight")))
    top = F.col("source_size") * cap
    total = numbered.agg(F.sum("source_size").alias("s")).first()["s"] or 0
    budget, rate = total * share, 0.0
    while True:  # every round but the last caps one more source at least, so it ends
        # One row of sums per round: what the capped sources take, and the weight of the others.
        full = top <= F.col("_weight") * rate
        row = numbered.agg(
            F.sum(F.when(full, top).otherwise(0.0)).alias("taken"), F.sum(F.when(full, 0.0).otherwise(F.col("_weight"))).alias("open")
        ).first()
        if not row["open"]:
            break
        new = (budget - row["taken"]) / row["open"]
        if new <= rate:
            break
        rate = new
    target = F.least(top, F.col("_weight") * rate)
    return numbered.select("source", "source_size", target.alias("target"))


def copy_rates(classes: DataFrame, cap: float) -> DataFrame:
    """Expected copies per (source, size class): the rate is solved over the classes, the heaviest capped first.

    A source has at most as many classes as a length has bits, so its window is short.
    """
    words, weight = F.col("words").cast("double"), F.col("class").cast("double")
    heavier = Window.partitionBy("source").orderBy(F.desc("class"))
    above = F.coalesce(F.sum(words).over(heavier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    below = F.sum(words * weight).over(heavier.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rates = classes.withColumn("_rate", (F.col("target") - cap * above) / below)
    fits = F.min(F.when(F.col("_rate") * weight <= cap, F.struct(-F.col("class"), F.col("_rate")))).over(Window.partitionBy("source"))
    copies = F.least(F.lit(float(cap)), F.greatest(F.lit(0.0), F.coalesce(fits["_rate"] * weight, F.lit(float(cap)))))
    return rates.withColumn("copies", copies).drop("_rate")


def mix(
    documents: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 20240501
) -> DataFrame:
    """``doc_id, size, source_size, target, copies, taken``, one row per document.

    ``weights`` repeat over the sources in code point order; together the sources get
    ``share`` times all words, and none more than ``cap`` times its own.
    """
    narrow = settle(
        documents.select("doc_id", "source", word_count(F.col("text")).alias("size")).withColumn("class", size_class(F.col("size")))
    )
    by_class = settle(narrow.groupBy("source", "class").agg(F.sum("size").alias("words")))
    sizes = by_class.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = source_targets(sizes, weights, share, cap)

    def on_source(left: DataFrame, right: DataFrame, how: str = "inner", *more: str) -> DataFrame:
        """Join on the source (null matches null) and further columns."""
        other = right.withColumnRenamed("source", "_source")
        for name in more:
            other = other.withColumnRenamed(name, f"_{name}")
        match = left["source"].eqNullSafe(other["_source"])
        for name in more:
            match = match & (left[name] == other[f"_{name}"])
        return left.join(other, match, how).drop("_source", *[f"_{n}" for n in more])

    rates = copy_rates(on_source(by_class.where("words > 0"), targets), cap)
    rates = rates.withColumn("whole", F.floor("copies")).withColumn("part", F.col("copies") - F.col("whole"))
    left_over = F.sum(F.col("part") * F.col("words")).over(Window.partitionBy("source"))
    rates = settle(rates.select("source", "class", "source_size", "target", "whole", "part", left_over.alias("budget")))

    drawn = on_source(narrow, small_side(rates.drop("source_size", "target")), "left", "class")
    u = draw(F.col("doc_id"), seed)
    odds = (u / (1 - u)) / (F.col("part") / (1 - F.col("part")))
    rank = F.when((F.col("part") > 0) & (F.col("size") > 0), odds / (1 + odds))
    drawn = settle(drawn.withColumn("rank", rank).withColumn("slice", F.floor(F.col("rank") * SLICES).cast("int")))

    # Words per source and slice; the slice in which the running total passes the budget.
    sums = drawn.where("rank IS NOT NULL").groupBy("source", "slice").agg(F.sum("size").alias("words"), F.first("budget").alias("budget"))
    upto = Window.partitionBy("source").orderBy("slice")
    run = sums.withColumn("upto", F.sum("words").over(upto))
    cut = run.where("upto >= budget").groupBy("source").agg(F.min_by(F.struct("slice", (F.col("upto") - F.col("words")).alias("before")), "slice").alias("_c"))
    cut = settle(cut.select("source", F.col("_c.slice").alias("cut_slice"), F.col("_c.before").alias("before")))

    # Only the documents of the cut slices are ordered; the last one stays where that is nearer.
    inside = on_source(drawn.where("rank IS NOT NULL"), small_side(cut)).where("slice = cut_slice")
    order = Window.partitionBy("source").orderBy("rank", "doc_id")
    until = F.sum("size").over(order) + F.col("before")
    inside = inside.withColumn("upto", until).where("2 * upto - size <= 2 * budget")
    last = inside.groupBy("source").agg(F.max(F.struct("rank", "doc_id")).alias("last"))
    bounds = on_source(cut.select("source", "cut_slice"), last, "left")
    chosen = on_source(drawn, small_side(bounds.select("source", "cut_slice", F.col("last.rank").alias("last_rank"), F.col("last.doc_id").alias("last_id"))), "left")
    # A null id sorts first, here as in the window above.
    not_after = (F.col("rank") < F.col("last_rank")) | (
        (F.col("rank") == F.col("last_rank")) & (F.col("doc_id").isNull() | F.coalesce(F.col("doc_id") <= F.col("last_id"), F.lit(False)))
    )
    taken = F.when(F.col("rank").isNull(), False).when(F.col("cut_slice").isNull(), True)
    taken = taken.when(F.col("slice") != F.col("cut_slice"), F.col("slice") < F.col("cut_slice")).otherwise(F.coalesce(not_after, F.lit(False)))
    copies = F.when(F.col("size") > 0, F.coalesce("whole", F.lit(0)) + taken.cast("bigint")).otherwise(0).cast("bigint")
    result = chosen.withColumn("copies", copies)
    return on_source(result, small_side(targets)).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def repeat_documents(documents: DataFrame, mixed: DataFrame) -> DataFrame:
    """The documents as often as the mix takes them, with their own columns.

    Matched by ``doc_id``: rows that share an id and a size share their number of copies.
    """
    times = mixed.where("copies > 0").groupBy("doc_id").agg(F.max("copies").alias("_copies"))
    names = documents.columns
    joined = documents.alias("d").join(times.alias("m"), F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")))
    repeated = joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    return repeated.select(*[F.col(f"d.`{n}`") for n in names])
