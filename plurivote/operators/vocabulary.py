"""A vocabulary with one id per word, by frequency.

Ids are dense: 0 for the most frequent word, equal counts by the word's bytes. Words are counted with a combine before the
shuffle; the counts are sorted in range parts, and a part's words are numbered from its offset, so neither the
vocabulary nor its order ever stands in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plurivote.functions import text as T
from plurivote.operators.encode import marked, mask_of
from plurivote.session import MAX_BROADCAST_ROWS, settle, small_side


def word_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """How often each word stands in all texts."""
    return texts.select(F.explode(T.words(F.col(text))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("count"))


def vocabulary(texts: DataFrame, text: str = "text") -> DataFrame:
    """``word, count, word_id`` of every word."""
    ordered = word_counts(texts, text).orderBy(F.desc("count"), "word").withColumn("_place", F.monotonically_increasing_id())
    ordered = settle(ordered)
    part = F.shiftright("_place", 33)
    parts = ordered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))  # one row per part
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = small_side(parts.select("_part", before.alias("_before")), short=True)
    word_id = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before")
    return ordered.withColumn("_part", part).join(offsets, "_part").select("word", "count", word_id.alias("word_id"))


def word_ids(texts: DataFrame, words: DataFrame, text: str = "text", keep: Sequence[str] = ("item_id",), frequent: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """``keep`` and ``ids``: the ids of each text's words in their order; an empty list where there are none.

    The first ``frequent`` words are broadcast: their number is the bound. All others are too rare to be a hot key and are
    joined by a shuffle. A word that ``words`` lacks has a null id. ``keep`` tells the texts apart.
    """
    placed = texts.select(*keep, F.posexplode_outer(T.words(F.col(text))).alias("_at", "word"))
    top = small_side(words.where(F.col("word_id") < frequent).select("word", "word_id"), frequent)
    found = placed.join(top, "word", "left")
    rest = words.where(F.col("word_id") >= frequent).select("word", F.col("word_id").alias("_rare"))
    known = found.where("word_id IS NOT NULL OR word IS NULL").withColumn("_rare", F.lit(None).cast("bigint"))
    rare = found.where("word_id IS NULL AND word IS NOT NULL").join(rest, "word", "left")
    each = known.unionByName(rare).select(*keep, "_at", F.coalesce("word_id", "_rare").alias("_id"))
    in_order = F.array_sort(F.collect_list(F.when(F.col("_at").isNotNull(), F.struct("_at", "_id"))))
    return each.groupBy(*keep).agg(in_order.alias("_ids")).select(*keep, F.col("_ids._id").alias("ids"))


def encode(texts: DataFrame, words: DataFrame, max_length: int | None = 256, text: str = "text", keep: Sequence[str] = ("item_id", "label")) -> DataFrame:
    """Begin mark, ids, end mark, cut to ``max_length`` in all, with mask. Ids start behind those of the marks."""
    ids = word_ids(texts, words, text, keep)
    encoded = ids.select(*keep, marked(F.transform("ids", shifted).cast("array<bigint>"), max_length).alias("input_ids"))
    return encoded.withColumn("attention_mask", mask_of(F.col("input_ids")))


FIRST_WORD = 50_260  # the marks' ids lie below


def shifted(word_id: Column) -> Column:
    return word_id + FIRST_WORD
