"""Token ids, multiple-choice pairs, batches and padding, as column expressions.

The ids are of words: a word's id is a hash of its letters, so no vocabulary is collected or
shipped. Marks, truncation, pair fitting and masks are the same for any other array of ids.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plurivote.functions import text as T
from plurivote.functions.keys import hash32
from plurivote.operators.projection import label_column
from plurivote.operators.sampling import shuffle_order

# Ids of the marks around a sequence, next to a 50,257-entry vocabulary.
BEGIN_ID, PAD_ID, END_ID = 50257, 50258, 50259
WORD_IDS = 50_257


def word_ids(text: Column) -> Column:
    """One id per word; a null text has none."""
    words = F.coalesce(T.words(text), F.array().cast("array<string>"))
    return F.transform(words, lambda w: (hash32("word", w) % WORD_IDS).cast("int"))


def mask_of(ids: Column) -> Column:
    """1 for every id."""
    return F.array_repeat(F.lit(1), F.size(ids))


def marked(ids: Column, max_length: int | None = None) -> Column:
    """Begin mark, ids, end mark — cut to ``max_length`` in all."""
    body = ids if max_length is None else F.slice(ids, 1, max(0, max_length - 2))
    return F.concat(F.array(F.lit(BEGIN_ID)), body, F.array(F.lit(END_ID)))


def token_encode(df: DataFrame, max_length: int | None = 256, text: str = "text", keep: Sequence[str] = ("item_id", "label")) -> DataFrame:
    """Begin mark, word ids, end mark — cut to ``max_length`` in all — with mask."""
    encoded = df.select(*keep, marked(word_ids(F.col(text)), max_length).alias("input_ids"))
    return encoded.withColumn("attention_mask", mask_of(F.col("input_ids")))


def token_lengths(df: DataFrame, text: str = "text", keep: Sequence[str] = ("item_id",)) -> DataFrame:
    """Ids per text with both marks, uncut. Words are counted, ids are not made."""
    return df.select(*keep, (T.word_count(F.col(text)) + 2).alias("n_tokens"))


def token_length_profile(lengths: DataFrame, limits: Sequence[int] = (256, 512), by: Sequence[str] = ()) -> DataFrame:
    """Texts, longest and mean length, and the rows a limit would cut."""
    return lengths.groupBy(*by).agg(
        F.count(F.lit(1)).alias("texts"),
        F.max("n_tokens").alias("max_tokens"),
        F.avg("n_tokens").alias("mean_tokens"),
        *[F.count(F.when(F.col("n_tokens") > m, 1)).alias(f"over_{m}") for m in limits],
    )


def multiple_choice_pairs(df: DataFrame) -> DataFrame:
    """Pairs of context and option from either schema, as arrays inside the row.

    ``ctx_a, ctx_b, endings`` (or ``ending0…3``): the option is ``ctx_b`` and the ending.
    ``context, question, answer0…3``: the question follows the context.
    """
    names = set(df.columns)
    if "endings" in names or "ending0" in names:
        endings = F.col("endings") if "endings" in names else F.array(*[F.col(f"ending{i}") for i in range(4)])
        options = F.transform(endings, lambda e: F.concat(F.col("ctx_b"), F.lit(" "), e))
        parts = [F.col("ctx_a").alias("context"), F.lit(None).cast("string").alias("question")]
    elif "answer0" in names:
        options = F.array(*[F.col(f"answer{i}") for i in range(4)])
        parts = [F.col("context"), F.col("question")]
    else:
        raise ValueError("no ending0…3, endings or answer0…3 columns")
    return df.select("item_id", *parts, options.alias("options"), F.col("label"))


SEPARATOR = "</s></s>"  # fixed value: the text form of the two marks between context and question


def joined_context(context: Column, question: Column) -> Column:
    """Context, or context and question with the separator between them."""
    return F.when(question.isNull(), context).otherwise(F.concat(context, F.lit(SEPARATOR), question))


def fit_pair(first: Column, second: Column, room: int) -> tuple[Column, Column]:
    """Lengths after dropping ids one at a time from the longer part (the second on ties)."""
    half = F.lit((room + 1) // 2)
    keep = F.when(first + second <= room, first).otherwise(F.least(first, F.greatest(half, F.lit(room) - second)))
    return keep, F.least(second, F.lit(room) - keep)


def multiple_choice_encode(pairs: DataFrame, max_length: int = 256) -> DataFrame:
    """One id list per option: begin, context, end, end, option, end. No shuffle: the
    options of a question stay in its row, and its context is encoded once for all."""
    between = F.array(F.lit(END_ID), F.lit(END_ID))
    asked = F.when(F.col("question").isNull(), F.array().cast("array<int>")).otherwise(F.concat(between, word_ids(F.col("question"))))
    heads = pairs.select(
        "item_id", "label", F.concat(word_ids(F.col("context")), asked).alias("_head"), F.transform("options", word_ids).alias("_tails")
    )

    def encoded(tail: Column) -> Column:
        head = F.col("_head")
        a, b = fit_pair(F.size(head), F.size(tail), max_length - 4)
        return F.concat(F.array(F.lit(BEGIN_ID)), F.slice(head, F.lit(1), a), between, F.slice(tail, F.lit(1), b), F.array(F.lit(END_ID)))

    rows = heads.select("item_id", "label", F.transform("_tails", encoded).alias("input_ids"))
    return rows.withColumn("attention_mask", F.transform("input_ids", mask_of))


def make_batches(df: DataFrame, id_col: str, size: int = 16, seed=1) -> DataFrame:
    """Shuffle and cut into batches of ``size``; the last one may be short."""
    placed = shuffle_order(df, id_col, seed, name="_place")
    return placed.withColumn("batch_id", F.floor(F.col("_place") / size).cast("bigint")).drop("_place")


def _padded(ids: Column, longest: Column, value: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(value), (longest - F.size(ids)).cast("int")))


def pad_batches(df: DataFrame, batch: str = "batch_id", ids: str = "input_ids", pad_id: int = PAD_ID) -> DataFrame:
    """Pad every row to the longest row of its batch; both id shapes."""
    nested = dict(df.dtypes)[ids].startswith("array<array")
    size = F.array_max(F.transform(ids, F.size)) if nested else F.size(ids)
    rows = df.withColumn("padded_length", F.max(size).over(Window.partitionBy(batch)))
    longest = F.col("padded_length")
    if nested:
        mask = F.transform(ids, lambda x: _padded(mask_of(x), longest, 0))
        padded = F.transform(ids, lambda x: _padded(x, longest, pad_id))
    else:
        mask, padded = _padded(mask_of(F.col(ids)), longest, 0), _padded(F.col(ids), longest, pad_id)
    return rows.withColumn("attention_mask", mask).withColumn(ids, padded)


def padding_waste(df: DataFrame, length: Column, max_length: int, batch: str = "batch_id") -> DataFrame:
    """Cells per batch: used, padded to the batch's longest row, padded to ``max_length``."""
    cut = F.least(length, F.lit(max_length))
    return df.groupBy(batch).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(cut).cast("bigint").alias("used_cells"),
        (F.max(cut) * F.count(F.lit(1))).cast("bigint").alias("batch_cells"),
        (F.lit(max_length) * F.count(F.lit(1))).cast("bigint").alias("fixed_cells"),
    )


def collect_batches(df: DataFrame, batch: str = "batch_id", id_col: str = "item_id") -> DataFrame:
    """One row per batch: ids, masks and labels (from ``label`` or ``labels``) as matrices. A batch has a fixed few rows."""
    row = F.struct(F.col(id_col).alias("item"), "input_ids", "attention_mask", F.col(label_column(df)).cast("bigint").alias("label"))
    rows = F.array_sort(F.collect_list(row))
    return df.groupBy(batch).agg(rows.alias("_rows")).select(
        batch, *[F.col(f"_rows.{n}").alias(n) for n in ("input_ids", "attention_mask", "label")]
    )
