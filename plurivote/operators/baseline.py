"""F1 of random guessing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plurivote.functions import scores as S
from plurivote.functions.keys import hash32

GUESS_BITS = 32  # guesses taken from one hash


def random_guess_trials(truth: DataFrame, trials: int, seed=1, item: str = "item_id", label: str = "label") -> DataFrame:
    """F1 and accuracy of ``trials`` uniform 0/1 guessers, one row per trial.

    One hash per item and block of 32 trials gives 32 guesses, and the guesses are
    summed per block as 64 counters, so an item makes trials / 32 short rows and only
    one row per block and task is shuffled.
    """
    blocks = (trials + GUESS_BITS - 1) // GUESS_BITS
    guesses = truth.select(
        F.col(label).alias("_label"),
        F.col(item).alias("_item"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"),
    ).select("_label", "_block", hash32(seed, "_block", "_item").alias("_word"))
    bit = [F.getbit(F.col("_word"), F.lit(b)).cast("bigint") for b in range(GUESS_BITS)]
    sums = guesses.groupBy("_block").agg(
        F.count(F.lit(1)).alias("_n"),
        F.count(F.when(F.col("_label") == 1, 1)).alias("_positives"),
        *[F.sum(bit[b]).alias(f"_guessed_{b}") for b in range(GUESS_BITS)],
        *[F.sum(F.when(F.col("_label") == 1, bit[b]).otherwise(0)).alias(f"_tp_{b}") for b in range(GUESS_BITS)],
    )
    per_trial = sums.select(
        "_block",
        "_n",
        "_positives",
        F.posexplode(
            F.array(*[F.struct(F.col(f"_guessed_{b}").alias("guessed"), F.col(f"_tp_{b}").alias("tp")) for b in range(GUESS_BITS)])
        ).alias("_bit", "_s"),
    ).select(
        (F.col("_block") * GUESS_BITS + F.col("_bit")).cast("bigint").alias("trial"),
        F.col("_n").alias("n"),
        F.col("_s.tp").alias("tp"),
        (F.col("_s.guessed") - F.col("_s.tp")).alias("fp"),
        (F.col("_positives") - F.col("_s.tp")).alias("fn"),
    )
    tp, fp, fn, n = F.col("tp"), F.col("fp"), F.col("fn"), F.col("n")
    return per_trial.where(F.col("trial") < trials).select(
        "trial", "n", S.f1(tp, fp, fn).alias("f1"), S.ratio_or_zero(n - fp - fn, n).alias("accuracy")
    )


def random_f1_baseline(truth: DataFrame, trials: int = 5000, seed=1, item: str = "item_id", label: str = "label") -> DataFrame:
    """Mean F1 and accuracy over the trials."""
    return random_guess_trials(truth, trials, seed, item, label).agg(
        F.count(F.lit(1)).alias("trials"), F.avg("f1").alias("mean_f1"), F.avg("accuracy").alias("mean_accuracy")
    )


def random_f1_closed_form(truth: DataFrame, label: str = "label") -> DataFrame:
    """What the mean tends to: prevalence / (prevalence + 1/2), and 1/2 for accuracy."""
    share = F.count(F.when(F.col(label) == 1, 1)) / F.count(F.lit(1))
    return truth.agg(share.alias("prevalence")).select(
        "prevalence", (F.col("prevalence") / (F.col("prevalence") + 0.5)).alias("expected_f1"), F.lit(0.5).alias("expected_accuracy")
    )
