"""A join that stays even where one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARE = 10_000  # a key with more than 1/SHARE of the rows is hot, so there are fewer than SHARE hot keys
SALTS = 64


def join_unique(rows: DataFrame, side: DataFrame, key: str) -> DataFrame:
    """Left join of many ``rows`` to a ``side`` that has ``key`` once.

    Rows are counted by key (combined before the exchange). The rows of a hot key are dealt to ``SALTS`` parts and its
    entry stands in each of them; fewer than ``SHARE`` keys can be hot, and that proven bound allows their names to
    be broadcast. A null key meets nothing.
    """
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col(key).isNotNull())
    total = rows.agg(F.count(F.lit(1)).alias("_all"))
    hot = F.broadcast(counts.join(F.broadcast(total), F.col("_n") * SHARE > F.greatest("_all", F.lit(SHARE * 1000))).select(key, F.lit(True).alias("_hot")))
    others = [c for c in rows.columns if c != key]
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*others) if others else F.lit(0), F.lit(SALTS)).cast("int")).otherwise(0)
    dealt = rows.join(hot, key, "left").withColumn("_salt", salt).drop("_hot")
    places = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    spread = side.join(hot, key, "left").withColumn("_salt", F.explode(places)).drop("_hot")
    return dealt.join(spread, [key, "_salt"], "left").drop("_salt")
