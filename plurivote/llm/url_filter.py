"""URL rules and an exact block list as a cascade of Bloom filters (operator 2).

The first level encodes the listed keys. Keys of the corpus that are not listed but pass it
are its false positives; the second level encodes those, the third the listed keys that pass
the second, and so on until a level has no false positive in the corpus. As the levels are
built over the complete set of keys of the corpus, the first level a key fails tells exactly
whether it is listed: an even level means listed, an odd one means not.

The keys are dealt to shards by hash and every shard has its own small cascade, one array of
64-bit words per level. A page looks its shard up and tests bits in place. The number of shards follows the
listed keys and the keys that the first level is expected to let through, whichever are more, so no
level of a shard grows with the corpus. While the cascade is built, the first level is tested on the pages in place, and only the keys that
pass it (the listed ones and one in 16 of the others) are told apart by a join with the list. Everything is DataFrame functions.

The filters are broadcast when their measured size is below ``MAX_BROADCAST_BYTES``. Above it
they are joined by shuffle on (shard, salt), with the pages of a shard spread over all salts,
so a URL on a third of all pages does not meet in one task.

Defined cases: a null URL or one without ``://`` has empty host and path, fits no rule and has
the empty key; null ids, repeated rows and extra columns are kept apart from the result
(one row per input row: ``page_id, host, path, rule, verdict, listed``); an empty list blocks nothing; a null key is never listed;
empty tables give empty results. Of two rules of one length that both fit, the first in code point order holds.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plurivote.session import settle

HASHES = 4  # per level: a false positive rate of 1/16
BITS_PER_KEY = 5.8  # 1.44 x HASHES
KEYS_PER_SHARD = 1 << 14
MAX_BROADCAST_BYTES = 32 << 20
SALTS = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (ASCII lower case) and path."""
    at = F.instr(url, "://")
    after = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(after, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(after, F.length(host) + 1), "^[^?#]*", 0)
    empty = F.lit("")
    return F.coalesce(F.translate(host, UPPER, LOWER), empty), F.coalesce(path, empty)


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Struct ``(rule, action)`` of the longest rule that fits; null if none does."""
    found = F.lit(None).cast("struct<rule:string,action:string>")
    for action, rule in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(action).alias("action"))).otherwise(found)
    return found


def shard_of(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("shard"), key), F.lit(shards)).cast("int")


def _bit(key: Column, level: Column, number: int, bits: Column) -> Column:
    return F.pmod(F.xxhash64(level, F.lit(number), key), bits)


def _has(key: Column, level: Column, bits: Column, words: Column) -> Column:
    """Are all of the key's bits set in this level?"""
    tests = []
    for number in range(HASHES):
        at = _bit(key, level, number, bits)
        word = F.get(words, F.shiftright(at, 6).cast("int"))
        tests.append(F.call_function("shiftright", word, (at % 64).cast("int")).bitwiseAND(F.lit(1)) != 0)
    return reduce(lambda a, b: a & b, tests)


def _level(keys: DataFrame, number: int) -> DataFrame:
    """``shard, level, bits, words`` of one level over ``keys(shard, key)``."""
    sized = keys.groupBy("shard").agg(F.count(F.lit(1)).alias("_n"))
    blocks = F.ceil(F.col("_n") * (BITS_PER_KEY / 64)).cast("bigint")
    sized = sized.select("shard", (blocks * 64).alias("bits"))
    level = F.lit(number)
    at = F.explode(F.array(*[_bit(F.col("key"), level, i, F.col("bits")) for i in range(HASHES)]))
    set_bits = keys.join(sized, "shard").select("shard", "bits", at.alias("_at"))
    words = set_bits.select("shard", "bits", F.shiftright("_at", 6).alias("_w"), F.expr("shiftleft(1L, cast(_at % 64 as int))").alias("_v"))
    empty = sized.select("shard", "bits", F.explode(F.sequence(F.lit(0).cast("bigint"), F.shiftright("bits", 6) - 1)).alias("_w"), F.lit(0).cast("bigint").alias("_v"))
    filled = words.unionByName(empty).groupBy("shard", "bits", "_w").agg(F.bit_or("_v").alias("_v"))
    # A shard's words are as many as its own keys need, some 6 bits a key.
    return filled.groupBy("shard", "bits").agg(F.array_sort(F.collect_list(F.struct("_w", "_v"))).alias("_ws")).select(
        "shard", level.alias("level"), "bits", F.col("_ws._v").alias("words")
    )


def _beside(rows: DataFrame, filters: DataFrame, how: str = "inner") -> DataFrame:
    """The rows, which have ``key`` and ``shard``, each beside its shard's filters."""
    if _small(filters):
        return rows.join(F.broadcast(filters), "shard", how)
    salted = filters.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # By all columns of a row, so that the rows of one key do not meet in one task.
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, ["shard", "_salt"], how).drop("_salt")


def build_cascade(listed: DataFrame, universe: DataFrame, spread: Sequence[str] = ()) -> tuple[DataFrame, int]:
    """Cascades ``shard, levels`` of the listed keys, exact over ``universe``; and the number of shards.

    Both tables have a column ``key``. Keys that are listed but not in the universe do no harm. The universe may hold a key
    in any number of rows; columns named in ``spread`` (an id) deal the rows of one key to many tasks.
    """
    inside = settle(listed.select("key").where(F.col("key").isNotNull()).distinct())
    held = universe.select("key", *spread).where(F.col("key").isNotNull())
    # An estimate is enough: it sizes the shards and decides nothing else.
    keys = held.agg(F.approx_count_distinct("key")).first()[0]
    shards = max(1, math.ceil(max(inside.count(), keys / 2**HASHES) / KEYS_PER_SHARD))
    inside = inside.withColumn("shard", shard_of(F.col("key"), shards))

    def passing(rows: DataFrame, level: DataFrame, number: int) -> DataFrame:
        tested = _beside(rows, level).where(_has(F.col("key"), F.lit(number), F.col("bits"), F.col("words")))
        return tested.select("key", "shard")

    encoded, others = inside, None
    made, number = [], 0
    while True:
        number += 1
        level = settle(_level(encoded, number))
        made.append(level)
        if others is None:
            # The distinct keys are combined before their exchange, so a key in many rows is not one task.
            passed = passing(held.withColumn("shard", shard_of(F.col("key"), shards)), level, number).distinct()
            passed = passed.join(inside.select("key"), "key", "left_anti")
        else:
            passed = passing(others, level, number)
        passed = settle(passed)
        if passed.isEmpty():
            break
        encoded, others = passed, encoded
    stacked = reduce(DataFrame.unionByName, made)
    cascade = stacked.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("level", "bits", "words"))).alias("levels"))
    return settle(cascade), shards


def _small(filters: DataFrame) -> bool:
    size = filters.agg(F.sum(F.size("words") if "words" in filters.columns else F.aggregate("levels", F.lit(0), lambda n, lv: n + F.size(lv["words"])))).first()[0]
    return (size or 0) * 8 <= MAX_BROADCAST_BYTES


def is_listed(key: Column, levels: Column) -> Column:
    """Exact for every key of the universe; a shard without listed keys has null levels."""
    passes = F.transform(levels, lambda lv: _has(key, lv["level"], lv["bits"], lv["words"]))
    first_failed = F.array_position(passes, F.lit(False))
    failed_at = F.when(first_failed == 0, F.size(levels) + 1).otherwise(first_failed)
    # A shard whose false positives ended early has fewer levels than the others; the rule is the same.
    return F.coalesce(failed_at % 2 == 0, F.lit(False))


def filter_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str]], listed: DataFrame, allow: str = "allow", block: str = "block"
) -> DataFrame:
    """Judge every page: by its longest rule, else by the list.

    ``listed`` has one column ``key`` = host + path.
    """
    host, path = url_parts(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    keyed = parts.withColumn("key", F.concat("host", "path"))
    cascade, shards = build_cascade(listed, keyed, spread=["page_id"])
    held = _beside(keyed.withColumn("shard", shard_of(F.col("key"), shards)), cascade, "left")
    judged = held.select(
        "page_id", "host", "path", longest_rule(F.col("host"), F.col("path"), rules).alias("_r"), is_listed(F.col("key"), F.col("levels")).alias("listed")
    )
    verdict = F.coalesce(F.col("_r.action"), F.when(F.col("listed"), block).otherwise(allow))
    return judged.select("page_id", "host", "path", F.col("_r.rule").alias("rule"), verdict.alias("verdict"), "listed")
