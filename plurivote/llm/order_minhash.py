"""Order MinHash fingerprints, in DataFrame functions only (operator 9).

The k-mers of a text are its runs of ``K`` pieces of a few code points. A piece ends at white space, so an edit moves the
cuts of its own word only; in scripts without cases every letter is a piece. Each k-mer is numbered by its occurrence in the
text, so a repeated k-mer counts as often as it stands there. A sketch selects the ``TUPLE``
numbered k-mers with the least hash, puts them back into text order and hashes the tuple.
Two texts agree in a sketch where they share these k-mers in the same order, so the share of equal
sketches falls with their edit distance, not only with the k-mers they share.

The hash functions of the sketches are ``h(x) xor seed(j)``, where the seeds differ in their
leading bits. The least values of sketch j are then the numbered k-mers whose own hash lies nearest to
seed(j): those of its slice of the hash range first, then those of the next slice in xor order.
So one hash per k-mer serves all sketches.

Occurrence numbers come from one sorted array of (hash, place): equal hashes stand side by
side, and the place of the first in its run is found by doubling steps, as many as the longest possible run needs.
A text of n pieces takes n log n steps, whatever repeats in it.

Defined cases: a null text counts as empty; a text of fewer than ``K`` pieces has one k-mer of all
its pieces, and one of white space alone a fingerprint of its own kind, equal only to that of other
such texts; where a text has fewer k-mers than a tuple, the tuple is shorter. Equal texts
have equal fingerprints. Null ids come last in the order of documents; rows with one id stand in
the order of their texts; a table of one row is its own next document; empty tables give empty results.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 2
# A piece: a letter of a script without cases (such scripts often write no blanks), or up to five code points of anything else.
PIECE = r"\p{Lo}|[^\x20\x09-\x0D\p{Lo}]{1,5}"
SKETCHES = 32  # a power of two
TUPLE = 2
# A packed k-mer: 37 leading bits of its hash, then 26 bits of its place.
PLACE_BITS = 26
SLICE_SHIFT = 63 - 5  # the leading 5 of 63 bits name one of 32 slices


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once."""
    return F.get(F.transform(F.array(value), body), 0)


def _pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))


def _kmer_hashes(pieces: Column) -> Column:
    """63-bit hashes of the k-mers in text order; one for a text shorter than a k-mer."""
    count = F.greatest(F.size(pieces) - (K - 1), F.lit(1))

    def kmer(i: Column) -> Column:
        return F.shiftrightunsigned(F.xxhash64(*[F.get(pieces, i + j) for j in range(K)]), 1)

    return F.when(F.size(pieces) > 0, F.transform(F.sequence(F.lit(0), count - 1), kmer)).otherwise(F.array().cast("array<bigint>"))


def _same_kmer(ordered: Column, x: Column, i: Column) -> Column:
    """Is the entry before ``x`` of the same k-mer?"""
    return F.coalesce(F.shiftright(F.get(ordered, i - 1), PLACE_BITS) == F.shiftright(x, PLACE_BITS), F.lit(False))


def _numbered(hashes: Column) -> Column:
    """Packed (hash of k-mer and occurrence, place), in order. First occurrences keep the k-mer's own hash."""
    low = (1 << PLACE_BITS) - 1

    def pack(h: Column, place: Column) -> Column:
        return h.bitwiseAND(F.lit((1 << 63) - 1 - low)).bitwiseOR(place.cast("bigint"))

    def renumbered(ordered: Column, repeats: Column) -> Column:
        # Each step doubles how far an entry sees back to the start of its run.
        steps = F.ceil(F.log2(repeats.cast("double") + 1)).cast("int")
        before = F.transform(ordered, lambda x, i: F.when(_same_kmer(ordered, x, i), i - 1).otherwise(i))
        starts = F.aggregate(F.sequence(F.lit(1), steps), before, lambda far, _: F.transform(far, lambda i: F.get(far, i)))

        def renumber(x: Column, occurrence: Column) -> Column:
            again = F.shiftrightunsigned(F.xxhash64(F.shiftright(x, PLACE_BITS), occurrence), 1)
            return F.when(occurrence == 0, x).otherwise(pack(again, x.bitwiseAND(F.lit(low))))

        return F.sort_array(_let(starts, lambda start: F.transform(ordered, lambda x, i: _let(i - F.get(start, i), lambda n: renumber(x, n)))))

    def number(ordered: Column) -> Column:
        repeats = F.size(F.filter(ordered, lambda x, i: _same_kmer(ordered, x, i)))
        return _let(repeats, lambda n: F.when(n == 0, ordered).otherwise(renumbered(ordered, n)))

    return _let(F.sort_array(F.transform(hashes, pack)), number)


def _sketches(ordered: Column) -> Column:
    """The tuple hash of every sketch, from the numbered k-mers in order.

    Only the first entries of each slice can be chosen: they are the least of their own
    sketch, and where another slice has too few, also the least that slice lends.
    """

    def leading(x: Column, i: Column, packed: Column) -> Column:
        ahead = F.get(packed, i - TUPLE)
        return F.coalesce(F.shiftright(ahead, SLICE_SHIFT) != F.shiftright(x, SLICE_SHIFT), F.lit(True))

    def sketch(first: Column, j: Column) -> Column:
        seed = F.call_function("shiftleft", j.cast("bigint"), F.lit(SLICE_SHIFT))

        def lent() -> Column:
            near = F.sort_array(F.transform(first, lambda x: x.bitwiseXOR(seed)))
            return F.transform(F.slice(near, 1, TUPLE), lambda x: x.bitwiseXOR(seed))

        own = F.filter(first, lambda x: F.shiftright(x, SLICE_SHIFT) == j)
        picked = _let(own, lambda found: F.when(F.size(found) >= TUPLE, found).otherwise(lent()))
        by_place = F.sort_array(
            F.transform(picked, lambda x: F.struct(x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).alias("place"), F.shiftright(x, PLACE_BITS).alias("kmer")))
        )
        return F.substring(F.lpad(F.hex(F.xxhash64(F.transform(by_place, lambda p: p["kmer"]))), 16, "0"), 9, 8)

    first = _let(ordered, lambda packed: F.filter(packed, lambda x, i: leading(x, i, packed)))
    return _let(first, lambda entries: F.transform(F.sequence(F.lit(0), F.lit(SKETCHES - 1)), lambda j: sketch(entries, j)))


def fingerprint(text: Column) -> Column:
    """``SKETCHES`` sketches of 32 bits as one hex string."""
    pieces = _pieces(F.coalesce(text, F.lit("")))
    return F.array_join(_sketches(_numbered(_let(pieces, _kmer_hashes))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal sketches."""
    equal = F.filter(F.sequence(F.lit(0), F.lit(SKETCHES - 1)), lambda j: F.substr(a, j * 8 + 1, F.lit(8)) == F.substr(b, j * 8 + 1, F.lit(8)))
    return F.size(equal) / F.lit(float(SKETCHES))


def _table(values: list[int | None]) -> Column:
    """A constant array, however long, as one literal."""
    return F.from_json(F.lit(json.dumps(values)), "array<bigint>")


def _cuts_up_to(value: Column, cuts: list[int]) -> Column:
    """How many of the ascending ``cuts`` are not above ``value``: whole blocks first, then inside one block."""
    if not cuts:
        return F.lit(0)
    block = max(1, round(len(cuts) ** 0.5))
    blocks = F.size(F.filter(_table(cuts[block - 1 :: block]), lambda c: c <= value))
    inside = F.slice(_table(cuts), blocks * block + 1, F.lit(block))
    return blocks * block + F.size(F.filter(inside, lambda c: c <= value))


def in_order(documents: DataFrame) -> DataFrame:
    """The documents dealt to ranges of ascending ``doc_id``: ``part, guard, doc_id, text``.

    The ids are cut into ranges of about equal number. Every range also gets, as ``guard``, a
    copy of the first document of the next range (the last range that of the first), so a
    document and its follower always stand in one range. One shuffle.
    """
    spark = documents.sparkSession
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / parts for i in range(1, parts)] or [0.5]
    found = rows.agg(F.percentile_approx("doc_id", shares, 10_000).alias("cuts")).first()["cuts"] or []
    cuts = sorted(set(found))
    # A null id stands behind all others.
    number = F.when(F.col("doc_id").isNull(), F.lit(parts)).otherwise(_cuts_up_to(F.col("doc_id"), cuts))
    ranged = rows.withColumn("part", number)
    # One row per range, and no more ranges than partitions.
    firsts = sorted(tuple(r) for r in ranged.groupBy("part").agg(F.min("doc_id").alias("doc_id")).collect())
    first, before = [None] * (parts + 1), [None] * (parts + 1)
    for i, (part, doc_id) in enumerate(firsts):
        first[part], before[part] = doc_id, firsts[i - 1][0]
    here = F.col("doc_id").eqNullSafe(F.get(_table(first), F.col("part")))
    guard = F.when(here, F.get(_table(before), F.col("part")).cast("int"))
    own = F.struct(F.col("part").alias("part"), F.lit(False).alias("guard"))
    lent = F.struct(F.col("_lent").alias("part"), F.lit(True).alias("guard"))
    places = F.when(F.col("_lent").isNull(), F.array(own)).otherwise(F.array(own, lent))
    dealt = ranged.withColumn("_lent", guard).withColumn("_place", F.explode(places))
    return dealt.select("_place.part", "_place.guard", "doc_id", "text").repartitionByRange(parts, "part")


def follower(column: str) -> Column:
    """The column's value in the next document of ``in_order``."""
    order = Window.partitionBy("part").orderBy("guard", F.col("doc_id").asc_nulls_last(), "text")
    return F.lead(column).over(order)


def edited(text: Column, next_text: Column) -> Column:
    """The last quarter replaced by the beginning of the next text, code points of the same number or all there are."""
    quarter = F.floor(F.length(text) / 4).cast("int")
    return F.concat(F.substr(text, F.lit(1), F.length(text) - quarter), F.substr(next_text, F.lit(1), quarter))


def fingerprints(documents: DataFrame) -> DataFrame:
    """``doc_id, text, fingerprint`` of every document and of the one after it (``next_text``, ``next_fingerprint``)."""
    marked = in_order(documents).withColumn("fingerprint", fingerprint(F.col("text")))
    paired = marked.withColumn("next_text", follower("text")).withColumn("next_fingerprint", follower("fingerprint"))
    return paired.where(~F.col("guard")).drop("part", "guard")
