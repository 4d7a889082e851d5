"""Near duplicates by DartMinHash (operator 5).

A document is the weighted set of its runs of five words, a run's weight is how often it
stands there. DartMinHash throws darts: every unit of weight of every run owns a fixed random stream of darts,
each with a rank and one of ``COORDINATES`` coordinates. A document keeps, per coordinate, the dart of
the least rank that falls into its own weight. Two documents agree in a coordinate with the probability of
their weighted Jaccard similarity. Only darts up to a rank bound are thrown, so that about
``k ln k + 2k`` of them land whatever the document's weight; the bound is doubled for a document
with an empty coordinate.

Signatures are cut into bands of ``ROWS`` coordinates; documents that share a band are in one bucket.

* Documents with one text are one entry, so a text with very many copies costs one signature.
* In a bucket all members are held against its leader: the member that shares most bands with others, and
  against its first member. That is linear in the bucket. Exact similarities decide.
* Linked documents form components. Where a bucket still holds several components, members of different ones may be
  linked without the leader. What a member shares with another beyond the leader is bounded exactly by what both
  lack of the leader and what both add to it, so each member carries these two sets as bits, and only pairs whose bits
  allow 0.8 are written out. Random edits of one
  text share almost nothing there, so a large group of copies leaves few pairs; no link between
  different texts is given up, and only members outside the largest component
  of a bucket are held against its others.

The similarity is exact: shared weight over all weight of the runs (as 64-bit hashes of run and occurrence).

Defined cases: a null text counts as empty; texts equal to each other are copies, empty ones too; a text of fewer than five words is one run of
all its words, and one without words is only a copy of others of that kind; a row with a null id takes the class of
its text's other rows, else null; rows that share an id are one document; empty tables give empty results; extra
columns are not read. ``class_id`` is the least id of the class.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plurivote.llm.arrow import kept, slices, text_buffers
from plurivote.llm.words import mix, runs, whole_runs, word_hashes, word_spans
from plurivote.session import settle

SHINGLE = 5
SIMILARITY = 0.8
ROWS, BANDS = 5, 26
COORDINATES = ROWS * BANDS
DARTS = COORDINATES * (math.log(COORDINATES) + 2)
LEAST_LEVEL = -10  # ranks below 2**-9 are one interval
SALT_ROWS = 2_000  # members of a bucket that one group of the second round holds


def _poisson_steps(length: float) -> np.ndarray:
    """Distribution function of the number of darts in an interval, up to a share of 2**-53."""
    p, total, n, out = math.exp(-length), 0.0, 0, []
    while True:
        total += p
        out.append(total)
        n += 1
        p *= length / n
        if n > length and p < 2.0**-54:
            return np.array(out[:-1] or [1.0])


def _uniform(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


class Darts:
    """Signatures of the texts of a slice."""

    def __init__(self):
        self.steps: dict[int, np.ndarray] = {}

    def throw(self, cells: np.ndarray, owner: np.ndarray, level: int, best: np.ndarray) -> None:
        """Darts of the cells with ranks in one dyadic interval; keeps the least per owner and coordinate.

        Interval ``level`` is [2**level, 2**(level + 1)), the lowest one begins at 0.
        """
        low = 0.0 if level == LEAST_LEVEL else 2.0**level
        length = 2.0 ** (level + 1) - low
        # Very long intervals are thrown in parts, so that the chance of no dart stays a number.
        parts = max(1, int(length // 64))
        if level not in self.steps:
            self.steps[level] = _poisson_steps(length / parts)
        for part in range(parts):
            seed = mix(cells ^ mix(np.full(1, (level + 64) * (1 << 32) + part, dtype=np.uint64)))
            number = np.searchsorted(self.steps[level], _uniform(seed), side="right")
            hit = np.flatnonzero(number)
            number = number[hit]
            times = np.repeat(hit, number)
            turn = np.arange(len(times)) - np.repeat(np.cumsum(number) - number, number)
            dart = mix(seed[times] + (turn.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95))
            rank = low + length * (part + _uniform(dart)) / parts
            name = mix(dart ^ np.uint64(0xA0761D6478BD642F))
            place = owner[times] * COORDINATES + (name >> np.uint64(40)).astype(np.int64) % COORDINATES
            # A positive float sorts like its bits; the low 32 bits carry the dart's name.
            order = (rank.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | (name & np.uint64(0xFFFFFFFF))
            np.minimum.at(best, place, order)

    def signatures(self, cells: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
        """(texts, COORDINATES) names of the kept darts; a text without cells has none."""
        nothing = np.iinfo(np.uint64).max
        best = np.full(texts * COORDINATES, nothing, dtype=np.uint64)
        weight = np.bincount(owner, minlength=texts)
        if len(cells):
            with np.errstate(divide="ignore"):
                top = np.ceil(np.log2(DARTS / np.maximum(weight, 1))).astype(np.int64) - 1  # highest interval of each text
            top = np.maximum(top, LEAST_LEVEL)
            own_top = top[owner]
            for level in range(LEAST_LEVEL, int(top.max()) + 1):
                reach = own_top >= level
                self.throw(cells[reach], owner[reach], level, best)
            level_of = top
            while True:
                empty = (best.reshape(texts, COORDINATES) == nothing).any(axis=1) & (weight > 0)
                if not empty.any():
                    break
                level_of = level_of + 1
                for level in np.unique(level_of[empty]):
                    mine = (empty & (level_of == level))[owner]
                    self.throw(cells[mine], owner[mine], int(level), best)
        return (best & np.uint64(0xFFFFFFFF)).astype(np.uint32).reshape(texts, COORDINATES)


def shingle_cells(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One 64-bit cell per unit of weight — run of words and occurrence — with its text; and the words of each text.

    Cells come sorted by text and run.
    """
    data, bounds = text_buffers(column)
    begins, ends, first = word_spans(data, bounds)
    words = word_hashes(data, begins, ends)
    place, owner = whole_runs(first, SHINGLE)
    cells = runs(words, SHINGLE)[place] if len(place) else np.zeros(0, dtype=np.uint64)
    count = np.diff(first)
    few = np.flatnonzero((count > 0) & (count < SHINGLE))
    if len(few):
        # A short text is one run: its words and a mark that no longer run has.
        whole = []
        for t in few:
            h = np.full(1, 0x51ED270B, dtype=np.uint64)
            for w in words[first[t] : first[t + 1]]:
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + w)
            whole.append(h[0])
        cells, owner = np.concatenate([cells, np.array(whole, dtype=np.uint64)]), np.concatenate([owner, few])
    order = np.lexsort((cells, owner))
    cells, owner = cells[order], owner[order]
    if len(cells):
        same = np.zeros(len(cells), dtype=bool)
        same[1:] = (cells[1:] == cells[:-1]) & (owner[1:] == owner[:-1])
        at = np.arange(len(cells))
        occurrence = at - np.maximum.accumulate(np.where(same, 0, at))
        cells = np.where(occurrence > 0, mix(cells + occurrence.astype(np.uint64)), cells)
    return cells, owner, count


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, limit=1 << 20):
        darts = kept("darts", Darts)
        cells, owner, _ = shingle_cells(batch.column("text"))
        names = darts.signatures(cells, owner, batch.num_rows)
        keys = np.zeros((batch.num_rows, BANDS), dtype=np.uint64)
        for row in range(ROWS):
            keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + names[:, row::ROWS])
        weight = np.bincount(owner, minlength=batch.num_rows)
        bands = pa.ListArray.from_arrays(np.arange(0, (batch.num_rows + 1) * BANDS, BANDS, dtype=np.int32), pa.array(keys.ravel().view(np.int64)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("h"), batch.column("h2"), pa.array(weight, pa.int64()), bands],
            names=["doc_id", "h", "h2", "weight", "bands"],
        )


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        cells, owner, _ = shingle_cells(batch.column("text"))
        offsets = np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(cells.view(np.int64)))], names=["id", "cells"]
        )


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Similarity of ``x`` to its leader ``y``, and where it departs from it, as bits.

    ``lacks``: one bit per cell of the leader that x lacks. ``adds``: a bit for each cell x adds, by its hash;
    ``doubled``: how many of these fell on a bit that was taken.
    """

    def words(bits: np.ndarray) -> list[int]:
        return np.packbits(bits, bitorder="little").view(np.int64).tolist()

    for batch in batches:
        xs, ys = (batch.column(n) for n in ("_x", "_y"))
        rows = []
        for i in range(batch.num_rows):
            x, y = (c[i].values.to_numpy(zero_copy_only=False) for c in (xs, ys))
            length = -(-max(len(y), 1) // 64) * 64
            lacks, adds = np.zeros(length, dtype=np.uint8), np.zeros(2 * length, dtype=np.uint8)
            shared = np.isin(y, x, assume_unique=True)
            lacks[: len(y)] = ~shared
            new = x[~np.isin(x, y, assume_unique=True)]
            adds[new.view(np.uint64) % np.uint64(len(adds))] = 1
            both = int(shared.sum())
            alike = both / max(1, len(x) + len(y) - both) >= SIMILARITY
            rows.append((alike, len(x) + len(y) - 2 * both, words(lacks), words(adds), len(new) - int(adds.sum())))
        kinds = (pa.bool_(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32())
        found = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("to"), *found], names=["id", "to", "alike", "apart", "lacks", "adds", "doubled"])


def _both(a: Column, b: Column) -> Column:
    """Bits set in both."""
    return F.aggregate(F.zip_with(a, b, lambda p, q: F.bit_count(p.bitwiseAND(q))), F.lit(0), lambda n, m: n + m)


def similarity(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return shared / (F.size(a) + F.size(b) - shared)


def cells_of(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``id, cells`` of the texts that stand in a pair ``(id, to)``; only these are moved, once."""
    wanted = pairs.select("id").unionByName(pairs.select(F.col("to").alias("id"))).distinct()
    return settle(texts.join(wanted, "id", "left_semi").mapInArrow(_cells, "id bigint, cells array<bigint>"))


def _with_cells(pairs: DataFrame, cells: DataFrame, a: str, b: str) -> DataFrame:
    """The pairs with the cells of both texts, ``_x`` and ``_y``."""
    first, second = (cells.select(F.col("id").alias(n), F.col("cells").alias(c)) for n, c in ((a, "_x"), (b, "_y")))
    return pairs.join(first, a).join(second, b)


def linked(pairs: DataFrame, cells: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` whose texts are similar enough."""
    return _with_cells(pairs, cells, "a", "b").where(similarity(F.col("_x"), F.col("_y")) >= SIMILARITY).select("a", "b")


def _measured(df: DataFrame) -> DataFrame:
    """The table settled, under its measured size.

    A settled join counts as the product of its sides' sizes; over many rounds that number alone would take all the time.
    """
    held = df.persist()
    try:
        held.count()
        return settle(held.select("*"))
    finally:
        held.unpersist()


def _roots(both: DataFrame) -> DataFrame:
    """``id, label``: every id's root, where each id hooks onto its least neighbour.

    Along these hooks every second id never grows, so each way ends in two ids that name each other; the lower one is
    the root. Jumps double how far an id sees until all see their root.
    """
    near = _measured(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("label")))
    back = near.select(F.col("id").alias("label"), F.col("label").alias("_back"))
    root = (F.col("_back") == F.col("id")) & (F.col("id") < F.col("label"))
    hooks = _measured(near.join(back, "label").select("id", F.when(root, F.col("id")).otherwise(F.col("label")).alias("label")))
    while True:
        ahead = hooks.select(F.col("id").alias("label"), F.col("label").alias("_ahead"))
        jumped = _measured(hooks.join(ahead, "label").select("id", F.col("label").alias("_old"), F.col("_ahead").alias("label")))
        hooks = jumped.select("id", "label")
        if jumped.where("label <> _old").isEmpty():
            return hooks


def components(links: DataFrame) -> DataFrame:
    """``id, label``: the least id of the component, for every id that has a link.

    Every round the ids of a tree of hooks become one, and the links are drawn between the roots. Each id with a link hooks onto another,
    so a round leaves at most half of them; the rounds end when no link is left.
    """
    both = _measured(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = _roots(both)
    roots = labels
    while True:
        for end in ("a", "b"):
            both = both.join(roots.select(F.col("id").alias(end), F.col("label").alias("_root")), end).drop(end).withColumnRenamed("_root", end)
        both = _measured(both.where("a <> b").select("a", "b").distinct())
        if both.isEmpty():
            break
        roots = _roots(both)
        up = roots.select(F.col("id").alias("label"), F.col("label").alias("_root"))
        labels = _measured(labels.join(up, "label", "left").select("id", F.coalesce("_root", "label").alias("label")))
    least = labels.groupBy("label").agg(F.min("id").alias("_least"))
    return _measured(labels.join(least, "label").select("id", F.col("_least").alias("label")))


def _sides(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Who is held against whom in a bucket: the members outside its largest label against all, per ``(band, key, _salt)``.

    Of two members with different labels one stands outside the largest. The members are dealt to salts
    of about ``SALT_ROWS`` rows, and every outsider goes to each.
    """
    sizes = members.groupBy("band", "key", "label").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("band", "key").agg(F.max(F.struct("n", "label"))["label"].alias("_largest"), F.ceil(F.sum("n") / SALT_ROWS).cast("int").alias("_salts"))
    placed = members.join(largest, ["band", "key"]).withColumn("outside", F.col("label") != F.col("_largest"))
    outside = placed.where("outside").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)))
    return outside, placed.withColumn("_salt", F.pmod(F.xxhash64("id"), F.col("_salts")).cast("int"))


def _open_pairs(members: DataFrame) -> DataFrame:
    """``a, b``: members of one bucket with different labels whose bits allow a link."""
    x, y = (side.alias(name) for side, name in zip(_sides(members), "xy", strict=True))
    # |x - y| = |x - l| + |y - l| - 2 shared, and 0.8 asks for at most a ninth of both weights.
    shared = _both(F.col("x.lacks"), F.col("y.lacks")) + _both(F.col("x.adds"), F.col("y.adds")) + F.least("x.doubled", "y.doubled")
    apart = F.col("x.apart") + F.col("y.apart") - 2 * shared
    possible = (
        (F.col("x.band") == F.col("y.band"))
        & (F.col("x.key") == F.col("y.key"))
        & (F.col("x._salt") == F.col("y._salt"))
        & (F.col("x.label") != F.col("y.label"))
        & (~F.col("y.outside") | (F.col("x.id") < F.col("y.id")))
        & (5 * F.least("x.weight", "y.weight") >= 4 * F.greatest("x.weight", "y.weight"))
        & (9 * apart <= F.col("x.weight") + F.col("y.weight"))
    )
    return x.join(y, possible).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def near_duplicates(documents: DataFrame) -> DataFrame:
    """``doc_id, class_id``, one row per input row."""
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    hashed = rows.withColumn("h", F.xxhash64("text")).withColumn("h2", F.xxhash64(F.lit(1), "text"))
    signed = settle(
        hashed.mapInArrow(_sign, "doc_id bigint, h bigint, h2 bigint, weight bigint, bands array<bigint>")
    )
    # One entry per text, under its least id.
    entry = signed.groupBy("h", "h2").agg(F.min("doc_id").alias("id"))
    entries = signed.join(entry, ["h", "h2"]).where("doc_id = id AND weight > 0").dropDuplicates(["h", "h2", "id"])
    entries = settle(entries.select("id", "weight", "bands"))
    banded = entries.select("id", F.posexplode("bands").alias("band", "key"))

    sizes = banded.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("least")).where("size > 1")
    members = settle(banded.join(sizes, ["band", "key"]))
    # How many others a document meets over all its bands; the best connected member leads its bucket.
    met = members.groupBy("id").agg(F.sum("size").alias("met"))
    ranked = members.select("band", "key", "id").join(met, "id")
    leaders = ranked.groupBy("band", "key").agg(F.max(F.struct(F.col("met"), (-F.col("id")).alias("_minus"))).alias("_top"))
    leaders = leaders.select("band", "key", (-F.col("_top._minus")).alias("leader"))
    star = members.join(leaders, ["band", "key"])
    to = F.explode(F.array_distinct(F.array("leader", "least"))).alias("to")
    stars = settle(star.select("id", to).where("id <> to").distinct())
    texts = rows.where("doc_id IS NOT NULL").withColumnRenamed("doc_id", "id")
    kinds = "id bigint, to bigint, alike boolean, apart int, lacks array<bigint>, adds array<bigint>, doubled int"
    # Every member of a bucket stands in a star, so these cells serve the second round too.
    cells = cells_of(stars, texts)
    measured = settle(_with_cells(stars, cells, "id", "to").select("id", "to", "_x", "_y").mapInArrow(_measure, kinds))
    links = measured.where("alike").select(F.least("id", "to").alias("a"), F.greatest("id", "to").alias("b")).distinct()

    # Buckets that still hold several components: their members against those of the other components.
    labels = components(links)
    labelled = star.select("band", "key", "id", "leader").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    mixed = labelled.groupBy("band", "key").agg(F.min("label").alias("_low"), F.max("label").alias("_high")).where("_low < _high").select("band", "key")
    open_members = labelled.join(mixed, ["band", "key"]).join(
        measured.select("id", F.col("to").alias("leader"), "apart", "lacks", "adds", "doubled"), ["id", "leader"]
    )
    open_members = settle(open_members.join(entries.select("id", "weight"), "id"))
    others = settle(_open_pairs(open_members))
    if not others.isEmpty():
        labels = components(links.unionByName(linked(others, cells)).distinct())

    classed = entry.join(labels, "id", "left").select("h", "h2", F.coalesce("label", "id").alias("class_id"))
    return signed.select("doc_id", "h", "h2").join(classed, ["h", "h2"]).select("doc_id", "class_id")


def one_of_each(documents: DataFrame) -> DataFrame:
    """The documents that name their class, with all their columns; rows without an id or a class stay."""
    names = documents.columns
    classes = near_duplicates(documents).where("doc_id <> class_id").select(F.col("doc_id").alias("_gone")).distinct()
    return documents.join(classes, documents["doc_id"] == F.col("_gone"), "left_anti").select(*[F.col(f"`{n}`") for n in names])
