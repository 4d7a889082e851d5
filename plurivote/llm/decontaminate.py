"""Benchmark decontamination by pigeonhole edit matching (operator 8).

A benchmark item of n characters may appear in a document with up to ``k = rate x n`` edits.
The item is cut in k + 1 pieces: k edits cannot touch all of them, so every such passage
holds one piece unchanged. All pieces go into one Aho-Corasick automaton; a hit says
where the item would lie, and Myers' bit-parallel distance decides on that window (windows of
one item that overlap are merged and read once).

Texts are compared in lower case with runs of white space as one blank.

The items are a stated query set. They are taken in blocks of bounded size, each
broadcast as its own automaton's pieces and run against all documents.

Defined cases: null and empty documents and items match nothing; an item shorter than
``min_chars`` characters is searched for unchanged and as whole words, wherever it stands, and its matches say so in
``short`` (letters of scripts without cases need no word boundary); repeated rows match each for itself; null ids
are carried along; empty tables give no matches; extra columns are left alone.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plurivote.llm.arrow import ddl, slices

BLOCK_BYTES = 4 << 20  # item texts of a block
ERROR_RATE = 0.05
MIN_CHARS = 30


def plain(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """``budget + 1`` pieces of nearly equal length with their place in the item."""
    cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def character_masks(item: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | (1 << i)
    return masks


def nearest(masks: dict[str, int], n: int, text: str, budget: int) -> tuple[int, int] | None:
    """Least edit distance of the item to any part of ``text`` and where that part ends.

    One step of whole-column bit vectors per character; null above the budget.
    """
    all_rows, last_row = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score = all_rows, 0, n
    best, best_end = budget + 1, -1
    get = masks.get
    for end, c in enumerate(text, 1):
        match = get(c, 0)
        diagonal = (((match & plus) + plus) ^ plus) | match | minus
        down_plus = minus | (all_rows & ~(diagonal | plus))
        down_minus = plus & diagonal
        if down_plus & last_row:
            score += 1
        elif down_minus & last_row:
            score -= 1
        down_plus <<= 1
        down_minus <<= 1
        plus = (down_minus | ~(match | minus | down_plus)) & all_rows
        minus = down_plus & (match | minus) & all_rows
        if score < best:
            best, best_end = score, end
            if best == 0:
                break
    return (best, best_end) if best <= budget else None


def _joined(a: str, b: str) -> bool:
    """Do two neighbouring characters belong to one word?"""
    return a.isalnum() and b.isalnum() and "Lo" not in (unicodedata.category(a), unicodedata.category(b))


def whole_words(text: str, start: int, stop: int) -> bool:
    """Is ``text[start:stop]`` cut out at word boundaries?"""
    return not (start and _joined(text[start - 1], text[start])) and not (stop < len(text) and _joined(text[stop - 1], text[stop]))


class Items:
    """A block of items, ready to be searched for."""

    def __init__(self, rows: list[tuple[int | None, str]], rate: float, min_chars: int):
        import ahocorasick

        self.long, self.short = [], []
        at_piece: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in rows:
            item = plain(text)
            if not item:
                continue
            if len(item) < min_chars:
                # Short items are numbered from -1 downwards.
                self.short.append((item_id, item))
                at_piece.setdefault(item, []).append((-len(self.short), 0))
                continue
            budget = math.floor(rate * len(item))
            for place, piece in pieces(item, budget):
                at_piece.setdefault(piece, []).append((len(self.long), place))
            self.long.append((item_id, item, budget, character_masks(item)))
        self.automaton = ahocorasick.Automaton()
        for piece, where in at_piece.items():
            self.automaton.add_word(piece, (len(piece), where))
        if at_piece:
            self.automaton.make_automaton()

    def matches(self, text: str) -> Iterator[tuple[int | None, int, int, bool]]:
        """``(item id, distance, end, short)`` of every item the text holds; the nearest place of each, the first of equals."""
        if not self.long and not self.short:
            return
        begins: dict[int, set[int]] = {}
        ends: dict[int, int] = {}
        for end, (length, where) in self.automaton.iter(text):
            for number, place in where:
                if number >= 0:
                    begins.setdefault(number, set()).add(end + 1 - length - place)
                elif number not in ends and whole_words(text, end + 1 - length, end + 1):
                    ends[number] = end + 1
        for number in sorted(ends, reverse=True):
            yield self.short[-number - 1][0], 0, ends[number], True
        for number in sorted(begins):
            item_id, item, budget, masks = self.long[number]
            best = None
            for low, high in self._windows(sorted(begins[number]), len(item), budget):
                low = max(low, 0)
                found = nearest(masks, len(item), text[low:high], budget if best is None else best[0] - 1)
                if found:
                    best = (found[0], low + found[1])
                    if best[0] == 0:
                        break
            if best:
                yield item_id, *best, False

    @staticmethod
    def _windows(begins: list[int], length: int, budget: int) -> Iterator[tuple[int, int]]:
        low = high = None
        for begin in begins:
            if high is not None and begin - budget <= high:
                high = begin + length + budget
                continue
            if high is not None:
                yield low, high
            low, high = begin - budget, begin + length + budget
        yield low, high


def _searcher(shipped, rate: float, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(shipped.value, rate, min_chars)
        for batch in slices(batches):
            rows, ids, distances, ends, shorts = [], [], [], [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                for item_id, distance, end, short in items.matches(plain(text)):
                    rows.append(row)
                    ids.append(item_id)
                    distances.append(distance)
                    ends.append(end)
                    shorts.append(short)
            kept = [n for n in batch.schema.names if n != "text"]
            picked = [batch.column(n).take(pa.array(rows, pa.int32())) for n in kept]
            found = [pa.array(ids, pa.int64()), pa.array(distances, pa.int32()), pa.array(ends, pa.int64()), pa.array(shorts, pa.bool_())]
            yield pa.RecordBatch.from_arrays(picked + found, names=[*kept, "item_id", "distance", "end", "short"])

    return run


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    """The items in blocks of about ``BLOCK_BYTES``, each small enough to be broadcast."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text")).alias("s")).first()["s"] or 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    numbered = items.withColumn("_block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    for block in range(blocks):
        yield [(r["item_id"], r["text"]) for r in numbered.where(F.col("_block") == block).orderBy("item_id", "text").collect()]


def contaminated(documents: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc_id, item_id, distance, end, short``: one row for each document and item it holds.

    ``end`` is where the nearest passage ends, in characters of the plain text.
    """
    context, rows = documents.sparkSession.sparkContext, documents.select("doc_id", "text")
    kinds = ddl(rows, "doc_id") + ", item_id bigint, distance int, end bigint, short boolean"
    return reduce(
        DataFrame.unionByName, [rows.mapInArrow(_searcher(context.broadcast(block), rate, min_chars), kinds) for block in _blocks(benchmark)]
    )


def _flagger(shipped, rate: float, min_chars: int):
    @F.arrow_udf("boolean")
    def flag(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        items = Items(shipped.value, rate, min_chars)
        for column in columns:
            yield pa.array([next(items.matches(plain(text)), None) is not None for text in column.to_pylist()], pa.bool_())

    return flag


def flagged(documents: DataFrame, benchmark: DataFrame, into: str = "leak", rate: float = ERROR_RATE, min_chars: int = MIN_CHARS) -> DataFrame:
    """The documents with a boolean column: does the text hold an item? All other columns stay."""
    context = documents.sparkSession.sparkContext
    flags = [_flagger(context.broadcast(block), rate, min_chars)(F.col("text")) for block in _blocks(benchmark)]
    return documents.withColumn(into, reduce(lambda a, b: a | b, flags))
