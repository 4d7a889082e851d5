"""Edit distance of whole prediction vectors, in tiles that hand on their borders.

The table of two sequences is cut into tiles of ``block`` by ``block`` cells. Inside a tile a column is one number
with a bit per row, and a step of a dozen operations on whole numbers moves it on by one character. A tile
needs the steps up or down along its upper and left border and gives out those along its lower and right border, so the
tiles of one diagonal are worked out side by side, for all pairs of models at once, and a diagonal is one job.
A task holds one tile: two stretches of ``block`` characters and their borders.

What a tile needs is brought together by one grouping and not by joins. A diagonal is made from the one before it, and the planner takes a
join for as large as the product of its sides: joined to itself, that estimate gets twice the digits with every diagonal, until it
fills the driver's memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plurivote.session import settle, small_side

BLOCK = 4096
ITEMS_A_PART = 1 << 16  # ids that are numbered by one task


def tile(down: str, along: str, up: int, lower: int, top: np.ndarray) -> tuple[int, int, np.ndarray]:
    """Borders right and below of the tile of ``down`` (rows) and ``along`` (columns).

    ``up`` and ``lower`` have a bit for every row whose cell on the left border is one more, one less than the cell
    above it; ``top`` is the difference of neighbours along the upper border, per column.
    """
    rows = len(down)
    full, high = (1 << rows) - 1, rows - 1
    match: dict[str, int] = {}
    for i, c in enumerate(down):
        match[c] = match.get(c, 0) | 1 << i
    bottom = np.empty(len(along), dtype=np.int8)
    for j, c in enumerate(along):
        came = int(top[j])
        equal = match.get(c, 0)
        diagonal = equal | lower
        equal |= came < 0
        same = (((equal & up) + up) ^ up) | equal
        more = lower | (full & ~(same | up))
        less = up & same
        bottom[j] = (more >> high & 1) - (less >> high & 1)
        more = (more << 1 & full) | (came > 0)
        less = (less << 1 & full) | (came < 0)
        up = less | (full & ~(diagonal | more))
        lower = more & diagonal
    return up, lower, bottom


def stretches(predictions: DataFrame, block: int = BLOCK) -> DataFrame:
    """Each model's predictions in the order of ``item_id`` as text, one character a class, cut every ``block`` items.

    Items are numbered inside parts of the id range and shifted by the parts before them. Null predictions are left out.
    """
    rows = predictions.where("pred IS NOT NULL").select("model_name", "item_id", F.chr(F.col("pred").cast("bigint") + 48).alias("_c"))
    rows = rows.withColumn("_part", F.floor(F.col("item_id") / ITEMS_A_PART))
    counts = rows.groupBy("model_name", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("model_name").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("model_name", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("model_name", "_part").orderBy("item_id"))
    placed = rows.withColumn("_at", inside).join(offsets, ["model_name", "_part"])
    place = F.col("_before") + F.col("_at") - 1
    numbered = placed.select("model_name", F.floor(place / block).cast("int").alias("stretch"), place.alias("_at"), "_c")
    letters = F.array_sort(F.collect_list(F.struct("_at", "_c")))
    return numbered.groupBy("model_name", "stretch").agg(F.array_join(letters["_c"], "").alias("text"))


_BORDERS = "model_name string, i int, up binary, lower binary, steps binary, edge bigint"
EDGE = -1  # in place of ``i``: the steps down the table's right edge so far


def _run_tiles(batches: Iterator[pa.RecordBatch], last: int) -> Iterator[pa.RecordBatch]:
    """Borders for the next diagonal. The tile of row ``last`` has the table's right edge, whose steps are added up."""
    types = [pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
    names = ["model_name", "i", "up", "lower", "steps", "edge"]
    for batch in batches:
        for r in batch.to_pylist():
            model, i = r["model_name"], r["i"]
            if i == EDGE:
                out = [(model, EDGE, None, None, None, r["edge"])]
            else:
                rows = len(r["down"])
                # At the table's edge every cell is one more than its neighbour.
                up = (1 << rows) - 1 if r["up"] is None else int.from_bytes(r["up"], "little")
                lower = 0 if r["lower"] is None else int.from_bytes(r["lower"], "little")
                top = np.ones(len(r["along"]), dtype=np.int8) if r["steps"] is None else np.frombuffer(r["steps"], dtype=np.int8)
                up, lower, bottom = tile(r["down"], r["along"], up, lower, top)
                size = (rows + 7) // 8
                right = (model, i, up.to_bytes(size, "little"), lower.to_bytes(size, "little"), None, None)
                edge = (model, EDGE, None, None, None, up.bit_count() - lower.bit_count())
                out = [edge if i == last else right, (model, i + 1, None, None, bottom.tobytes(), None)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)


def vector_levenshtein(predictions: DataFrame, against: str, block: int = BLOCK) -> DataFrame:
    """Edits between each model's and one model's whole prediction vector, with both lengths.

    ``predictions`` holds one row per (model_name, item_id). Work is the product of the two lengths, in whole-number
    steps of ``block`` cells; lengths / ``block`` diagonals are one job each. A model without a prediction is left out.
    """
    cut = settle(stretches(predictions, block))
    sizes = cut.groupBy("model_name").agg(F.sum(F.length("text")).alias("n"), (F.max("stretch") + 1).alias("stretches"))
    # One row per model.
    known = settle(sizes)
    base = known.where(F.col("model_name") == against).select(F.col("n").alias("n_against"), F.col("stretches").alias("wide")).first()
    most, tiles = known.where(F.col("model_name") != against).agg(F.max("stretches"), F.sum("stretches")).first()
    others = known.where(F.col("model_name") != against).select("model_name", "n")
    if base is None or most is None:
        return others.select("model_name", "n", F.lit(0).cast("bigint").alias("n_against"), F.col("n").alias("edits"))
    down = cut.where(F.col("model_name") != against).select("model_name", F.col("stretch").alias("i"), F.col("text").alias("down"))
    along = cut.where(F.col("model_name") == against).select(F.col("stretch").alias("j"), F.col("text").alias("along"))
    # The base's stretches once per model.
    along = settle(along.crossJoin(small_side(others.select("model_name"), short=True)))
    tasks = min(4 * predictions.sparkSession.sparkContext.defaultParallelism, tiles)
    borders = predictions.sparkSession.createDataFrame([], _BORDERS)
    for diagonal in range(most + base["wide"] - 1):
        last = diagonal - base["wide"] + 1
        crossing = along.select("model_name", (F.lit(diagonal) - F.col("j")).alias("i"), "along").where(F.col("i").between(0, most - 1))
        pieces = down.where(F.col("i").between(last, diagonal)).unionByName(crossing, allowMissingColumns=True).unionByName(borders, allowMissingColumns=True)
        met = pieces.groupBy("model_name", "i").agg(*[F.max(c).alias(c) for c in ("down", "along", "up", "lower", "steps")], F.sum("edge").alias("edge"))
        ready = met.where((F.col("i") == EDGE) | (F.col("down").isNotNull() & F.col("along").isNotNull()))
        # So many small rows of heavy work: dealt evenly to a fixed number of tasks, which is not merged again.
        borders = settle(ready.repartition(tasks).mapInArrow(partial(_run_tiles, last=last), _BORDERS))
    # The corner: the length along the upper edge, and all steps down the right edge.
    steps = borders.where(F.col("i") == EDGE).groupBy("model_name").agg(F.sum("edge").alias("_steps"))
    return others.join(steps, "model_name").select(
        "model_name", "n", F.lit(base["n_against"]).cast("bigint").alias("n_against"), (F.lit(base["n_against"]) + F.col("_steps")).cast("bigint").alias("edits")
    )
