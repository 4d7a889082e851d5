"""Product codes of integer vectors, with the nearest entries found by LAESA.

Every component becomes ``floor(256 * x)``; a vector is cut into equal parts, and each part position has its own
codebook, which starts as that part of the vectors with the smallest ids. A round assigns every part to its nearest
entry and replaces the entry by the floored mean of its parts.

A few entries of the first codebooks are pivots. The squared distance of every part to its pivots is worked out
once and stored beside the vector; a round measures pivots against entries only. By the triangle inequality the
difference of the two is a lower bound of the distance of part and entry. Entries are tried in the order of
their bounds, exactly and in integers, until the bound passes the best distance; ties go to the lower index.

A round moves one row per part position, entry and task (count and sums), combined over all tasks; the driver holds
codebooks only, whose size is a parameter. Tasks hold one slice of rows.

Defined cases: a vector that is null or holds a null or a non-finite component is dropped; ids may repeat and may be
null (null ids are the last, rows of one id are taken by their components); with fewer vectors than entries the
codebooks are shorter; a null label is a label; an empty table gives an empty result; other columns are not read. Vectors
of two lengths, or of a length that the parts do not divide, raise. Components too large for exact 64-bit distances are
worked out in Python integers; an error beyond a long is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plurivote.llm.arrow import ddl
from plurivote.llm.hot_keys import join_unique
from plurivote.session import scratch_path

PARTS, ENTRIES, ROUNDS, PIVOTS = 16, 64, 2, 4
SCALE = 256
SLICE = 4096  # vectors that are worked on at once
_LONG = 2**63


def to_integers(flat: np.ndarray) -> np.ndarray:
    """``floor(SCALE * x)``, as Python integers where 64 bits could not hold a distance."""
    scaled = np.floor(flat.astype(np.float64) * SCALE)
    if len(scaled) and np.abs(scaled).max() >= 2**26:
        return np.array([int(v) for v in scaled], dtype=object)
    return scaled.astype(np.int64)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances over the last axis."""
    return ((a - b) ** 2).sum(axis=-1)


def choose_pivots(entries: np.ndarray, count: int) -> np.ndarray:
    """Entries far from each other: the first, then always the one with the largest sum of distances to those chosen."""
    chosen, total = [0], squared(entries, entries[0])
    while len(chosen) < min(count, len(entries)):
        total[chosen] = -1
        chosen.append(int(np.argmax(total)))
        total = total + squared(entries, entries[chosen[-1]])
    return entries[chosen]


def nearest(parts: np.ndarray, to_pivots: np.ndarray, pivots: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index of the nearest entry of each part, its squared distance, and the number of exact evaluations.

    ``parts`` (n, d), ``to_pivots`` (n, p) squared, ``pivots`` (p, d), ``entries`` (k, d).
    """
    n, k = len(parts), len(entries)
    known = np.sqrt(to_pivots.astype(np.float64))
    bounds = np.zeros((n, k))
    for p, pivot in enumerate(pivots):
        across = np.sqrt(squared(entries, pivot).astype(np.float64))
        both = known[:, p, None]
        # A little less than the difference, so that rounding never passes for distance.
        np.maximum(bounds, np.abs(both - across) - 1e-9 * (both + across), out=bounds)
    order = np.argsort(bounds, axis=1, kind="stable")
    wide = parts.dtype == object or entries.dtype == object
    best = np.full(n, None if wide else np.iinfo(np.int64).max, dtype=object if wide else np.int64)
    index = np.full(n, k, dtype=np.int64)
    active, tried = np.arange(n), 0
    for t in range(k):
        entry = order[active, t]
        if t:
            hopeful = bounds[active, entry] ** 2 <= best[active].astype(np.float64) * (1 + 1e-12)
            active, entry = active[hopeful], entry[hopeful]
        if not len(active):
            break
        found = squared(parts[active], entries[entry])
        tried += len(active)
        better = np.ones(len(active), dtype=bool) if not t else (found < best[active]) | ((found == best[active]) & (entry < index[active]))
        best[active[better]], index[active[better]] = found[better], entry[better]
    return index, best, tried


def _vectors(column: pa.Array) -> np.ndarray:
    """Rows of a list column as a matrix."""
    sizes = np.unique(column.value_lengths().to_numpy(zero_copy_only=False))
    if len(sizes) > 1:
        raise ValueError(f"vectors of {sizes[0]} and of {sizes[-1]} components")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), int(sizes[0]) if len(sizes) else 0)


def _cut(matrix: np.ndarray, parts: int) -> np.ndarray:
    """(n, parts, d) view of (n, parts * d)."""
    if matrix.shape[1] % parts:
        raise ValueError(f"{matrix.shape[1]} components are not cut into {parts} equal parts")
    return matrix.reshape(len(matrix), parts, matrix.shape[1] // parts)


def _stored(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """Integers of a stored list column; long ones are stored as text."""
    column = batch.column(width)
    values = column.flatten()
    if pa.types.is_string(values.type):
        flat = np.array([int(v) for v in values.to_pylist()], dtype=object)
    else:
        flat = values.to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), len(flat) // len(column) if len(column) else 0)


class Codes:
    """``rows`` (id, label, code, error) and the codebooks ``entries`` (parts, k, d) they refer to."""

    def __init__(self, rows: DataFrame, entries: np.ndarray):
        self.rows, self.entries = rows, entries

    def sha256(self) -> str:
        """Digest of all components by part, entry and position."""
        return hashlib.sha256(",".join(str(int(x)) for x in self.entries.ravel()).encode()).hexdigest()


def finite(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``id``, ``label``, ``vector`` of the rows whose vector is whole."""
    whole = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    narrow = vectors.select(F.col(vec_id).alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    return narrow.where(F.col("vector").isNotNull() & F.coalesce(whole, F.lit(False)))


def train(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    pivots: int = PIVOTS,
) -> Codes:
    """Codes of all whole vectors under the codebooks that ``rounds`` rounds made of them."""
    spark = vectors.sparkSession
    kept = finite(vectors, vec_id, vector, label)
    first = kept.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).select("vector").toArrow()
    if not first.num_rows:
        nothing = kept.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"))
        return Codes(nothing, np.zeros((parts, 0, 0), dtype=np.int64))
    raw = _vectors(first.column(0).combine_chunks())
    width = raw.shape[1]
    start = _cut(to_integers(raw.ravel()).reshape(raw.shape), parts)
    book = np.ascontiguousarray(start.transpose(1, 0, 2))
    fixed = np.stack([choose_pivots(x, pivots) for x in book])

    # Long integers are stored as text; whether there are any is known after one look at the largest component.
    largest = kept.agg(F.max(F.array_max(F.transform("vector", lambda x: F.abs(x))))).first()[0] or 0.0
    kind = "bigint" if largest * SCALE < 2**26 else "string"
    lists = _list_maker(kind)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                matrix = _vectors(batch.column(2))
                if matrix.shape[1] != width:
                    raise ValueError(f"vectors of {width} and of {matrix.shape[1]} components")
                integers = to_integers(matrix.ravel()).reshape(matrix.shape)
                away = squared(_cut(integers, parts)[:, :, None, :], fixed[None])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists(integers), lists(away.reshape(len(away), -1))], ["id", "label", "integers", "away"])

    path = scratch_path(spark, "vectors")
    kept.mapInArrow(measure, f"{ddl(kept, 'id', 'label')}, integers array<{kind}>, away array<{kind}>").write.parquet(path)
    rows = spark.read.parquet(path)
    for _ in range(rounds):
        book = _moved(rows, book, fixed)
    return Codes(_assigned(rows, book, fixed), book)


def _list_maker(kind: str):
    """Matrix to a list column of bigint or, for integers beyond 64 bits, of text."""

    def lists(matrix: np.ndarray) -> pa.Array:
        offsets = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
        flat = matrix.ravel()
        values = pa.array([str(v) for v in flat], pa.string()) if kind == "string" else pa.array(flat.astype(np.int64))
        return pa.ListArray.from_arrays(pa.array(offsets), values)

    return lists


def _coded(rows: DataFrame, book: np.ndarray, fixed: np.ndarray, emit, schema: str) -> DataFrame:
    """Assign all parts slice by slice; ``emit`` gets (batch, parts, index, distance) and what it returns at the end."""
    count = len(book)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = emit()
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                parts = _cut(_stored(batch, 2), count)
                away = _stored(batch, 3).reshape(batch.num_rows, count, -1)
                index = np.empty((batch.num_rows, count), dtype=np.int64)
                distance = np.empty((batch.num_rows, count), dtype=object if parts.dtype == object or book.dtype == object else np.int64)
                for p in range(count):
                    index[:, p], distance[:, p], _ = nearest(parts[:, p], away[:, p], fixed[p], book[p])
                yield from made.slice(batch, parts, index, distance)
        yield from made.end()

    return rows.select("id", "label", "integers", "away").mapInArrow(run, schema)


class _Sums:
    """Count and sums of the parts of every entry, one row per part position and entry that has any."""

    def __init__(self, shape: tuple[int, int, int]):
        self.counts = np.zeros(shape[:2], dtype=np.int64)
        self.sums = np.zeros(shape, dtype=object)

    def slice(self, batch, parts, index, distance):
        for p in range(parts.shape[1]):
            # Sorted by entry, so that one reduction adds up each entry's parts; at most SLICE rows are added in 64 bits.
            order = np.argsort(index[:, p], kind="stable")
            entries, begin, count = np.unique(index[order, p], return_index=True, return_counts=True)
            self.counts[p, entries] += count
            if parts.shape[2]:
                self.sums[p, entries] += np.add.reduceat(parts[order, p], begin, axis=0).astype(object)
        return ()

    def end(self):
        part, entry = np.nonzero(self.counts)
        sums = [[str(v) for v in self.sums[p, e]] for p, e in zip(part, entry, strict=True)]
        columns = [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(self.counts[part, entry]), pa.array(sums, pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "n", "sums"])


def _moved(rows: DataFrame, book: np.ndarray, fixed: np.ndarray) -> np.ndarray:
    """Codebooks after one round."""
    shape = book.shape
    tallied = _coded(rows, book, fixed, lambda: _Sums(shape), "part int, entry int, n bigint, sums array<string>")
    totals = [F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(shape[2])]
    moved = book.astype(object)
    for row in tallied.groupBy("part", "entry").agg(F.sum("n").alias("n"), *totals).collect():  # one row per entry
        moved[row["part"], row["entry"]] = [int(row[f"s{i}"]) // row["n"] for i in range(shape[2])]
    return moved if moved.size and max(abs(int(v)) for v in moved.ravel()) >= 2**26 else moved.astype(np.int64)


class _Rows:
    """Code and error of every vector."""

    def slice(self, batch, parts, index, distance):
        flat = index.astype(np.uint8).tobytes().hex()
        width = 2 * index.shape[1]
        codes = [flat[i * width : (i + 1) * width] for i in range(len(index))]
        errors = [int(v) if v < _LONG else None for v in distance.sum(axis=1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.string()), pa.array(errors, pa.int64())], ["id", "label", "code", "error"])

    def end(self):
        return ()


def _assigned(rows: DataFrame, book: np.ndarray, fixed: np.ndarray) -> DataFrame:
    """``id``, ``label``, ``code``, ``error``, stored in the shared folder: they are read twice."""
    path = scratch_path(rows.sparkSession, "codes")
    _coded(rows, book, fixed, _Rows, f"{ddl(rows, 'id', 'label')}, code string, error bigint").write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def with_label_error(codes: DataFrame) -> DataFrame:
    """Adds the sum of ``error`` over all rows of the same label, nulls together."""
    keyed = codes.withColumn("_label", F.coalesce(F.to_json(F.struct("label")), F.lit("")))
    sums = keyed.groupBy("_label").agg(F.sum("error").alias("label_error"))
    return join_unique(keyed, sums, "_label").drop("_label")
