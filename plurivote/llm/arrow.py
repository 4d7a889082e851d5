"""Helpers for functions over Arrow batches: bounded slices, text buffers, kept state."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SLICE_BYTES = 4 << 20  # texts that are worked on at once; a longer text is a slice of its own


def kept(name: str, make: Callable):
    """An object that the worker process keeps for its next tasks, until an operator of another module asks for one."""
    store = sys.modules.setdefault("_plurivote_kept", types.ModuleType("_plurivote_kept")).__dict__
    if store.get("owner") != make.__module__:
        store.clear()
        store["owner"] = make.__module__
    if name not in store:
        store[name] = make()
    return store[name]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and where each begins (one entry more than texts). Null: empty."""
    plain = column.cast(pa.large_binary())
    if plain.null_count:
        plain = plain.fill_null(b"")
    bounds = np.frombuffer(plain.buffers()[1], dtype=np.int64)[plain.offset : plain.offset + len(plain) + 1]
    data = plain.buffers()[2]
    if data is None or len(plain) == 0:
        return np.empty(0, np.uint8), np.zeros(len(plain) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of a slice take about ``limit`` bytes. Memory of batches gone by goes back to the system."""
    for batch in batches:
        pa.default_memory_pool().release_unused()
        if batch.num_rows == 0:
            continue
        bounds = text_buffers(batch.column(text))[1]
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(bounds, bounds[start] + limit, side="right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def ddl(df: DataFrame, *names: str) -> str:
    """Schema text of the named columns."""
    kinds = dict(df.dtypes)
    return ", ".join(f"`{n}` {kinds[n]}" for n in names)


def ragged(lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Positions ``start .. start + length`` of every entry, end to end."""
    lengths = np.asarray(lengths, dtype=np.int64)
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, dtype=np.int64) - (ends - lengths), lengths)
