"""Token counts by rank-synchronous merging (operator 1).

A byte-level BPE splits a text into pre-tokens and merges, inside each, the adjacent
pair of the lowest rank until none is left. Here all new pre-tokens of a slice are held
as one ragged numpy array; each round looks up the rank of every adjacent pair, takes the
lowest rank of each sequence and merges all its occurrences in all sequences at once.
The symbols that survive are the tokens. Counts of pre-tokens are kept by the worker,
in a table of bounded size, because words repeat.

Applying every occurrence of a sequence's lowest pair in one round gives the same result as
one merge at a time: a merge that uses a new symbol always ranks behind the one that makes it.
Overlapping occurrences (``a a a``) merge from the left.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); special strings in a text
are one token each, as the library does by default; null ids, repeated rows and extra
columns change nothing; every input row gives one output row.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plurivote.llm.arrow import ddl, kept, slices

# Fixed value: the split pattern of byte-level BPE with ``use_regex``.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHED_PRE_TOKENS = 300_000
CACHED_CHARS = 16_000_000
BATCH_SYMBOLS = 1 << 20  # symbols merged in one array; a longer pre-token is an array of its own
NO_RANK = np.iinfo(np.int32).max


def byte_symbols() -> list[str]:
    """The printable stand-in of every byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    stand_in = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in stand_in:
            stand_in[b] = chr(256 + len(stand_in) - len(plain))
    return [stand_in[b] for b in range(256)]


class MergeTable:
    """Vocabulary and merges of a tokenizer file, as sorted arrays."""

    def __init__(self, tokenizer_json: str):
        spec = json.loads(tokenizer_json)
        model, step = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or spec["normalizer"] or step["type"] != "ByteLevel" or step["add_prefix_space"]:
            raise ValueError("a byte-level BPE without normalizer or prefix space is needed")
        vocab = model["vocab"]
        self.first = np.array([vocab[s] for s in byte_symbols()], dtype=np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.rank = keys[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)  # by rank
        self.special = [t["content"] for t in spec.get("added_tokens", [])]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.rank[at], NO_RANK)

    def count(self, pre_tokens: list[bytes]) -> np.ndarray:
        """Symbols left of each pre-token after all merges."""
        lengths = np.array([len(p) for p in pre_tokens], dtype=np.int64)
        counts = np.zeros(len(pre_tokens), dtype=np.int64)
        filled = np.flatnonzero(lengths)
        start = 0
        ends = np.cumsum(lengths[filled])
        while start < len(filled):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + BATCH_SYMBOLS, side="right")))
            part = filled[start:stop]
            counts[part] = self._merged(b"".join([pre_tokens[i] for i in part]), lengths[part])
            start = stop
        return counts

    def _merged(self, data: bytes, lengths: np.ndarray) -> np.ndarray:
        symbols = self.first[np.frombuffer(data, dtype=np.uint8)]
        counts = lengths.copy()
        active = np.arange(len(lengths))  # sequences that may still merge
        lengths = lengths.copy()
        while len(active):
            starts = np.cumsum(lengths) - lengths
            rank = np.full(len(symbols), NO_RANK, dtype=np.int32)  # of the pair that begins here
            rank[:-1] = self.ranks(symbols[:-1], symbols[1:])
            rank[starts + lengths - 1] = NO_RANK
            lowest = np.minimum.reduceat(rank, starts)
            hit = (rank == np.repeat(lowest, lengths)) & (rank != NO_RANK)
            # In a run of overlapping hits every second one merges, counted from its left end.
            place = np.flatnonzero(hit)
            fresh = np.ones(len(place), dtype=bool)
            fresh[1:] = place[1:] != place[:-1] + 1
            run_start = place[np.maximum.accumulate(np.where(fresh, np.arange(len(place)), 0))] if len(place) else place
            place = place[(place - run_start) % 2 == 0]
            symbols[place] = self.made[rank[place]]
            stay = np.ones(len(symbols), dtype=bool)
            stay[place + 1] = False
            left = np.add.reduceat(stay, starts, dtype=np.int64)
            counts[active] = left
            going = (lowest != NO_RANK) & (left > 1)
            symbols = symbols[stay & np.repeat(going, lengths)]
            active, lengths = active[going], left[going]
        return counts


class Counts(dict):
    """Token counts of the pre-tokens seen so far; notes the ones it lacks."""

    def __init__(self):
        super().__init__()
        self.number = np.zeros(0, dtype=np.int64)
        self.new: list[str] = []
        self.chars = 0

    def __missing__(self, pre_token: str) -> int:
        self[pre_token] = place = len(self)
        self.new.append(pre_token)
        self.chars += len(pre_token)
        return place

    def learn(self, table: MergeTable) -> None:
        if self.new:
            self.number = np.concatenate([self.number, table.count([p.encode() for p in self.new])])
            self.new = []

    def shrink(self) -> None:
        if len(self) > CACHED_PRE_TOKENS or self.chars > CACHED_CHARS:
            self.clear()
            self.__init__()


def _counter(tokenizer_json):
    shipped = tokenizer_json

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = kept(f"merges-{hash(shipped.value)}", lambda: MergeTable(shipped.value))
        known = kept(f"counts-{hash(shipped.value)}", Counts)
        find = regex.compile(PRE_TOKEN).findall
        special = regex.compile("|".join(map(regex.escape, table.special))) if table.special else None
        for batch in slices(batches):
            column = batch.column("text")
            places, per_row, marks = [], [], []
            for text in column.to_pylist():
                text = text or ""
                parts = special.split(text) if special else [text]
                before = len(places)
                for part in parts:
                    places += map(known.__getitem__, find(part))
                per_row.append(len(places) - before)
                marks.append(len(parts) - 1)
            known.learn(table)
            tokens = known.number[np.array(places, dtype=np.int64)]
            ends = np.cumsum(np.concatenate([[0], tokens]))
            bounds = np.cumsum(np.concatenate([[0], np.array(per_row, dtype=np.int64)]))
            n_tokens = ends[bounds[1:]] - ends[bounds[:-1]] + np.array(marks, dtype=np.int64)
            known.shrink()
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in batch.schema.names if n != "text"], pa.array(n_tokens)],
                names=[*[n for n in batch.schema.names if n != "text"], "n_tokens"],
            )

    return run


def token_counts(documents: DataFrame, tokenizer_json: str, limit: int = 512) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every document.

    ``tokenizer_json`` is the text of a byte-level BPE file (fixed size, a few MB), which
    is broadcast. One pass, no shuffle.
    """
    shipped = documents.sparkSession.sparkContext.broadcast(tokenizer_json)
    rows = documents.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), "text")
    counted = rows.mapInArrow(_counter(shipped), ddl(rows, "doc_id", "n_bytes") + ", n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


