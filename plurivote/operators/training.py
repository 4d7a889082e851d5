"""Training that can be stopped, stored, resumed and moved to another task.

A network has one hidden layer over hashed words and a softmax head. An epoch is one or a few passes: every task
works out the gradient sums of its own rows, the sums are added over the executors, and the driver, which holds the
weights and nothing else, takes one Adam step. The state (weights, both moments, epoch) is a small table.

Sums are exact. What a row adds is rounded to a fixed fraction and added as an integer, so the order of rows, tasks
and retries changes nothing: training on from a stored state gives the weights of training through, bit for bit, on
any partitioning. Several networks (replicas) learn in the same passes over the rows, each with its own row weights.

Rows are ``item_id``, ``label`` (0, 1, …), ``ids`` (hashed words) and, per network, a weight. A null label is left out;
a text without words is a row of biases.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plurivote.functions import scores as S
from plurivote.functions import text as T
from plurivote.functions.keys import hash32

WIDTH, HIDDEN = 1 << 12, 16
RATE, DECAYS, EPSILON = 0.05, (0.9, 0.999), 1e-8  # Adam's step and moments
# Fixed fractions: activations, errors of the classes, errors of the hidden units for every word, losses, row weights.
ACTIVE, ERROR, FINE, LOSS, WEIGHT = float(1 << 10), float(1 << 16), float(1 << 24), float(1 << 20), float(1 << 10)
CHUNK_ROWS, CHUNK_IDS = 4096, 1 << 20
LARGEST = 1 << 61  # of a sum that may still be added to another
SLICE = 1 << 13  # gradient entries that travel as one row
LAYERS = ("hidden", "hidden_bias", "head", "head_bias")
FRACTIONS = {"hidden": FINE, "hidden_bias": FINE, "head": ERROR * ACTIVE, "head_bias": ERROR}


@dataclass(frozen=True)
class Network:
    """Weights by layer with their moments, after ``epoch`` epochs and ``step`` steps."""

    weights: dict[str, np.ndarray]
    first: dict[str, np.ndarray]
    second: dict[str, np.ndarray]
    epoch: int = 0
    step: int = 0

    @property
    def classes(self) -> int:
        return self.weights["head"].shape[1]


def _still(weights: dict[str, np.ndarray]) -> Network:
    """A network at rest: no moments yet."""
    return Network(weights, {k: np.zeros_like(v) for k, v in weights.items()}, {k: np.zeros_like(v) for k, v in weights.items()})


def new_network(classes: int, seed: int = 1, width: int = WIDTH, hidden: int = HIDDEN) -> Network:
    """Small random weights, the same for a seed everywhere."""
    rng = np.random.default_rng(seed)
    return _still(
        {
            "hidden": rng.uniform(-0.1, 0.1, (width, hidden)),
            "hidden_bias": np.zeros(hidden),
            "head": rng.uniform(-0.3, 0.3, (hidden, classes)),
            "head_bias": np.zeros(classes),
        }
    )


def with_new_head(network: Network, classes: int, seed: int = 1) -> Network:
    """The hidden layer of a trained network under a head made anew, ready for a task with other classes."""
    fresh = new_network(classes, seed, *network.weights["hidden"].shape).weights
    return _still({k: network.weights[k].copy() if k.startswith("hidden") else fresh[k] for k in LAYERS})


def hashed_words(text: Column, width: int = WIDTH) -> Column:
    """Bucket of every word; a null text has none."""
    words = F.coalesce(T.words(text), F.array().cast("array<string>"))
    return F.transform(words, lambda w: F.pmod(F.crc32(w), F.lit(width)).cast("int"))


def features(rows: DataFrame, width: int = WIDTH, keep: Sequence[str] = ()) -> DataFrame:
    """``item_id, label, ids`` and the columns of ``keep``."""
    return rows.select("item_id", F.col("label").cast("int").alias("label"), hashed_words(F.col("text"), width).alias("ids"), *keep)


def _hidden(weights: dict[str, np.ndarray], row: np.ndarray, ids: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Activations of all rows, one hidden unit at a time; every sum runs over one row's words in their order."""
    made = np.empty((len(scale), weights["hidden"].shape[1]))
    for k in range(made.shape[1]):
        made[:, k] = np.bincount(row, weights=weights["hidden"][:, k][ids], minlength=len(scale)) * scale + weights["hidden_bias"][k]
    return np.tanh(made)


def _logits(weights: dict[str, np.ndarray], active: np.ndarray) -> np.ndarray:
    return np.stack([(active * weights["head"][:, c]).sum(axis=1) + weights["head_bias"][c] for c in range(weights["head"].shape[1])], axis=1)


def _softmax(logits: np.ndarray) -> np.ndarray:
    raised = np.exp(logits - logits.max(axis=1, keepdims=True))
    return raised / raised.sum(axis=1, keepdims=True)


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Begin and end of a few rows, the row of each of their ids, the ids, and each row's scale."""
    ids = batch.column("ids")
    bounds = ids.offsets.to_numpy().astype(np.int64)
    flat = ids.values.to_numpy(zero_copy_only=False)
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(bounds, bounds[start] + CHUNK_IDS, side="right")) - 1
        stop = min(max(stop, start + 1), start + CHUNK_ROWS, batch.num_rows)
        lengths = np.diff(bounds[start : stop + 1])
        row = np.repeat(np.arange(stop - start), lengths)
        yield start, stop, row, flat[bounds[start] : bounds[stop]], 1.0 / np.sqrt(np.maximum(lengths, 1))
        start = stop


def _gradient(weights, row, ids, scale, label, weight) -> tuple[np.ndarray, np.ndarray]:
    """Integer gradient sums of a few rows, layers end to end, and their loss and weight."""
    active = _hidden(weights, row, ids, scale)
    logits = _logits(weights, active)
    chance = _softmax(logits)
    at = np.arange(len(label))
    loss = -np.log(np.maximum(chance[at, label], 1e-300)) * weight
    chance[at, label] -= 1.0
    out = np.rint(chance * weight[:, None] * ERROR)
    back = sum(out[:, c, None] * weights["head"][:, c] for c in range(out.shape[1])) / ERROR * (1.0 - active * active)
    rounded = np.rint(back * scale[:, None] * FINE)
    units, width = active.shape[1], len(weights["hidden"])
    hidden = np.stack([np.bincount(ids, weights=rounded[row, k], minlength=width) for k in range(units)], axis=1)
    parts = [hidden.ravel(), np.rint(back * FINE).sum(axis=0), (np.rint(active * ACTIVE).T @ out).ravel(), out.sum(axis=0)]
    tail = [np.rint(loss * LOSS).sum(), np.rint(weight * WEIGHT).sum()]
    return np.concatenate(parts).astype(np.int64), np.array(tail).astype(np.int64)


def _worker(all_weights: Sequence[dict[str, np.ndarray]], names: Sequence[str]):
    """Gradient sums of a task's rows for every network, cut into slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: list[np.ndarray | None] = [None] * len(names)
        for batch in batches:
            label = batch.column("label").to_numpy(zero_copy_only=False)
            counts = [batch.column(n).to_numpy(zero_copy_only=False).astype(np.float64) for n in names]
            for start, stop, row, ids, scale in _chunks(batch):
                for i, weights in enumerate(all_weights):
                    mine = counts[i][start:stop]
                    if mine.any():
                        found = np.concatenate(_gradient(weights, row, ids, scale, label[start:stop], mine))
                        sums[i] = found if sums[i] is None else sums[i] + found
        for i, total in enumerate(sums):
            if total is not None:
                for at in range(0, len(total), SLICE):
                    part = pa.array([total[at : at + SLICE].tolist()], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([at], pa.int64()), part], ["network", "at", "sums"])

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the slices of one place."""
    totals: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for i, at, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            values = part.values.to_numpy(zero_copy_only=False)
            totals[i, at] = totals[i, at] + values if (i, at) in totals else values
            if np.abs(totals[i, at]).max() >= LARGEST:
                raise OverflowError("gradient sums beyond 64 bits: use more steps an epoch")
    for (i, at), values in totals.items():
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([at], pa.int64()), pa.array([values.tolist()], pa.list_(pa.int64()))], ["network", "at", "sums"])


_SUMS = "network int, at bigint, sums array<bigint>"


def _step(network: Network, total: np.ndarray, rate: float) -> tuple[Network, float]:
    """One Adam step from the gradient sums, and the mean loss before it."""
    share = total[-1] / WEIGHT
    if not share:
        return replace(network, step=network.step + 1), 0.0
    first, second, weights, at = {}, {}, {}, 0
    step = network.step + 1
    for name in LAYERS:
        old = network.weights[name]
        slope = total[at : at + old.size].reshape(old.shape) / (share * FRACTIONS[name])
        at += old.size
        first[name] = DECAYS[0] * network.first[name] + (1 - DECAYS[0]) * slope
        second[name] = DECAYS[1] * network.second[name] + (1 - DECAYS[1]) * slope * slope
        moved = (first[name] / (1 - DECAYS[0] ** step)) / (np.sqrt(second[name] / (1 - DECAYS[1] ** step)) + EPSILON)
        weights[name] = old - rate * moved
    return Network(weights, first, second, network.epoch, step), float(total[-2] / LOSS / share)


def train(
    rows: DataFrame, networks: Sequence[Network], epochs: int, weights: Sequence[str] | None = None, steps: int = 1, rate: float = RATE
) -> Iterator[tuple[list[Network], list[float]]]:
    """The networks and their mean train losses after each further epoch.

    ``weights`` names a column per network (default: all rows count once). With ``steps`` an epoch goes through the rows
    in so many parts, drawn anew each epoch. A step is one job; it moves one row of sums per task and slice.
    ``rows`` are read once a step: settle them first.
    """
    names = list(weights) if weights is not None else ["_one"] * len(networks)
    known = rows.where("label IS NOT NULL").withColumn("_one", F.lit(1.0))
    known = known.select("item_id", "label", "ids", *dict.fromkeys(names))
    networks = list(networks)
    for _ in range(epochs):
        losses = []
        for part in range(steps):
            mine = known if steps == 1 else known.where(hash32(f"epoch{networks[0].epoch + 1}", "item_id") % steps == part)
            slices = mine.drop("item_id").mapInArrow(_worker([n.weights for n in networks], names), _SUMS)
            totals = [np.zeros(sum(w.size for w in n.weights.values()) + 2, dtype=np.int64) for n in networks]
            for row in slices.repartition("network", "at").mapInArrow(_add, _SUMS).collect():  # as long as the weights
                totals[row["network"]][row["at"] : row["at"] + len(row["sums"])] = row["sums"]
            done = [_step(n, t, rate) for n, t in zip(networks, totals, strict=True)]
            networks = [n for n, _ in done]
            losses.append([loss for _, loss in done])
        networks = [replace(n, epoch=n.epoch + 1) for n in networks]
        yield networks, [float(np.mean(x)) for x in zip(*losses, strict=True)]


def score(named: Sequence[tuple[str, int, Network]], rows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Long predictions with logits of many networks from one pass over the rows (``features``)."""
    shipped = [(name, epoch_no, network.weights) for name, epoch_no, network in named]
    kinds = dict(rows.dtypes)
    extra = ["item_id", "label", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, row, ids, scale in _chunks(batch):
                own = [batch.column(c).slice(start, stop - start) for c in extra]
                for name, epoch_no, weights in shipped:
                    logits = _logits(weights, _hidden(weights, row, ids, scale))
                    n = stop - start
                    offsets = pa.array(np.arange(n + 1, dtype=np.int32) * logits.shape[1])
                    lists = pa.ListArray.from_arrays(offsets, pa.array(logits.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array([epoch_no] * n, pa.int32()), *own, lists], ["model_name", "epoch_no", *extra, "logits"])

    schema = "model_name string, epoch_no int, " + ", ".join(f"`{c}` {kinds[c]}" for c in extra) + ", logits array<double>"
    found = rows.select(*extra, "ids").mapInArrow(run, schema)
    return found.select("model_name", "epoch_no", "item_id", S.argmax(F.col("logits")).alias("pred"), "logits", "label", *keep)


def save_state(spark: SparkSession, network: Network, path: str) -> str:
    """Store the whole state, one row per row of weights, under ``path``. A retry replaces it whole."""
    rows = []
    for layer in LAYERS:
        parts = [np.atleast_2d(x[layer]) for x in (network.weights, network.first, network.second)]
        vector = network.weights[layer].ndim == 1
        rows += [(layer, i, vector, network.epoch, network.step, *[p[i].tolist() for p in parts]) for i in range(len(parts[0]))]
    schema = "layer string, row int, vector boolean, epoch int, step int, weights array<double>, first array<double>, second array<double>"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(path)
    return path


def load_state(spark: SparkSession, path: str) -> Network:
    """A stored state, ready to train on."""
    stored = spark.read.parquet(path).orderBy("layer", "row").collect()  # as long as the weights
    state: dict[str, dict[str, np.ndarray]] = {"weights": {}, "first": {}, "second": {}}
    for layer in LAYERS:
        mine = [r for r in stored if r["layer"] == layer]
        for part, found in state.items():
            matrix = np.array([r[part] for r in mine], dtype=np.float64)
            found[layer] = matrix[0] if mine[0]["vector"] else matrix
    return Network(**state, epoch=stored[0]["epoch"], step=stored[0]["step"])


def same_state(a: Network, b: Network) -> bool:
    """Equal in every bit of weights, moments, epoch and step."""
    parts = ((a.weights, b.weights), (a.first, b.first), (a.second, b.second))
    return (a.epoch, a.step) == (b.epoch, b.step) and all(np.array_equal(x[k], y[k]) for x, y in parts for k in LAYERS)
