"""Scoring rows with a saved model of another library.

The model is a file in a store that all executors reach. A worker loads it once and gets the rows in Arrow batches;
nothing of it passes through the driver.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow.fs as pafs
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from plurivote.functions import scores as S

Predict = Callable[..., np.ndarray]


def read_bytes(path: str) -> bytes:
    """A whole file of a local or remote store."""
    files, name = pafs.FileSystem.from_uri(path)
    with files.open_input_file(name) as file:
        return file.read()


def save_arrays(path: str, **arrays: np.ndarray) -> str:
    """Named arrays as one ``.npz`` file; it appears whole or not at all."""
    files, name = pafs.FileSystem.from_uri(path)
    files.create_dir(name.rsplit("/", 1)[0], recursive=True)
    held = io.BytesIO()
    np.savez(held, **arrays)
    with files.open_output_stream(f"{name}.part") as file:
        file.write(held.getvalue())
    files.move(f"{name}.part", name)
    return path


def linear_model(path: str) -> Predict:
    """``weights`` (inputs, classes) and ``bias`` of an ``.npz`` file: one score per class."""
    with np.load(io.BytesIO(read_bytes(path))) as file:
        weights, bias = file["weights"], file["bias"]
    return lambda x: np.asarray(x, dtype=np.float64) @ weights + bias


def onnx_model(path: str) -> Predict:
    """The first output of an ONNX file, for inputs in the order of the file."""
    import onnxruntime

    session = onnxruntime.InferenceSession(read_bytes(path), providers=["CPUExecutionProvider"])
    names = [i.name for i in session.get_inputs()]
    return lambda *arrays: session.run(None, dict(zip(names, arrays, strict=True)))[0]


def score_external(
    rows: DataFrame,
    path: str,
    load: Callable[[str], Predict],
    inputs: Sequence[str],
    widths: Sequence[int],
    model_name: str,
    epoch_no: int = 1,
    batch_size: int = 1024,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Long predictions with logits of the model at ``path``.

    ``load`` turns the path into a function from arrays (rows, width) to scores (rows, classes). ``inputs`` are vector
    columns of the given ``widths``. A row whose input is null or of another width has no logits and no prediction.
    """

    def make() -> Predict:
        return load(path)

    predict = predict_batch_udf(make, return_type=ArrayType(DoubleType()), batch_size=batch_size, input_tensor_shapes=[[w] for w in widths])
    usable = F.lit(True)
    filled = []
    for name, width in zip(inputs, widths, strict=True):
        fits = F.coalesce(F.size(name) == width, F.lit(False)) & ~F.coalesce(F.exists(name, lambda x: x.isNull()), F.lit(False))
        usable = usable & fits
        filled.append(F.when(fits, F.col(name).cast("array<double>")).otherwise(F.array_repeat(F.lit(0.0), width)))
    logits = F.when(F.col("_usable"), F.col("_found"))
    found = rows.withColumn("_usable", usable).withColumn("_found", predict(*filled))
    return found.select(
        F.lit(model_name).alias("model_name"), F.lit(epoch_no).alias("epoch_no"), "item_id", S.argmax(logits).alias("pred"), logits.alias("logits"), *keep
    )
