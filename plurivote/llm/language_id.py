"""Language identification by prediction by partial matching (operator 4).

For each language a byte context tree of order 3 is counted on labelled documents. The code
length of a byte is that of PPM with escape method C: from the longest context the language has
seen, ``n(byte) / (N + T)`` where the byte was seen there, else the escape ``T / (N + T)`` and
the next shorter context, down to equal chances for all 256 bytes (T: distinct bytes of
a context, N: their number). The statistics are frozen, so code lengths are worked out once, in
sparse tables: a row for each sequence of a context and its byte that any language has seen, and a row for the escapes of
each context, an entry per language in both. A text is scored on whole batches, from the longest order down;
bytes that an order knows are done, the others pay its escape and go on. The language with the shortest code is the answer.

Learning uses at most ``docs_per_language`` labelled documents per language (whole texts; those
with the smallest hash of their id), which is a parameter. All their contexts and all bytes are kept, so the model grows with that sample and not with the
corpus: 4 bytes per language and table row. It is broadcast.

Defined cases: a null text or one without a letter is ``und`` with score 0; equal code lengths go to
the language first in code point order; without labelled documents all are ``und``; repeated
rows, null ids and extra columns change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plurivote.llm.arrow import slices, text_buffers
from plurivote.session import small_side

ORDER = 3
SLICE, CHUNK = 1 << 20, 1 << 18  # bytes of text that are prepared and scored at once
EVIDENCE = 64  # bytes beyond which the score does not sharpen any more
NO_LANGUAGE = "und"
BLANK = 32
PARTS = 64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Model(NamedTuple):
    languages: list[str]
    grams: list[np.ndarray]  # per order: context and byte as one number, ascending
    bits: list[np.ndarray]  # per order: (grams, languages) code lengths
    contexts: list[np.ndarray]  # per order: contexts, ascending
    escapes: list[np.ndarray]  # per order: (contexts, languages) code lengths


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def _contexts(data: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """The ORDER bytes before every position, the nearest first; blanks before a text."""
    before, out = data, []
    for _ in range(ORDER):
        shifted = np.empty_like(before)
        shifted[1:] = before[:-1]
        shifted[starts] = BLANK
        out.append(shifted)
        before = shifted
    return out


def _codes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Every byte with its context as one number, the byte lowest."""
    one, two, three = (c.astype(np.uint32) for c in _contexts(data, starts))
    return (three << 24) | (two << 16) | (one << 8) | data


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        data, bounds = text_buffers(batch.column("text"))
        starts = bounds[:-1][np.diff(bounds) > 0]
        if not len(starts):
            continue
        plain = LOWER[data]
        code = _codes(plain, starts)
        language = np.repeat(np.array(batch.column("lang").to_pylist(), dtype=object), np.diff(bounds))
        for lang in set(language):
            codes, counts = np.unique(code[language == lang], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes)), pa.array(codes, pa.int64()), pa.array(counts)], names=["lang", "code", "n"])


def fit(documents: DataFrame, docs_per_language: int = 300) -> Model | None:
    """Count the context trees on documents that are not held out; none without labels."""
    rows = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    # The first of every language, chosen among the first of its parts, so a language with most rows is not one task.
    first = rows.select("doc_id", "lang", F.xxhash64(F.col("doc_id").cast("string")).alias("_h")).withColumn("_part", F.pmod("_h", F.lit(PARTS)))
    for by in (["lang", "_part"], ["lang"]):
        place = F.row_number().over(Window.partitionBy(*by).orderBy("_h", "doc_id"))
        first = first.withColumn("_n", place).where(F.col("_n") <= docs_per_language)
    chosen = first.select("doc_id", "lang").distinct()
    sample = rows.select("doc_id", "lang", "text").join(small_side(chosen), ["doc_id", "lang"], "left_semi").select("lang", "text")
    counts = sample.mapInArrow(_count, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow()
    if counts.num_rows == 0:
        return None
    languages = sorted(set(counts.column("lang").to_pylist()))
    place = {lang: i for i, lang in enumerate(languages)}
    lang = np.array([place[x] for x in counts.column("lang").to_pylist()])
    return tree(languages, lang, counts.column("code").to_numpy().astype(np.uint32), counts.column("n").to_numpy())


def tree(languages: list[str], lang: np.ndarray, code: np.ndarray, n: np.ndarray) -> Model:
    """Freeze the code lengths of every (context, byte) seen and of every context's escape."""
    grams, bits, contexts, escapes = [], [], [], []
    for order in range(ORDER + 1):
        gram, place = np.unique(_shorter(code, order), return_inverse=True)
        count = np.zeros((len(gram), len(languages)))
        np.add.at(count, (place, lang), n)
        context, of = np.unique(gram >> 8, return_inverse=True)
        whole, distinct = np.zeros((2, len(context), len(languages)))
        np.add.at(whole, of, count)
        np.add.at(distinct, of, count > 0)
        # A sequence that is known here is known to the shorter orders too, if perhaps in other languages.
        behind = bits[-1][np.searchsorted(grams[-1], _shorter(gram, order - 1))] if order else np.full(count.shape, 8.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(whole > 0, -np.log2(distinct / (whole + distinct)), 0.0)
            coded = -np.log2(count / (whole + distinct)[of])
        grams.append(gram)
        bits.append(np.where(count > 0, coded, escape[of] + behind))
        contexts.append(context)
        escapes.append(escape)
    return Model(languages, grams, [b.astype(np.float32) for b in bits], contexts, [e.astype(np.float32) for e in escapes])


def _shorter(code: np.ndarray, order: int) -> np.ndarray:
    """The byte with the nearest ``order`` bytes of its context."""
    return code & np.uint32((1 << 8 * (order + 1)) - 1)


def _find(known: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in an ascending table, and which are there."""
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return at, known[at] == wanted


def _bits(model: Model, code: np.ndarray) -> np.ndarray:
    """Code length (byte, language)."""
    total = np.zeros((len(code), len(model.languages)), np.float32)
    left = np.arange(len(code))
    for order in range(ORDER, -1, -1):
        here = _shorter(code[left], order)
        at, known = _find(model.grams[order], here)
        total[left[known]] += model.bits[order][at[known]]
        left, here = left[~known], here[~known]
        at, known = _find(model.contexts[order], here >> 8)
        total[left[known]] += model.escapes[order][at[known]]
    total[left] += 8.0
    return total


def code_lengths(model: Model, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Bits of every text in every language."""
    totals = np.zeros((len(bounds) - 1, len(model.languages)))
    filled = np.flatnonzero(np.diff(bounds) > 0)
    if not len(filled):
        return totals
    starts = bounds[:-1][filled]
    code = _codes(LOWER[data], starts)
    for low in range(0, len(code), CHUNK):
        stop = min(low + CHUNK, len(code))
        bits = _bits(model, code[low:stop])
        here = slice(int(np.searchsorted(starts, low, side="right")) - 1, int(np.searchsorted(starts, stop, side="left")))
        totals[filled[here]] += np.add.reduceat(bits, np.maximum(starts[here], low) - low, axis=0, dtype=np.float64)
    return totals


ANSWER = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("bits_per_byte", pa.float64())])


def _answers(model: Model, texts: pa.Array) -> pa.Array:
    data, bounds = text_buffers(texts)
    size = np.diff(bounds)
    bits = code_lengths(model, data, bounds)
    best = bits.argmin(axis=1)
    behind = (bits - bits.min(axis=1, keepdims=True)) * (np.minimum(size, EVIDENCE) / np.maximum(size, 1))[:, None]
    score = 1.0 / np.exp2(-behind).sum(axis=1)
    per_byte = bits.min(axis=1) / np.maximum(size, 1)
    names = pa.array(model.languages).take(pa.array(best))
    return pa.StructArray.from_arrays([names, pa.array(score), pa.array(per_byte)], fields=list(ANSWER))


def predictor(shipped):
    @F.arrow_udf("struct<lang_pred:string,score:double,bits_per_byte:double>")
    def predict(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            batch = pa.RecordBatch.from_arrays([column], names=["text"])
            parts = [_answers(Model(*shipped.value), part.column("text")) for part in slices(iter([batch]), limit=SLICE)]
            yield pa.concat_arrays(parts) if parts else pa.array([], ANSWER)

    return predict


def identify(documents: DataFrame, model: Model | None, into: str = "language") -> DataFrame:
    """The documents with a struct column ``into`` = (lang_pred, score, bits_per_byte).

    Only the text is read. One pass, no shuffle; the other columns stay as they are.
    """
    nothing = F.struct(F.lit(NO_LANGUAGE).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("bits_per_byte"))
    if model is None:
        return documents.withColumn(into, nothing)
    # Shipped as a plain tuple: a broadcast class would be looked up by name on the executors.
    shipped = documents.sparkSession.sparkContext.broadcast(tuple(model))
    has_letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return documents.withColumn(into, predictor(shipped)(F.col("text"))).withColumn(into, F.when(has_letter, F.col(into)).otherwise(nothing))
