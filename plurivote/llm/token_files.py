"""Token ids in Arrow files of equal-length rows (operator 6).

The documents are put in the order of ``doc_id`` by one range shuffle. Every task encodes
its own range as it streams by, packs the ids end to end, and writes two files:

* ``shard-00007.tokens.arrow`` — Arrow file format; record batches of a fixed-size list
  ``input_ids`` (the narrowest unsigned type that holds the vocabulary) and a fixed-size list of
  bits ``mask`` (false: padding at the end of the shard). A row is found without reading the rest.
* ``shard-00007.docs.arrow`` — ``doc_id``, ``start`` inside the shard and ``n_tokens``.

A file is written under the attempt's own name and then renamed, so a task that is run
again after a lost executor replaces its files whole. The manifest (one row per shard) is
settled in the shared folder before anything is read.

Distinct words are encoded once by the library and kept by the worker in a table of bounded size. Cutting
at blanks first is exact for a tokenizer whose pattern never joins characters across white
space, and whose normalizers only change white space or single characters. Its pattern also
cuts between a letter or digit and the marks behind it, so a word that ends in an ASCII letter or digit sheds these before it
is looked up. Whether a tokenizer is of this kind is read from its file; with any other the texts are encoded whole.

Defined cases: a null text counts as empty and holds the end mark alone; null ids come
first; documents with the same id stand in the order of their texts; an empty table gives no shards; extra columns
are not written.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plurivote.llm.arrow import kept, ragged, slices
from plurivote.session import scratch_path, settle

END_ID = 1  # appended to every document
ROW_LENGTH = 2048  # ids of a row
BATCH_ROWS = 256  # rows of a record batch
# A worker remembers up to so many words and pieces; beyond that it forgets all but the most used half.
CACHED_WORDS = 300_000
CACHED_PIECES = 400_000
CACHED_CHARS = 6_000_000
SLICE_TEXTS = 1 << 20  # bytes of texts that are encoded at once
ENCODED_AT_ONCE = 1 << 13  # pieces the library gets at once; its answers take some hundred bytes an id
# Fixed value: the pattern this module knows to be cut at blanks, and between a letter or digit and other marks.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
TAIL = ".,!|*$#%&?;:"  # marks that a word sheds before it is looked up


class TokenFiles(NamedTuple):
    """Where the files are and one manifest row per shard."""

    path: str
    manifest: DataFrame


class Pieces(dict):
    """Ids of the word pieces seen so far as one flat array; notes the pieces it lacks. Piece 0 is empty."""

    def __init__(self):
        super().__init__({"": 0})
        self.flat, self.length, self.start = np.zeros(0, dtype=np.uint32), np.zeros(1, dtype=np.int32), np.zeros(1, dtype=np.int64)
        self.new: list[str] = []
        self.chars = 0

    def __missing__(self, piece: str) -> int:
        self[piece] = place = len(self)
        self.new.append(piece)
        self.chars += len(piece)
        return place

    def learn(self, tokenizer, letters, ends: np.ndarray) -> None:
        if not self.new:
            return
        lengths, starts, ids = _encode_pieces(self.new, tokenizer, letters, ends)
        self.start = np.concatenate([self.start, len(self.flat) + starts])
        self.length = np.concatenate([self.length, lengths.astype(np.int32)])
        self.flat = np.concatenate([self.flat, ids])
        self.new = []

    def keep(self, places: np.ndarray) -> None:
        """Forget all pieces but these (ascending, piece 0 among them), which are numbered anew in their order."""
        names = list(self)
        self.length, self.flat = self.length[places], self.flat[ragged(self.length[places], self.start[places])]
        self.start = np.cumsum(self.length, dtype=np.int64) - self.length
        self.clear()
        self.update(zip([names[i] for i in places], range(len(places)), strict=True))
        self.chars = sum(map(len, self))


class Words(dict):
    """The two pieces of the words seen so far; notes the words it lacks."""

    def __init__(self):
        super().__init__()
        self.pairs, self.uses = np.zeros((0, 2), dtype=np.int32), np.zeros(0, dtype=np.int64)
        self.new: list[str] = []
        self.chars = 0

    def __missing__(self, word: str) -> int:
        self[word] = place = len(self)
        self.new.append(word)
        self.chars += len(word)
        return place

    def learn(self, pieces: Pieces) -> None:
        cut = chain.from_iterable(map(_cut, self.new))
        found = np.fromiter(map(pieces.__getitem__, cut), dtype=np.int32, count=2 * len(self.new))
        self.pairs = np.concatenate([self.pairs, found.reshape(-1, 2)])
        self.uses = np.concatenate([self.uses, np.zeros(len(self.new), dtype=np.int64)])
        self.new = []

    def keep_most_used(self) -> None:
        """Forget the less used half, by number, by pieces and by characters, and what was used once. Old uses count half."""
        names = list(self)
        order = np.argsort(-self.uses, kind="stable")
        order = order[self.uses[order] > 1][: CACHED_WORDS // 2]
        # Where in this order each piece is named first; the word that names one too many ends it.
        first = np.sort(np.unique(self.pairs[order], return_index=True)[1]) // 2
        if len(first) > CACHED_PIECES // 2:
            order = order[: first[CACHED_PIECES // 2]]
        chars = np.cumsum(np.array([len(names[i]) for i in order], dtype=np.int64))
        places = np.sort(order[chars <= CACHED_CHARS // 2])
        self.pairs, self.uses = self.pairs[places], self.uses[places] // 2
        self.clear()
        self.update(zip([names[i] for i in places], range(len(places)), strict=True))
        self.chars = sum(map(len, self))


class Encoder:
    """The library's tokenizer with what the worker remembers of it."""

    def __init__(self, tokenizer_json: str):
        self.tokenizer, self.pieces, self.words = _load(tokenizer_json), Pieces(), Words()
        # None: the tokenizer is not one whose words can be told apart beforehand; texts are encoded whole.
        self.ends = _word_ends(self.tokenizer) if cuts_at_words(tokenizer_json) else None
        self.letters = None if self.ends is None else _letters(self.tokenizer)

    def shrink(self) -> None:
        """Bound the memory: the most used words stay, and the pieces these name. A word has two pieces at most."""
        words, pieces = self.words, self.pieces
        if len(words) > CACHED_WORDS or len(pieces) > CACHED_PIECES or max(words.chars, pieces.chars) > CACHED_CHARS:
            words.keep_most_used()
            named = np.zeros(len(pieces), dtype=bool)
            named[words.pairs], named[0] = True, True
            pieces.keep(np.flatnonzero(named))
            words.pairs = (np.cumsum(named, dtype=np.int32) - 1)[words.pairs]


def cuts_at_words(tokenizer_json: str) -> bool:
    """Does this tokenizer never join characters across a blank, nor a letter or digit and the marks behind it?

    Told from its file: the normalizers, the pattern and the mark of a word's end must be the known ones, and special
    strings must take no neighbours with them.
    """
    spec = json.loads(tokenizer_json)
    normalizer = spec.get("normalizer") or {"type": "Sequence", "normalizers": []}
    steps = normalizer.get("normalizers", [normalizer])
    blanks = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
    if any(step != blanks and step not in ({"type": "NFC"}, {"type": "Lowercase"}) for step in steps):
        return False
    cutter = spec.get("pre_tokenizer") or {}
    parts = cutter.get("pretokenizers", [cutter])
    split = {"type": "Split", "pattern": {"Regex": WORD_PATTERN}, "behavior": "Removed", "invert": True}
    if len(parts) != 2 or parts[0] != split or parts[1].get("type") != "ByteLevel" or parts[1].get("use_regex") or parts[1].get("add_prefix_space"):
        return False
    special = spec.get("added_tokens") or []
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or " " in t["content"] or "<" not in t["content"] or t["content"][-1] in TAIL for t in special):
        return False
    model = spec["model"]
    return model.get("type") == "BPE" and bool(model.get("end_of_word_suffix")) and not model.get("dropout")


def _encode_pieces(pieces: list[str], tokenizer, letters, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of ids of every piece, where they begin, and the ids of all pieces, from bounded calls of the library."""
    places, lengths, flat = [], [], []
    for at in range(0, len(pieces), ENCODED_AT_ONCE):
        for some, sizes, ids in _encode_some(pieces[at : at + ENCODED_AT_ONCE], tokenizer, letters, ends):
            places.append(np.array(some, dtype=np.int64) + at)
            lengths.append(sizes)
            flat.append(ids)
    place, length = np.concatenate(places), np.concatenate(lengths)
    lengths_of, starts_of = np.zeros((2, len(pieces)), dtype=np.int64)
    lengths_of[place], starts_of[place] = length, np.cumsum(length) - length
    return lengths_of, starts_of, np.concatenate(flat)


def _encode_some(pieces: list[str], tokenizer, letters, ends: np.ndarray) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Numbers of some pieces, how many ids each has, and these ids end to end, until every piece was given out.

    Pieces of letters alone are joined by blanks and encoded many at a time: each gives one
    pre-token, whose last id carries the mark of a word's end. Those of lower-case ASCII letters, which neither the
    normalizers nor the byte mapping change, go to ``letters``.
    """
    # A capital I with a dot falls apart when it is lowered; such pieces go one by one.
    plain = [i for i, p in enumerate(pieces) if p.isalpha() and "\u0130" not in p]
    unchanged = [i for i in plain if pieces[i].isascii() and pieces[i].islower()]
    done, fixed = set(plain), set(unchanged)
    singles = [i for i in range(len(pieces)) if i not in done]
    for some, encoder in ((unchanged, letters), ([i for i in plain if i not in fixed], tokenizer)):
        groups = [some[i : i + 256] for i in range(0, len(some), 256)]
        for group, ids in zip(groups, _ids([" ".join([pieces[i] for i in g]) for g in groups], encoder), strict=True):
            ids = np.array(ids, dtype=np.uint32)
            cuts = np.flatnonzero(ends[ids]) + 1
            if len(cuts) == len(group):
                cuts[-1] = len(ids)
                yield group, np.diff(cuts, prepend=0), ids
            else:  # not one pre-token per piece after all
                singles += group
    found = _ids([pieces[i] for i in singles], tokenizer)
    ids = np.fromiter((i for one in found for i in one), dtype=np.uint32)
    yield singles, np.fromiter(map(len, found), dtype=np.int64, count=len(found)), ids


def _ids(texts: list[str], tokenizer) -> list[list[int]]:
    """Ids of every text; without offsets where the library can leave them out."""
    encode = getattr(tokenizer, "encode_batch_fast", None) or tokenizer.encode_batch
    return [one.ids for one in encode(texts, add_special_tokens=False)]


def _letters(tokenizer):
    """The same model behind a cut at blanks alone."""
    from tokenizers import Tokenizer, pre_tokenizers

    plain = Tokenizer(tokenizer.model)
    plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    return plain


def _word_ends(tokenizer) -> np.ndarray:
    """Which ids end a word."""
    mark = tokenizer.model.end_of_word_suffix
    vocab = tokenizer.get_vocab(with_added_tokens=False)
    ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
    ends[[i for token, i in vocab.items() if token.endswith(mark)]] = True
    return ends


def _load(tokenizer_json: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores belong to Spark's tasks
    from tokenizers import Tokenizer

    return Tokenizer.from_str(tokenizer_json)


def _cut(word: str) -> tuple[str, str]:
    """A word and the marks behind it, where the tokenizer's pattern also cuts; ASCII in lower case.

    It cuts behind an ASCII letter or digit. Other letters may end in a combining mark once they are normalized, which
    the pattern takes together with the marks, so a word that ends in one stays whole.
    """
    if word.isalpha() and (word.islower() or not word.isascii()):
        return word, ""
    core = word.rstrip(TAIL)
    if not core or not (core[-1].isascii() and core[-1].isalnum()):
        core = word
    # Special strings are told by their case, so what may hold one keeps it.
    plain = core.lower() if core.isascii() and "<" not in core else core
    # A word that is its own piece is held once.
    return word if plain == word else plain, word[len(core) :]


def encode_slice(texts: list[str | None], encoder: Encoder) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts end to end, each with the end mark, and the number of ids of each."""
    if encoder.ends is None:
        found = [np.array(e.ids, dtype=np.uint32) for e in encoder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        lengths = np.array([len(x) + 1 for x in found], dtype=np.int64)
        end = np.array([END_ID], dtype=np.uint32)
        return np.concatenate([x for ids in found for x in (ids, end)] or [end[:0]]), lengths
    words, pieces = encoder.words, encoder.pieces
    places: list[np.ndarray] = []
    for text in texts:
        some = (text or "").replace("\n", " ").split(" ")
        places.append(np.fromiter(map(words.__getitem__, some), dtype=np.int32, count=len(some)))
    words.learn(pieces)
    pieces.learn(encoder.tokenizer, encoder.letters, encoder.ends)
    per_text = np.fromiter(map(len, places), dtype=np.int64, count=len(places))
    found = np.concatenate([np.zeros(0, dtype=np.int32), *places])
    words.uses += np.bincount(found, minlength=len(words))
    piece = words.pairs[found].ravel()
    lengths = pieces.length[piece]
    ids = pieces.flat[ragged(lengths, pieces.start[piece])]
    ends = np.concatenate([[0], np.cumsum(lengths)])[2 * np.cumsum(per_text)]
    encoder.shrink()
    return np.insert(ids, ends, END_ID), np.diff(np.concatenate([[0], ends])) + 1


def _opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def token_schema(kind: pa.DataType) -> pa.Schema:
    return pa.schema([("input_ids", pa.list_(kind, ROW_LENGTH)), ("mask", pa.list_(pa.bool_(), ROW_LENGTH))])


DOC_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def _rows(ids: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
    """Full rows of ids; the last one is padded with id 0 outside the mask."""
    short = -len(ids) % ROW_LENGTH
    mask = np.ones(len(ids) + short, dtype=bool)
    mask[len(ids) :] = False
    padded = np.concatenate([ids, np.zeros(short, dtype=ids.dtype)])
    arrays = [
        pa.FixedSizeListArray.from_arrays(pa.array(padded, schema.field("input_ids").type.value_type), ROW_LENGTH),
        pa.FixedSizeListArray.from_arrays(pa.array(mask), ROW_LENGTH),
    ]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def _writer(tokenizer_json, folder: str):
    shipped = tokenizer_json

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        shard = task.partitionId()
        encoder = kept(f"encoder-{hashlib.md5(shipped.value.encode()).hexdigest()}", lambda: Encoder(shipped.value))
        files, root = _opened(folder)
        files.create_dir(root, recursive=True)
        final = [f"{root}/shard-{shard:05d}.{kind}.arrow" for kind in ("tokens", "docs")]
        trial = [f"{name}.{task.taskAttemptId()}" for name in final]
        docs = tokens = 0
        # The narrowest type that holds every id of the vocabulary.
        narrow = np.uint16 if encoder.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        schema = token_schema(pa.from_numpy_dtype(narrow))
        rest = np.zeros(0, dtype=narrow)
        block = ROW_LENGTH * BATCH_ROWS
        with (
            files.open_output_stream(trial[0]) as token_file,
            files.open_output_stream(trial[1]) as doc_file,
            pa.ipc.new_file(token_file, schema) as token_out,
            pa.ipc.new_file(doc_file, DOC_SCHEMA) as doc_out,
        ):
            for batch in slices(batches, limit=SLICE_TEXTS):
                ids, lengths = encode_slice(batch.column("text").to_pylist(), encoder)
                starts = tokens + np.cumsum(lengths) - lengths
                doc_out.write_batch(
                    pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(starts), pa.array(lengths)], schema=DOC_SCHEMA)
                )
                docs, tokens = docs + batch.num_rows, tokens + len(ids)
                rest = np.concatenate([rest, ids.astype(narrow)])
                full = len(rest) // block * block
                for at in range(0, full, block):
                    token_out.write_batch(_rows(rest[at : at + block], schema))
                rest = rest[full:]
            if len(rest):
                token_out.write_batch(_rows(rest, schema))
        for here, there in zip(trial, final, strict=True):
            files.move(here, there)
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([docs]), pa.array([tokens])], names=["shard", "n_docs", "n_tokens"])

    return run


def write_token_files(documents: DataFrame, tokenizer_json: str, folder: str | None = None) -> TokenFiles:
    """Encode all documents in ascending ``doc_id`` order and write the files.

    ``folder`` is a URI that all executors reach; by default a fresh one in the session's
    shared folder. The tokenizer text (fixed size) is broadcast.
    """
    spark = documents.sparkSession
    folder = folder or scratch_path(spark, f"tokens-{uuid.uuid4().hex}")
    shipped = spark.sparkContext.broadcast(tokenizer_json)
    ordered = documents.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    written = ordered.mapInArrow(_writer(shipped, folder), "shard int, n_docs bigint, n_tokens bigint")
    return TokenFiles(folder, settle(written))


def _batch_arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Ids (a view of the file's own buffer) and mask (unpacked from bits)."""
    ids = batch.column("input_ids").flatten().to_numpy(zero_copy_only=True)
    return ids, batch.column("mask").flatten().to_numpy(zero_copy_only=False)


def read_rows(folder: str, shard: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and mask of a shard, batch by batch."""
    files, root = _opened(folder)
    with files.open_input_file(f"{root}/shard-{shard:05d}.tokens.arrow") as source:
        reader = pa.ipc.open_file(source)
        for i in range(reader.num_record_batches):
            yield _batch_arrays(reader.get_batch(i))


def read_row(folder: str, shard: int, row: int) -> tuple[np.ndarray, np.ndarray]:
    """One row by its number; only its record batch is read."""
    files, root = _opened(folder)
    with files.open_input_file(f"{root}/shard-{shard:05d}.tokens.arrow") as source:
        ids, mask = _batch_arrays(pa.ipc.open_file(source).get_batch(row // BATCH_ROWS).slice(row % BATCH_ROWS, 1))
        return ids.copy(), mask


def _reader(folder: str):
    def documents_of(shard: int) -> Iterator[pa.RecordBatch]:
        files, root = _opened(folder)
        blocks = read_rows(folder, shard)
        ids, begin = np.zeros(0, dtype=np.uint32), 0  # the unread ids and the place of the first
        with files.open_input_file(f"{root}/shard-{shard:05d}.docs.arrow") as source:
            reader = pa.ipc.open_file(source)
            for i in range(reader.num_record_batches):
                batch = reader.get_batch(i)
                sums = []
                for start, n in zip(batch.column("start").to_pylist(), batch.column("n_tokens").to_pylist(), strict=True):
                    check, at, stop = 0, start, start + n
                    while at < stop:
                        if at >= begin + len(ids):
                            begin += len(ids)
                            block, mask = next(blocks)
                            ids = block[mask].astype("<u4")
                            continue
                        until = min(stop, begin + len(ids))
                        check = zlib.crc32(ids[at - begin : until - begin].tobytes(), check)
                        at = until
                    sums.append(check)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(batch.num_rows, shard, dtype=np.int32)), *batch.columns, pa.array(sums, pa.int64())],
                    names=["shard", *DOC_SCHEMA.names, "ids_crc32"],
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column("shard").to_pylist():
                yield from documents_of(shard)

    return run


def read_documents(files: TokenFiles) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files.

    ``start`` counts the ids of all shards before. The manifest has one short row per
    shard, so its running total is one small task.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = files.manifest.select("shard", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("_before"))
    shards = files.manifest.where("n_docs > 0").select("shard")
    found = shards.repartition("shard").mapInArrow(_reader(files.path), "shard int, doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    return found.join(F.broadcast(offsets), "shard").select("doc_id", (F.col("start") + F.col("_before")).alias("start"), "n_tokens", "ids_crc32")
