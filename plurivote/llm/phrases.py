"""Removal of passages that stand in an earlier document, by repeated-phrase automata (operator 10).

A window is 13 consecutive words. A word is removed where a window that covers it also stands in a
document with a smaller id. All windows of all documents are judged; the steps only keep small what is moved.

1. Exact copies. Of documents with one text only the one with the least id goes on; the others lose all words
   (if they have a window at all).
2. Anchors. A window's anchor is the least hash of its eight runs of six words, so equal windows have equal anchors and
   neighbouring windows mostly share one. Anchors are counted in shards; only windows whose anchor stands in
   several documents are candidates. An anchor is named by its shard and 32 bits of its hash; two anchors of one name
   only make more candidates.
3. Confirmed passages. Candidate windows are counted by hash with their least and largest document. Those in two
   documents or more recur; their words are read from their first document.
4. Automata. The recurring windows are dealt to shards by anchor, each shard's Aho-Corasick
   automaton is compiled once in its task, and the candidate stretches of all documents stream through the automaton
   of their shard. Each hit knows the window's first document.
5. The hits of a document are united and the words that stay are hashed.

A common passage meets itself only as counts: within a slice of text an anchor or window is sent once, aggregates combine
before the shuffle, and a shard with more stretches than the mean is dealt to several
tasks, each with the shard's automaton. No document is compared with another.

Words are told apart by 64-bit hashes, and by 32 bits of them per word (416 bits a window) in the automata.

Defined cases: a null text has no words; rows with a null id are neither judged nor a source; rows that share an id are each
judged against smaller ids only; a document of fewer than 13 words keeps all; repeats inside one document stay;
empty tables give empty results; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plurivote.llm.arrow import ragged, slices, text_buffers
from plurivote.llm.words import mix, runs, sliding_min, whole_runs, word_hashes, word_spans
from plurivote.session import settle

WINDOW = 13
RUN = 6  # words of an anchor
SHARDS_PER_PARTITION = 4


def _names(anchor: np.ndarray, shards: int) -> np.ndarray:
    """Names of anchors: the shard in the upper 32 bits, the lower 32 bits of the hash below it. The upper bits of the hash
    give the shard, so the two are independent."""
    return (anchor >> np.uint64(32)) % np.uint64(shards) << np.uint64(32) | anchor & np.uint64(0xFFFFFFFF)


def _shard(names: np.ndarray) -> np.ndarray:
    return (names >> np.uint64(32)).astype(np.int64)


class Windows:
    """All windows of a slice: place of the first word, text, name of the anchor and hash."""

    def __init__(self, column: pa.Array, shards: int):
        data, bounds = text_buffers(column)
        begins, ends, self.first = word_spans(data, bounds)
        self.words = word_hashes(data, begins, ends)
        self.place, self.text = whole_runs(self.first, WINDOW)
        if len(self.place):
            self.anchor = _names(sliding_min(runs(self.words, RUN), WINDOW - RUN + 1)[self.place], shards)
        else:
            self.anchor = np.zeros(0, dtype=np.uint64)

    def hashes(self, chosen: np.ndarray) -> np.ndarray:
        return runs(self.words, WINDOW)[self.place[chosen]] if len(self.place) else self.anchor

    def stretches(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Runs of neighbouring chosen windows with one anchor: text, place of the first word, number of words, anchor."""
        at, text, anchor = self.place[chosen], self.text[chosen], self.anchor[chosen]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (text[1:] != text[:-1]) | (anchor[1:] != anchor[:-1])
        start = np.flatnonzero(new)
        count = np.diff(np.append(start, len(at)))
        return text[start], at[start], count + WINDOW - 1, anchor[start]


def _marked(values: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Values bound to their text, to look up pairs."""
    return mix(values ^ mix(text.astype(np.uint64) + np.uint64(1)))


def _listed(windows: Windows, values: np.ndarray, lists: pa.Array) -> np.ndarray:
    """Places of the windows whose value is in the list of their own text."""
    held = pa.array(lists).cast(pa.list_(pa.int64()))
    lengths = np.array([len(x) if x is not None else 0 for x in held.to_pylist()]) if held.null_count else np.diff(held.offsets.to_numpy())
    flat = held.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    known = _marked(flat, np.repeat(np.arange(len(lengths)), lengths))
    return np.flatnonzero(np.isin(_marked(values, windows.text), known))


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64) if x.dtype == np.uint64 else x, pa.int64())


def _by_shard(shard: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in range(shards):
        if cuts[s] < cuts[s + 1]:
            yield s, order[cuts[s] : cuts[s + 1]]


ANCHORS = pa.schema(
    [
        ("shard", pa.int32()),
        ("known", pa.bool_()),
        ("ids", pa.list_(pa.int64())),
        ("anchors", pa.list_(pa.int32())),
        ("shards", pa.list_(pa.int32())),
        ("many", pa.list_(pa.bool_())),
    ]
)
ANCHOR_DDL = "shard int, known boolean, ids array<bigint>, anchors array<int>, shards array<int>, many array<boolean>"


def _anchors(shards: int):
    """Anchors of a slice by shard, as the lower half of their names. One that stands in several documents of the slice is sent
    to its shard once, marked ``many``, and its documents go straight on as ``known`` with both halves, dealt by slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in enumerate(slices(batches)):
            windows = Windows(batch.column("text"), shards)
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)[windows.text]
            anchor = windows.anchor
            fresh = np.ones(len(anchor), dtype=bool)
            fresh[1:] = (anchor[1:] != anchor[:-1]) | (ids[1:] != ids[:-1])
            anchor, ids = anchor[fresh], ids[fresh]
            if not len(anchor):
                continue
            order = np.lexsort((ids, anchor))
            anchor, ids = anchor[order], ids[order]
            keep = np.ones(len(anchor), dtype=bool)
            keep[1:] = (anchor[1:] != anchor[:-1]) | (ids[1:] != ids[:-1])
            anchor, ids = anchor[keep], ids[keep]
            start = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
            count = np.diff(np.append(start, len(anchor)))
            several = np.repeat(count > 1, count)
            half = anchor.astype(np.uint32).view(np.int32)
            none = np.zeros(0, dtype=np.int32)
            rows = [(number % shards, True, ids[several], half[several], _shard(anchor[several]).astype(np.int32), none.astype(bool))] if several.any() else []
            one, one_id, many = half[start], ids[start], count > 1
            for shard, members in _by_shard(_shard(anchor[start]), shards):
                rows.append((shard, False, one_id[members], one[members], none, many[members]))
            columns = [pa.array([r[i] for r in rows], field.type) for i, field in enumerate(ANCHORS)]
            yield pa.RecordBatch.from_arrays(columns, schema=ANCHORS)

    return run


def _recurring(group: pa.Table) -> pa.Table:
    """Documents and anchors of a shard, of the anchors that stand in several documents."""
    group = group.combine_chunks()
    here = group.column("shard")[0].as_py()
    known = group.filter(group.column("known"))
    open_ = group.filter(pc.invert(group.column("known")))

    def flat(table: pa.Table, name: str) -> np.ndarray:
        return table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)

    def whole(table: pa.Table, shard) -> np.ndarray:
        return shard << np.int64(32) | flat(table, "anchors").view(np.uint32).astype(np.int64)

    ids, anchors, many = flat(open_, "ids"), whole(open_, np.int64(here)), flat(open_, "many").astype(bool)
    order = np.lexsort((ids, anchors))
    ids, anchors, many = ids[order], anchors[order], many[order]
    if len(anchors):
        start = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]]))
        count = np.diff(np.append(start, len(anchors)))
        recurs = (np.maximum.reduceat(ids, start) != np.minimum.reduceat(ids, start)) | np.logical_or.reduceat(many, start)
        send = np.repeat(recurs, count) & ~many
        ids, anchors = ids[send], anchors[send]
    ids, anchors = np.concatenate([ids, flat(known, "ids")]), np.concatenate([anchors, whole(known, flat(known, "shards").astype(np.int64))])
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "anchor": pa.array(anchors, pa.int64())})


def _candidates(shards: int):
    """Hashes of the candidate windows of a slice, each once, with its least and largest document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            windows = Windows(batch.column("text"), shards)
            chosen = _listed(windows, windows.anchor, batch.column("anchors"))
            if not len(chosen):
                continue
            ids = batch.column("doc_id").to_numpy()[windows.text[chosen]]
            w = windows.hashes(chosen)
            order = np.argsort(w)
            w, ids = w[order], ids[order]
            start = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
            yield pa.RecordBatch.from_arrays(
                [_longs(w[start]), _longs(np.minimum.reduceat(ids, start)), _longs(np.maximum.reduceat(ids, start))], names=["w", "least", "largest"]
            )

    return run


STRETCHES = pa.schema(
    [
        ("shard", pa.int32()),
        ("kind", pa.int32()),
        ("salt", pa.int32()),
        ("ids", pa.list_(pa.int64())),
        ("texts", pa.list_(pa.int64())),
        ("places", pa.list_(pa.int32())),
        ("lengths", pa.list_(pa.int32())),
        ("words", pa.list_(pa.int32())),
    ]
)
STRETCH_DDL = "shard int, kind int, salt int, ids array<bigint>, texts array<bigint>, places array<int>, lengths array<int>, words array<int>"


def _stretches(kind: int, by_hash: bool, shards: int, salts):
    """Stretches of a slice by shard: of the recurring windows (kind 0) or of all candidates (kind 1).

    Phrases go to every salt of their shard, without text and place; the stretches of a document to one of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times = salts.value
        for number, batch in enumerate(slices(batches)):
            windows = Windows(batch.column("text"), shards)
            values = windows.hashes(np.arange(len(windows.place))) if by_hash else windows.anchor
            chosen = _listed(windows, values, batch.column("listed" if by_hash else "anchors"))
            if not len(chosen):
                continue
            text, place, length, anchor = windows.stretches(chosen)
            short = (windows.words >> np.uint64(32)).astype(np.uint32).view(np.int32)
            ids, texts = batch.column("doc_id").to_numpy(), batch.column("h").to_numpy()
            rows = []
            for shard, members in _by_shard(_shard(anchor), shards):
                t, p, n = text[members], place[members], length[members]
                where = (texts[t], (p - windows.first[t]).astype(np.int32)) if kind else (texts[:0], place[:0])
                arrays = (ids[t], *where, n.astype(np.int32), short[ragged(n, p)])
                for salt in range(times[shard]) if kind == 0 else [number % times[shard]]:
                    rows.append((shard, kind, salt, *arrays))
            columns = [pa.array([r[i] for r in rows], field.type) for i, field in enumerate(STRETCHES)]
            yield pa.RecordBatch.from_arrays(columns, schema=STRETCHES)

    return run


def _as_text(words: np.ndarray) -> str:
    """Two characters per word, of its upper 12 and its lower 20 bits; they come from different planes, so a word never begins
    in the middle of one.

    The automaton looks through a node's children one by one, and the root is asked for every word that goes on no phrase:
    the first character has few values.
    """
    bits = words.view(np.uint32)
    points = np.empty((len(bits), 2), dtype="<u4")
    points[:, 0] = (bits >> 20) + 0x1000
    points[:, 1] = (bits & 0xFFFFF) + 0x10000
    return points.tobytes().decode("utf-32-le")


class Automaton:
    """The recurring windows of a shard; each leads to its first document."""

    def __init__(self, phrases: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        for ids, lengths, words in phrases:
            text, at = _as_text(words), 0
            for doc_id, n in zip(ids.tolist(), lengths.tolist(), strict=True):
                for start in range(at, at + n - WINDOW + 1):
                    # A window comes from its first document alone, so a repeat has the same value.
                    self.machine.add_word(text[2 * start : 2 * (start + WINDOW)], doc_id)
                at += n
        if len(self.machine):
            self.machine.make_automaton()

    def hits(self, words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Stretch, place of the window in it, and first document of every occurrence."""
        if not len(self.machine):
            return (np.zeros(0, dtype=np.int64),) * 3
        found = [pair for pair in self.machine.iter(_as_text(words))]
        end = np.array([e for e, _ in found], dtype=np.int64)
        first = np.array([d for _, d in found], dtype=np.int64)
        begin = (end + 1) // 2 - WINDOW
        starts = np.cumsum(lengths) - lengths
        stretch = np.searchsorted(starts, begin, side="right") - 1
        inside = begin + WINDOW <= starts[stretch] + lengths[stretch] if len(begin) else np.zeros(0, dtype=bool)
        return stretch[inside], (begin - starts[stretch])[inside], first[inside]


def _lists(batch: pa.RecordBatch, row: int, name: str, kind) -> np.ndarray:
    return batch.column(name)[row].values.to_numpy(zero_copy_only=False).astype(kind)


def _locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stream stretches through the automaton of their shard. Rows come by shard and salt, phrases first."""
    here, phrases, automaton = None, [], None
    for batch in batches:
        out = []
        keys = list(zip(batch.column("shard").to_pylist(), batch.column("salt").to_pylist(), batch.column("kind").to_pylist(), strict=True))
        for row, (shard, salt, kind) in enumerate(keys):
            if (shard, salt) != here:
                here, phrases, automaton = (shard, salt), [], None
            ids, lengths, words = _lists(batch, row, "ids", np.int64), _lists(batch, row, "lengths", np.int64), _lists(batch, row, "words", np.int32)
            if kind == 0:
                phrases.append((ids, lengths, words))
                continue
            if automaton is None:
                automaton = Automaton(phrases)
                phrases = []
            stretch, place, first = automaton.hits(words, lengths)
            earlier = first < ids[stretch]
            stretch, place = stretch[earlier], place[earlier]
            if not len(stretch):
                continue
            begin = _lists(batch, row, "places", np.int64)[stretch] + place
            texts = _lists(batch, row, "texts", np.int64)[stretch]
            # Windows that follow each other in one stretch are sent as one span.
            new = np.ones(len(begin), dtype=bool)
            new[1:] = (stretch[1:] != stretch[:-1]) | (begin[1:] != begin[:-1] + 1)
            start = np.flatnonzero(new)
            stop = np.append(start[1:], len(begin)) - 1
            out.append((ids[stretch][start], texts[start], begin[start], begin[stop] + WINDOW))
        if out:
            columns = [_longs(np.concatenate(c)) for c in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "h", "begin", "end"])


REPORT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])


def _report(with_text: bool):
    schema = pa.schema([*REPORT, ("kept_text", pa.string())]) if with_text else REPORT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, bounds = text_buffers(batch.column("text"))
            begins, ends, first = word_spans(data, bounds)
            raw = data.tobytes()
            hs, copies, spans = (batch.column(n).to_pylist() for n in ("h", "copy", "spans"))
            removed, sums, texts = [], [], []
            for row, (h, copy) in enumerate(zip(hs, copies, strict=True)):
                a, b = int(first[row]), int(first[row + 1])
                stay = np.ones(b - a, dtype=bool)
                if copy and b - a >= WINDOW:
                    stay[:] = False
                for span in spans[row] or ():
                    if span["h"] == h:
                        stay[span["begin"] : span["end"]] = False
                left = np.flatnonzero(stay) + a
                kept = b" ".join([raw[x:y] for x, y in zip(begins[left].tolist(), ends[left].tolist(), strict=True)])
                removed.append(b - a - len(left))
                sums.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    texts.append(kept.decode())
            columns = [batch.column("doc_id"), pa.array(np.diff(first), pa.int64()), pa.array(removed, pa.int64()), pa.array(sums, pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())] if with_text else columns, schema=schema)

    return run


def remove_repeats(documents: DataFrame, with_text: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every row; ``with_text`` adds the kept words, joined by one blank."""
    spark = documents.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(1, partitions * SHARDS_PER_PARTITION)
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    named = rows.withColumn("h", F.xxhash64("text"))
    # Rows with an id go through the joins; all of these read one exchange of the texts.
    keyed, unnamed = named.where("doc_id IS NOT NULL"), named.where("doc_id IS NULL")

    # 1. Copies: rows whose text stands under a smaller id. The groups are aggregated, never gathered.
    narrow = settle(keyed.select("doc_id", "h", F.xxhash64(F.lit(1), "text").alias("h2")))
    groups = narrow.groupBy("h", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    copies = narrow.join(groups, ["h", "h2"]).where("doc_id > first").groupBy("doc_id").agg(F.collect_set("h").alias("copied"))

    # 2. Anchors that stand in several documents, as a list per document.
    found = keyed.select("doc_id", "text").mapInArrow(_anchors(shards), ANCHOR_DDL)
    recurring = found.groupBy("shard").applyInArrow(_recurring, "doc_id bigint, anchor bigint")
    lists = settle(recurring.groupBy("doc_id").agg(F.collect_list("anchor").alias("anchors")))

    # How many tasks share a shard's stretches: one row of counts per shard, as many as a few per partition.
    per_shard = lists.select(F.explode("anchors").alias("a"))
    counts = {r[0]: r[1] for r in per_shard.groupBy(F.shiftright("a", 32).cast("int")).count().collect()}
    mean = max(1.0, sum(counts.values()) / shards)
    salts = spark.sparkContext.broadcast([max(1, round(counts.get(s, 0) / mean)) for s in range(shards)])

    # Texts with what is known of them; one exchange on the id serves all that follows.
    marked = keyed.join(copies, "doc_id", "left").withColumn("copy", F.coalesce(F.array_contains("copied", F.col("h")), F.lit(False))).drop("copied")
    sources = marked.where("NOT copy").select("doc_id", "h", "text").join(lists, "doc_id")

    # 3. Windows that stand in several documents, with their first document.
    windows = sources.select("doc_id", "text", "anchors").mapInArrow(_candidates(shards), "w bigint, least bigint, largest bigint")
    confirmed = windows.groupBy("w").agg(F.min("least").alias("first"), F.max("largest").alias("last")).where("first < last")
    phrase_lists = confirmed.groupBy(F.col("first").alias("doc_id")).agg(F.collect_list("w").alias("listed"))
    phrases = marked.where("NOT copy").select("doc_id", "h", "text").join(phrase_lists, "doc_id").mapInArrow(_stretches(0, True, shards, salts), STRETCH_DDL)

    # 4. Every shard's automaton, and the documents' candidate stretches through it.
    stretches = sources.mapInArrow(_stretches(1, False, shards, salts), STRETCH_DDL)
    dealt = phrases.unionByName(stretches).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")
    spans = dealt.mapInArrow(_locate, "doc_id bigint, h bigint, begin bigint, end bigint")

    # 5. What stays of every document.
    per_doc = spans.groupBy("doc_id").agg(F.collect_list(F.struct("h", "begin", "end")).alias("spans"))
    kinds = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + (", kept_text string" if with_text else "")
    judged = marked.join(per_doc, "doc_id", "left").select("doc_id", "text", "h", "copy", "spans")
    others = unnamed.select("doc_id", "text", "h", F.lit(False).alias("copy"), F.lit(None).cast(judged.schema["spans"].dataType).alias("spans"))
    report = _report(with_text)
    return judged.mapInArrow(report, kinds).unionByName(others.mapInArrow(report, kinds))
