"""Near duplicates (5) and repeated passages (10) against plain versions."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import made_text, rows

from plurivote.llm import near_duplicates as N
from plurivote.llm import phrases as P
from plurivote.llm import words as W

VOCABULARY = tuple(f"w{i}" for i in range(400))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text):
    w = words(text)
    if 0 < len(w) < 5:
        return Counter([("few", *w)])
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def alike(a, b):
    x, y = shingles(a), shingles(b)
    shared = sum((x & y).values())
    return shared / max(1, sum(x.values()) + sum(y.values()) - shared)


def classes(docs):
    parent = {d: d for d, _ in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(docs):
        for b, t in docs[:i]:
            if (s or "") == (t or "") or alike(s, t) >= 0.8:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: root(d) for d, _ in docs}


def corpus():
    rng = random.Random(3)
    docs = []
    for family in range(14):
        base = made_text(family, rng.choice([3, 8, 40, 120]), VOCABULARY).split()
        for copy in range(8):
            w = list(base)
            for _ in range(copy * len(w) // 60):
                w[rng.randrange(len(w))] = f"n{rng.randrange(9999)}"
            docs.append(" ".join(w))
    rng.shuffle(docs)
    return list(enumerate(docs)) + [(500, ""), (501, None), (502, "  \n"), (503, "la " * 300), (504, "la " * 290), (505, "la " * 200)]


def test_classes_by_hand(spark):
    docs = corpus()
    table = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    got = {r["doc_id"]: r["class_id"] for r in N.near_duplicates(table).collect()}
    assert got == classes(docs)
    kept = {r["doc_id"] for r in N.one_of_each(table).collect()}
    assert kept == set(got.values())


def test_second_round_finds_what_stars_miss(spark):
    """A chain: each text is near the next one only."""
    base = made_text(1, 200, VOCABULARY).split()
    docs, w = [], list(base)
    for i in range(9):
        docs.append((i * 7 % 9, " ".join(w)))
        for j in range(i * 18, i * 18 + 18):
            w[j] = f"c{i}_{j}"
    table = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert {r["doc_id"]: r["class_id"] for r in N.near_duplicates(table).collect()} == classes(docs)


def drifting(n, words=100, step=6):
    """Texts of which each is near the next one only, with shuffled ids."""
    ids, w = list(range(n)), made_text(4, words, VOCABULARY).split()
    random.Random(n).shuffle(ids)
    for i in range(n):
        yield ids[i], " ".join(w)
        for j in range(i * step, i * step + step):
            w[j % words] = f"c{i}_{j}"


def test_a_long_chain_is_one_class(spark):
    docs = list(drifting(1000))
    assert all(alike(s, t) >= 0.8 for (_, s), (_, t) in zip(docs, docs[1:])) and all(alike(s, t) < 0.8 for (_, s), (_, t) in zip(docs, docs[2:]))
    got = N.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert len(got) == 1000 and {r["class_id"] for r in got} == {0}


@pytest.mark.parametrize("reach", [1, 2])
def test_components_of_long_chains_and_stars(spark, reach):
    ids = list(range(3000))
    random.Random(reach).shuffle(ids)
    chain, sorted_chain = ids[:1500], sorted(ids[1500:2500])
    links = [(c[i], c[i + k]) for c in (chain, sorted_chain) for k in range(1, reach + 1) for i in range(len(c) - k)]
    star = ids[2500:]
    links += [(max(star), x) for x in star if x != max(star)]
    rng = random.Random(9)
    links = [pair if rng.random() < 0.5 else pair[::-1] for pair in links]
    got = {r["id"]: r["label"] for r in N.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {x: min(part) for part in (chain, sorted_chain, star) for x in part}


def one_bucket(sign):
    """Signatures that put all texts into one bucket, with bits, where rows carry any, that differ between even and odd ids."""

    def signed(batches):
        for batch in sign(batches):
            made = {n: batch.column(n) for n in batch.schema.names}
            bits = pa.array([-(d % 2) for d in batch.column("doc_id").to_pylist()], pa.int64())
            made |= {n: bits for n in made if n.startswith("bits")} | {"bands": pa.array([[0] * N.BANDS] * batch.num_rows, pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_arrays(list(made.values()), names=list(made))

    return signed


def test_second_round_does_not_judge_by_signatures(spark, monkeypatch):
    base = made_text(1, 200, VOCABULARY).split()
    far = base[:100] + made_text(3, 100, VOCABULARY).split()
    docs = [(0, " ".join(base)), (1, " ".join(far)), (2, " ".join([*far[:-1], "end"]))]
    monkeypatch.setattr(N, "_sign", one_bucket(N._sign))
    table = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert {r["doc_id"]: r["class_id"] for r in N.near_duplicates(table).collect()} == classes(docs) == {0: 0, 1: 1, 2: 1}


def test_second_round_looks_at_outsiders_only(spark, monkeypatch):
    """300 linked copies and 4 outsiders of 3 labels: the looks grow with the copies, and no pair is given up."""
    monkeypatch.setattr(N, "SALT_ROWS", 100, raising=False)
    label = {i: 0 for i in range(300)} | {300: 300, 301: 300, 302: 302, 303: 303}
    made = [(1, 7, i, 0, lab, 0, [0], [0], 0, 50) for i, lab in label.items()]
    kinds = "band int, key bigint, id bigint, leader bigint, label bigint, apart int, lacks array<bigint>, adds array<bigint>, doubled int, weight bigint"
    members = spark.createDataFrame(made, kinds)
    outside, all_ = N._sides(members)
    assert {r["id"] for r in outside.collect()} == {300, 301, 302, 303}
    assert outside.select("band", "key", "_salt").join(all_, ["band", "key", "_salt"]).count() == 4 * 304
    got = {tuple(r) for r in N._open_pairs(members).collect()}
    assert got == {(a, b) for a in label for b in label if a < b and label[a] != label[b]}


def test_large_groups(spark):
    """Many exact and many near copies of one text."""
    base = made_text(2, 90, VOCABULARY).split()
    docs = [(i, " ".join(base)) for i in range(300)]
    for i in range(300, 500):
        w = list(base)
        w[i % 90] = f"n{i}"
        docs.append((i, " ".join(w)))
    got = N.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert len(got) == 500 and {r["class_id"] for r in got} == {0}


def test_signatures_estimate_weighted_similarity():
    for seed, share in [(1, 0.8), (2, 0.5), (3, 0.95)]:
        base = made_text(seed, 600, VOCABULARY).split()
        other = base[: int(600 * share)] + made_text(seed + 50, 600 - int(600 * share), VOCABULARY).split()
        texts = [" ".join(base), " ".join(other)]
        cells, owner, _ = N.shingle_cells(pa.array(texts))
        names = N.Darts().signatures(cells, owner, 2)
        assert abs((names[0] == names[1]).mean() - alike(*texts)) < 0.15


def test_signature_depends_on_the_text_alone():
    texts = [r[1] for r in rows()]
    cells, owner, _ = N.shingle_cells(pa.array(texts, pa.string()))
    whole = N.Darts().signatures(cells, owner, len(texts))
    for i, text in enumerate(texts):
        cells, owner, _ = N.shingle_cells(pa.array([text], pa.string()))
        assert np.array_equal(N.Darts().signatures(cells, owner, 1)[0], whole[i])


def test_near_duplicate_edge_rows(spark, edge, none):
    got = sorted((tuple(r) for r in N.near_duplicates(edge).collect()), key=repr)
    plain = {r[0]: r[1] for r in rows() if r[0] is not None}
    want = classes(sorted(plain.items()))
    assert got == sorted([(r[0], want.get(r[0])) for r in rows()], key=repr)
    kept = N.one_of_each(edge)
    assert kept.columns == edge.columns
    assert N.near_duplicates(none).collect() == [] and N.one_of_each(none).collect() == []


# ---- words ----
@pytest.mark.parametrize("text", ["", " ", "a", " a  b\t\nc ", "é x \x0b\x0c y", "x" * 200 + " " + "x" * 201])
def test_word_spans(text):
    data = np.frombuffer(text.encode(), np.uint8)
    begins, ends, first = W.word_spans(data, np.array([0, len(data)]))
    assert [data[a:b].tobytes().decode() for a, b in zip(begins, ends)] == words(text)
    hashes = W.word_hashes(data, begins, ends)
    assert len(set(hashes.tolist())) == len(set(words(text)))


def test_words_do_not_cross_texts():
    data = np.frombuffer(b"abcd", np.uint8)
    begins, ends, first = W.word_spans(data, np.array([0, 2, 2, 4]))
    assert begins.tolist() == [0, 2] and ends.tolist() == [2, 4] and first.tolist() == [0, 1, 1, 2]


def test_sliding_min():
    x = np.random.default_rng(0).integers(0, 99, 50).astype(np.uint64)
    for width in (1, 2, 3, 7, 8, 50):
        assert W.sliding_min(x, width).tolist() == [x[i : i + width].min() for i in range(50 - width + 1)]


# ---- passages ----
def removed_by_hand(docs):
    """(id, words, removed, checksum) of every row, windows judged on the input."""
    first = {}
    for d, text in docs:
        if d is None:
            continue
        w = words(text)
        for i in range(len(w) - 12):
            key = tuple(w[i : i + 13])
            first[key] = min(first.get(key, d), d)
    out = []
    for d, text in docs:
        w = words(text)
        stay = [True] * len(w)
        for i in range(len(w) - 12) if d is not None else ():
            if first[tuple(w[i : i + 13])] < d:
                stay[i : i + 13] = [False] * 13
        kept = " ".join(x for x, s in zip(w, stay) if s)
        out.append((d, len(w), stay.count(False), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def passages():
    rng = random.Random(5)
    shared = [made_text(900 + i, rng.choice([12, 13, 14, 20, 60]), VOCABULARY) for i in range(12)]
    docs = []
    for i in range(160):
        parts = [made_text(i, rng.randrange(0, 30), VOCABULARY)]
        for _ in range(rng.randrange(0, 4)):
            parts += [rng.choice(shared), made_text(1000 + i, rng.randrange(0, 8), VOCABULARY)]
        docs.append((i * 3 % 160 - 5, rng.choice([" ", "\n", "  \t"]).join(parts)))
    docs += [(400, docs[0][1]), (401, docs[0][1]), (399, docs[7][1]), (402, shared[4] * 3), (403, "la " * 40), (404, "la " * 20)]
    return docs


def test_passages_by_hand(spark):
    docs = passages()
    table = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(6)
    got = sorted((tuple(r) for r in P.remove_repeats(table).collect()), key=repr)
    assert got == removed_by_hand(docs)
    assert sum(r[2] for r in got) > 1000


def test_a_very_common_passage(spark):
    """Every document holds it, with other words around; one task per salt."""
    common = made_text(77, 20, VOCABULARY)
    docs = [(i, f"{made_text(i, 9, VOCABULARY)} {common} {made_text(i + 5000, 9, VOCABULARY)}") for i in range(400)]
    table = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(8)
    assert sorted((tuple(r) for r in P.remove_repeats(table).collect()), key=repr) == removed_by_hand(docs)


def test_passage_edge_rows(edge, none):
    docs = [(r[0], r[1]) for r in rows()]
    got = P.remove_repeats(edge, with_text=True).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got), key=repr) == removed_by_hand(docs)
    assert all(hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"] for r in got)
    assert P.remove_repeats(none).collect() == []


def test_anchors_travel_as_half_of_their_names():
    """Four bytes an anchor; shard and half give back the name that the windows are looked up by."""
    docs = [(i, made_text(i, 40, VOCABULARY)) for i in range(30)] + [(100 + i, made_text(i, 40, VOCABULARY)) for i in range(20)]
    docs += [(i, t) for i, t in zip(range(200, 210), ["short", None, *[made_text(3, 40, VOCABULARY)] * 3, *[made_text(70 + i, 14, VOCABULARY) for i in range(5)]])]
    shards = 5
    # Two slices in one case, so that equal anchors meet in a slice and between slices.
    cuts = [docs[:30], docs[30:]]
    batches = [pa.RecordBatch.from_arrays([pa.array([d for d, _ in c], pa.int64()), pa.array([t for _, t in c], pa.string())], names=["doc_id", "text"]) for c in cuts]
    sent = pa.Table.from_batches(list(P._anchors(shards)(iter(batches))))
    assert sent.schema.field("anchors").type == pa.list_(pa.int32())
    holders = {}
    for batch in batches:
        windows = P.Windows(batch.column("text"), shards)
        for text, name in zip(windows.text.tolist(), windows.anchor.view(np.int64).tolist()):
            holders.setdefault(name, set()).add(batch.column("doc_id")[text].as_py())
    wanted = {(d, name) for name, ids in holders.items() if len(ids) > 1 for d in ids}
    shard_of = sent.column("shard").to_numpy()
    found = [P._recurring(sent.filter(pa.array(shard_of == s))) for s in sorted(set(shard_of.tolist()))]
    got = {(r["doc_id"], r["anchor"]) for t in found for r in t.to_pylist()}
    assert got == wanted and len(wanted) > 100
    assert {name >> 32 for _, name in wanted} <= set(range(shards))
    assert any(name & (1 << 31) for _, name in wanted)


def test_phrases_travel_without_text_and_place():
    class Salts:
        value = [1] * 3

    text = made_text(1, 40, VOCABULARY)
    names = P.Windows(pa.array([text]), 3).anchor.view(np.int64).tolist()
    columns = {"doc_id": pa.array([7], pa.int64()), "h": pa.array([5], pa.int64()), "text": pa.array([text]), "anchors": pa.array([names], pa.list_(pa.int64()))}
    listed = pa.array([P._longs(P.Windows(pa.array([text]), 3).hashes(np.arange(28))).to_pylist()], pa.list_(pa.int64()))
    batch = pa.RecordBatch.from_pydict(columns | {"listed": listed})
    phrases = [r for b in P._stretches(0, True, 3, Salts)(iter([batch])) for r in b.to_pylist()]
    stretches = [r for b in P._stretches(1, False, 3, Salts)(iter([batch])) for r in b.to_pylist()]
    assert phrases and all(r["ids"] and r["words"] and not r["texts"] and not r["places"] for r in phrases)
    assert [(r["ids"], r["lengths"], r["words"]) for r in phrases] == [(r["ids"], r["lengths"], r["words"]) for r in stretches]
    assert all(len(r["texts"]) == len(r["places"]) == len(r["ids"]) for r in stretches)


def test_words_of_the_automaton_begin_with_few_characters():


    words = np.concatenate([np.arange(0, 1 << 32, 60_013, dtype=np.int64), [0, (1 << 31) - 1, 1 << 31, (1 << 32) - 1]]).astype(np.uint32)
    text = P._as_text(words.view(np.int32))
    begins, ends = set(text[::2]), set(text[1::2])
    assert len(text) == 2 * len(words) and not begins & ends
    assert len({text[i : i + 2] for i in range(0, len(text), 2)}) == len(set(words.tolist()))
    assert len(begins) <= 4096  # a node's children are looked through one by one
