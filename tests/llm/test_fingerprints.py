"""Order MinHash (9) against a plain version, and the pairing of neighbours."""

import hashlib
import random
import struct
import time
from collections import Counter

import pytest
import regex
import xxhash
from conftest import made_text, rows
from pyspark.sql import functions as F

from plurivote.llm import order_minhash as O
from plurivote.llm.queries import QUERIES


def h64(*parts):
    seed = 42
    for p in parts:
        if isinstance(p, str):
            seed = xxhash.xxh64_intdigest(p.encode(), seed)
        else:
            seed = xxhash.xxh64_intdigest(struct.pack(p[0], p[1]), seed)
    return seed


def plain(text):
    pieces = regex.findall(r"\p{Lo}|[^\x20\x09-\x0D\p{Lo}]{1,5}", text or "")
    grams = [pieces[i : i + O.K] for i in range(max(1, len(pieces) - O.K + 1))] if pieces else []
    seen, numbered = Counter(), []
    for place, gram in enumerate(grams):
        kmer = (h64(*gram) >> 1) >> O.PLACE_BITS
        n = seen[kmer]
        seen[kmer] += 1
        if n:
            kmer_n = (h64(("<q", kmer), ("<i", n)) >> 1) >> O.PLACE_BITS
        else:
            kmer_n = kmer
        numbered.append((kmer_n << O.PLACE_BITS) | place)
    out = []
    for j in range(O.SKETCHES):
        near = sorted(numbered, key=lambda x: x ^ (j << O.SLICE_SHIFT))[: O.TUPLE]
        in_text_order = sorted((x & ((1 << O.PLACE_BITS) - 1), x >> O.PLACE_BITS) for x in near)
        out.append(f"{h64(*[('<q', k) for _, k in in_text_order]) & 0xFFFFFFFF:08X}")
    return "".join(out)


TEXTS = ["a b c d e f g", "a a a a a a a a", "x", "x y", "", None, " \t", made_text(1, 300), ("la li lu " * 50) + made_text(4, 9), "é " * 40, "日本語のテキスト漢字仮名交じり文", "x=foo(bar,baz);return(x)", "🎉" * 12]


def test_same_as_plain(spark):
    table = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, text string")
    for r in table.select("i", "text", O.fingerprint(F.col("text")).alias("f")).collect():
        assert r["f"] == plain(r["text"]), r["text"]


def test_falls_with_edits_and_order(spark):
    text = made_text(5, 400, tuple(f"w{i}" for i in range(300)))
    words = text.split()
    few = " ".join("new" if i % 40 == 20 else w for i, w in enumerate(words))
    half = " ".join(words[:200] + [f"n{i}" for i in range(200)])
    turned = " ".join(words[200:] + words[:200])
    table = spark.createDataFrame([(text, t) for t in (text, few, half, turned)], "a string, b string")
    like = [r[0] for r in table.select(O.likeness(O.fingerprint(F.col("a")), O.fingerprint(F.col("b")))).collect()]
    assert like[0] == 1 > like[1] > like[2] and like[3] < 0.9


@pytest.mark.parametrize("partitions", ["1", "4", "9"])
def test_neighbours(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        ids = [7, -3, 12, 100, 5, 6, 8, 9, 4000, 41, 42, 43]
        table = spark.createDataFrame([(i, f"text of {i}") for i in ids], "doc_id bigint, text string").repartition(5)
        got = {r["doc_id"]: r["next_text"] for r in O.fingerprints(table).collect()}
        order = sorted(ids)
        assert got == {a: f"text of {b}" for a, b in zip(order, order[1:] + order[:1])}
        one = spark.createDataFrame([(3, "alone")], "doc_id bigint, text string")
        assert [r["next_text"] for r in O.fingerprints(one).collect()] == ["alone"]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_edge_rows(edge, none):
    got = O.fingerprints(edge).collect()
    assert len(got) == len(rows())
    ordered = sorted(rows(), key=lambda r: (r[0] is None, r[0] or 0, (r[1] or "").encode()))
    texts = [r[1] or "" for r in ordered]
    want = sorted(((o[0], t, n) for o, t, n in zip(ordered, texts, texts[1:] + texts[:1])), key=repr)
    assert sorted(((r["doc_id"], r["text"], r["next_text"]) for r in got), key=repr) == want
    assert all(r["fingerprint"] == plain(r["text"]) and r["next_fingerprint"] == plain(r["next_text"]) for r in got)
    assert O.fingerprints(none).collect() == []


def test_query(spark, tmp_path):
    edge_rows = [(i, t) for i, t in enumerate(["", "abc", "🎉éxyz 12345678", made_text(3, 50), made_text(4, 9), made_text(3, 50)])]
    spark.createDataFrame(edge_rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in QUERIES["op9_order_minhash"](spark, str(tmp_path)).collect()}
    for i, text in edge_rows:
        following = edge_rows[(i + 1) % len(edge_rows)][1]
        k = len(text) // 4
        edited = text[: len(text) - k] + following[:k]
        assert got[i]["n_chars"] == len(text)
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i]["edited_fingerprint"] == plain(edited)
    assert got[3]["fingerprint"] == got[5]["fingerprint"]


def likeness_of(spark, pairs):
    table = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    made = table.select("i", O.likeness(O.fingerprint(F.col("a")), O.fingerprint(F.col("b"))).alias("l")).collect()
    return [r["l"] for r in sorted(made)]


def test_short_and_unspaced_texts_answer_to_edits(spark):
    rng = random.Random(2)
    han = "".join(chr(rng.randrange(0x4E00, 0x9FA0)) for _ in range(200))
    other = "".join(chr(rng.randrange(0x4E00, 0x9FA0)) for _ in range(50))
    twelve = "the of and a thing that was here for you and me"
    pairs = [("one two three four", "one two three five"), (han, han[:150] + other), (han, han[:100] + other[:1] + han[100:]), (twelve, twelve[:-2] + "us")]
    found = likeness_of(spark, pairs)
    assert all(0 < x < 1 for x in found) and found[2] > 0.8


def test_falls_as_edits_grow(spark):
    """Likeness goes down with the share of edited code points, on average over random texts."""
    rng = random.Random(6)
    shares, means = (0.005, 0.02, 0.1, 0.3), []
    texts = ["".join(rng.choice("abcdefghij    ") for _ in range(600)) for _ in range(40)]
    for share in shares:
        edits = [list(t) for t in texts]
        for chars in edits:
            for _ in range(int(share * len(chars))):
                at = rng.randrange(len(chars))
                chars[at : at + rng.randrange(2)] = rng.choice(["", "k", "m"])
        found = likeness_of(spark, [(t, "".join(e)) for t, e in zip(texts, edits, strict=True)])
        means.append(sum(found) / len(found))
    assert means[0] > means[1] > means[2] > means[3] and means[0] > 0.75 and means[3] < 0.2


def test_many_ranges(spark):
    """5,000 ranges are planned and dealt in seconds, and every document finds its follower."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "5000")
    try:
        table = spark.range(20_000).select((F.col("id") * 3).alias("doc_id"), F.lit("x").alias("text"))
        start = time.perf_counter()
        planned = O.in_order(table)
        planned._jdf.queryExecution().executedPlan()
        assert time.perf_counter() - start < 60
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert planned.coalesce(8).where("guard").count() == planned.select("part").distinct().coalesce(8).count()
