"""Language identification (4) and benchmark decontamination (8)."""

import math
import random

import numpy as np
import pytest
from conftest import made_text, rows

from plurivote.llm import decontaminate, language_id

FR = ("le", "été", "où", "ça", "être", "queue", "eaux", "ment", "tion", "leur")


def speech(spark, n=240):
    data = [(i, made_text(i, 30, FR) if i % 3 == 0 else made_text(i, 30), "fr" if i % 3 == 0 else "en") for i in range(n)]
    return spark.createDataFrame(data, "doc_id bigint, text string, lang string")


def test_held_out_accuracy(spark):
    docs = speech(spark)
    model = language_id.fit(docs)
    assert model.languages == ["en", "fr"]
    got = language_id.identify(docs, model).select("lang", language_id.held_out().alias("held"), "language.*").collect()
    held = [r for r in got if r["held"]]
    assert len(held) > 40 and all(r["lang"] == r["lang_pred"] for r in held)
    assert all(0 <= r["score"] <= 1 and 0 < r["bits_per_byte"] < 8 for r in got)


def test_learns_only_from_its_share(spark):
    """Labels of held-out rows are never read."""
    docs = speech(spark)
    wrong = docs.selectExpr("doc_id", "text", "CASE WHEN crc32(CAST(doc_id AS string)) % 3 = 1 THEN 'zz' ELSE lang END AS lang")
    model, other = language_id.fit(docs), language_id.fit(wrong)
    assert other.languages == model.languages
    assert all(np.array_equal(a, b) for x, y in zip(model[1:], other[1:]) for a, b in zip(x, y))


def code_length_by_hand(trained, text):
    """PPM with escape C, byte by byte, with full counts."""
    counts = {}
    for t in trained:
        data = b"   " + bytes(language_id.LOWER[np.frombuffer(t.encode(), np.uint8)])
        for i in range(3, len(data)):
            for k in range(4):
                counts.setdefault(data[i - k : i], {}).setdefault(data[i], 0)
                counts[data[i - k : i]][data[i]] += 1
    data, bits = b"   " + bytes(language_id.LOWER[np.frombuffer(text.encode(), np.uint8)]), 0.0
    for i in range(3, len(data)):
        for k in range(3, -1, -1):
            seen = counts.get(data[i - k : i])
            if seen is None:
                continue
            whole, distinct = sum(seen.values()), len(seen)
            if data[i] in seen:
                bits -= math.log2(seen[data[i]] / (whole + distinct))
                break
            bits -= math.log2(distinct / (whole + distinct))
        else:
            bits += 8
    return bits


def test_code_lengths_by_hand(spark):
    trained = [made_text(1, 40), made_text(2, 40), "abc abd"]
    docs = spark.createDataFrame([(i, t, "en") for i, t in zip((1, 2, 4), trained)], "doc_id bigint, text string, lang string")
    docs = docs.where(~language_id.held_out())
    used = [r["text"] for r in docs.collect()]
    model = language_id.fit(docs)
    texts = ["the thing of", "abz q", "Ünknown é", made_text(77, 15)]
    data = "".join(texts).encode()
    bounds = np.cumsum([0] + [len(t.encode()) for t in texts])
    got = language_id.code_lengths(model, np.frombuffer(data, np.uint8), bounds)[:, 0]
    assert got == pytest.approx([code_length_by_hand(used, t) for t in texts], rel=1e-5)


def test_nothing_is_cut_from_the_trees(spark):
    """Many bytes and contexts: a small language keeps all of its own beside one with far more text."""
    rng = random.Random(3)
    wide = ["".join(chr(rng.choice((rng.randrange(1, 0xD800), rng.randrange(1, 128), rng.randrange(0x10000, 0x110000)))) for _ in range(400)) for _ in range(90)]
    small = ["ŧħīş ĩß šmäll", "żółć gęślą jaźń"]
    rows = [(3 * i, t, "big") for i, t in enumerate(wide)] + [(3 * i + 1, t, "tiny") for i, t in enumerate(small * 4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").where(~language_id.held_out())
    model = language_id.fit(docs)
    assert len(model.grams[0]) > 120 and len(model.contexts[3]) > 20_000
    used = [r["text"] for r in docs.where("lang = 'tiny'").collect()]
    texts = [*small, "żółw ŧħīş", "􏿿 plain", wide[0][:50]]
    bounds = np.cumsum([0] + [len(t.encode()) for t in texts])
    got = language_id.code_lengths(model, np.frombuffer("".join(texts).encode(), np.uint8), bounds)[:, 1]
    assert got == pytest.approx([code_length_by_hand(used, t) for t in texts], rel=1e-5)


def test_chunks_change_nothing(spark, monkeypatch):
    model = language_id.fit(speech(spark))
    texts = [r[1] or "" for r in rows()]
    data, bounds = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0] + [len(t.encode()) for t in texts])
    whole = language_id.code_lengths(model, data, bounds)
    monkeypatch.setattr(language_id, "CHUNK", 7)
    some = bounds[:8]
    assert np.allclose(language_id.code_lengths(model, data[: some[-1]], some), whole[:7])


def test_language_of_edge_rows(spark, edge, none):
    model = language_id.fit(speech(spark))
    got = language_id.identify(edge, model)
    assert got.columns == [*edge.columns, "language"] and got.count() == len(rows())
    for r in got.collect():
        has_letter = any(c.isalpha() for c in r["text"] or "")
        assert (r["language"]["lang_pred"] == "und") == (not has_letter)
    assert language_id.fit(none) is None and language_id.identify(none, model).collect() == []
    assert {r["language"]["lang_pred"] for r in language_id.identify(edge, None).collect()} == {"und"}


# ---- decontamination ----
def least_distance(item, text):
    """Least edits between the item and any part of the text, by the full table."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(item, 1):
            new.append(min(row[i] + 1, new[i - 1] + 1, row[i - 1] + (p != c)))
        row = new
        best = min(best, row[-1])
    return best


def damaged(text, edits, seed):
    rng, out = random.Random(seed), list(text)
    for _ in range(edits):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[at] = rng.choice("xyzq")
        elif kind == 1:
            del out[at]
        else:
            out.insert(at, rng.choice("xyzq"))
    return "".join(out)


def test_same_as_the_full_table(spark):
    items = [(i, made_text(100 + i, 12 + i)) for i in range(12)]
    docs = []
    for i in range(90):
        item = items[i % 12][1]
        body = made_text(i, 20) + " " + damaged(item, i % 9, i) + " " + made_text(i + 500, 20)
        docs.append((i, body.upper() if i % 4 == 0 else body.replace(" ", " \n")))
    table = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id int, text string")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontaminate.contaminated(table, bench).collect()}
    want = {}
    for d, text in docs:
        for i, item in items:
            item = decontaminate.plain(item)
            found = least_distance(item, decontaminate.plain(text))
            if found <= math.floor(decontaminate.ERROR_RATE * len(item)):
                want[d, i] = found
    assert got == want and len(want) > 30
    flags = {r["doc_id"] for r in decontaminate.flagged(table, bench).collect() if r["leak"]}
    assert flags == {d for d, _ in want}


def test_blocks_change_nothing(spark, monkeypatch):
    items = spark.createDataFrame([(i, made_text(i, 15)) for i in range(9)], "item_id int, text string")
    docs = spark.createDataFrame([(i, made_text(50, 5) + made_text(i % 12, 15)) for i in range(24)], "doc_id bigint, text string")
    whole = sorted(map(tuple, decontaminate.contaminated(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 200)
    assert sorted(map(tuple, decontaminate.contaminated(docs, items).collect())) == whole and whole


def test_benchmark_edge_rows(spark, edge, none):
    bench = spark.createDataFrame(
        [(1, None, "x"), (2, "", "x"), (3, "X", "x"), (4, "  ", "x"), (5, made_text(1, 55), "x"), (None, made_text(2, 40), "x"), (6, "nowhere " * 9, "x")],
        "item_id int, text string, doc_id string",
    )
    got = decontaminate.contaminated(edge, bench).collect()
    found = sorted(((r["doc_id"], r["item_id"]) for r in got), key=repr)
    # A short item counts as a whole word; the repeated row matches for itself.
    assert found == sorted([(1, 5), (2, 5), (2, 5), (12, 5), (6, 3), (None, None)], key=repr)
    assert decontaminate.contaminated(none, bench).collect() == []
    assert decontaminate.contaminated(edge, bench.limit(0)).collect() == []
    assert decontaminate.flagged(edge, bench.limit(0)).where("leak").count() == 0


def test_short_items_inside_longer_documents(spark):
    items = [(1, "Why is the sky blue?"), (2, "blue"), (3, "天空"), (4, made_text(1, 40)), (5, "sky. blue")]
    docs = [
        (1, "well, WHY is\nthe sky  blue? because"),
        (2, "why is the sky bluer than the sea"),
        (3, "bluebell"),
        (4, "为什么天空是蓝的"),
        (5, "blue"),
        (6, "a blue-green " + made_text(1, 40)),
        (7, "xwhy is the sky blue?"),
    ]
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r["doc_id"], r["item_id"], r["distance"], r["short"]) for r in got.collect()) == [
        (1, 1, 0, True), (1, 2, 0, True), (4, 3, 0, True), (5, 2, 0, True), (6, 2, 0, True), (6, 4, 0, False), (7, 2, 0, True),
    ]
    flags = decontaminate.flagged(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items[:1], "item_id long, text string"))
    assert [r["doc_id"] for r in flags.collect() if r["leak"]] == [1]
