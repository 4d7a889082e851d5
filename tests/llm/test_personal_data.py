"""Personal data (7): patterns, gradient, windows, and what the tagger adds."""

import random
import re

import numpy as np
import pytest
from conftest import made_text, rows
from hypothesis import given, settings
from hypothesis import strategies as st

from plurivote.llm import pii

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def digits(text):
    return re.sub("[^0-9]", "", text)


def checksum(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (2 if i % 2 else 1)
        total += d if d < 10 else d - 9
    return total % 10 == 0


def by_hand(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(EMAIL, text)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(IP, text) if all(int(p) <= 255 for p in m.group().split("."))]
    found += [(m.start(), 2, m.end()) for m in re.finditer(CARD, text) if 12 <= len(digits(m.group())) <= 19 and checksum(digits(m.group()))]
    found += [(m.start(), 3, m.end()) for m in re.finditer(PHONE, text) if 9 <= len(digits(m.group())) <= 15]
    return sorted(found)


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="a@.1234567890+- ()\né%", max_size=60))
def test_patterns(text):
    assert pii.base_spans(text) == by_hand(text)


@pytest.mark.parametrize(
    "text",
    ["a@b.c@d.e", "x@@y.z", "@a.b", "a.b@c..d", "1.2.3.4.5.6.7.8", "256.1.1.1", "1.1.1.999", "0001.02.3.4", "4111 1111-1111 1111", "+1 (867) 555-2364.", "+1+2 3456789 012"],
)
def test_pattern_corners(text):
    assert pii.base_spans(text) == by_hand(text)


def test_long_texts_take_linear_time():
    for text in ["a" * 400_000 + "@", "1" * 400_000, "+1" + "(" * 400_000, "1." * 200_000, "@" * 400_000]:
        pii.base_spans(text)


def test_gradient():
    rng = np.random.default_rng(0)
    tagger = pii.fresh_tagger(1)
    x = rng.integers(0, pii.SYMBOLS, (3, pii.WINDOW))
    y = rng.integers(0, pii.TAGS, (3, pii.WINDOW))
    _, gradient = pii.loss_and_gradient(tagger, x, y)
    for name in tagger._fields:
        weight = getattr(tagger, name)
        for at in [tuple(rng.integers(0, s) for s in weight.shape) for _ in range(4)]:
            sides = []
            for step in (1e-5, -1e-5):
                moved = weight.copy()
                moved[at] += step
                sides.append(pii.loss_and_gradient(tagger._replace(**{name: moved}), x, y)[0])
            assert (sides[0] - sides[1]) / 2e-5 == pytest.approx(getattr(gradient, name)[at], abs=2e-5), name


def test_decode_is_the_best_path():
    rng = np.random.default_rng(2)
    tagger = pii.fresh_tagger(3)._replace(move=rng.normal(size=(pii.TAGS, pii.TAGS)))
    x = rng.integers(0, pii.SYMBOLS, (2, pii.WINDOW))
    best = pii.decode(tagger, x)

    def score(y):
        emit = pii.emissions(tagger, x)
        rows_ = np.arange(len(x))[:, None]
        return tagger.begin[y[:, 0]] + emit[rows_, np.arange(pii.WINDOW), y].sum(1) + tagger.move[y[:, :-1], y[:, 1:]].sum(1)

    for _ in range(300):
        other = best.copy()
        other[:, rng.integers(0, pii.WINDOW, 3)] = rng.integers(0, pii.TAGS, 3)
        assert (score(other) <= score(best) + 1e-9).all()


def test_windows_cover_and_reconcile():
    values = np.arange(300) % 100
    for low, high in [(0, 10), (5, 69), (5, 70), (3, 300), (10, 171)]:
        windows = pii.cut_windows(values.astype(np.int8), low, high)
        assert pii.reconciled(windows, low, high).tolist() == values[low:high].tolist()


def carrier(spark, n=400):
    rng = random.Random(4)
    docs = []
    for i in range(n):
        card = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        card += next(c for c in "0123456789" if checksum(card + c))
        things = [
            f"{made_text(i, 1)[:5].strip(',. ')}.{rng.randrange(99):02d}@mail{rng.randrange(9)}.example.com",
            ".".join(str(rng.randrange(256)) for _ in range(4)),
            card,
            f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(9999):04d}",
            "Version 2.0",
            f'token = "{rng.getrandbits(120):030x}"',
        ]
        docs.append((i, f"{made_text(i, 9)} {rng.choice(things)} {made_text(i + 1, 8)} {rng.choice(things)} {made_text(i + 2, 6)}."))
    return spark.createDataFrame(docs, "doc_id bigint, text string")


@pytest.fixture(scope="module")
def tagger(spark):
    return pii.fit(carrier(spark))


def test_tagger_adds_other_notations(spark, tagger):
    """On unseen cards in dotted groups and phone numbers without ``+``."""
    rng, texts, want = random.Random(99), [], []
    for i in range(60):
        card = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        card += next(c for c in "0123456789" if checksum(card + c))
        thing = ".".join(card[k : k + 4] for k in range(0, 16, 4)) if i % 2 else f"({rng.randrange(200, 999)}) 555-{rng.randrange(9999):04d}"
        head = made_text(i, 12) + " "
        texts.append(head + thing + " " + made_text(i + 7, 9))
        want.append((len(head), 2 if i % 2 else 3, len(head) + len(thing)))
    got = pii.added_spans(tagger, texts, [pii.base_spans(t) for t in texts])
    assert sum(w in g for g, w in zip(got, want)) >= 45
    clean = [f"{made_text(i, 20)} Version 2.{i} of chapter {i} {made_text(i, 9)}" for i in range(60)]
    assert not any(pii.added_spans(tagger, clean, [[] for _ in clean]))


def whole_search(tagger, x):
    emit = pii._emit(tagger, pii._scan(tagger, x, np.float32)).astype(float)
    out = np.zeros(x.shape, int)
    for j in range(len(x)):
        best, back = tagger.begin + emit[0, :, j], []
        for t in range(1, x.shape[1]):
            step = best[:, None] + tagger.move
            back.append(step.argmax(0))
            best = step.max(0) + emit[t, :, j]
        k = int(best.argmax())
        for t in range(x.shape[1] - 1, -1, -1):
            out[j, t] = k
            k = back[t - 1][k] if t else k
    return out


@pytest.mark.parametrize("seed", range(8))
def test_runs_give_what_whole_windows_give(seed):
    rng = np.random.default_rng(seed)
    tagger = pii.fresh_tagger(seed)._replace(
        move=rng.normal(size=(pii.TAGS, pii.TAGS)) * (seed % 3 + 0.3), begin=rng.normal(size=pii.TAGS), out_bias=np.array([1.0 + seed / 3] + [0.0] * (pii.TAGS - 1))
    )
    x = rng.integers(0, pii.SYMBOLS, (24, 96))
    assert (pii.decode(tagger, x) == whole_search(tagger, x)).all()


def test_wide_forms_and_other_digits_are_classed_alike():
    assert (pii.symbols("０１２＠．＋Ａb") == pii.symbols("012@.+ab")).all()
    assert (pii.symbols("٣४") == pii.DIGIT).all()
    assert pii.symbols("é中").tolist() == [pii.LETTER] * 2


def test_whole_texts_are_read(tagger):
    """A spelled address far inside a text without any digit or at sign."""
    found = 0
    for i in range(20):
        head = made_text(i, 700) + " "
        thing = f"{made_text(i, 1)[:5].strip(',. ').lower()} (at) mail.example.com"
        text = re.sub("[0-9@]", "", head) + thing + " " + re.sub("[0-9@]", "", made_text(i + 3, 300))
        start = text.index(thing)
        found += any(k == 0 and a <= start + 8 and b == start + len(thing) for a, k, b in pii.added_spans(tagger, [text], [[]])[0])
    assert found >= 15


def test_pieces_of_longer_words_are_not_added(tagger):
    for i in range(10):
        text = f"{made_text(i, 9)} a4524132264652876b{i} {made_text(i + 1, 9)}"
        assert pii.added_spans(tagger, [text], [[]]) == [[]]


def test_added_spans_are_plausible():
    good = [(0, "jane dot doe at mail dot org"), (0, "j (at) mail.org"), (0, "ｊ＠mail.org"), (1, "10[.]2[.]33[.]4"), (2, "4111.1111.1111.1111"), (3, "020 7946 0958"), (3, "＋１ (867) 555-2364")]
    bad = [(0, "met at noon"), (0, "dot at"), (1, "10[.]2[.]333[.]4"), (1, "10[.]2[.]33"), (2, "4111.1111.1111.1112"), (3, "12 34"), (3, "call 020 7946"), (0, "")]
    assert all(pii.plausible(k, t) for k, t in good) and not any(pii.plausible(k, t) for k, t in bad)


def test_base_spans_stay(spark, tagger):
    docs = carrier(spark, 60).unionByName(spark.createDataFrame([(1000, "+12 34 56 78 90 a@b.c " * 40 + "9" * 300)], "doc_id bigint, text string"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in pii.personal_data(docs, tagger).collect():
        want = by_hand(texts[r["doc_id"]])
        assert r["base_spans"] == pii.joined(want)
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(k == s[1] for s in want) for k in range(4)]
        assert set(filter(None, r["base_spans"].split(","))) <= set(filter(None, r["spans"].split(",")))


def test_edge_rows(edge, none, tagger):
    got = pii.personal_data(edge, tagger).collect()
    assert sorted((r["doc_id"] for r in got), key=repr) == sorted((r[0] for r in rows()), key=repr)
    assert all(r["spans"] == "" for r in got)
    assert pii.fit(none) is None and pii.personal_data(none, None).collect() == []
    assert len(pii.personal_data(edge, None).collect()) == len(rows())


def test_the_sample_is_worked_out_once_for_all_draws(spark, monkeypatch):
    from pyspark.sql import functions as F

    texts = [(i, f"write to a{i}@b.org or 10.0.0.{i} today") for i in range(40)]
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def read(text):
        seen.add(1)
        return text

    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("text", read.asNondeterministic()("text"))
    monkeypatch.setattr(pii, "train", lambda x, y: (x, y))
    x, y = pii.fit(docs)
    assert len(x) == len(y) and y.any()
    assert seen.value <= 2 * len(texts)  # the pass for the keys, and one for all examples


def test_decoding_does_not_depend_on_the_batches(monkeypatch):
    rng = np.random.default_rng(5)
    tagger = pii.fresh_tagger(3)
    x = rng.integers(1, pii.SYMBOLS, (50, 64)).astype(np.int8)
    whole = pii.decode(tagger, x)
    monkeypatch.setattr(pii, "TEXTS", 7 * 64)
    monkeypatch.setattr(pii, "RUNS", 3)
    assert whole.any() and (pii.decode(tagger, x) == whole).all()
