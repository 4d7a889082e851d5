"""Column expressions on edge rows."""

import re
import string
from functools import reduce

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plurivote.functions import scores as S
from plurivote.functions import text as T


def values(spark, inputs, kind, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r["out"] for r in df.select("i", make(F.col("v")).alias("out")).orderBy("i").collect()]


def test_word_count(spark):
    texts = ["", "   ", None, "a", " a  b\nc\t", "a b", "x y z"]
    assert values(spark, texts, "string", T.word_count) == [0, 0, 0, 1, 3, 2, 3]


# What is removed, in Python's syntax and in this order.
REMOVED = (r"\[.*?\]", r"https?://\S+|www\.\S+", r"<.*?>+", "[" + re.escape(string.punctuation) + "]", "\n", r"\w*\d\w*")


def plain_clean(text):
    """The same removals by Python's own engine, one text at a time."""
    return reduce(lambda rest, pattern: re.sub(pattern, "", rest), REMOVED, text.lower())


CLEAN = [
    "Hello [note 1] World",
    "see https://a.example/x?y=1 and www.b.example now",
    "<b>bold</b> text <i>>x",
    "one\ntwo",
    "a1éb c é9 ñ",
    "nested [a [b] c] d",
    "it's (fine), isn't_it?",
    "",
    "tab\tand space",
    "[open <open http",
]


def test_clean_text_agrees_with_plain_regular_expressions(spark):
    assert values(spark, CLEAN, "string", T.clean_text) == [plain_clean(t) for t in CLEAN]
    assert values(spark, [None], "string", T.clean_text) == [None]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aZé1_ \n[]<>./:-w'htps", max_size=40), min_size=1, max_size=30))
def test_clean_text_random(spark, texts):
    assert values(spark, texts, "string", T.clean_text) == [plain_clean(t) for t in texts]


def test_stopwords(spark):
    out = values(spark, ["the cat and the hat", "the", ""], "string", lambda v: T.remove_stopwords(T.words(v), ["the", "and"]))
    assert out == [["cat", "hat"], [], []]


def test_names(spark):
    names = ["control_iS_01", "target-x_inter-AB_12", "a_b", "x_1_2"]
    assert values(spark, names, "string", T.model_family) == ["control_iS", "target-x_inter-AB", "a_b", "x_1"]
    shown = values(spark, ["target-AB", "AB", "pre-target-AB"], "string", lambda v: T.display_name(v, ["target-"], {"AB": "A-coarse"}))
    assert shown == ["A-coarse", "A-coarse", "pre-target-AB"]


def test_epoch_tags(spark):
    df = spark.createDataFrame(
        [(1, 0.753125, 0.414412), (2, 0.835, 0.4), (10, 0.125, 1.0), (120, 0.375, 0.0)], "e int, a double, f double"
    )
    tags = [r[0] for r in df.orderBy("e").select(T.epoch_tag(F.col("e"), F.col("a"), F.col("f"))).collect()]
    assert tags == [f"E{str(e).zfill(2)}_A{round(a, 2)}_F{round(f, 2)}" for e, a, f in ((1, 0.753125, 0.414412), (2, 0.835, 0.4), (10, 0.125, 1.0), (120, 0.375, 0.0))]
    parsed = values(spark, ["E02_A0.77_F0.4", "checkpoint", "E1_A1.0_F0.5"], "string", T.parse_epoch_tag)
    assert [tuple(p) for p in parsed] == [(2, 0.77, 0.4), (None, None, None), (1, 1.0, 0.5)]


def test_lists_and_tuples(spark):
    assert values(spark, ["[0, 1, 1]", "[]"], "string", T.list_from_text) == [[0, 1, 1], []]
    assert values(spark, ["('a', 'b-c')", "('a',)"], "string", T.tuple_from_text) == [["a", "b-c"], ["a"]]


def test_rounding(spark):
    assert values(spark, [0.575, 0.125, 0.135, -0.125], "double", S.round_scaled) == [0.57, 0.12, 0.14, -0.12]


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.integers(0, 2000).map(lambda k: k / 1000), st.integers(0, 400).map(lambda k: k / 200), st.floats(0, 1)), min_size=1, max_size=60))
def test_round_decimal_is_exact(spark, xs):
    assert values(spark, xs, "double", S.round_decimal) == [round(x, 2) for x in xs]


def test_argmax_first_on_ties(spark):
    assert values(spark, [[0.1, 0.9, 0.9], [1.0], [-3.0, -3.0]], "array<double>", S.argmax) == [1, 0, 0]


def test_cross_entropy_survives_large_logits(spark):
    out = values(spark, [[1000.0, 0.0], [0.0, 0.0]], "array<double>", lambda v: S.row_cross_entropy(v, F.lit(1)))
    assert out[0] == pytest.approx(1000.0)
    assert out[1] == pytest.approx(0.6931471805599453)
