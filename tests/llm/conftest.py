"""Rows that every operator of this package must get along with."""

import random

import pytest

CLASHING = ["h", "id", "label", "size", "class", "part", "guard", "spans", "copies", "n_tokens", "shard", "key"]
SCHEMA = "doc_id bigint, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in CLASHING)


def made_text(seed, n, words=("the", "of", "and", "thing", "erst", "onea", "blewh", "ti", "or", "heed")):
    rng = random.Random(seed)
    return " ".join(rng.choice(words) + rng.choice(["", "", "", ",", "er", "ing", "st"]) for _ in range(n))


def rows():
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, texts in other scripts."""
    plain = [
        (1, made_text(1, 60), "en", "a"),
        (2, made_text(1, 60), "en", "a"),  # an exact copy
        (2, made_text(1, 60), "en", "a"),  # a repeated row
        (3, None, "en", "b"),
        (4, "", None, "b"),
        (5, " \t\n ", "en", None),
        (6, "x", "en", None),
        (None, made_text(2, 40), None, "c"),
        (7, "le été où ça être " * 12, "fr", "c"),
        (8, "日本語のテキスト 漢字 🎉 e\u0301 İ Σ", "fr", "a"),
        (9, "a " * 3000, "en", "a"),
        (10, "x" * 5000, "en", "b"),
        (11, made_text(3, 20000), "en", "b"),
        (12, made_text(1, 55) + " " + made_text(9, 6), "en", "c"),
    ]
    return [(*r, *["other"] * (len(CLASHING) - 1), None) for r in plain]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
