"""Mixing sources (3)."""

import math
import re
from collections import defaultdict

import pytest
from conftest import made_text, rows

from plurivote.llm import mixing


def by_hand(sizes, weights, share, cap):
    """Targets of sources in order, by dealing the excess again and again."""
    total, target, open_ = share * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        rest = total - sum(cap * sizes[i] for i in range(len(sizes)) if i not in open_)
        weight = sum(weights[i % len(weights)] for i in open_)
        full = {i for i in open_ if rest * weights[i % len(weights)] / weight > cap * sizes[i]}
        if not full:
            for i in open_:
                target[i] = rest * weights[i % len(weights)] / weight
            break
        open_ -= full
    return [cap * s if i not in open_ else t for i, (s, t) in enumerate(zip(sizes, target))]


def corpus(spark, spread):
    data = []
    for source, n in spread.items():
        data += [(len(data) + i, made_text(len(data) + i, 1 + (i * 37) % 90), None if source == "" else source) for i in range(n)]
    return spark.createDataFrame(data, "doc_id bigint, text string, source string").repartition(4)


@pytest.mark.parametrize("spread", [{"a": 400, "B": 100, "é": 60, "z": 5, "": 80}, {"only": 200}, {"a": 3, "b": 900, "c": 2, "d": 1}])
def test_targets_and_taken(spark, spread):
    docs = corpus(spark, spread)
    got = mixing.mix(docs).collect()
    sums, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
        sums[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    order = sorted(sums, key=lambda s: (s is None, s or ""))
    want = by_hand([sums[s] for s in order], (3, 1, 2), 1.5, 2.0)
    assert [target[s] for s in order] == pytest.approx(want)
    for s in order:
        assert abs(taken[s] - target[s]) <= 90 / 2 + 1, s  # half of the longest document
    assert len(got) == sum(spread.values())
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, got), key=repr)


def test_edge_rows(edge):
    got = mixing.mix(edge).collect()
    sizes = sorted(len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows())
    assert sorted(r["size"] for r in got) == sizes
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    repeated = mixing.repeat_documents(edge, mixing.mix(edge))
    assert repeated.columns == edge.columns
    assert all(r["text"] and r["text"].split() for r in repeated.collect())


def test_empty(none, spark):
    assert mixing.mix(none).collect() == []
    blank = spark.createDataFrame([(1, None, "a"), (2, "", "b")], "doc_id bigint, text string, source string")
    assert sorted((r["doc_id"], r["taken"], r["target"]) for r in mixing.mix(blank).collect()) == [(1, 0, 0.0), (2, 0, 0.0)]


def test_inclusion_follows_the_odds(spark):
    """Over many seeds a document is taken as often as its expected copies say."""
    docs = corpus(spark, {"a": 60, "b": 60})
    total, seeds = defaultdict(int), 12
    for seed in range(seeds):
        for r in mixing.mix(docs, weights=(1, 3), share=0.6, seed=seed).collect():
            total[r["source"], r["size"] > 45] += r["copies"]
    # Longer documents have the larger inclusion weight.
    assert total["a", True] / 30 > total["a", False] / 30 * 0.9
    assert math.isfinite(sum(total.values()))
