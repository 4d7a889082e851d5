"""The pipeline and the registered queries, on small tables."""

import random
import re
import zlib

import numpy as np
import pytest
from conftest import SCHEMA, made_text, rows

import __spark_entry__ as entry
import corpus_pipeline
from plurivote.llm import mixing
from plurivote.llm.queries import ORACLES, QUERIES

FR = ("le", "été", "où", "ça", "être", "queue", "eaux", "ment", "tion", "leur")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    rng = random.Random(1)
    words = tuple(f"{a}{b}" for a in ("th", "on", "er", "bl") for b in ("ing", "ed", "ou", "es", "at", "ti", "an"))
    items = [made_text(7000 + i, 25, words) for i in range(5)]
    docs = [(i, made_text(i, 60 + i % 50, words if i % 3 else FR), "en" if i % 3 else "fr", f"s{i % 4}") for i in range(150)]
    docs += [(200 + i, docs[i][1], docs[i][2], "s1") for i in range(30)]  # exact copies
    for i in range(30):
        w = docs[30 + i][1].split()
        w[rng.randrange(len(w))] = "changed"
        docs.append((300 + i, " ".join(w), docs[30 + i][2], "s2"))  # near copies
    docs += [(400 + i, made_text(5000 + i, 20, words) + " " + items[i] + " " + made_text(6000 + i, 20, words), "en", "s3") for i in range(5)]
    docs += [(500, None, "en", "s0"), (501, "", None, None), (502, "123 !!", "en", "s0"), (None, made_text(9999, 30, words), "en", "s0")]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string").selectExpr("*", "length(text) AS n_chars").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(1, "http://a.com/x")], "page_id bigint, url string").write.parquet(f"{folder}/pages.parquet")
    return str(folder), docs, items


def test_stages_by_hand(spark, tables):
    folder, docs, items = tables
    table = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontaminate", "mix_sources", "token_files"]

    known = stages["language_id"](spark, table, folder)
    assert known.columns == table.columns
    left = {r["doc_id"] for r in known.collect()}
    assert left == {d[0] for d in docs} - {500, 501, 502}

    single = stages["near_duplicates"](spark, known, folder)
    assert single.columns == table.columns
    left -= {*range(200, 230), *range(300, 330)}
    assert {r["doc_id"] for r in single.collect()} == left

    clean = stages["decontaminate"](spark, single, folder)
    assert clean.columns == table.columns
    left -= set(range(400, 405))
    assert {r["doc_id"] for r in clean.collect()} == left

    mixed = stages["mix_sources"](spark, clean, folder)
    assert mixed.columns == table.columns
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(clean).collect()}
    texts = {d[0]: d[1] for d in docs}
    want = sorted((d, texts[d]) for d in copies if d is not None for _ in range(copies[d]))
    assert sorted((r["doc_id"], r["text"]) for r in mixed.collect() if r["doc_id"] is not None) == want


def test_run(spark, tables):
    folder = tables[0]
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
    start, want = 0, []
    for r in sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"])):
        ids = np.array([*library.encode(r["text"], add_special_tokens=False).ids, 1], dtype="<u4")
        want.append((r["doc_id"], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = [tuple(r) for r in corpus_pipeline.run(spark, folder).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_edge_rows_pass_through(spark, tables, tmp_path):
    folder = tables[0]
    for data in (rows(), []):
        docs = spark.createDataFrame(data, SCHEMA)
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, folder)
            if name != "token_files":
                assert docs.columns[:4] == ["doc_id", "text", "lang", "source"]
        assert (docs.count() > 0) == bool(data)


def test_registered():
    names = entry.queries()
    for n in range(1, 11):
        assert sum(bool(re.match(rf"op{n}_", q)) for q in names) == 1
    assert "pipeline" in names and set(ORACLES) <= set(entry.oracle_sql())
    assert not {*QUERIES, "pipeline"} - set(names)


def test_contract_columns(spark, tables):
    """The digest columns of every query that has a fixed form."""
    folder = tables[0]
    want = {
        "op1_token_counts": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
        "op2_url_filter": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
        "op3_mix_sources": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
        "op4_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
        "op6_token_files": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
        "op7_personal_data": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
        "op9_order_minhash": {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"},
        "op10_repeated_phrases": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    }
    for name, columns in want.items():
        kinds = dict(QUERIES[name](spark, folder).dtypes)
        assert {c: kinds.get(c) for c in columns} == columns, name
