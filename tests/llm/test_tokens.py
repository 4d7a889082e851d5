"""Token counts (1) and token files (6) against the library itself."""

import random
import string
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pytest
from conftest import rows
from tokenizers import Tokenizer

from plurivote.llm import arrow, token_counts, token_files
from plurivote.llm.queries import tokenizer_text

BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"
ODD = [
    "aaaa aaaaa aaaaaaaaaaaa",
    "it's we'll I'm  two  blanks \n\n lines\t tabs \r\n end ",
    "a<|endoftext|>b <|endoftext|><|endoftext|>",
    "<|startoftext|>x <|ENDOFTEXT|> y<|endoftext|>",
    "1234567 3.14 €100 ½ Ⅷ",
    "naïve café cafe\u0301 ÀÉ ΣΑΣ İstanbul ǅ",
    "\u00a0nbsp\u2003em\u3000wide\u0085nel\x1cfs",
    "don't!!! \"quoted.\" (x) -- end.,;:",
    "🎉🎉 👩‍👩‍👧 \x00\x01",
    "l'été d'or rock'n'roll 'tis",
]


def library(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


def test_counts_like_the_library(spark, edge):
    texts = ODD + [r[1] for r in rows()]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in token_counts.token_counts(table, tokenizer_text(BYTE)).collect()}
    for i, text in enumerate(texts):
        want = len(library(BYTE).encode(text or "", add_special_tokens=False).ids)
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (want, len((text or "").encode()), want > 512)
    assert token_counts.token_counts(edge, tokenizer_text(BYTE)).count() == len(rows())


def test_merges_with_small_arrays(monkeypatch):
    table = token_counts.MergeTable(tokenizer_text(BYTE))
    words = [w.encode() for w in ["", "a", " thing", "aaaaaaa", "ontiesher", "zzzzzzzzzzzzzzzzzz"]]
    whole = table.count(words).tolist()
    monkeypatch.setattr(token_counts, "BATCH_SYMBOLS", 1)
    assert table.count(words).tolist() == whole
    assert whole == [len(library(BYTE).encode(w.decode()).ids) for w in words]


def test_caches_stay_bounded(monkeypatch):
    known = token_counts.Counts()
    monkeypatch.setattr(token_counts, "CACHED_PRE_TOKENS", 2)
    for word in "abc":
        known[word]
    known.shrink()
    assert not known and len(known.number) == 0


def test_empty_tables(none):
    assert token_counts.token_counts(none, tokenizer_text(BYTE)).collect() == []
    files = token_files.write_token_files(none, tokenizer_text(WORD))
    assert token_files.read_documents(files).collect() == []


def expected(texts):
    """(start, number, checksum) of documents in order."""
    start, out = 0, []
    for text in texts:
        ids = np.array([*library(WORD).encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        out.append((start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("row_length", [16, 2048])
def test_files_round_trip(spark, monkeypatch, row_length):
    monkeypatch.setattr(token_files, "ROW_LENGTH", row_length)
    monkeypatch.setattr(token_files, "BATCH_ROWS", 4)
    texts = ODD + [r[1] for r in rows()]
    table = spark.createDataFrame([(i * 3 - 20, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(5)
    files = token_files.write_token_files(table, tokenizer_text(WORD))
    got = sorted(tuple(r) for r in token_files.read_documents(files).collect())
    assert got == [(i * 3 - 20, *e) for i, e in enumerate(expected(texts))]


def test_order_of_nulls_and_ties(edge):
    files = token_files.write_token_files(edge, tokenizer_text(WORD))
    got = sorted(tuple(r)[1:] for r in token_files.read_documents(files).collect())
    ordered = sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    assert got == expected([r[1] for r in ordered])


def test_rows_by_number(spark):
    text = "the thing of " * 3000
    files = token_files.write_token_files(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), tokenizer_text(WORD))
    shard = files.manifest.where("n_docs > 0").first()["shard"]
    ids = np.array([*library(WORD).encode(text).ids, 1])
    third, mask = token_files.read_row(files.path, shard, 2)
    assert third.dtype == np.uint16 and mask.all()
    assert third.tolist() == ids[2 * 2048 : 3 * 2048].tolist()
    last, mask = token_files.read_row(files.path, shard, (len(ids) - 1) // 2048)
    assert mask.sum() == len(ids) % 2048 and last[mask].tolist() == ids[-(len(ids) % 2048) :].tolist()


def test_small_caches_change_nothing(monkeypatch):
    texts = ODD + [r[1] for r in rows()]
    whole = token_files.encode_slice(texts, token_files.Encoder(tokenizer_text(WORD)))
    monkeypatch.setattr(token_files, "CACHED_PIECES", 3)
    encoder = token_files.Encoder(tokenizer_text(WORD))
    parts = [token_files.encode_slice([t], encoder) for t in texts]
    assert np.concatenate([p[0] for p in parts]).tolist() == whole[0].tolist()


def test_full_caches_keep_the_most_used(monkeypatch):
    monkeypatch.setattr(token_files, "CACHED_WORDS", 8)
    encoder = token_files.Encoder(tokenizer_text(WORD))
    texts = [f"the thing. the thing. rare{chr(97 + i)} once{chr(97 + i)}, The" for i in range(20)]
    parts = [token_files.encode_slice([t], encoder) for t in texts]
    assert [ids.tolist() for ids, _ in parts] == [[*library(WORD).encode(t, add_special_tokens=False).ids, 1] for t in texts]
    assert len(encoder.words) <= 8 and len(encoder.words.pairs) == len(encoder.words.uses) == len(encoder.words)
    assert {"the", "thing."} <= set(encoder.words) and len(encoder.pieces) == len(encoder.pieces.length)


def test_full_caches_count_the_pieces_that_are_named(monkeypatch):
    monkeypatch.setattr(token_files, "CACHED_PIECES", 8)
    encoder = token_files.Encoder(tokenizer_text(WORD))
    texts = ["one one one two two two three three three four four five five", "a b c d"]
    parts = [token_files.encode_slice([t], encoder) for t in texts]
    assert [ids.tolist() for ids, _ in parts] == [[*library(WORD).encode(t, add_special_tokens=False).ids, 1] for t in texts]
    # Half of the pieces: the empty one, which words without marks name, and those of the three words used most.
    assert list(encoder.words) == ["one", "two", "three"] and list(encoder.pieces) == ["", "one", "two", "three"]


def test_ids_are_taken_without_offsets():
    class Watched:
        calls = 0

        def __init__(self, library):
            self.library = library

        def encode_batch_fast(self, texts, **options):
            Watched.calls += 1
            return self.library.encode_batch(texts, **options)

    encoder = token_files.Encoder(tokenizer_text(WORD))
    encoder.tokenizer, encoder.letters = Watched(encoder.tokenizer), Watched(encoder.letters)
    texts = ["lower Case ÄÖ äö 12, it's", "don't <|endoftext|> end."]
    ids, _ = token_files.encode_slice(texts, encoder)
    assert ids.tolist() == [i for t in texts for i in [*library(WORD).encode(t, add_special_tokens=False).ids, 1]]
    assert Watched.calls == 3


def test_letters_alone_have_the_ids_of_the_whole_tokenizer():
    rng = random.Random(7)
    pieces = ["".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randrange(1, 30))) for _ in range(5_000)]
    letters = token_files.Encoder(tokenizer_text(WORD)).letters
    assert [e.ids for e in letters.encode_batch(pieces)] == [e.ids for e in library(WORD).encode_batch(pieces, add_special_tokens=False)]


def test_a_worker_keeps_the_objects_of_one_operator():
    first = arrow.kept("a", token_counts.Counts)
    assert arrow.kept("a", token_counts.Counts) is first and arrow.kept("b", token_counts.Counts) is not first
    encoder = arrow.kept("c", token_files.Words)
    assert arrow.kept("c", token_files.Words) is encoder and arrow.kept("a", token_counts.Counts) is not first


def same_ids(texts, name=WORD):
    ids, lengths = token_files.encode_slice(texts, token_files.Encoder(tokenizer_text(name)))
    plain = [[*e.ids, 1] for e in library(name).encode_batch(texts, add_special_tokens=False)]
    return lengths.tolist() == [len(p) for p in plain] and ids.tolist() == [i for p in plain for i in p]


def test_every_code_point_beside_marks():
    """Letters that fall apart or lose their end when they are normalized, before and behind every mark."""
    points = [chr(c) for c in range(0x21, 0x110000) if not 0xD800 <= c <= 0xDFFF and unicodedata.category(chr(c)) not in ("Cn", "Co")]
    moved = [c for c in points if unicodedata.normalize("NFC", c.lower()) != c or unicodedata.category(c)[0] == "M"]
    assert same_ids(["İSTANBUL SAATİ.", "TÜRKİYE CUMHURİYETİ,", "SAATİ! x", "a\u0958.", "ΑΣ. ΑΣ", "<|endoftext|>. <|endoftext|", "it's. 'S."])
    assert same_ids([" ".join(f"a{c}{mark} {mark}{c}" for c in moved) for mark in token_files.TAIL])
    assert same_ids([" ".join(f"a{c}. .{c}b," for c in points[i : i + 4000]) for i in range(0, len(points), 4000)])


def test_random_texts_equal_the_library():
    rng = random.Random(4)
    letters = "abcXYZ019 .,!|*$#%&?;:'<>-_\n\t\u0301\u093cİıßΣσςéÉ\u0958日本🎉\u00a0\u2028"
    assert same_ids(["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(20_000)])


def test_other_tokenizers_are_not_cut():
    assert token_files.cuts_at_words(tokenizer_text(WORD)) and not token_files.cuts_at_words(tokenizer_text(BYTE))
    texts = ["hello big world", "", "a  b\n c", "İSTANBUL."]
    assert same_ids(texts, BYTE)
    # One after the other: neither uses what the worker keeps of the other.
    assert same_ids(texts, WORD) and same_ids(texts, BYTE)


def test_the_library_gets_a_bounded_number_of_pieces_at_once():
    encoder = token_files.Encoder(tokenizer_text("word_bpe_49k.json"))
    library, sizes = encoder.tokenizer, []

    class Watched:
        def encode_batch(self, texts, **options):
            sizes.append(sum(len(t.split(" ")) for t in texts))
            return library.encode_batch(texts, **options)

    texts = [" ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}{'' if i % 3 else i}" for i in range(17_000)), None]
    encoder.tokenizer = Watched()
    ids, lengths = token_files.encode_slice(texts, encoder)
    assert max(sizes) <= token_files.ENCODED_AT_ONCE
    assert ids.tolist() == [*library.encode(texts[0], add_special_tokens=False).ids, 1, 1] and lengths.tolist() == [len(ids) - 1, 1]
