"""Byte-pair encoding against the tiktoken library, and back."""

import random

import public_tokenizers
import pytest
import tiktoken

from quantloom.llm import bytepair
from quantloom.llm.queries import QUERIES

random.seed(5)
TEXTS = [
    None, "", " ", "  a", "don't we'll I'M", "a  'll  've x", "é" * 90, "a" * 700, " " * 900, "=-" * 400, " \n\t \r\n  end  ",
    "日本語テキスト" * 30, "0123456789" * 40, "\U0001f600\U0001f600 x  y　z \x1c\x1f\x85", "same", "same",
    "".join(random.choice("etaoinsh") for _ in range(500)), "".join(random.choice("abcdef ghij\n'slé") for _ in range(2000)),
    "".join(chr(random.randrange(32, 0xD7FF)) for _ in range(500)),
]


@pytest.fixture(scope="module")
def vocabulary():
    return bytepair.Vocabulary.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def expected(vocabulary):
    return tiktoken.Encoding("own", pat_str=vocabulary.pattern, mergeable_ranks=vocabulary.ranks, special_tokens={}).encode_ordinary


def test_ids_are_the_librarys_and_decode_to_the_text(spark, vocabulary, expected):
    docs = spark.createDataFrame([(k, t, "x", k) for k, t in enumerate(TEXTS)], "ids long, text string, made string, value long")
    tokens = bytepair.encode(docs.withColumnRenamed("ids", "bytes"), vocabulary, "bytes", "made", "value", "text")
    found = bytepair.decode(tokens.withColumnRenamed("bytes", "k"), vocabulary, "k", "made", "ids", "value").collect()
    assert len(found) == len(TEXTS)
    for row in found:
        text = TEXTS[row["k"]] or ""
        assert row["ids"] == expected(text), text[:40]
        assert bytes(row["bytes"]) == text.encode()
        assert row["made"] == "x" and row["value"] == row["k"]


def test_empty_table_and_null_ids(spark, vocabulary):
    assert bytepair.encode(spark.createDataFrame([], "doc_id long, text string"), vocabulary, "doc_id").collect() == []
    rows = spark.createDataFrame([(1, None), (2, []), (3, [0])], "doc_id long, ids array<int>")
    found = {r["doc_id"]: bytes(r["bytes"]) for r in bytepair.decode(rows, vocabulary, "doc_id").collect()}
    assert found[1] == found[2] == b"" and len(found[3]) == 1


def test_a_text_is_cut_only_between_matches(vocabulary, monkeypatch):
    coder = bytepair._coder(vocabulary)
    whole = [coder.pieces(t or "") for t in TEXTS]
    monkeypatch.setattr(bytepair, "CHARS", 7)
    assert [coder.pieces(t or "") for t in TEXTS] == whole


def test_a_worker_that_forgets_pieces_gives_the_same_ids(vocabulary, expected, monkeypatch):
    monkeypatch.setattr(bytepair, "KNOWN", 10)
    coder = bytepair._Coder(vocabulary)
    for text in TEXTS:
        assert [found.to_pylist() for found in coder.encode([[text], [None, text]])] == [[expected(text or "")], [[], expected(text or "")]]


def test_query_over_the_table(spark, expected):
    import hashlib

    rows = QUERIES["op11_byte_pairs"](spark, "/root/testdata/sf0.001").collect()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for row in rows:
        ids = expected(texts[row["doc_id"]])
        digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert (row["n_tokens"], row["ids_sha256"], row["decoded_sha256"]) == (len(ids), digest, hashlib.sha256(texts[row["doc_id"]].encode()).hexdigest())


def test_a_worker_keeps_the_pieces_that_came_again(vocabulary, expected):
    coder = bytepair._Coder(vocabulary)
    texts = [" ".join(f"{'abcd'[k]}{'efghi'[n // 10]}{'jklmnopqrs'[n % 10]}qz" for n in range(50)) + " plainly zzyzxish" for k in range(4)]
    for text in texts:
        assert [x.to_pylist() for x in coder.encode([[text]])] == [[expected(text)]]
    coder.slim(20)
    assert " zzyzxish" in coder.number and len(coder.number) <= 10 and len(coder.ids) == coder.size.sum()
    for text in reversed(texts):
        assert [x.to_pylist() for x in coder.encode([[text]])] == [[expected(text)]]


def test_every_distinct_piece_of_a_portion_is_looked_up_once(vocabulary, expected):
    class Counted(dict):
        looked = 0

        def __getitem__(self, piece):
            self.looked += 1
            return dict.__getitem__(self, piece)

    coder = bytepair._Coder(vocabulary)
    coder.number = Counted()
    texts = ["so it is zorglub, " * 500, None, "é zorglub 日本 日本" * 20, ""]
    assert [ids.to_pylist() for ids in coder.encode([texts])] == [[expected(t or "") for t in texts]]
    assert coder.number.looked == len(coder.number)
