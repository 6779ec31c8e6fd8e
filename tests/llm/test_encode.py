from __future__ import annotations

import os

import pytest

from dyadica.llm import encode as module
from dyadica.llm import vocab
from dyadica.llm.encode import decode, encode

if not os.path.exists(vocab.FOLDER):
    pytest.skip("no vocabulary files here", allow_module_level=True)

tiktoken = pytest.importorskip("tiktoken")
NAME = "byte_bpe_50k"
SCHEMA = "doc_id bigint, text string, word string, ids string, pos int"
TEXTS = [
    "Hello world, it's   a test.\n\n  The end 123 4567 ",
    "",
    None,
    "   ",
    "\t\n",
    "naïve Überprüfung façade ¿qué? <|endoftext|> don't I'LL we've",
    "日本語のテキスト 🙂🙂👩‍👩‍👧   x\u0085y​z",
    "a" * 3000,
    "=" * 700 + " " * 900 + "x",
    "Donaudampfschifffahrtselektrizitätenhauptbetriebswerkbauunterbeamtengesellschaft" * 3,
    "é broken � \x00 \x7f",
    "word " * 5000,
    "1," * 100_000,
    " " * 300_000 + "a",
    "b" * 20_000 + "\n" * 50_000,
]


def want(name=NAME):
    enc = tiktoken.Encoding("x", pat_str=vocab.PATTERN, mergeable_ranks=vocab.read_ranks(name), special_tokens={})
    return lambda t: enc.encode_ordinary(t) if t else []


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "w", "i", 0) for i, t in enumerate(texts)], SCHEMA)


@pytest.mark.parametrize("name", [NAME, "byte_bpe_multi_50k"])
def test_equal_to_public_encoder_and_back(spark, name):
    df = encode(frame(spark, TEXTS), name)
    got = {r["doc_id"]: r["ids"] for r in df.collect()}
    assert got == {i: want(name)(t) for i, t in enumerate(TEXTS)}
    assert {r["doc_id"]: r["text"] for r in decode(df, name).collect()} == {i: t or "" for i, t in enumerate(TEXTS)}


def test_vocabulary_joined(spark, monkeypatch):
    monkeypatch.setattr(module, "LITERAL_WORDS", 3)
    got = {r["doc_id"]: r["ids"] for r in encode(frame(spark, TEXTS)).collect()}
    assert got == {i: want()(t) for i, t in enumerate(TEXTS)}


@pytest.mark.parametrize("most", [0, 100])
def test_repeated_and_clashing_ids(spark, monkeypatch, most):
    monkeypatch.setattr(module, "LITERAL_WORDS", most)
    df = spark.createDataFrame([(1, "one two"), (1, "one two"), (1, "three"), (None, "four"), (None, None)], "doc_id bigint, text string")
    got = sorted(((r["doc_id"], r["ids"]) for r in encode(df).collect()), key=repr)
    assert got == sorted([(1, want()("one two")), (1, want()("one two")), (1, want()("three")), (None, want()("four")), (None, [])], key=repr)


def test_empty_table(spark):
    assert encode(frame(spark, [])).count() == 0
