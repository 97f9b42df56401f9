"""Ids against the public libraries."""

import random

import pytest

from tallyroot.llm import encoding

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(f"{encoding.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda texts: [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def texts():
    rnd = random.Random(5)
    pools = ["abcdefgh ", "aA1 .\n\t", "  \n", "éßñ ж日本語 　", "😀👨‍👩‍👧 a", "'s't're've ll'd ", "0123456789,.", "-=_*#/ \\", "the and ing tion er "]
    out = ["", " ", "a", "<|endoftext|>", " <|endoftext|> x", "a" * 5000, " " * 3000 + "x", "x" + "\n" * 500, "\x00\x01", "ﬁ ½ ²", "​­﻿", "won't I'LL we're"]
    for _ in range(400):
        out.append("".join(rnd.choice(rnd.choice(pools)) for _ in range(rnd.randrange(1, 200))))
    return out


def test_words_and_texts(reference):
    enc = encoding.encoder(encoding.vocabulary())
    got = enc.encode_texts([*texts(), None])
    assert got[-1] == []
    assert got[:-1] == reference(texts())


def test_memory_starts_anew(reference, monkeypatch):
    monkeypatch.setattr(encoding, "MEMORY", 3)
    enc = encoding.TrieEncoder(encoding.vocabulary())
    for part in (["one two three four"], ["five six one"], ["one two"]):
        assert enc.encode_texts(part) == reference(part)


def test_column(spark, reference):
    rows = [(1, "one two", "keep"), (2, None, None), (3, "", "x"), (3, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((r.doc_id, r.ids) for r in encoding.encode_column(df, "text", "ids", encoding.vocabulary()).collect())
    assert got == [(1, reference(["one two"])[0]), (2, []), (3, []), (3, [])]
    counted = encoding.encode_column(df, "text", "n", encoding.vocabulary(), only_counts=True)
    assert sorted((r.doc_id, r.n, r.ids) for r in counted.collect() if r.doc_id < 3) == [(1, 2, "keep"), (2, 0, None)]
    assert encoding.encode_column(df.limit(0), "text", "n", encoding.vocabulary()).count() == 0
