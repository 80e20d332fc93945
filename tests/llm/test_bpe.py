"""Operator 8 against the tokenizers library."""

import hashlib
import random

import numpy as np
import pytest

from mixshard.llm import bpe, vocab

TEXTS = ["Hello WORLD it's", "İstanbul ΣΑΣ ς", "a\x1cb c\xa0d\x85e", "<|startoftext|>Hi<|endoftext|> x<|ENDOFTEXT|> <|startoftext", "é ñ é", "123 4½", "   ", "", None,
         "can'T I'LL 's'", "aaaaaaa " + "a" * 3001, "​ 　x", "日本 語😀", "a�b", "ſ K Å", "hahahahahaha", "Ᲊ Ɤ ՘x", "tab\tnew\nline\x0b\x0c\r", "#$% &amp; <a>"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocab.default_path("word_bpe_49k.json"))


def test_encode_and_decode_as_the_library(spark, library):
    r = random.Random(0)
    texts = TEXTS + ["".join(r.choices("abcdethn 'sé1!", k=r.randint(0, 300))) for _ in range(200)]
    df = spark.createDataFrame([(i, t, "z", "q") for i, t in enumerate(texts)], "doc_id long, text string, ids string, id string")
    ids = {x["id"]: list(x["ids"]) for x in bpe.encode(spark, df).collect()}
    back = {x["id"]: x["text"] for x in bpe.decode(spark, bpe.encode(spark, df)).collect()}
    rows = {x["id"]: x for x in bpe.round_trip(spark, df).collect()}
    for i, t in enumerate(texts):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert ids[i] == want, t
        assert back[i] == library.decode(want, skip_special_tokens=False)
        assert rows[i]["n_tokens"] == len(want)
        assert rows[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert rows[i]["decoded_sha256"] == hashlib.sha256(back[i].encode()).hexdigest()


def test_pieces_do_not_change_the_result(monkeypatch):
    b = bpe.PairIndexBPE(vocab.read_file(vocab.default_path("word_bpe_49k.json")))
    texts = [t for t in TEXTS if t] * 3
    ids, per = b.encode(texts)
    end = np.cumsum(per)
    for t, e, n in zip(texts, end, per):
        one, _ = b.encode([t])
        assert one.tolist() == ids[e - n: e].tolist()


def test_no_rows_null_ids_repeats(spark):
    df = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], "doc_id long, text string")
    assert bpe.round_trip(spark, df.where("false")).count() == 0
    assert sorted(str(r["id"]) for r in bpe.round_trip(spark, df).collect()) == ["1", "1", "None"]
    bad = spark.createDataFrame([(1, [320, None, -5, 10**8]), (2, None)], "id long, ids array<int>")
    assert {r["id"]: r["text"] for r in bpe.decode(spark, bad).collect()} == {1: "a</w>", 2: ""}
