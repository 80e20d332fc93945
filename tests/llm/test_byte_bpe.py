"""Operator 12 against the tiktoken library."""

import hashlib
import random
import struct

import numpy as np
import pytest

from mixshard.llm import byte_bpe as B
from mixshard.llm import vocab

TEXTS = ["Hello WORLD it's", "İstanbul ΣΑΣ ς can'T I'LL we've", "a\x1cb c\xa0d\x85e", "<|endoftext|> x", "123 4½ ٣٤", "   ", "", None, "\n\n  \t x \r\n", " 's 'll'd",
         "aaaaaaa " + "a" * 30001, "​ 　x", "日本 語😀👩‍👩‍👧", "a�b", "hahahahahaha", "Ᲊ Ɤ ՘x", " " * 3001 + "x", "xyz" * 2000, "#$% &amp; <a>", "éàü" * 50]


@pytest.fixture(scope="module")
def bpe():
    import public_tokenizers

    return B.MergeReplay(vocab.read_file(vocab.default_path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)


def library(bpe, pattern=None, ranks=None):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern or public_tokenizers.PATTERN, mergeable_ranks=ranks or bpe.rank_of, special_tokens={})


def _same(bpe, texts, lib):
    ids, per = bpe.encode(texts)
    end = np.cumsum(per)
    for t, e, n in zip(texts, end, per):
        assert ids[e - n: e].tolist() == lib.encode_ordinary(t or ""), (t or "")[:80]


def test_random_texts(bpe):
    r = random.Random(1)
    alphabets = ["abcdefghijklmnopqrstuvwxyz", "aeinrst", "ab", "hxyz", " \n\t", "  a\n", "éàüß语日本", "0123 ", "the and ing tion ".split(" "), "'stredvml "]
    _same(bpe, TEXTS + ["".join(r.choices(r.choice(alphabets), k=r.randint(0, r.choice([5, 50, 400])))) for _ in range(1500)], library(bpe))


def test_every_code_point(bpe):
    chars = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF)
    _same(bpe, [f"{sep}".join(chars[i: i + 5000]) for sep in ("x", "1", " ", "'") for i in range(0, len(chars), 40000)] + ["".join(chars[i: i + 5000]) for i in range(0, len(chars), 5000)], library(bpe))


@pytest.mark.parametrize("seed", range(30))
def test_rank_files_whose_merges_open_lower_ranks(seed):
    """Random rank files over three letters: a merge often opens a pair of a lower rank, so
    order inside a word decides."""
    r = random.Random(seed)
    tokens = {bytes([b]): b for b in range(256)}
    made = {"".join(r.choices("abc", k=r.randint(2, 6))) for _ in range(40)} | {"ab", "bc", "ca", "aa"}
    for t in r.sample(sorted(made), len(made)):
        tokens[t.encode()] = len(tokens)
    import base64

    own = B.MergeReplay(b"\n".join(base64.b64encode(t) + b" " + str(i).encode() for t, i in tokens.items()), r"\S+|\s+")
    assert own.opens_lower.any()
    texts = [" ".join("".join(r.choices("abc", k=r.randint(1, 60))) for _ in range(40)) for _ in range(20)]
    _same(own, texts, library(own, r"\S+|\s+", tokens))


def test_pieces_do_not_change_the_result(bpe):
    texts = [t for t in TEXTS if t] * 3
    ids, per = bpe.encode(texts)
    end = np.cumsum(per)
    for t, e, n in zip(texts, end, per):
        assert bpe.encode([t])[0].tolist() == ids[e - n: e].tolist()


def test_frames(spark, bpe):
    df = spark.createDataFrame([(i, t, "z", "q") for i, t in enumerate(TEXTS)] + [(None, "a b", "z", "q"), (0, TEXTS[0], "z", "q")], "doc_id long, text string, ids string, id string")
    lib = library(bpe)
    rows = {x["id"]: x for x in B.round_trip_bytes(spark, df).collect()}
    ids = {x["id"]: list(x["ids"]) for x in B.encode_bytes(spark, df).collect()}
    back = {x["id"]: bytes(x["data"]) for x in B.decode_bytes(spark, B.encode_bytes(spark, df)).collect()}
    for i, t in enumerate(TEXTS):
        want = lib.encode_ordinary(t or "")
        assert ids[i] == want
        assert back[i] == lib.decode_bytes(want) == (t or "").encode()
        assert rows[i]["n_tokens"] == len(want)
        assert rows[i]["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest()
        assert rows[i]["decoded_sha256"] == hashlib.sha256(back[i]).hexdigest()
    assert B.round_trip_bytes(spark, df).where("id = 0 OR id IS NULL").count() == 3
    assert B.round_trip_bytes(spark, df.where("false")).count() == 0
    bad = spark.createDataFrame([(1, [64, None, -5, 10**8]), (2, None)], "id long, ids array<int>")
    assert {r["id"]: bytes(r["data"]) for r in B.decode_bytes(spark, bad).collect()} == {1: bpe.tokens[64], 2: b""}


def test_whole_table(spark, bpe):
    path = "/root/testdata/sf0.01"
    lib = library(bpe)
    want = {r["doc_id"]: lib.encode_ordinary(r["text"] or "") for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    got = {r["doc_id"]: r["ids_sha256"] for r in B.q_byte_bpe(spark, path).collect()}
    assert got == {i: hashlib.sha256(struct.pack(f"<{len(w)}I", *w)).hexdigest() for i, w in want.items()}
