"""Operator 1 against the plain recurrence, pre-token by pre-token."""

import random

import numpy as np

from mixshard.llm import token_counts as C
from mixshard.llm import vocab


def brute(pieces, word):
    """Best segmentation by the definition: every split, scores by rank; ties to the shorter last piece."""
    score = {}
    for r, p in enumerate(pieces):
        score.setdefault(p, -float(np.log(r + 1.0)))
    byte = min(score.values()) - 10.0
    best = {"": (0.0, 0)}
    for i in range(1, len(word) + 1):
        options = []
        for j in range(i - 1, -1, -1):
            s, n = best[word[:j]]
            if word[j:i] in score:
                options.append((s + score[word[j:i]], n + 1))
            elif i - j == 1:
                b = len(word[j].encode())
                options.append((s + b * byte, n + b))
        top = max(o[0] for o in options)
        best[word[:i]] = next(o for o in options if o[0] == top)
    return best[word][1]


def test_matches_brute_force(spark):
    pieces = C.load_pieces(vocab.default_path("piece_bpe_32k.model"))
    r = random.Random(1)
    words = ["the", "thereation", "é", "日本語", "😀x", "a" * 50, "q" * 300, "hello,", "1234", "\u0001"] + ["".join(r.choices("etaoinshrdlué.,1", k=r.randint(1, 14))) for _ in range(300)]
    texts = [" ".join(r.choices(words, k=r.randint(1, 60))) for _ in range(60)] + ["", None, " \n ", "word " * 5000]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = {x["id"]: (x["n_words"], x["n_tokens"]) for x in C.token_counts(spark, df).collect()}
    known = {}
    for i, t in enumerate(texts):
        ws = (t or "").split()
        for w in ws:
            known.setdefault(w, None)
    for w in known:
        known[w] = brute(pieces, C.MARK + w) if len(w) < 100 else C.Unigram(pieces).count_one(C.MARK + w)
    assert got == {i: (len((t or "").split()), sum(known[w] for w in (t or "").split())) for i, t in enumerate(texts)}


def test_long_words_alone_count_the_same():
    m = C.Unigram(["a", "b", "ab", "aba", "▁", "▁a", "bb"])
    w = "▁" + "abbaabab" * 40
    points = np.array([ord(c) for c in w])
    assert C.Unigram.count_all(m, points, np.array([len(w)]))[0] == m.count_one(w)
    old, C.TRIE_DEPTH = C.TRIE_DEPTH, 10**6
    try:
        assert m.count_all(points, np.array([len(w)]))[0] == m.count_one(w)
    finally:
        C.TRIE_DEPTH = old


def test_no_rows_null_ids_repeats(spark):
    df = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (2, None)], "doc_id long, text string")
    assert C.token_counts(spark, df.where("false")).count() == 0
    assert sorted(str((r["id"], r["n_words"])) for r in C.token_counts(spark, df).collect()) == ["(1, 2)", "(1, 2)", "(2, 0)", "(None, 2)"]
