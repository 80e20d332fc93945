"""Span hashes: by content only, whatever the blocks, and no structural collisions."""

import random

import numpy as np
import pytest

from mixshard.llm import ngram_join as J
from mixshard.llm import quality
from mixshard.llm import text as T
from mixshard.llm import token_counts


def thue_morse(n):
    w = "a"
    while len(w) < n:
        w += w.translate(str.maketrans("ab", "ba"))
    return w, w.translate(str.maketrans("ab", "ba"))


def test_hashes_depend_on_content_only(monkeypatch):
    buf = np.frombuffer("".join(random.Random(0).choices("ab \n", k=5000)).encode(), np.uint8)
    s, e, _ = T.words(buf, np.array([0, 1000, 1000, 5000]))
    h = T.span_hashes(buf, s, e)
    seen = {}
    for a, b, x in zip(s, e, h.tolist()):
        assert seen.setdefault(bytes(buf[a:b]), x) == x
    assert len(set(seen.values())) == len(seen)
    for block in (1, 7, 512):
        monkeypatch.setattr(T, "_MIX_BYTES", block)
        assert (T.span_hashes(buf, s, e) == h).all()


@pytest.mark.parametrize("n", [512, 1024, 2048, 4096, 1 << 16])
def test_thue_morse_words_and_their_complements_differ(n):
    a, b = thue_morse(n)
    buf = np.frombuffer(f"{a} {b}".encode(), np.uint8)
    s, e, _ = T.words(buf, np.array([0, len(buf)]))
    x, y = T.span_hashes(buf, s, e)
    assert x != y


def test_queries_tell_them_apart(spark):
    a, b = thue_morse(4096)
    docs = spark.createDataFrame([(1, f"{a} x"), (2, f"{b} x"), (3, f"{a}\n{b}"), (4, f"{a}\n{a}")], "doc_id long, text string")
    assert {r["id"]: r["component_id"] for r in J.jaccard_classes(spark, docs).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}
    assert {r["id"]: r["n_dup_lines"] for r in quality.quality(spark, docs).collect()} == {1: 0, 2: 0, 3: 0, 4: 1}


def test_prefixes_of_similar_sets_meet():
    """By any counters that are no less than the true counts, also crowded ones."""
    r = np.random.default_rng(0)
    for trial in range(200):
        n = int(r.integers(1, 80))
        common = np.unique(r.integers(0, 1 << 62, n, dtype=np.uint64))
        extra = [r.integers(0, 1 << 62, int(r.integers(0, 1 + n // 4)), dtype=np.uint64) for _ in range(2)]
        sets = [np.unique(np.append(common, x)) for x in extra]
        sets += [np.unique(np.append(common[: n // 3], r.integers(0, 1 << 62, 20, dtype=np.uint64))) for _ in range(int(r.integers(0, 30)))]
        counts = np.zeros((2, int(r.choice([4, 64, 4096]))), np.int64)
        for s in sets:
            for row, at in zip(counts, J._slots(s, counts.shape[1])):
                np.add.at(row, at, 1)
        for p in (80, 85, 100):
            x, y = sets[:2]
            if 100 * len(np.intersect1d(x, y)) >= p * len(np.union1d(x, y)):
                assert len(np.intersect1d(J.set_prefix(x, counts, p), J.set_prefix(y, counts, p)))
