"""Operator 2 against brute force, and its parts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mixshard.llm import ngram_join as J

SCHEMA = "doc_id long, text string, n_shingles string, id string, area int"


def grams(text, n=4):
    w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if x]
    return frozenset([tuple(w)] if 0 < len(w) < n else [tuple(w[i:i + n]) for i in range(len(w) - n + 1)])


def brute(rows, p=85):
    sets = [(i, grams(t)) for i, t in rows]
    low = {i: i for i, _ in sets}
    changed = True
    while changed:
        changed = False
        for a, x in sets:
            for b, y in sets:
                if x and y and 100 * len(x & y) >= p * len(x | y) and low[a] < low[b]:
                    low[b], changed = low[a], True
    return {i: (len(s), low[i]) for i, s in sets}


def corpus(seed, n=120):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdeé", k=r.randint(1, 4)))
    passage = [word() for _ in range(30)]
    out = []
    for i in range(n):
        k = r.random()
        if out and k < 0.5:  # copy with a few edits
            w = r.choice(out).split(" ")
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = word()
        else:
            w = [word() for _ in range(r.choice([1, 2, 3, 4, 5, 8, 40, 120]))]
            if k > 0.8:
                w += passage
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("most,broadcast", [(128, 32 << 20), (4, 0)])
def test_matches_brute_force(spark, monkeypatch, most, broadcast):
    import mixshard.llm.columns as C

    monkeypatch.setattr(J, "AREA_SETS", most)
    monkeypatch.setattr(J, "BROADCAST_BYTES", broadcast)
    monkeypatch.setattr(C, "BROADCAST_BYTES", broadcast)
    rows = list(enumerate(corpus(most)))
    base = " ".join(f"w{i}" for i in range(100))
    for k in range(30):  # one large group of near copies
        w = base.split()
        w[k * 3] = f"x{k}"
        rows.append((1000 + k, " ".join(w)))
    rows += [(2000, None), (2001, ""), (2002, " \n\t "), (2003, "A b C"), (2004, "a B c"), (2005, "a b"), (2006, "word " * 30000)]
    df = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], SCHEMA)
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in J.jaccard_classes(spark, df).collect()}
    assert got == brute(rows)


def test_repeated_null_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (None, None), (None, "z"), (4, "A B C D E")], "doc_id long, text string")
    got = sorted(((r["id"], r["n_shingles"], r["component_id"]) for r in J.jaccard_classes(spark, df).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (None, 2, 1), (None, 0, None), (None, 1, None), (4, 2, 1)], key=str)
    assert J.jaccard_classes(spark, df.where("false")).count() == 0


def test_similar_sets_share_a_signature():
    r = np.random.default_rng(0)
    for n in [1, 2, 3, 5, 6, 7, 12, 13, 20, 50, 130, 400]:
        for _ in range(20):
            common = r.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2)
            extra = r.integers(0, 2**63, n, dtype=np.uint64)
            for a in range(0, n // 4 + 1, max(1, n // 12)):
                for b in range(0, n // 4 + 1, max(1, n // 12)):
                    x, y = np.unique(np.append(common, extra[:a])), np.unique(np.append(common, extra[n - b:]))
                    if 100 * len(np.intersect1d(x, y)) >= 85 * len(np.union1d(x, y)):
                        own, other = J.signatures(x, 85), set(J.signatures(y, 85)[0].tolist())
                        shared = {k: sum(e in other for e in own[0][own[1] == k].tolist()) for k in set(own[1].tolist())}
                        assert any(shared[k] >= r[1] for k, r in J._classes_of(len(x), 85))


def test_tree_finds_every_link():
    r = np.random.default_rng(1)
    for seed in range(20):
        sets = [np.unique(r.integers(0, 60, r.integers(1, 40))).astype(np.uint64) for _ in range(25)]
        for k in range(25):
            s = sets[r.integers(len(sets))]
            sets.append(np.unique(np.append(s[r.random(len(s)) > 0.08], r.integers(0, 60, 2).astype(np.uint64))))
        want = {(i, j) for i in range(len(sets)) for j in range(len(sets)) if i < j
                and 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))}
        found, _ = J.tree_links(sets, 85, every=True)
        assert {(min(p), max(p)) for p in found} == want and len(found) == len(want)
        _, forest = J.tree_links(sets, 85)
        full = J.Forest(len(sets))
        for i, j in want:
            full.union(i, j)
        assert [forest.find(i) for i in range(len(sets))] == [full.find(i) for i in range(len(sets))]


def test_pair_classes_keep_each_other(spark):
    df = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("same words in all of these").alias("text"))
    assert [r[0] for r in J.jaccard_classes(spark, df).select("component_id").distinct().collect()] == [0]
