"""The pipeline against a brute-force version of every stage on its own input."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline as P
from mixshard.llm import langid as L
from mixshard.llm import mixing as M
from mixshard.llm import text as T
from mixshard.llm import vocab

from test_line_chunks import brute as brute_lines
from test_mixing import brute as brute_rake
from test_ngram_join import brute as brute_groups
from test_ngram_join import grams  # noqa: F401

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus():
    r = random.Random(12)
    en = "the of and to in is that was for it with as on be at by this had not are but from or have an they which one you were".split()
    de = "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach".split()
    rows, passage = [], [" ".join(r.choices(en, k=9)) for _ in range(20)]
    for i in range(260):
        lang = "en" if i % 3 else "de"
        lines = [" ".join(r.choices(en if lang == "en" else de, k=r.randint(4, 14))) for _ in range(r.randint(2, 12))]
        if i % 9 == 0:
            lines[1:1] = passage
        rows.append([i, "\n".join(lines), lang, "hot" if i % 3 == 1 else f"s{i % 4}"])
    for i in range(260, 300):  # copies and near copies
        t = rows[r.randrange(200)][1]
        w = t.split(" ")
        if i % 2:
            w[len(w) // 2] = "changed"
        rows.append([i, " ".join(w), rows[i - 260][2], "hot"])
    rows += [[300, None, "en", "s1"], [301, "", None, "s1"], [302, "12 34 !", "en", None], [303, "the and of " * 4000, "en", "s1"], [304, "x", "de", None]]
    return [(*x, None if x[1] is None else len(x[1])) for x in rows]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Inputs and outputs of all stages."""
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long")
    root, out = str(tmp_path_factory.mktemp("run")), []
    docs.write.parquet(f"{root}/documents.parquet")
    docs = spark.read.parquet(f"{root}/documents.parquet")
    for name, f in P.STAGES:
        before = [tuple(x) for x in docs.select(*COLUMNS).collect()]
        f(spark, docs, root).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
        out.append((name, before, docs.columns, sorted(map(tuple, docs.collect()), key=str)))
    return root, out


def test_names_and_columns(stages):
    assert [n for n, *_ in stages[1]] == ["language_id", "line_dedup", "near_duplicates", "mixing", "bpe"]
    assert all(c == COLUMNS for _, _, c, _ in stages[1][:-1])


def test_language_id(stages, spark):
    _, before, _, after = stages[1][0]
    learn = spark.createDataFrame([r[:3] for r in before], "doc_id long, text string, lang string")
    net = L.learn(learn.where(~L.held_out()))
    texts = pa.array([r[1] for r in before], pa.string())
    lang, score = L.batch_predict(net, *T.flat(texts), texts)
    want = [r for r, x, s in zip(before, lang, score) if x != "und" and s >= P.LEAST_SCORE]
    assert after == sorted(want, key=str)
    gone = {r[0] for r in before} - {r[0] for r in after}
    assert {300, 301, 302} <= gone and len(gone) <= 5


def test_line_dedup(stages):
    _, before, _, after = stages[1][1]
    new = {i: (t, gone) for i, t, _, _, gone in brute_lines([(r[0], r[1]) for r in before])}
    want = [(r[0], new[r[0]][0], r[2], r[3], len(new[r[0]][0]) if new[r[0]][1] else r[4]) for r in before]
    assert after == sorted(want, key=str)
    assert any(g for _, g in new.values())


def test_near_duplicates(stages):
    _, before, _, after = stages[1][2]
    import test_ngram_join

    plain = test_ngram_join.grams
    test_ngram_join.grams = lambda t, n=5: plain(t, 5)
    try:
        low = brute_groups([(r[0], r[1]) for r in before], 80)
    finally:
        test_ngram_join.grams = plain
    assert after == sorted((r for r in before if low[r[0]][1] == r[0]), key=str)
    assert len(after) < len(before)


def test_mixing(stages):
    _, before, _, after = stages[1][3]
    words = {r[0]: len((r[1] or "").split()) for r in before}
    topic = lambda r: "none" if not words[r[0]] else "symbols" if 5 * sum(r[1].count(c) for c in M._SYMBOLS) >= words[r[0]] else "short" if words[r[0]] < 100 else "medium" if words[r[0]] < 1000 else "long"
    cells: dict = {}
    for r in before:
        k = (r[3], r[2], topic(r))
        cells[k] = cells.get(k, 0) + words[r[0]]
    w, _ = brute_rake(cells)
    lo, hi = 0.0, 1e6 * sum(cells.values())
    for _ in range(200):
        f = (lo + hi) / 2
        lo, hi = (f, hi) if sum(min(t, f * w.get(k, 0.0)) for k, t in cells.items()) < M.SHARE * sum(cells.values()) else (lo, f)
    rate = {k: min(1.0, lo * x / cells[k]) for k, x in w.items()}
    draw = lambda i: int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:8], 16) / 2**32
    assert after == sorted((r for r in before if words[r[0]] and draw(r[0]) < rate[r[3], r[2], topic(r)]), key=str)


def test_bpe(stages):
    from tokenizers import Tokenizer

    _, before, columns, after = stages[1][4]
    t = Tokenizer.from_file(vocab.default_path("word_bpe_49k.json"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in before:
        ids = t.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))))
    assert columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert after == sorted(want, key=str)


def test_run_chains_the_stages(spark, stages):
    got = sorted((tuple(x) for x in P.run(spark, stages[0]).collect()), key=str)
    assert got == stages[1][-1][3] and np.all([len(x) == 4 for x in got])


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
