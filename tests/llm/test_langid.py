"""Operator 5: held-out accuracy, windows, gradients, defined cases."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mixshard.llm import langid as L
from mixshard.llm import text as T

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = L.q_langid(spark, SF)
    assert got.count() == docs.count()
    rows = got.join(docs.select("doc_id", "lang", "text"), "doc_id").where("held_out and lang is not null and lang_pred <> 'und'")
    right, n = rows.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 100 and right > 0.97
    assert got.where("score < 0 or score > 1 or score is null").count() == 0


def test_held_out_column(spark):
    import zlib

    got = spark.range(2000).select("id", L.held_out("id").alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in got)


def test_defined_cases(spark):
    net = L.train(["the cat and the dog " * 30] * 40 + ["der hund und die katze " * 30] * 40, ["en"] * 40 + ["de"] * 40)
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, " 12 ?!", "x"), (4, "the dog and the cat", "x"), (4, "the dog and the cat", "x"), (None, "und der hund", "x"),
                                (5, "the dog " * 300_000, "x")], "doc_id long, text string, lang_pred string")
    got = [tuple(r)[:2] for r in L.predict(spark, df, net).collect()]
    assert sorted(got, key=str) == sorted([(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (None, "de"), (5, "en")], key=str)
    assert L.predict(spark, df.where("false"), net).count() == 0
    none = L.learn(df.withColumn("lang", F.lit(None).cast("string")).withColumnRenamed("doc_id", "i"), "i")
    assert none is None and {r["lang_pred"] for r in L.predict(spark, df, none).collect()} == {"und"}


def test_windows_cover_whole_texts():
    texts = ["a" * 5, "", "b" * 256, "c" * 1000, "é" * 300]
    buf, off = T.flat(pa.array(texts))
    rows, doc = L.cut_windows(buf, off)
    for i, t in enumerate(texts):
        assert rows[doc == i].tobytes().rstrip(b"\0") == t.encode()


def test_gradients_against_differences():
    rng = np.random.default_rng(0)
    net = L.ByteCNN(["a", "b", "c"], rng)
    x, y, w = rng.integers(1, 256, (6, L.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 0, 1, 2]), np.ones(6, np.float32)

    def loss():
        return float(-np.log(net.probabilities(x).astype(float)[np.arange(6), y]).mean())

    g = net._gradients(x, y, w)
    for name in ("filt", "bias", "out", "out_bias", "emb"):
        p = getattr(net, name)
        flat = np.flatnonzero(np.abs(g[name]).ravel() > np.abs(g[name]).max() * 0.5)[:3]
        for i in flat:
            old, eps = p.ravel()[i], 1e-2
            p.ravel()[i] = old + eps
            up = loss()
            p.ravel()[i] = old - eps
            down = loss()
            p.ravel()[i] = old
            assert (up - down) / (2 * eps) == pytest.approx(g[name].ravel()[i], rel=0.15, abs=2e-4), name


def test_training_windows_come_from_the_whole_text():
    """Also from far beyond the first kilobytes."""
    raw = bytes([97]) * 50_000 + bytes([98]) * 50_000
    seen = [L.training_windows(raw, str(i)) for i in range(40)]
    ends = [(w == 98).any(axis=1) for w in seen]
    assert 0.3 < np.mean(np.concatenate(ends)) < 0.7
    assert all((a == b).all() for a, b in zip(seen, (L.training_windows(raw, str(i)) for i in range(40))))
    assert L.training_windows(b"", "x").shape == (1, L.WINDOW) and not L.training_windows(b"", "x").any()


def test_learns_from_text_ends(spark):
    """The languages differ only after four kilobytes that they share."""
    r = np.random.default_rng(1)
    words = {"en": ["the", "and", "of", "with"], "de": ["der", "und", "von", "mit"]}
    rows = []
    for i in range(300):
        lang = ("en", "de")[i % 2]
        rows.append((i, "1234567 " * 512 + " ".join(r.choice(words[lang], 3000)), lang))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = L.learn(df)
    got = L.predict(spark, df, net).collect()
    assert np.mean([r["lang_pred"] == ("en", "de")[r["id"] % 2] for r in got]) > 0.98


def test_scores_against_a_plain_forward_pass(spark):
    """Window by window with loops: embedding, filters, maximum, softmax, weighted mean."""
    texts = ["the cat and the dog", "und der hund " * 60, "1 2 3 x", "é" * 200]
    net = L.train(["the cat and the dog " * 30] * 20 + ["der hund und die katze " * 30] * 20, ["en"] * 20 + ["de"] * 20)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["id"]: (r["lang_pred"], r["score"]) for r in L.predict(spark, df, net).collect()}
    for i, t in enumerate(texts):
        raw, total = t.encode(), np.zeros(len(net.langs))
        for lo in range(0, len(raw), L.WINDOW):
            w = raw[lo: lo + L.WINDOW]
            e = np.zeros((L.WINDOW + net.wide - 1, L.EMBED))
            e[: L.WINDOW] = net.emb[np.frombuffer(w.ljust(L.WINDOW, b"\0"), np.uint8)]
            resp = np.stack([e[p: p + net.wide].ravel() @ net.filt + net.bias for p in range(L.WINDOW)])
            z = np.maximum(resp, 0).max(axis=0) @ net.out + net.out_bias
            total += np.exp(z - z.max()) / np.exp(z - z.max()).sum() * (sum(c >= 128 or chr(c).isalpha() for c in w) + 1e-3)
        p = total / total.sum()
        assert got[i][0] == net.langs[int(p.argmax())]
        assert got[i][1] == pytest.approx(p.max(), abs=1e-4)
