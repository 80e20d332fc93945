"""Operator 9 against numpy raking; margins; defined cases."""

import collections
import hashlib

import pytest

from mixshard.llm import mixing as M


def brute(cells, power=M.POWER, rounds=M.ROUNDS, targets=None):
    cells = {k: t for k, t in cells.items() if t > 0}
    total = sum(cells.values())
    w = {k: t / total for k, t in cells.items()}
    aims = []
    for d in range(3):
        by = collections.Counter()
        for k, t in cells.items():
            by[k[d]] += t
        a = {v: (targets[d].get(v, 0.0) if targets and d in targets else t**power) for v, t in by.items()}
        s = sum(a.values())
        aims.append({v: x / s for v, x in a.items()})
    for _ in range(rounds):
        for d in range(3):
            held = collections.Counter()
            for k, x in w.items():
                held[k[d]] += x
            w = {k: x * aims[d][k[d]] / held[k[d]] if held[k[d]] else 0.0 for k, x in w.items()}
    return w, aims


@pytest.fixture(scope="module")
def docs(spark):
    rows = []
    for i in range(600):
        source, lang = ("hot" if i % 3 == 0 else f"s{i % 7}"), ["en", "de", None][(i // 5) % 3]
        text = " ".join(["word"] * (1 + (i * 37) % 1500)) + (" # $ %" * 300 if i % 11 == 0 else "")
        rows.append((i, None if i == 1 else "" if i == 2 else " \n" if i == 4 else text, lang, None if i % 50 == 7 else source, "x", 2))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, topic string, rate int").cache()


def test_matches_brute_force(spark, docs):
    got = M.mix(spark, docs).collect()
    assert len(got) == 600
    cells = collections.Counter()
    for r in got:
        assert r["n_tokens"] == len((r["row"]["text"] or "").split())
        cells[r["source"], r["lang"], r["topic"]] += r["n_tokens"]
    w, aims = brute(cells)
    rate = {k: x / cells[k] for k, x in w.items()}
    top = max(rate.values())
    for r in got:
        p = rate.get((r["source"], r["lang"], r["topic"]), 0) / top if r["n_tokens"] else 0.0
        assert r["probability"] == pytest.approx(p, rel=1e-9, abs=1e-12)
        u = int(hashlib.md5(f"mix:{r['row']['doc_id']}".encode()).hexdigest()[:8], 16) / 2**32
        assert r["kept"] == (u < r["probability"])
    for d in range(3):  # the margins are met
        held = collections.Counter()
        for k, x in w.items():
            held[k[d]] += x
        for v, a in aims[d].items():
            assert held[v] == pytest.approx(a, rel=5e-3)


def test_given_targets(spark, docs):
    got = M.mix(spark, docs, targets={"lang": {"en": 1.0, "de": 3.0}}).collect()
    want = collections.Counter()
    for r in got:
        want[r["lang"]] += r["n_tokens"] * r["probability"]
    assert want["de"] == pytest.approx(3 * want["en"], rel=0.02) and want[None] == 0


def test_rows(spark, docs):
    assert M.mix(spark, docs.where("false")).count() == 0
    df = spark.createDataFrame([(None, "a b", "en", "s"), (1, "a b", "en", "s"), (1, "a b", "en", "s")], "doc_id long, text string, lang string, source string")
    assert {(r["row"]["doc_id"], r["probability"], r["kept"]) for r in M.mix(spark, df).collect()} == {(None, 1.0, True), (1, 1.0, True)}


def test_budget_does_not_follow_the_scarcest_cell(spark, docs):
    tiny = spark.createDataFrame([(9999, "five words in a cell", "en", "its own", "x", 2)], docs.schema)
    for df in (docs, docs.union(tiny)):
        total = df.select(M.n_words(M.F.col("text")).alias("n")).agg({"n": "sum"}).first()[0]
        got = M.mix(spark, df, tokens=total / 2).collect()
        assert sum(r["rate"] * r["n_tokens"] for r in got) == pytest.approx(total / 2, rel=1e-9)
        assert sum(r["copies"] * r["n_tokens"] for r in got) == pytest.approx(total / 2, rel=0.1)
        for r in got:
            u = int(hashlib.md5(f"mix:{r['row']['doc_id']}".encode()).hexdigest()[:8], 16) / 2**32
            assert r["copies"] == int(r["rate"]) + (u < r["rate"] - int(r["rate"])) and r["kept"] == (r["copies"] > 0)
    assert max(r["rate"] for r in got) > 1 and min(r["copies"] for r in got if r["row"]["doc_id"] == 9999) > 1
    with_tiny = M.mix(spark, docs.union(tiny)).where("kept").count()  # without a budget the tiny cell sets the scale
    assert with_tiny < M.mix(spark, docs).where("kept").count() / 2 < sum(r["kept"] for r in got)


def test_rakes_to_a_tolerance(spark):
    df = spark.createDataFrame([("a", "x", "t", 300), ("a", "y", "t", 10), ("b", "x", "t", 10), ("b", "y", "t", 300)], "source string, lang string, topic string, tokens long")
    want = {"source": {"a": 0.5, "b": 0.5}, "lang": {"x": 0.7, "y": 0.3}}

    def worst(rows):
        off = []
        for d, aim in want.items():
            for v, a in aim.items():
                off.append(abs(sum(r["weight"] for r in rows if r[d] == v) - a) / a)
        return max(off)

    assert worst(M.rake(df, want).collect()) > 1e-3  # six rounds are not enough
    assert worst(M.rake(df, want, rounds=20, tolerance=1e-3).collect()) <= 1e-3
    odd = spark.createDataFrame([("a", "x", "t", 5), ("b", "y", "t", 5)], df.schema)
    with pytest.raises(ValueError, match="off their targets"):
        M.rake(odd, {"source": {"a": 0.9, "b": 0.1}, "lang": {"x": 0.5, "y": 0.5}}, rounds=3, tolerance=1e-3)


def test_plan_is_native(spark):
    plan = M.q_mixing(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_share_takes_scarce_cells_whole(spark, docs):
    """Against water filling by bisection; a stray document of its own source changes next to nothing."""
    tiny = spark.createDataFrame([(9999, "five words in a cell", "en", "its own", "x", 2)], docs.schema)
    held = []
    for df in (docs, docs.union(tiny)):
        got = M.mix(spark, df, share=0.8).collect()
        cells = collections.Counter()
        for r in got:
            cells[r["source"], r["lang"], r["topic"]] += r["n_tokens"]
        w, _ = brute(cells)
        total = sum(cells.values())
        lo, hi = 0.0, 1e6 * total
        for _ in range(200):
            f = (lo + hi) / 2
            lo, hi = (f, hi) if sum(min(cells[k], f * x) for k, x in w.items()) < 0.8 * total else (lo, f)
        for r in got:
            k = (r["source"], r["lang"], r["topic"])
            assert r["probability"] == pytest.approx(min(1.0, lo * w[k] / cells[k]) if r["n_tokens"] else 0.0, rel=1e-9, abs=1e-12)
            u = int(hashlib.md5(f"mix:{r['row']['doc_id']}".encode()).hexdigest()[:8], 16) / 2**32
            assert r["kept"] == (u < r["probability"])
        assert sum(r["n_tokens"] * r["probability"] for r in got) == pytest.approx(0.8 * total, rel=1e-9)
        held.append(sum(r["n_tokens"] for r in got if r["kept"]))
    assert abs(held[1] / held[0] - 1) < 0.01
    assert all(r["kept"] for r in M.mix(spark, docs.where("doc_id > 10"), share=1.0).collect())
    assert M.mix(spark, docs.where("false"), share=0.8).count() == 0
    with pytest.raises(ValueError, match="share"):
        M.mix(spark, docs, share=1.5)


def test_very_long_text(spark):
    df = spark.createDataFrame([(1, "w " * 2_000_000, "en", "s"), (2, "a b", "en", "s")], "doc_id long, text string, lang string, source string")
    assert {(r["row"]["doc_id"], r["n_tokens"], r["topic"]) for r in M.mix(spark, df, share=0.8).collect()} == {(1, 2_000_000, "long"), (2, 2, "short")}
