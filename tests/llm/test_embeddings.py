"""Operator 6 against brute force; recall on the larger table."""

import numpy as np
import pytest

from mixshard.llm import embeddings as E

SCHEMA = "vec_id long, embedding array<float>, label int, kept string, component_id int"


def brute(rows, t=0.93):
    ok = [(i, np.array(v, float), l) for i, v, l in rows if i is not None and l is not None and v and all(e is not None and np.isfinite(e) for e in v) and any(v)]
    n, low = {i: 0 for i, *_ in rows}, {i: i for i, *_ in rows}
    pairs = []
    for k, (a, x, l) in enumerate(ok):
        for b, y, m in ok[:k]:
            if l == m and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= t:
                pairs.append((a, b))
                n[a] += 1
                n[b] += 1
    for _ in rows:
        for a, b in pairs:
            low[a] = low[b] = min(low[a], low[b])
    return {i: (n[i], low[i], low[i] == i) for i, *_ in rows}


def cloud(n, d=16, seed=0, labels=3):
    r = np.random.default_rng(seed)
    base = r.normal(size=(max(2, n // 6), d))
    x = base[r.integers(len(base), size=n)] + r.normal(size=(n, d)) * r.choice([0.01, 0.08, 0.6], size=(n, 1))
    return [(i, x[i].astype(np.float32).tolist(), int(r.integers(labels))) for i in range(n)]


@pytest.mark.parametrize("block,cell_rows", [(1024, 4096), (16, 4096), (1024, 60)])
def test_matches_brute_force(spark, monkeypatch, block, cell_rows):
    monkeypatch.setattr(E, "BLOCK", block)
    rows = cloud(300, seed=block)
    rows += [(1000 + i, rows[0][1], rows[0][2]) for i in range(40)]  # exact copies
    rows += [(2000, None, 1), (2001, [], 1), (2002, [0.0] * 16, 1), (2003, [float("nan")] * 16, 1), (2004, [None] + [1.0] * 15, 1), (2005, rows[0][1], None),
             (2006, [1.0, 2.0], 1), (2007, [1.0, 2.1], 1), (2008, [float("inf")] * 16, 1), (2009, [1e-30] * 16, 9), (2010, [1e30] * 16, 9)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = {r["id"]: (r["n_links"], r["component_id"], r["kept"]) for r in E.near_dedup(spark, df, cell_rows=cell_rows).collect()}
    assert got == brute(rows)


def test_repeats_null_ids_no_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (2, [1.0, 0.01], 1)], "vec_id long, embedding array<float>, label int")
    got = sorted(str(tuple(r)) for r in E.near_dedup(spark, df).collect())
    assert got == ["(1, 2, 1, True)", "(1, 2, 1, True)", "(2, 2, 1, False)", "(None, 0, None, False)"]
    assert E.near_dedup(spark, df.where("false")).count() == 0


def test_recall_on_the_table(spark):
    """sf0.1 with small cells: every link of a brute-force product is found."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.select("vec_id", "label", "embedding").collect()
    x = np.array([r["embedding"] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r["label"] for r in rows])
    want = int(((x @ x.T >= 0.93) & (label[:, None] == label)).sum() - len(x))
    got = E.near_dedup(spark, df, cell_rows=128).agg({"n_links": "sum"}).first()[0]
    assert got <= want and got >= 0.99 * want


def planted(pairs, d=64, seed=3):
    """Random unit vectors, each followed by one at a cosine of 0.93 to 0.95."""
    r = np.random.default_rng(seed)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    a = unit(r.normal(size=(pairs, d)))
    z = r.normal(size=(pairs, d))
    z = unit(z - (z * a).sum(axis=1, keepdims=True) * a)
    c = r.uniform(0.9301, 0.95, size=(pairs, 1))
    return a, c * a + np.sqrt(1 - c * c) * z


def test_recall_with_many_cells(spark):
    a, b = planted(3000)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate([a, b]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = E.near_dedup(spark, df, cell_rows=6).agg({"n_links": "sum"}).first()[0]  # 1,000 cells
    assert 0.998 * 6000 <= got <= 6000


@pytest.mark.parametrize("k,rounds", [(20, 8), (200, 8), (2000, 3), (8000, 1)])
def test_pairs_share_a_cell(monkeypatch, k, rounds):
    monkeypatch.setattr(E, "ROUNDS", rounds)
    a, b = planted(2000)
    x = np.random.default_rng(4).normal(size=(32000, 64))
    centres = E.fit_cells((x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32), k)
    near_a, near_b = (E.nearest(m, centres, E.probes_for(k)) for m in (a, b))
    assert (near_a[:, :, None] == near_b[:, None, :]).any(axis=(1, 2)).mean() >= 0.998
