from itertools import combinations

import pytest

from mixshard.operators.evaluate import adjusted_rand_index, contingency, contingency_totals


def _ari_py(a, b):
    n = len(a)
    pairs = list(combinations(range(n), 2))
    both = sum(1 for i, j in pairs if a[i] == a[j] and b[i] == b[j])
    sa = sum(1 for i, j in pairs if a[i] == a[j])
    sb = sum(1 for i, j in pairs if b[i] == b[j])
    exp = sa * sb / len(pairs)
    den = (sa + sb) / 2 - exp
    return 1.0 if den == 0 else (both - exp) / den


def _ari(spark, a, b):
    df = spark.createDataFrame(list(zip(a, b)), "cluster_id INT, label INT")
    return adjusted_rand_index(df).first()["ari"]


@pytest.mark.parametrize("a,b", [
    ([0, 0, 1, 1, 2, 2], [5, 5, 3, 3, 9, 9]),  # same partition, other names
    ([0, 0, 1, 1, 2, 2, 2], [0, 1, 0, 1, 0, 1, 1]),  # independent-ish
    ([0, 0, 0, 1, 1, 2, 2, 2], [1, 1, 2, 2, 2, 0, 0, 1]),
    ([0, 0, 0, 0], [1, 1, 1, 1]),  # both trivial: defined as 1
])
def test_ari_golden(spark, a, b):
    assert _ari(spark, a, b) == pytest.approx(_ari_py(a, b), abs=1e-12)


def test_ari_identity_and_permutation(spark):
    a = [0, 0, 1, 1, 1, 2, 2, 3]
    assert _ari(spark, a, a) == pytest.approx(1.0)
    perm = {0: 3, 1: 0, 2: 1, 3: 2}
    assert _ari(spark, [perm[v] for v in a], a) == pytest.approx(1.0)


def test_contingency_margins(spark):
    df = spark.createDataFrame([(0, 1), (0, 1), (1, 1), (1, 2), (None, 2)], "cluster_id INT, label INT")
    ct = contingency(spark.createDataFrame([(0, 1), (0, 1), (1, 1), (1, 2)], "cluster_id INT, label INT"))
    t = {(r.cluster_id, r.label, r.level): r.n for r in contingency_totals(ct).collect()}
    assert t[(0, 1, 0)] == 2 and t[(0, -1, 1)] == 2 and t[(-1, 1, 2)] == 3 and t[(-1, -1, 3)] == 4
    assert df.count() == 5


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 2)), min_size=2, max_size=25))
def test_ari_matches_pair_counting(spark, pairs):
    a = [p[0] for p in pairs]
    b = [p[1] for p in pairs]
    assert _ari(spark, a, b) == pytest.approx(_ari_py(a, b), abs=1e-9)
