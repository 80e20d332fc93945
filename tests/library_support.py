"""Data and table paths that several tests share."""

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


def planted(spark, n=900, k=3, d=2, spread=100.0, E=1.0, seed=0, tiny=False):
    """Seeded planted mixture: centres ~ N(0, spread*I), points ~ N(centre, E*I), labels kept."""
    import numpy as np

    rng = np.random.default_rng(seed)
    cent = rng.normal(0.0, spread ** 0.5, (k, d))
    lab = rng.integers(0, k, n)
    if tiny:
        lab[lab == k - 1] = 0
        lab[:2] = k - 1
    X = cent[lab] + rng.normal(0.0, E ** 0.5, (n, d))
    rows = [(i, X[i].tolist(), int(lab[i])) for i in range(n)]
    return spark.createDataFrame(rows, "point_id BIGINT, x ARRAY<DOUBLE>, label INT")
