"""The quality model against plain numpy: normal equations, kernel, isotonic fit, whole fit; odd tables."""

import numpy as np

from skein.llm import quality_model as M


def test_normal_equations_equal_numpy(spark):
    rng = np.random.default_rng(2)
    k = len(M.STATISTICS)
    x, y = rng.normal(size=(700, k)), rng.integers(0, 2, 700).astype(float)
    model = M.Model(x.mean(0), x.std(0))
    train = spark.createDataFrame([(r.tolist(), float(v)) for r, v in zip(x, y)], "stats array<double>, y double").repartition(7)
    a, b = M._equations(train, model)
    z = model.features(x)
    assert np.allclose(a, z.T @ z) and np.allclose(b, z.T @ y)


def test_features_approximate_the_kernel():
    rng = np.random.default_rng(3)
    k = len(M.STATISTICS)
    x = rng.normal(size=(120, k))
    exact = np.exp(-M.GAMMA * ((x[:, None] - x[None]) ** 2).sum(2))
    near = lambda width: M.Model(np.zeros(k), np.ones(k), width=width).features(x)[:, :-1]
    error = {w: np.abs(near(w) @ near(w).T - exact).mean() for w in (M.FEATURES, 16 * M.FEATURES)}
    assert error[M.FEATURES] < 0.06 and error[16 * M.FEATURES] < 0.4 * error[M.FEATURES]


def test_isotonic_equals_the_minimax_formula():
    rng = np.random.default_rng(4)
    for _ in range(50):
        n = int(rng.integers(1, 30))
        x, y, w = np.sort(rng.normal(size=n)) + np.arange(n), rng.integers(0, 4, n) / 3, rng.integers(1, 5, n).astype(float)
        mean = lambda a, b: (y[a : b + 1] * w[a : b + 1]).sum() / w[a : b + 1].sum()
        want = [max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
        knots, values = M.isotonic(x, y, w)
        assert (np.diff(values) > 0).all() and (np.diff(knots) > 0).all()
        assert sorted({round(v, 9) for v in want}) == [round(v, 9) for v in values]


def test_fit_equals_numpy(spark):
    """Weights of the whole fit are those of ridge regression on the same features."""
    texts = [" ".join(["good"] * (5 + i)) if i % 2 else "#" * (i + 1) + " !! bad" for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    model = M.fit(M.describe(docs), labels)
    x = np.array([M.statistics(t) for t in texts])
    same = M.Model(x.mean(0), x.std(0))
    z, y = same.features(x), np.arange(60) % 2
    ridge = M.RIDGE * len(y) / len(same.b) * np.eye(z.shape[1])
    ridge[-1, -1] = 0
    assert np.allclose(z @ model.beta, z @ np.linalg.solve(z.T @ z + ridge, z.T @ y), atol=1e-5)
    scores = model.score(x)
    assert scores[1::2].min() > scores[::2].max()


def test_odd_rows_and_names(spark):
    rows = [(1, "good words here", 1, 2, 0.5), (1, "good words here", 1, 2, 0.5), (None, "bad !!!", 1, 2, 0.5), (2, None, 1, 2, 0.5), (3, "w " * 200_000, 1, 2, 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, stats int, y int, score double")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (None, 1), (9, None)], "doc_id long, quality int")
    found = M.classify(docs, labels).collect()
    assert len(found) == 5 and all(0 <= r.score <= 1 for r in found)
    assert len({r.score for r in found if r.doc_id == 1}) == 1
    assert M.statistics(None) == M.statistics("") == M.statistics(" \n\t")
