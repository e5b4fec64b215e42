import numpy as np

from kernelweave.operators import svm


def test_separable_classes():
    rng = np.random.default_rng(0)
    centres = np.array([[0, 0], [6, 0], [0, 6]])
    y = rng.integers(0, 3, 150)
    x = centres[y] + rng.standard_normal((150, 2))
    k = x @ x.T
    pred = svm.one_against_one(k[:100, :100], y[:100].astype(str), k[100:, :100])
    assert (pred == y[100:].astype(str)).mean() > 0.95


def test_optimality():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((60, 3))
    y = np.where(x[:, 0] + 0.5 * rng.standard_normal(60) > 0, 1.0, -1.0)
    k = x @ x.T
    w, bias = svm.smo(k, y, tolerance=1e-6)
    margin, alpha = y * (k @ w + bias), w * y
    assert abs(w.sum()) < 1e-8 and (alpha > -1e-9).all() and (alpha < 1 + 1e-9).all()
    assert (margin[alpha < 1e-8] > 1 - 1e-4).all() and (margin[alpha > 1 - 1e-8] < 1 + 1e-4).all()
