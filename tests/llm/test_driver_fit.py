"""The classifier's fit on the driver, which has to do without a threaded BLAS (it can wait there for good)."""

import numpy as np

from sluice.llm import quality


def product(a, b):
    return np.einsum("ij,jk->ik", a, b)  # no BLAS here either: this test runs on the driver too


def moments(x):
    return quality.Moments(len(x), x.sum(0), product(x.T, x))


def test_fit_calls_no_linear_algebra_library(monkeypatch):
    rng = np.random.default_rng(5)
    x = np.abs(rng.normal(size=(900, quality.WIDTH)))
    x[:300, :20] += 1
    every, positive = moments(x), moments(x[:200])
    mean, std = x.mean(0), np.maximum(x.std(0), 1e-3)
    one = np.column_stack([(x - mean) / std, np.ones(len(x))])
    a = product(one.T, one) / len(one) / 2 + 0.1 * np.eye(one.shape[1])

    def refuse(*_):
        raise AssertionError("a library call on the driver")

    monkeypatch.setattr(np.linalg, "inv", refuse)
    w = quality.fit_nnpu(positive, every, 0.4)
    scores = quality.times(x, w[:-1]) + w[-1]
    assert np.isfinite(w).all() and scores[:300].mean() > scores[300:].mean()
    assert np.allclose(product(a, quality.inverse(a)), np.eye(len(a)), atol=1e-9)
    assert np.allclose(quality.times(a, w), (a * w).sum(1))
