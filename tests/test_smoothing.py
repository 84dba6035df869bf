import numpy as np
import pytest
from framebasin.operators import smoothing as sm


def dense(x, y, w):
    """The penalised fit with full matrices."""
    n, h = len(x), np.diff(x)
    q, r = np.zeros((n, n - 2)), np.zeros((n - 2, n - 2))
    for k in range(n - 2):
        q[k, k], q[k + 1, k], q[k + 2, k] = 1 / h[k], -1 / h[k] - 1 / h[k + 1], 1 / h[k + 1]
        r[k, k] = (h[k] + h[k + 1]) / 3
        if k + 1 < n - 2:
            r[k, k + 1] = r[k + 1, k] = h[k + 1] / 6
    g = np.linalg.solve(r + w * q.T @ q, q.T @ y)
    return y - w * q @ g


@pytest.mark.parametrize("bound", [0.0, 0.3, 2.0])
def test_residual_meets_the_bound_and_nothing_is_smoother(bound):
    rng = np.random.default_rng(1)
    x = np.cumsum(rng.uniform(0.2, 0.6, 40))
    y = np.sin(x) + rng.normal(0, 0.3, 40)
    f, g = sm.smoothing_spline(x, y, bound)
    assert ((y - f) ** 2).sum() == pytest.approx(bound, abs=1e-9)
    if bound:
        weights = np.logspace(-6, 6, 400)
        sizes = [((y - dense(x, y, w)) ** 2).sum() for w in weights]
        w = np.interp(bound, sizes, weights)
        assert np.abs(f - dense(x, y, w)).max() < 0.02
    # continuous with its first derivative, and equal to f at the points
    eps = 1e-6
    assert np.allclose(sm.spline_values(x, f, g, x), f)
    inner = x[1:-1]
    left = (sm.spline_values(x, f, g, inner) - sm.spline_values(x, f, g, inner - eps)) / eps
    right = (sm.spline_values(x, f, g, inner + eps) - sm.spline_values(x, f, g, inner)) / eps
    assert np.abs(left - right).max() < 1e-4


def test_a_wide_bound_gives_the_straight_line():
    x = np.arange(1.0, 9.0)
    y = 3 - 0.5 * x + np.array([0.1, -0.1] * 4)
    f, g = sm.smoothing_spline(x, y, 100.0)
    assert np.allclose(f, np.polyval(np.polyfit(x, y, 1), x)) and not g.any()
    assert sm.first_rise(x, y, 100.0) is None
    assert sm.smoothing_spline(np.array([1.0]), np.array([2.0]), 1.0)[0] == [2.0]


def test_the_first_minimum_of_a_known_curve(spark):
    r = np.arange(1, 161) * 0.05
    g = 1 + 3 * np.exp(-((r - 2.0) ** 2) / 0.1) + 0.8 * np.exp(-((r - 4.5) ** 2) / 0.3) - np.exp(-((r - 3.1) ** 2) / 0.2)
    noisy = g + np.random.default_rng(2).normal(0, 0.02, len(r))
    assert sm.first_rise(r, noisy, bound=0.06) == pytest.approx(3.1, abs=0.15)
    rows = [("Mo", "Te", float(a), float(b)) for a, b in zip(r, noisy, strict=True)] + [("Li", "Mo", 1.0, 2.0), ("Li", "Mo", 2.0, 1.0)]
    got = {(x.sa, x.sb): x.rcut for x in sm.spline_minimum(spark.createDataFrame(rows, "sa string, sb string, r double, g double"), 0.06).collect()}
    assert got == {("Mo", "Te"): sm.first_rise(r, noisy, 0.06)}
