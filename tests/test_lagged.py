"""Lagged regressions and clusters of fronts against numpy."""

import datetime

import numpy as np
import pytest

from panelwalk.operators import lagged


@pytest.fixture(scope="module")
def world():
    rng = np.random.default_rng(5)
    out = {}
    for e, n in (("a", 300), ("b", 80)):
        r = rng.normal(0, 0.01, n)
        for t in range(1, n):
            r[t] *= 1 + 40 * abs(r[t - 1])
        out[e] = r
    return out


@pytest.fixture(scope="module")
def rows(spark, world):
    day = datetime.date(2001, 1, 1)
    data = [(e, day + datetime.timedelta(t), float(v), float(100 * np.exp(x[: t + 1].sum()))) for e, x in world.items() for t, v in enumerate(x)]
    return spark.createDataFrame([*data, ("c", day, 0.1, 5.0)], "entity string, ts date, r double, close double").repartition(3)


def regression(x, y):
    x = np.column_stack([np.ones(len(y)), x])
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    rest = ((y - x @ beta) ** 2).sum()
    error = np.sqrt(rest / (len(y) - x.shape[1]) * np.diag(np.linalg.inv(x.T @ x)))
    return beta, error, 1 - rest / ((y - y.mean()) ** 2).sum()


@pytest.mark.parametrize("most", [1, 2, 20])
def test_arch_lm_equals_numpy(rows, world, most):
    got = {r.entity: r for r in lagged.arch_lm(rows, most=most).collect()}
    assert set(got) == set(world)
    for e, r in world.items():
        y = (r - r.mean()) ** 2
        _, _, r2 = regression(np.column_stack([y[most - k : len(y) - k] for k in range(1, most + 1)]), y[most:])
        assert np.isclose(got[e].lm, (len(y) - most) * r2, rtol=1e-6) and got[e].n == len(y) - most


@pytest.mark.parametrize("lags", [0, 1, 5])
def test_dickey_fuller_equals_numpy(rows, world, lags):
    got = {r.entity: r for r in lagged.dickey_fuller(rows, lags=lags).collect()}
    for e, r in world.items():
        close = 100 * np.exp(np.cumsum(r))
        d = np.diff(close)
        y = d[lags:]
        beta, error, _ = regression(np.column_stack([close[lags:-1], *(d[lags - k : len(d) - k] for k in range(1, lags + 1))]), y)
        assert np.isclose(got[e].t_stat, beta[1] / error[1], rtol=1e-5) and got[e].stationary == (beta[1] / error[1] < -2.86)


def test_ljung_box_of_squares_equals_numpy(rows, world):
    got = {r.entity: r.q for r in lagged.ljung_box_of_squares(rows.where("entity <> 'c'")).collect()}
    for e, r in world.items():
        y = (r - r.mean()) ** 2
        d, n = y - y.mean(), len(y)
        rho = [(d[k:] * d[:-k]).sum() / (d * d).sum() for k in range(1, 21)]
        assert np.isclose(got[e], n * (n + 2) * sum(p * p / (n - k) for k, p in enumerate(rho, 1)))


def lloyd(points, k, steps):
    points = sorted(points)
    p = np.array(points)
    span = p.max(0) - p.min(0)
    x = np.where(span > 0, (p - p.min(0)) / np.where(span > 0, span, 1), 0.0)
    centers = np.array([x[int((i + 0.5) * len(x) / k)] for i in range(k)])
    for _ in range(steps):
        own = np.round(((x[:, None] - centers) ** 2).sum(-1), 12).argmin(1)
        centers = np.array([x[own == i].mean(0) if (own == i).any() else c for i, c in enumerate(centers)])
    return [points[int(np.round(((x - c) ** 2).sum(1), 12).argmin())] for c in centers]


def test_medoids_of_clusters_equal_numpy(spark):
    rng = np.random.default_rng(7)
    fronts = {g: [(float(a), float(b)) for a, b in np.round(rng.normal(size=(n, 2)) * [1, 20], 3)] for g, n in enumerate([1, 2, 3, 5, 9, 15, 15, 30])}
    fronts[8] = [(1.0, 2.0)] * 4
    df = spark.createDataFrame([(g, *p) for g, v in fronts.items() for p in v], "g int, f0 double, f1 double").repartition(4)
    got = {(r.g, r.nth): (r.f0, r.f1) for r in lagged.front_medoids(df, ["g"], 3, 4).collect()}
    assert {g for g, _ in got} == {g for g, v in fronts.items() if len(v) >= 3}
    for g, v in fronts.items():
        if len(v) >= 3:
            assert [got[g, i] for i in (1, 2, 3)] == lloyd(v, 3, 4), g
