"""Models by fold against numpy, fold by fold."""

import math

import numpy as np
import pytest

from panelwalk.operators import models

TRAIN, N = 80, 101


@pytest.fixture(scope="module")
def world():
    rng = np.random.default_rng(3)
    out = {}
    for fold in range(5):
        e = rng.normal(0, 0.01, N + 1)
        r = np.zeros(N)
        for t in range(N):
            r[t] = 0.001 + (0.5 * r[t - 1] if t else 0) + e[t + 1] + 0.4 * e[t]
        out[fold] = r
    out[5] = np.full(N, 0.01)
    return out


@pytest.fixture(scope="module")
def rows(spark, world):
    data = [(f, f"e{f % 2}", "train" if t < TRAIN else "val", t, float(v), float(v * v + t % 3)) for f, r in world.items() for t, v in enumerate(r)]
    return spark.createDataFrame(data, "fold_id long, entity string, split string, off int, r double, g double").repartition(4)


def plain(r, p, q, start, ahead):
    """One fold, one start."""
    def fit(y_at, columns):
        x = np.array([[1.0, *c] for c in columns])
        return np.linalg.lstsq(x, np.array([r[t] for t in y_at]), rcond=None)[0]

    if not q:
        at = range(p, start)
        beta = fit(at, [[r[t - k] for k in range(1, p + 1)] for t in at])
        values, shocks = list(r[:start]), []
    else:
        m = models.LONG
        at = range(m, start)
        long = fit(at, [[r[t - k] for k in range(1, m + 1)] for t in at])
        e = {t: r[t] - long @ [1.0, *(r[t - k] for k in range(1, m + 1))] for t in at}
        at = range(m + q, start)
        beta = fit(at, [[*(r[t - k] for k in range(1, p + 1)), *(e[t - k] for k in range(1, q + 1))] for t in at])
        values, shocks = list(r[:start]), [e[t] for t in range(m, start)]
    out = []
    for _ in range(ahead):
        out.append(float(beta @ [1.0, *values[: -p - 1 : -1], *(shocks[: -q - 1 : -1] if q else [])]))
        values.append(out[-1])
        shocks.append(0.0)
    return out


def test_forecasts_equal_least_squares_fold_by_fold(spark, rows, world):
    runs = spark.createDataFrame([(f, i, p, q) for f in world for i in (10, 42) for p in range(1, 8) for q in ((0, 2) if f < 5 else (0,))] + [(99, 10, 1, 0)], "fold_id long, interval int, p int, q int")
    got = {(r.fold_id, r.interval, r.p, r.q, r.off): r for r in models.arma_forecast(rows, runs).collect()}
    assert len(got) == (5 * 28 + 14) * (N - TRAIN)
    for (f, i, p, q, off), row in got.items():
        start = TRAIN + (off - TRAIN) // i * i
        if off in (TRAIN, TRAIN + 9, TRAIN + 10, N - 1):
            wanted = plain(world[f], p, q, start, off - start + 1)[-1]
            assert math.isclose(row.mu, wanted, rel_tol=1e-6, abs_tol=1e-9), (f, i, p, q, off)
        assert row.block == (off - TRAIN) // i and math.isclose(row.vol, world[f][:start].std(ddof=1), abs_tol=1e-12)
        assert row.still == bool(world[f][start : start + i].std() < 0.0015)


def test_champions_have_the_least_error(spark, rows, world):
    runs = spark.createDataFrame([(f, 42, p, 0) for f in range(5) for p in (1, 2, 3)], "fold_id long, interval int, p int, q int")
    for row in models.champions(models.arma_forecast(rows, runs)).collect():
        r = world[row.fold_id]
        rmse = {p: math.sqrt(np.mean((np.array(plain(r, p, 0, TRAIN, N - TRAIN)) - r[TRAIN:]) ** 2)) for p in (1, 2, 3)}
        assert row.p == min(rmse, key=rmse.get) and math.isclose(row.rmse, rmse[row.p]) and math.isclose(row.scaled, row.rmse / r[TRAIN:].std())


def test_draws_are_spread_and_near_champions(spark):
    cases = spark.createDataFrame([(f, i, f % 7 + 1, 3) for f in range(30) for i in (10, 20)], "fold_id long, interval int, p int, q int")
    got = models.draws(cases, 20).collect()
    assert len(got) == 30 * 2 * 20 and sorted(map(tuple, got)) == sorted(map(tuple, models.draws(cases.repartition(5), 20).collect()))
    for row in got:
        assert 1 <= row.p <= 7 and 1 <= row.q <= 7 and 0.01 <= row.thr <= 0.6
        assert row.k < 10 or abs(row.p - (row.fold_id % 7 + 1)) <= 1 and abs(row.q - 3) <= 1
    every = np.sort([(r.thr - 0.01) / 0.59 for r in got])
    assert np.abs(every - (np.arange(len(every)) + 0.5) / len(every)).max() < 0.05  # uniform
    for f in range(30):
        own = np.sort([r.thr for r in got if r.fold_id == f and r.interval == 10])
        assert own[-1] - own[0] > 0.25 and np.diff(own).max() < 0.35  # and so within each run
    assert {r.p for r in got if r.k < 10} == set(range(1, 8))
    assert abs(np.corrcoef([r.thr for r in got], [r.p for r in got])[0, 1]) < 0.1


@pytest.mark.parametrize(("lookback", "features"), [(1, ["r"]), (7, ["r", "g"])])
def test_window_regression_equals_numpy(spark, rows, world, lookback, features):
    scores, each = models.window_regression(rows, features, "g", lookback, 1e-3)
    pred = {(r.fold_id, r.off): r.pred for r in each.collect()}
    for row in scores.collect():
        r = world[row.fold_id]
        g = np.array([v * v + t % 3 for t, v in enumerate(r)])
        columns = {"r": r, "g": g}
        x = np.array([[1.0, *(columns[f][t - lookback + k] for f in features for k in range(lookback))] for t in range(lookback, N)])
        train = x[: TRAIN - lookback]
        penalty = 1e-3 * np.eye(x.shape[1])
        penalty[0, 0] = 0
        beta = np.linalg.solve(train.T @ train + penalty, train.T @ g[lookback:TRAIN])
        wanted = x @ beta
        assert np.allclose([pred[row.fold_id, t] for t in range(TRAIN, N)], wanted[TRAIN - lookback :], atol=1e-6)
        assert math.isclose(row.rmse, math.sqrt(((wanted - g[lookback:])[TRAIN - lookback :] ** 2).mean()), rel_tol=1e-6)
        assert math.isclose(row.scaled, row.rmse / g[TRAIN:].std(), rel_tol=1e-9)


def test_nulls_and_short_folds(spark, rows):
    odd = spark.createDataFrame([(7, None, "train" if t < 5 else "val", t, None if t == 2 else 0.1 * t, 1.0) for t in range(8)], rows.schema)
    runs = spark.createDataFrame([(7, 2, 1, 0)], "fold_id long, interval int, p int, q int")
    assert [r.mu for r in models.arma_forecast(odd, runs).collect()] == [None] * 3
    scores, each = models.window_regression(odd, ["r"], "g", 2)
    assert tuple(scores.first()) == (7, None, None, None) and [r.pred for r in each.collect()] == [None] * 3
    assert models.arma_forecast(rows.limit(0), runs).collect() == []
