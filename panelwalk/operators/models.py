"""Models by fold in one plan: autoregressions with and without moving averages, and ridge regressions of windows.

A fold has a fixed number of rows, so it becomes one row with arrays; tasks fit the models of many folds at once
from Gram matrices. Nothing of a fold comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Order of the autoregression whose residuals stand for the shocks of a moving average.
LONG = 12
#: Folds whose running Gram matrices are held at once.
FOLDS_AT_ONCE = 64
STILL = 0.0015


def fold_arrays(rows: DataFrame, columns: list[str]) -> DataFrame:
    """fold_id, entity, train (how many rows) and an array of each column in order of off. A fold is a bounded group."""
    found = rows.groupBy("fold_id", "entity").agg(F.count_if(F.col("split") == "train").cast("int").alias("train"), F.sort_array(F.collect_list(F.struct("off", *columns))).alias("rows"))
    return found.select("fold_id", "entity", "train", *[F.col(f"rows.{c}").alias(c) for c in columns])


def least_squares(gram: np.ndarray) -> np.ndarray:
    """Coefficients from Gram matrices of (regressors, goal): batched Cholesky solves; the shortest solution where
    a batch has a singular matrix."""
    a, b = gram[..., :-1, :-1], gram[..., :-1, -1:]
    try:
        lower = np.linalg.cholesky(a)
        return np.linalg.solve(lower.swapaxes(-1, -2), np.linalg.solve(lower, b))[..., 0]
    except np.linalg.LinAlgError:
        return (np.linalg.pinv(a, hermitian=True) @ b)[..., 0]


def _lagged(r: np.ndarray, p: int) -> np.ndarray:
    """(1, the p values before, the value) of each place from p on."""
    n, t = r.shape
    return np.stack([np.ones((n, t - p)), *(r[:, p - k : t - k] for k in range(1, p + 1)), r[:, p:]], -1)


def _autoregressions(r: np.ndarray, p: int, starts: list[int]) -> np.ndarray:
    """Coefficients by start and fold, from running Gram matrices read where blocks begin."""
    x = _lagged(r, p)
    running = np.cumsum(x[..., :, None] * x[..., None, :], axis=1)
    return np.stack([least_squares(running[:, s - p - 1]) for s in starts])


def arma_means(r: np.ndarray, p: int, q: int, starts: list[int], ahead: int) -> np.ndarray:
    """Mean forecasts by start, fold and step of ARMA(p, q) fitted to all values before the start. With q = 0 by least
    squares; otherwise shocks are the residuals of an autoregression of order LONG (Hannan and Rissanen), and
    shocks to come are 0."""
    if q:
        long, whole = _autoregressions(r, LONG, starts), _lagged(r, LONG)
    else:
        short = _autoregressions(r, p, starts)
    out = np.zeros((len(starts), len(r), ahead))
    for i, s in enumerate(starts):
        shocks = np.zeros((len(r), 0))
        if q:
            past = whole[:, : s - LONG]
            e = past[..., -1] - (past[..., :-1] @ long[i][..., None])[..., 0]
            first, n = LONG + q, s - LONG - q
            x = np.stack([np.ones((len(r), n)), *(r[:, first - k : s - k] for k in range(1, p + 1)), *(e[:, q - k : q - k + n] for k in range(1, q + 1)), r[:, first:s]], -1)
            beta, shocks = least_squares(x.swapaxes(-1, -2) @ x), e[:, -1 : -q - 1 : -1]
        else:
            beta = short[i]
        values = r[:, s - 1 : s - p - 1 : -1]  # the last one first
        for h in range(ahead):
            known = np.concatenate([np.ones((len(r), 1)), values, shocks], 1)
            out[i, :, h] = (known * beta).sum(1)
            values = np.concatenate([out[i, :, h : h + 1], values[:, :-1]], 1)
            shocks = np.concatenate([np.zeros((len(r), 1)), shocks[:, :-1]], 1) if q else shocks
    return out


def arma_forecast(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """Forecasts of the validation rows for each run (fold_id, interval, p, q): models are fitted anew at the start of
    each block of `interval` rows on all rows before it. Also the history's volatility and whether the block is still.

    Null returns make the forecasts of their fold null. Runs of folds that aren't there give no rows."""
    wanted = runs.select("fold_id", F.struct(F.col("interval").cast("int").alias("interval"), F.col("p").cast("int").alias("p"), F.col("q").cast("int").alias("q")).alias("run")).groupBy("fold_id").agg(F.sort_array(F.collect_set("run")).alias("runs"))
    folds = fold_arrays(rows, ["r"]).join(wanted, "fold_id").select("fold_id", "entity", "train", "r", "runs")
    schema = "fold_id long, entity string, interval int, p int, q int, off int, block int, r double, mu double, vol double, still boolean"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, FOLDS_AT_ONCE):
                yield from _forecast(batch.slice(at, FOLDS_AT_ONCE))

    return folds.mapInArrow(task, schema)


def _forecast(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    ids, entity, train, series, runs = (batch.column(k).to_pylist() for k in range(5))
    by_shape: dict[tuple, list[int]] = {}
    for i in range(len(ids)):
        for run in runs[i]:
            by_shape.setdefault((train[i], len(series[i]), run["interval"], run["p"], run["q"]), []).append(i)
    for (t, n, interval, p, q), some in by_shape.items():
        r = np.array([[np.nan if v is None else v for v in series[i]] for i in some], float)
        bad = np.isnan(r).any(1)
        starts = list(range(t, n, interval))
        mu = arma_means(np.where(bad[:, None], 0.0, r), p, q, starts, min(interval, n - t))
        block = np.arange(n - t) // interval
        mean = mu[block, :, np.arange(n - t) - block * interval].T
        mean[bad] = np.nan
        vol = np.stack([r[:, :s].std(1, ddof=1) for s in starts])[block].T
        still = np.stack([r[:, s : s + interval].std(1) < STILL for s in starts])[block].T
        k, size = len(some), n - t
        repeat = lambda x: pa.array(np.repeat(np.array(x), size))
        yield pa.RecordBatch.from_arrays(
            [repeat([ids[i] for i in some]), pa.array([entity[i] for i in some for _ in range(size)], pa.string()), *(pa.array(np.full(k * size, x, np.int32)) for x in (interval, p, q)),
             pa.array(np.tile(np.arange(t, n, dtype=np.int32), k)), pa.array(np.tile(block.astype(np.int32), k)), pa.array(r[:, t:].ravel()), pa.array(mean.ravel(), from_pandas=True), pa.array(vol.ravel()), pa.array(still.ravel())],
            ["fold_id", "entity", "interval", "p", "q", "off", "block", "r", "mu", "vol", "still"],
        )


def champions(forecasts: DataFrame) -> DataFrame:
    """fold_id, p, q, rmse, scaled (by the deviation of what was to be forecast): each fold's best order over all its
    intervals; the smaller order where two are equal to twelve digits."""
    err = F.sqrt(F.avg(F.pow(F.col("r") - F.col("mu"), F.lit(2.0))))
    by = forecasts.groupBy("fold_id", "p", "q").agg(F.coalesce(err, F.lit(1000.0)).alias("rmse"), F.stddev_pop("r").alias("_sd"))
    best = by.groupBy("fold_id").agg(F.min(F.struct(F.round("rmse", 12).alias("key"), "p", "q", "rmse", "_sd")).alias("x"))
    return best.select("fold_id", "x.p", "x.q", "x.rmse", (F.col("x.rmse") / F.when(F.coalesce("x._sd", F.lit(0.0)) == 0, 1.0).otherwise(F.col("x._sd"))).alias("scaled"))


def chance(name: str, *keys: str, seed: int = 42):
    """A number from 0 up to 1 by the digest of keys and name: independent draws that every task makes alike."""
    digest = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(name), F.lit(seed)))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0


def draws(cases: DataFrame, n: int, most_p: int = 7, most_q: int = 7, low: float = 0.01, high: float = 0.6, seed: int = 42) -> DataFrame:
    """n draws for each case (fold_id, interval, p, q of its champion): thresholds anywhere in their range, orders
    anywhere in 1..most for the first half and within one of the champion's for the second. most_q = 0: no q."""
    keys = ("fold_id", "interval", "k")
    rows = cases.select("fold_id", "interval", F.col("p").alias("p0"), F.col("q").alias("q0"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("k"))

    def order(name: str, most: int):
        if not most:
            return F.lit(0)
        u = chance(name, *keys, seed=seed)
        near = F.greatest(F.lit(1), F.least(F.lit(most), F.col(f"{name}0") + F.floor(3 * u) - 1))
        return F.when(F.col("k") < n // 2, 1 + F.floor(most * u)).otherwise(near)

    thr = F.round(low + (high - low) * chance("thr", *keys, seed=seed), 6)
    return rows.select(*keys, order("p", most_p).cast("int").alias("p"), order("q", most_q).cast("int").alias("q"), thr.alias("thr"))


def window_regression(rows: DataFrame, features: list[str], target: str, lookback: int = 20, ridge: float = 1e-3) -> tuple[DataFrame, DataFrame]:
    """A ridge regression for each fold of the target on the features of the `lookback` rows before it, fitted to the
    training windows; the intercept isn't shrunk. Validation windows begin in the training rows.

    Returns fold_id, train_rmse, rmse, scaled, and fold_id, off, pred, y of the validation rows. A fold with a null
    value, or with no more training rows than lookback, gets nulls."""
    folds = fold_arrays(rows, list(dict.fromkeys([*features, target])))
    schema = "fold_id long, train_rmse double, rmse double, scaled double, offs array<int>, pred array<double>, y array<double>"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            x_lists, y_lists = [batch.column(c).to_pylist() for c in features], batch.column(target).to_pylist()
            for i, (fold, t) in enumerate(zip(batch.column("fold_id").to_pylist(), batch.column("train").to_pylist(), strict=True)):
                x = np.array([[np.nan if v is None else v for v in c[i]] for c in x_lists], float).T
                y = np.array([np.nan if v is None else v for v in y_lists[i]], float)
                if t <= lookback or np.isnan(x).any() or np.isnan(y).any():
                    out.append((fold, None, None, None, list(range(t, len(y))), [None] * (len(y) - t), y[t:].tolist()))
                    continue
                windows = np.lib.stride_tricks.sliding_window_view(x, lookback, axis=0)[:-1].reshape(len(y) - lookback, -1)
                design = np.column_stack([np.ones(len(windows)), windows, y[lookback:]])
                train = design[: t - lookback]
                gram = train.T @ train
                gram[np.arange(1, gram.shape[0] - 1), np.arange(1, gram.shape[0] - 1)] += ridge
                pred = design[:, :-1] @ least_squares(gram)
                error = pred - y[lookback:]
                fit, val = error[: t - lookback], error[t - lookback :]
                rmse = float(np.sqrt((val**2).mean())) if len(val) else None
                out.append((fold, float(np.sqrt((fit**2).mean())), rmse, rmse / (float(y[t:].std()) or 1.0) if len(val) else None, list(range(t, len(y))), pred[t - lookback :].tolist(), y[t:].tolist()))
            names = ["fold_id", "train_rmse", "rmse", "scaled", "offs", "pred", "y"]
            kinds = [pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kinds[k]) for k in range(7)], names)

    fitted = folds.mapInArrow(task, schema)
    each = fitted.select("fold_id", F.explode(F.arrays_zip("offs", "pred", "y")).alias("x")).select("fold_id", F.col("x.offs").alias("off"), "x.pred", "x.y")
    return fitted.select("fold_id", "train_rmse", "rmse", "scaled"), each
