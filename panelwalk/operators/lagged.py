"""Regressions of a series on its own lags, by key: Gram matrices summed in tasks, a small solve for each key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import series
from .models import least_squares
from .stats import acf, ljung_box


def grouped_regression(rows: DataFrame, key: str, regressors: list[str], goal: str) -> DataFrame:
    """key, n, beta, error (both with the intercept first), r2 of least squares with an intercept. Rows with a null
    don't count. Tasks sum the products of their rows; what is shuffled is a matrix for each key and task. A key with no
    more rows than coefficients has a null error, one whose goal doesn't vary a null r2."""
    size = len(regressors) + 2
    whole = rows.select(F.col(key).cast("string").alias("key"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate([*regressors, goal])]).dropna()

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            x = np.column_stack([np.ones(batch.num_rows), *(batch.column(i + 1).to_numpy() for i in range(size - 1))])
            keys = batch.column(0).dictionary_encode()
            which = keys.indices.to_numpy()
            for i, name in enumerate(keys.dictionary.to_pylist()):
                own = x[which == i]
                sums[name] = sums.get(name, 0.0) + own.T @ own
        for name, gram in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * size * size), pa.array(np.arange(size * size)), pa.array(gram.ravel())], ["key", "slot", "value"])

    summed = whole.mapInArrow(products, "key string, slot long, value double").groupBy("key", "slot").agg(F.sum("value").alias("value"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        gram = pdf.sort_values("slot")["value"].to_numpy().reshape(size, size)
        n = int(round(gram[0, 0]))
        # Columns of unit length, so that levels and changes can stand side by side.
        scale = np.sqrt(np.maximum(np.diag(gram), 1e-300))
        unit = gram / scale[:, None] / scale
        beta = least_squares(unit)
        rest = max(unit[-1, -1] - beta @ unit[:-1, -1], 0.0) * scale[-1] ** 2
        total = gram[-1, -1] - gram[0, -1] ** 2 / n
        inverse = np.linalg.pinv(unit[:-1, :-1], hermitian=True)
        error = np.sqrt(rest / (n - size + 1) * np.diag(inverse)) / scale[:-1] if n > size - 1 else [None] * (size - 1)
        r2 = 1 - rest / total if total > 0 else None
        return pd.DataFrame({"key": [pdf["key"].iloc[0]], "n": [n], "beta": [list(beta * scale[-1] / scale[:-1])], "error": [list(error)], "r2": [r2]})

    found = summed.groupBy("key").applyInPandas(solve, "key string, n long, beta array<double>, error array<double>, r2 double")
    return found.withColumnRenamed("key", key)


def _with_lags(df: DataFrame, column: str, most: int, name: str) -> DataFrame:
    return df.withColumns({f"{name}{k}": F.lag(column, k).over(series()) for k in range(1, most + 1)})


def arch_lm(df: DataFrame, column: str = "r", most: int = 20) -> DataFrame:
    """entity, lm, n: rows times R2 of squared residuals on their own last values."""
    squared = (F.col(column) - F.avg(column).over(Window.partitionBy("entity"))) ** 2
    rows = _with_lags(df.select("entity", "ts", squared.alias("y")), "y", most, "x")
    return grouped_regression(rows, "entity", [f"x{k}" for k in range(1, most + 1)], "y").select("entity", (F.col("n") * F.col("r2")).alias("lm"), "n")


def dickey_fuller(df: DataFrame, column: str = "close", lags: int = 5) -> DataFrame:
    """entity, t_stat of the last level in: change on the last level and the last changes, with an intercept; n."""
    change: Column = F.col(column) - F.lag(column).over(series())
    rows = df.select("entity", "ts", F.lag(column).over(series()).alias("level"), change.alias("y"))
    rows = _with_lags(rows, "y", lags, "d")
    found = grouped_regression(rows, "entity", ["level", *[f"d{k}" for k in range(1, lags + 1)]], "y")
    t = F.col("beta")[1] / F.col("error")[1]
    return found.select("entity", t.alias("t_stat"), (t < -2.86).alias("stationary"), "n")


def ljung_box_of_squares(df: DataFrame, column: str = "r", most: int = 20) -> DataFrame:
    squared = (F.col(column) - F.avg(column).over(Window.partitionBy("entity"))) ** 2
    return ljung_box(acf(df.select("entity", "ts", squared.alias("r")), most))


def front_medoids(fronts: DataFrame, keys: list[str], k: int = 3, steps: int = 10) -> DataFrame:
    """keys, nth, f0, f1: the points next to the centers of k clusters of each front, all fronts in one plan.

    Objectives are scaled to their range in the front. Points are in order of both; the first centers are the points
    in the middle of k equal stretches of that order. Lloyd steps run over each front's array of points: a center
    moves to the mean of the points next to it (the first of equally near ones), one without points stays. Fronts of fewer
    than k points are left out; a front is as long as the list of parameters that were tried."""
    w = Window.partitionBy(*keys)

    def unit(c: str) -> Column:
        return F.coalesce((F.col(c) - F.min(c).over(w)) / F.nullif(F.max(c).over(w) - F.min(c).over(w), F.lit(0.0)), F.lit(0.0))

    scaled = fronts.select(*keys, "f0", "f1", unit("f0").alias("x"), unit("f1").alias("y"))
    grouped = scaled.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("f0", "f1", "x", "y"))).alias("points")).where(F.size("points") >= k)

    def far(p: Column, c: Column) -> Column:
        return (p["x"] - c["x"]) * (p["x"] - c["x"]) + (p["y"] - c["y"]) * (p["y"] - c["y"])

    def nearest(p: Column, centers: Column) -> Column:
        gaps = F.transform(centers, lambda c: F.round(far(p, c), 12))
        return F.array_position(gaps, F.array_min(gaps))

    def mean(points: Column, field: str) -> Column:
        return F.aggregate(points, F.lit(0.0), lambda s, p: s + p[field]) / F.size(points)

    def moved(centers: Column, _: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            own = F.filter("points", lambda p: nearest(p, centers) == i + 1)
            return F.when(F.size(own) == 0, c).otherwise(F.struct(mean(own, "x").alias("x"), mean(own, "y").alias("y")))

        return F.transform(centers, one)

    start = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.element_at("points", (F.floor((i + 0.5) * F.size("points") / k) + 1).cast("int")))
    start = F.transform(start, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    found = grouped.withColumn("centers", start)
    for _ in range(steps):
        found = found.withColumn("centers", moved(F.col("centers"), F.lit(0)))

    def medoid(c: Column, i: Column) -> Column:
        gaps = F.transform("points", lambda p: F.round(far(p, c), 12))
        p = F.element_at("points", F.array_position(gaps, F.array_min(gaps)).cast("int"))
        return F.struct((i + 1).alias("nth"), p["f0"].alias("f0"), p["f1"].alias("f1"))

    return found.select(*keys, F.explode(F.transform("centers", medoid)).alias("m")).select(*keys, "m.*")
