"""Principal components of chosen rows: covariances from one aggregate, a small model, projections as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Components:
    """shares: of the variance, of all components; axes: rows of loadings of those that are kept."""

    columns: list[str]
    means: list[float]
    shares: list[float]
    axes: list[list[float]]


def fit(rows: DataFrame, columns: list[str], target: float = 0.95, most: int = 20) -> Components:
    """As many components as explain the target share, `most` at most. The largest loading of each is positive (the
    first of equal ones, to nine digits). Rows with a null in a column don't count; fewer than two rows, or columns that
    don't vary, give no components."""
    whole = rows.dropna("any", subset=columns)
    n = len(columns)
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    marks = whole.agg(*[F.avg(c) for c in columns], *[F.covar_samp(columns[i], columns[j]) for i, j in pairs]).first()
    means = [x or 0.0 for x in marks[:n]]
    cov = np.zeros((n, n))
    for (i, j), x in zip(pairs, marks[n:], strict=True):
        cov[i, j] = cov[j, i] = x or 0.0
    size, axes = np.linalg.eigh(cov)
    size, axes = np.maximum(size[::-1], 0.0), axes[:, ::-1].T
    if not size.sum():
        return Components(columns, means, [], [])
    shares = size / size.sum()
    k = min(int(np.searchsorted(np.round(np.cumsum(shares), 12), target)) + 1, most, n)
    signs = [np.sign(a[int(np.argmax(np.round(np.abs(a), 9)))]) for a in axes]
    return Components(columns, means, shares.tolist(), [(s * a).tolist() for s, a in zip(signs[:k], axes, strict=False)])


def project(rows: DataFrame, model: Components, keep: list[str]) -> DataFrame:
    """The kept columns and pc1, pc2 ..., of whatever rows: the model's few numbers are part of the plan."""

    def along(axis: list[float]) -> Column:
        return sum(((F.col(c) - m) * a for c, m, a in zip(model.columns, model.means, axis, strict=True)), F.lit(0.0))

    return rows.select(*keep, *[along(axis).alias(f"pc{i + 1}") for i, axis in enumerate(model.axes)])


def loadings(spark: SparkSession, model: Components, n: int) -> DataFrame:
    """component, feature, loading with its sign, rank: the n largest of each component."""
    rows = [(f"pc{i + 1}", c, x) for i, axis in enumerate(model.axes) for c, x in zip(model.columns, axis, strict=True)]
    order = Window.partitionBy("component").orderBy(F.desc(F.round(F.abs("loading"), 9)), "feature")
    return spark.createDataFrame(rows, "component string, feature string, loading double").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def variance_table(spark: SparkSession, model: Components, pad: int = 20) -> DataFrame:
    """nth, share, cumulative of all components, padded with empty ones."""
    shares = (model.shares + [0.0] * pad)[: max(pad, len(model.shares))]
    return spark.createDataFrame([(i + 1, x, float(c)) for i, (x, c) in enumerate(zip(shares, np.cumsum(shares), strict=True))], "nth int, share double, cumulative double")
