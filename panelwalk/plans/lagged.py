"""Queries of lagged regressions and clusters of fronts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import lagged
from ..sources import files
from . import frames as fr
from .registry import query

_SQUARES = "SELECT entity, ts, pow(r - avg(r) OVER (PARTITION BY entity), 2) AS y FROM rets"


@query("arch_lm_lag_2", f"""SELECT entity, round(n * ((c1y * c22 - c2y * c12) / (c11 * c22 - c12 * c12) * c1y + (c2y * c11 - c1y * c12) / (c11 * c22 - c12 * c12) * c2y) / cyy, 6) AS lm, n FROM (
  SELECT entity, count(*) AS n, covar_pop(x1, x1) AS c11, covar_pop(x1, x2) AS c12, covar_pop(x2, x2) AS c22, covar_pop(x1, y) AS c1y, covar_pop(x2, y) AS c2y, covar_pop(y, y) AS cyy FROM (
    SELECT entity, y, lag(y) OVER w AS x1, lag(y, 2) OVER w AS x2 FROM ({_SQUARES}) WINDOW w AS (PARTITION BY entity ORDER BY ts)) WHERE x2 IS NOT NULL GROUP BY entity)""")
def arch_lm_lag_2(s: SparkSession, d: str) -> DataFrame:
    return lagged.arch_lm(fr.rets(s, d), most=2)


@query("arch_lm_lag_20")
def arch_lm_lag_20(s: SparkSession, d: str) -> DataFrame:
    return lagged.arch_lm(fr.rets(s, d))


@query("df_lag_1", """SELECT entity, round(t, 6) AS t_stat, t < -2.86 AS stationary, n FROM (SELECT entity, n, b / sqrt((cyy - b * cxy - g * czy) * n / (n - 3) * czz / det / n) AS t FROM (
  SELECT *, (cxy * czz - czy * cxz) / det AS b, (czy * cxx - cxy * cxz) / det AS g FROM (SELECT *, cxx * czz - cxz * cxz AS det FROM (
    SELECT entity, count(*) AS n, covar_pop(x, x) AS cxx, covar_pop(x, z) AS cxz, covar_pop(z, z) AS czz, covar_pop(x, y) AS cxy, covar_pop(z, y) AS czy, covar_pop(y, y) AS cyy FROM (
      SELECT entity, x, y, lag(y) OVER (PARTITION BY entity ORDER BY ts) AS z FROM (SELECT entity, ts, lag(close) OVER w AS x, close - lag(close) OVER w AS y FROM panel WINDOW w AS (PARTITION BY entity ORDER BY ts)))
    WHERE z IS NOT NULL GROUP BY entity))))""")
def df_lag_1(s: SparkSession, d: str) -> DataFrame:
    return lagged.dickey_fuller(fr.panel(s, d), lags=1)


@query("df_lag_5")
def df_lag_5(s: SparkSession, d: str) -> DataFrame:
    return lagged.dickey_fuller(fr.panel(s, d))


@query("ljung_box_squares", f"""WITH squares AS (SELECT entity, row_number() OVER (PARTITION BY entity ORDER BY ts) AS i, y - avg(y) OVER (PARTITION BY entity) AS d FROM ({_SQUARES})),
whole AS (SELECT entity, sum(d * d) AS ss, count(*) AS n FROM squares GROUP BY entity),
a AS (SELECT entity, k, sum(x.d * y.d) AS s FROM (SELECT unnest(range(1, 21)) AS k), squares x JOIN squares y USING (entity) WHERE y.i = x.i + k GROUP BY ALL)
SELECT entity, round(any_value(n) * (any_value(n) + 2) * sum(pow(s / ss, 2) / (n - k)), 6) AS q FROM a JOIN whole USING (entity) GROUP BY entity""")
def ljung_box_squares(s: SparkSession, d: str) -> DataFrame:
    return lagged.ljung_box_of_squares(fr.rets(s, d))


@query("front_medoids", digits=7)
def front_medoids(s: SparkSession, d: str) -> DataFrame:
    return lagged.front_medoids(files.stored(fr.fronts(s, d), "fronts"), fr.CASE, 3)
