"""The shared steps from tables to folds, forecasts, evaluations and fronts.

Bars and tagged returns are named several times by the plans after them, so they are written once and read again:
a table is scanned once for a query. A query that needs two results of the same step makes it first and hands it on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.common import series, upto  # noqa: F401
from ..operators import backtest, clean, folds, indicators, pareto
from ..sources.files import stored
from ..sources.panels import bars

THRESHOLDS = (0.02, 0.05, 0.1, 0.2, 0.4)
CASE = ["fold_id", "interval"]


def panel(spark: SparkSession, d: str) -> DataFrame:
    return clean.no_gaps(stored(bars(spark, d), "bars"))


def rets(spark: SparkSession, d: str) -> DataFrame:
    return clean.log_returns(panel(spark, d))


def labelled(spark: SparkSession, d: str) -> DataFrame:
    return clean.label(rets(spark, d))


def fold_rows(spark: SparkSession, d: str) -> DataFrame:
    return folds.fold_rows(stored(indicators.regime(labelled(spark, d)), "tagged"))


def fold_table(spark: SparkSession, d: str, rows: DataFrame | None = None) -> DataFrame:
    return folds.fold_summary(fold_rows(spark, d) if rows is None else rows)


def qc_table(spark: SparkSession, d: str, rows: DataFrame | None = None) -> DataFrame:
    return fold_table(spark, d, rows).select("fold_id", "entity", F.round("val_pos_ratio", 9).alias("ratio"), F.round("val_vol", 9).alias("vol"))


def meta(spark: SparkSession, d: str, rows: DataFrame | None = None) -> DataFrame:
    return folds.meta_features(fold_rows(spark, d) if rows is None else rows)


def forecasts(spark: SparkSession, d: str, rows: DataFrame | None = None) -> DataFrame:
    return backtest.ar1_forecast(fold_rows(spark, d) if rows is None else rows)


def trace(spark: SparkSession, d: str, rows: DataFrame | None = None) -> DataFrame:
    return backtest.pnl(backtest.positions(forecasts(spark, d, rows), THRESHOLDS))


def evals(spark: SparkSession, d: str, rows: DataFrame | None = None) -> DataFrame:
    """Objectives of the sweep, to seven digits so that equal runs tie."""
    out = backtest.objectives(backtest.backtests(trace(spark, d, rows)), 0.03, 0.3)
    return out.withColumns({"f0": F.round("f0", 7), "f1": F.round("f1", 7)})


def fronts(spark: SparkSession, d: str) -> DataFrame:
    return pareto.front(evals(spark, d), CASE)


def stages(front: DataFrame) -> DataFrame:
    """Fronts before and after refinement: the first stage had the small thresholds only."""
    each = F.when(F.col("thr") < 0.15, F.array(F.lit("GA"), F.lit("GA+BO"))).otherwise(F.array(F.lit("GA+BO")))
    return front.select("*", F.explode(each).alias("stage"))


def hypervolumes(spark: SparkSession, d: str) -> DataFrame:
    every = stored(evals(spark, d), "evals")
    refs = pareto.references(every, CASE).select("*", F.explode(F.array(F.lit("GA"), F.lit("GA+BO"))).alias("stage"))
    return pareto.hypervolume(stages(pareto.front(every, CASE)), refs, [*CASE, "stage"]).select(*CASE, "stage", "hv", F.col("n_front").cast("long").alias("n_front"))


def gains(spark: SparkSession, d: str) -> DataFrame:
    return pareto.gains(hypervolumes(spark, d), CASE, "stage", "GA", "GA+BO")
