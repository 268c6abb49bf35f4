"""Queries of principal components by fold, and small report forms, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.common import series, significant
from ..operators import backtest, clean, components, facility, folds, indicators, pareto, qc, select
from ..sources import files
from . import frames as fr
from .registry import query
from .selection import K, packed_folds
from .sql import TABLES

_WIDE = ["open", "high", "low", "close", "volume", "r"]


def _kept(s: SparkSession, d: str, rows: DataFrame) -> DataFrame:
    """Ids of the folds that quality control keeps."""
    table = fr.qc_table(s, d, rows)
    ruled = qc.iqr_outliers(qc.rule(table, qc.thresholds(table)))
    return qc.restore(ruled).where("kept").select("fold_id")


def _scaled(rows: DataFrame, chosen: DataFrame, standard: list[str], minmax: list[str]) -> tuple[DataFrame, DataFrame]:
    """All rows, and the training rows of the chosen folds, scaled by the latter."""
    train = rows.where("split = 'train'").join(chosen, "fold_id", "left_semi")
    return select.scale(rows, train, standard, minmax), select.scale(train, train, standard, minmax)


TABLES["pair_rows"] = """SELECT fold_id, split, off, (r - m) / sd AS x, (volume - lo) / (hi - lo) AS y FROM fold_rows, (
  SELECT avg(r) AS m, stddev_pop(r) AS sd, min(volume) AS lo, max(volume) AS hi FROM fold_rows JOIN restored USING (fold_id) WHERE kept AND split = 'train')"""
TABLES["pair_axes"] = """SELECT mx, my, CASE WHEN abs(vx) >= abs(vy) THEN sign(vx) ELSE sign(vy) END * vx / sqrt(vx * vx + vy * vy) AS ax, CASE WHEN abs(vx) >= abs(vy) THEN sign(vx) ELSE sign(vy) END * vy / sqrt(vx * vx + vy * vy) AS ay, l1, l2 FROM (
  SELECT *, c AS vx, l1 - a AS vy FROM (SELECT *, (a + b) / 2 + sqrt((a - b) * (a - b) / 4 + c * c) AS l1, (a + b) / 2 - sqrt((a - b) * (a - b) / 4 + c * c) AS l2 FROM (
    SELECT avg(x) AS mx, avg(y) AS my, var_samp(x) AS a, var_samp(y) AS b, covar_samp(x, y) AS c FROM pair_rows JOIN restored USING (fold_id) WHERE kept AND split = 'train')))"""


def _pair(s: SparkSession, d: str) -> tuple[DataFrame, components.Components]:
    rows = files.stored(fr.fold_rows(s, d), "rows")
    every, train = _scaled(rows.select("fold_id", "entity", "ts", "split", "off", "r", "volume"), files.stored(_kept(s, d, rows), "kept"), ["r"], ["volume"])
    return every, components.fit(train, ["r", "volume"], 0.9)


@query("pca_pair", """SELECT fold_id, split, count(*) AS n, round(avg((x - mx) * ax + (y - my) * ay), 6) AS mean, round(stddev_pop((x - mx) * ax + (y - my) * ay), 6) AS std,
  round(min((x - mx) * ax + (y - my) * ay), 6) AS least, round(max((x - mx) * ax + (y - my) * ay), 6) AS most FROM pair_rows, pair_axes GROUP BY ALL""")
def pca_pair(s: SparkSession, d: str) -> DataFrame:
    """Two columns, whose components SQL can give: fitted to training rows of the kept folds, applied to all splits."""
    every, model = _pair(s, d)
    pc = F.col("pc1")
    return components.project(every, model, ["fold_id", "split"]).groupBy("fold_id", "split").agg(F.count("*").alias("n"), F.avg(pc).alias("mean"), F.stddev_pop(pc).alias("std"), F.min(pc).alias("least"), F.max(pc).alias("most"))


@query("pca_pair_loadings", "SELECT 'pc1' AS component, 'r' AS feature, round(ax, 6) AS loading FROM pair_axes UNION ALL SELECT 'pc1', 'volume', round(ay, 6) FROM pair_axes")
def pca_pair_loadings(s: SparkSession, d: str) -> DataFrame:
    return components.loadings(s, _pair(s, d)[1], 2).drop("rank")


@query("pca_variance", """SELECT nth::INT AS nth, round(CASE nth WHEN 1 THEN l1 / (l1 + l2) WHEN 2 THEN l2 / (l1 + l2) ELSE 0 END, 6) AS share, round(CASE nth WHEN 1 THEN l1 / (l1 + l2) ELSE 1 END, 6) AS cumulative
FROM pair_axes, (SELECT unnest(range(1, 21)) AS nth)""")
def pca_variance(s: SparkSession, d: str) -> DataFrame:
    return components.variance_table(s, _pair(s, d)[1])


def _chosen_model(s: SparkSession, d: str) -> tuple[DataFrame, components.Components]:
    rows = files.stored(fr.fold_rows(s, d).select("fold_id", "entity", "ts", "split", "off", *_WIDE), "rows")
    picks = facility.greedy(packed_folds(s, d), K[0])[0]
    chosen = s.createDataFrame([(p.fold_id,) for p in picks], "fold_id long")
    every, train = _scaled(rows, chosen, ["open", "high", "low", "close", "r"], ["volume"])
    return every.join(F.broadcast(chosen), "fold_id", "left_semi"), components.fit(train, _WIDE)  # K[0] folds


@query("pca_folds")
def pca_folds(s: SparkSession, d: str) -> DataFrame:
    """Components of the representative folds' training rows, for both splits of these folds; numpy in the tests."""
    every, model = _chosen_model(s, d)
    return components.project(every, model, ["fold_id", "entity", "ts", "split", "off"])


@query("pca_loadings")
def pca_loadings(s: SparkSession, d: str) -> DataFrame:
    return components.loadings(s, _chosen_model(s, d)[1], 3)


TABLES["meta_all"] = TABLES["meta"].replace("FROM fold_rows WHERE split = 'val' WINDOW", "FROM fold_rows WINDOW")


@query("meta_features_all", "SELECT fold_id, round(volatility, 6) AS volatility, round(max_drawdown, 6) AS max_drawdown, round(trend_strength, 6) AS trend_strength, round(acf_lag_5, 6) AS acf_lag_5, round(bull_ratio, 6) AS bull_ratio, date_min, date_max FROM meta_all")
def meta_features_all(s: SparkSession, d: str) -> DataFrame:
    """Training and validation rows together."""
    out = folds.meta_features(fr.fold_rows(s, d), "all")
    return out.select("fold_id", "volatility", "max_drawdown", "trend_strength", "acf_lag_5", "bull_ratio", "date_min", "date_max")


@query("interval_by_sharpe", 'SELECT "interval", round(median(sharpe), 6) AS median_sharpe, count(*) AS n FROM tests GROUP BY "interval" ORDER BY round(median(sharpe), 9) DESC, n DESC, "interval" LIMIT 1')
def interval_by_sharpe(s: SparkSession, d: str) -> DataFrame:
    """What decides where there are no hypervolumes."""
    return pareto.interval_by_sharpe(backtest.backtests(fr.trace(s, d)), "interval")


@query("target_repair_both", """SELECT entity, ts, round(x, 6) AS x, round(target, 6) AS target FROM (SELECT *, lead(x) OVER (PARTITION BY entity ORDER BY ts) AS target FROM (
  SELECT entity, ts, CASE WHEN day(ts) % 7 <> 0 THEN r END AS x FROM rets)) WHERE x IS NOT NULL AND target IS NOT NULL""")
def target_repair_both(s: SparkSession, d: str) -> DataFrame:
    gappy = fr.rets(s, d).select("entity", "ts", F.when(F.day("ts") % 7 != 0, F.col("r")).alias("x"))
    return clean.repaired_target(gappy, "x", "both").select("entity", "ts", "x", "target")


@query("equity_bands", 'SELECT "interval", thr, off, count(*) AS n, round(avg(c), 6) AS mean, round(stddev_pop(c), 6) AS std FROM curve WHERE off < 252 + 10 + fold_id % 33 GROUP BY ALL')
def equity_bands(s: SparkSession, d: str) -> DataFrame:
    """All thresholds, over runs that end at different rows: each row's band is that of the runs that reach it."""
    trace = fr.trace(s, d).where(F.col("off") < 252 + 10 + F.col("fold_id") % 33).drop("r").withColumnRenamed("net", "r")
    run = indicators.equity(trace, series("fold_id", "interval", "thr", order="off"))
    return run.groupBy("interval", "thr", "off").agg(F.count("*").alias("n"), F.avg("equity").alias("mean"), F.stddev_pop("equity").alias("std"))


@query("source_delta_mdd", """SELECT a.fold_id, a."interval", round(b.mdd - a.mdd, 6) AS delta FROM tests a JOIN tests b ON a.fold_id = b.fold_id AND a."interval" = b."interval" AND a.thr = 0.05 AND b.thr = 0.2
ORDER BY round(abs(b.mdd - a.mdd), 6) DESC, a.fold_id, a."interval" LIMIT 3""")
def source_delta_mdd(s: SparkSession, d: str) -> DataFrame:
    tests = files.stored(backtest.backtests(fr.trace(s, d)).select("fold_id", "interval", "thr", "mdd"), "tests")
    one, two = (tests.where(F.col("thr") == t).select("fold_id", "interval", F.col("mdd").alias(n)) for t, n in ((0.05, "a"), (0.2, "b")))
    delta = one.join(two, ["fold_id", "interval"]).select("fold_id", "interval", (F.col("b") - F.col("a")).alias("delta"))
    return delta.orderBy(F.desc(F.round(F.abs("delta"), 6)), "fold_id", "interval").limit(3)


@query("significant_digits", """SELECT fold_id, CASE WHEN val_vol = 0 THEN 0 ELSE round(round(val_vol / pow(10, floor(log10(val_vol)) - 3)) * pow(10, floor(log10(val_vol)) - 3), 12) END AS label FROM folds""", digits=12)
def significant_digits(s: SparkSession, d: str) -> DataFrame:
    return fr.fold_table(s, d).select("fold_id", F.round(significant(F.col("val_vol"), 4), 12).alias("label"))
