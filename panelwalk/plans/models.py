"""Queries of models by fold, sweeps and signals from their forecasts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import backtest, models, pareto, report
from ..sources import files
from . import frames as fr
from .registry import query

DRAWS = 6
RUN = ["fold_id", "entity", "interval", "k", "p", "q", "thr"]


def _runs(rows: DataFrame, orders: list[tuple[int, int]], intervals: tuple[int, ...] = (10, 20, 42)) -> DataFrame:
    """Every fold with every interval and order."""
    grid = F.explode(F.array(*[F.struct(F.lit(i).alias("interval"), F.lit(p).alias("p"), F.lit(q).alias("q")) for i in intervals for p, q in orders])).alias("x")
    return rows.select("fold_id").distinct().select("fold_id", grid).select("fold_id", "x.*")


def _swept(rows: DataFrame, orders: list[tuple[int, int]], most_q: int) -> DataFrame:
    """Evaluations of drawn orders and thresholds; champions are the best orders over the whole validation part."""
    first = models.champions(models.arma_forecast(rows, _runs(rows, orders, (42,))))
    cases = first.select("fold_id", "p", "q", F.explode(F.array(*map(F.lit, (10, 20, 42)))).alias("interval"))
    drawn = files.stored(models.draws(cases, DRAWS, max(p for p, _ in orders), most_q), "draws")
    forecasts = models.arma_forecast(rows, drawn)
    runs = report.scaled_position(forecasts.join(drawn, ["fold_id", "interval", "p", "q"]), F.col("thr"))
    out = backtest.objectives(backtest.backtests(backtest.pnl(runs, RUN), RUN), 0.03, 0.3)
    return out.withColumns({"f0": F.round("f0", 7), "f1": F.round("f1", 7)})


def sweep(s: SparkSession, d: str, rows: DataFrame) -> DataFrame:
    """The sweep that SQL can follow: orders 1 and 2."""
    return _swept(rows, [(1, 0), (2, 0)], 0)


@query("parameter_sweep", """SELECT fold_id, "interval", k, ar AS p, round(thr, 6) AS thr, round(f0, 6) AS f0, round(f1, 6) AS f1 FROM swept_front""", digits=7)
def parameter_sweep(s: SparkSession, d: str) -> DataFrame:
    return pareto.front(sweep(s, d, files.stored(fr.fold_rows(s, d), "rows")), fr.CASE).select(*fr.CASE, "k", "p", "thr", "f0", "f1")


@query("arma_sweep")
def arma_sweep(s: SparkSession, d: str) -> DataFrame:
    """Orders p and q from 1 to 7; champions among p with q = 1. Tests hold forecasts and draws against numpy."""
    rows = files.stored(fr.fold_rows(s, d), "rows")
    return pareto.front(_swept(rows, [(p, 1) for p in range(1, 8)], 7), fr.CASE).select(*fr.CASE, "k", "p", "q", "thr", "f0", "f1")


@query("parameter_draws", """SELECT fold_id, "interval", k, ar AS p, thr FROM samples""")
def parameter_draws(s: SparkSession, d: str) -> DataFrame:
    rows = files.stored(fr.fold_rows(s, d), "rows")
    first = models.champions(models.arma_forecast(rows, _runs(rows, [(1, 0), (2, 0)], (42,))))
    return models.draws(first.select("fold_id", "p", "q", F.explode(F.array(*map(F.lit, (10, 20, 42)))).alias("interval")), DRAWS, 2, 0).drop("q")


@query("ar2_forecast", 'SELECT fold_id, "interval", off, round(mu, 6) + 0 AS mu, round(vol, 6) AS vol FROM forecasts2')
def ar2_forecast(s: SparkSession, d: str) -> DataFrame:
    rows = files.stored(fr.fold_rows(s, d), "rows")
    return models.arma_forecast(rows, _runs(rows, [(2, 0)])).select("fold_id", "interval", "off", "mu", "vol")


@query("ar_forecast")
def ar_forecast(s: SparkSession, d: str) -> DataFrame:
    """Orders 1 to 7 of every fold and interval."""
    rows = files.stored(fr.fold_rows(s, d), "rows")
    return models.arma_forecast(rows, _runs(rows, [(p, 0) for p in range(1, 8)])).select("fold_id", "interval", "p", "off", "mu", "vol")


@query("order_champions", """SELECT w.fold_id, p0 AS p, round(sqrt(avg((r - mu) * (r - mu))), 6) AS rmse, round(sqrt(avg((r - mu) * (r - mu))) / stddev_pop(r), 6) AS scaled
FROM winners w JOIN orders o ON o.fold_id = w.fold_id AND o.ar = p0 AND o."interval" = 42 GROUP BY ALL""")
def order_champions(s: SparkSession, d: str) -> DataFrame:
    rows = files.stored(fr.fold_rows(s, d), "rows")
    return models.champions(models.arma_forecast(rows, _runs(rows, [(1, 0), (2, 0)], (42,)))).drop("q")


_SLOPE = """SELECT fold_id, b, my - b * mx AS a FROM (
  SELECT fold_id, avg(x) AS mx, avg(y) AS my, (sum(x * y) - sum(x) * sum(y) / count(*)) / (sum(x * x) - sum(x) * sum(x) / count(*) + 0.001) AS b FROM pairs1 WHERE split = 'train' GROUP BY fold_id)"""
_PAIRS = "WITH pairs1 AS (SELECT fold_id, off, split, lag(r) OVER w AS x, next AS y FROM fold_rows WINDOW w AS (PARTITION BY fold_id ORDER BY off) QUALIFY x IS NOT NULL)"


@query("window_regression_1", _PAIRS + f""", slopes AS ({_SLOPE})
SELECT fold_id, round(sqrt(avg(e * e) FILTER (split = 'train')), 6) AS train_rmse, round(sqrt(avg(e * e) FILTER (split = 'val')), 6) AS rmse,
  round(sqrt(avg(e * e) FILTER (split = 'val')) / stddev_pop(y) FILTER (split = 'val'), 6) AS scaled FROM (SELECT *, a + b * x - y AS e FROM pairs1 JOIN slopes USING (fold_id)) GROUP BY fold_id""")
def window_regression_1(s: SparkSession, d: str) -> DataFrame:
    """The last return alone, which SQL can follow."""
    return models.window_regression(fr.fold_rows(s, d), ["r"], "next", 1)[0]


_FEATURES = ["r", "range", "bull", "bear"]


def _wide(s: SparkSession, d: str) -> DataFrame:
    shape = F.log(F.col("high") / F.col("low"))
    return fr.fold_rows(s, d).withColumns({"range": shape, "bull": (F.col("regime") == "bull").cast("double"), "bear": (F.col("regime") == "bear").cast("double")})


@query("window_regression")
def window_regression(s: SparkSession, d: str) -> DataFrame:
    """Windows of 20 rows of four features against the next target; numpy in the tests."""
    return models.window_regression(_wide(s, d), _FEATURES, "target")[0]


@query("window_signal")
def window_signal(s: SparkSession, d: str) -> DataFrame:
    """Positions by hysteresis over the window models' predictions, in blocks of 20 rows."""
    pred = models.window_regression(_wide(s, d), _FEATURES, "target")[1].withColumn("block", F.floor((F.col("off") - 252) / 20))
    return backtest.hysteresis(pred.withColumn("pred", F.round("pred", 9)), ["fold_id"], ["block"]).select("fold_id", "off", "pos")


@query("streak_signal", """WITH RECURSIVE marks AS (SELECT fold_id, "interval", block, quantile_cont(round(mu, 9), 0.6) AS high, quantile_cont(round(mu, 9), 0.4) AS low FROM forecasts GROUP BY ALL),
moves AS (SELECT fold_id, "interval", off, block, (round(mu, 9) > high)::INT AS up, (round(mu, 9) < low)::INT AS down FROM forecasts JOIN marks USING (fold_id, "interval", block)),
states AS (SELECT fold_id, "interval", 251 AS off, -1::BIGINT AS block, 0 AS pos, 0 AS held, 0 AS rise, 0 AS fall FROM moves GROUP BY ALL
  UNION ALL
  SELECT fold_id, "interval", off, block, CASE WHEN pos = 0 AND rise >= 2 THEN 1 WHEN pos = 1 AND fall >= 2 AND held >= 3 THEN 0 ELSE pos END,
    CASE WHEN pos = 0 AND rise >= 2 THEN 1 WHEN pos = 1 AND fall >= 2 AND held >= 3 THEN 0 WHEN pos = 1 THEN held + 1 ELSE 0 END, rise, fall FROM (
    SELECT m.fold_id, m."interval", m.off, m.block, s.pos, CASE WHEN m.block = s.block THEN held ELSE 0 END AS held,
      CASE WHEN up = 1 THEN CASE WHEN m.block = s.block THEN rise ELSE 0 END + 1 ELSE 0 END AS rise, CASE WHEN down = 1 THEN CASE WHEN m.block = s.block THEN fall ELSE 0 END + 1 ELSE 0 END AS fall
    FROM states s JOIN moves m ON m.fold_id = s.fold_id AND m."interval" = s."interval" AND m.off = s.off + 1))
SELECT fold_id, "interval", off, pos FROM states WHERE off >= 252""")
def streak_signal(s: SparkSession, d: str) -> DataFrame:
    """Rising and falling rows are forecasts above the block's upper and below its lower mark."""
    pred = fr.forecasts(s, d).withColumn("pred", F.round("mu", 9))
    return backtest.streak_signal(backtest.moves(pred, ["fold_id", "interval", "block"], 0.4, 0.6).select("fold_id", "interval", "off", "block", "up", "down"), ["fold_id", "interval"])


_BLOCKS = """WITH by_block AS (SELECT fold_id, "interval", thr, block, bool_or(still) AS still, stddev_pop(r) AS vol, sum(abs(pos)) AS held FROM {0} GROUP BY ALL),
by_run AS (SELECT fold_id, "interval", thr, sum(CASE WHEN still THEN 2 * (0.0015 - vol) ELSE 0 END) AS calm, count(*) FILTER (NOT still AND held = 0) AS idle FROM by_block GROUP BY ALL)"""


@query("all_penalties", _BLOCKS.format("placed") + """
SELECT fold_id, "interval", thr, idle, 0::BIGINT AS failed, round(calm, 6) AS calm, round(10 * greatest(thr - 0.3, 0.03 - thr, 0) + calm + CASE WHEN rebalances = 0 THEN 0.5 ELSE 0 END, 6) AS penalty FROM by_run JOIN tests USING (fold_id, "interval", thr)""")
def all_penalties(s: SparkSession, d: str) -> DataFrame:
    """The first family, of sized positions."""
    trace = files.stored(fr.trace(s, d), "trace")
    keys = ["fold_id", "interval", "thr"]
    out = report.first_penalties(backtest.backtests(trace), report.block_penalties(trace, keys), keys, 0.03, 0.3)
    return out.select(*keys, "idle", "failed", "calm", "penalty")


_MARKS = " UNION ALL ".join(f'SELECT fold_id, "interval", block, {q}::DOUBLE AS thr, quantile_cont(x, {q}) AS up, quantile_cont(x, {q - 0.05}) AS down, quantile_cont(x, 0.5) AS mid FROM b GROUP BY ALL' for q in (0.6, 0.8, 0.95))
_HELD = f"WITH b AS (SELECT *, round(mu, 9) AS x FROM forecasts), q AS ({_MARKS}),\n" + """m AS (SELECT fold_id, "interval", block, thr, quantile_cont(abs(x - mid), 0.5) AS mad FROM b JOIN q USING (fold_id, "interval", block) GROUP BY ALL),
signals AS (SELECT *, coalesce(last_value(event IGNORE NULLS) OVER (PARTITION BY fold_id, "interval", thr ORDER BY off ROWS UNBOUNDED PRECEDING), 0)::DOUBLE AS pos FROM (
  SELECT b.*, thr, CASE WHEN x >= up AND abs(x - mid) >= 0.5 * mad THEN 1 WHEN x < down OR abs(x - mid) < 0.5 * mad THEN 0 END AS event FROM b JOIN q USING (fold_id, "interval", block) JOIN m USING (fold_id, "interval", block, thr))), """


@query("block_penalties", _HELD + _BLOCKS.format("signals").removeprefix("WITH ") + """
SELECT fold_id, "interval", thr, idle, 0::BIGINT AS failed, round(calm, 6) AS calm, round(20 * idle + calm, 6) AS penalty FROM by_run""")
def block_penalties(s: SparkSession, d: str) -> DataFrame:
    """The second family, of signals by hysteresis at several shares."""
    keys, runs = ["fold_id", "interval", "thr"], files.stored(fr.forecasts(s, d).withColumn("pred", F.round("mu", 9)), "forecasts")
    signals = [backtest.hysteresis(runs.withColumn("thr", F.lit(q)), keys, ["block"], q) for q in (0.6, 0.8, 0.95)]
    every = signals[0].unionByName(signals[1]).unionByName(signals[2])
    return report.second_penalties(report.block_penalties(every, keys)).select(*keys, "idle", "failed", "calm", "penalty")
