"""Forecasts, positions, costs and walk-forward backtests; one plan for all folds, intervals and thresholds."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import clip, series, upto
from .stats import risk

COST, SLIP = 0.0005, 0.0002
RUN = ["fold_id", "entity", "interval", "thr"]


def ar1_forecast(rows: DataFrame, intervals: tuple[int, ...] = (10, 20, 42), train: int = 252) -> DataFrame:
    """Mean and volatility forecasts of each validation row from the history before its block.

    A first-order regression is refitted at each block on all rows before it. Its sums are running sums over
    the fold, read at the block's first row; the forecast h rows ahead is m + phi^h (last - m)."""
    w = series("fold_id", order="off")
    x, y = F.lag("r").over(w), F.col("r")
    run = rows.withColumns({"_x": x, "_y": F.when(x.isNotNull(), y)})
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    run = run.withColumns({"h_n": F.count("_x").over(past), "h_x": F.sum("_x").over(past), "h_y": F.sum("_y").over(past), "h_xy": F.sum(F.col("_x") * F.col("_y")).over(past), "h_xx": F.sum(F.col("_x") * F.col("_x")).over(past), "h_vol": F.stddev_samp("r").over(past), "h_last": x})
    val = run.where("split = 'val'").select("*", F.explode(F.array(*map(F.lit, intervals))).alias("interval")).withColumn("block", F.floor((F.col("off") - train) / F.col("interval")))
    b = Window.partitionBy("fold_id", "interval", "block").orderBy("off").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    val = val.withColumns({c: F.first(c).over(b) for c in ("h_n", "h_x", "h_y", "h_xy", "h_xx", "h_vol", "h_last")} | {"_still": F.stddev_pop("r").over(b) < 0.0015})
    phi = (F.col("h_n") * F.col("h_xy") - F.col("h_x") * F.col("h_y")) / (F.col("h_n") * F.col("h_xx") - F.col("h_x") * F.col("h_x"))
    val = val.withColumn("phi", phi).withColumn("_m", (F.col("h_y") - F.col("phi") * F.col("h_x")) / F.col("h_n") / (1 - F.col("phi")))
    ahead = F.col("off") - train - F.col("block") * F.col("interval") + 1
    mu = F.col("_m") + F.pow("phi", ahead.cast("double")) * (F.col("h_last") - F.col("_m"))
    return val.select("fold_id", "entity", "ts", "off", "interval", "block", "r", mu.alias("mu"), F.col("h_vol").alias("vol"), F.col("_still").alias("still"))


def positions(forecasts: DataFrame, thresholds: tuple[float, ...], limit: float = 1.0) -> DataFrame:
    """z by forecast volatility, scaled by each threshold and clipped; still blocks hold nothing."""
    runs = forecasts.select("*", F.explode(F.array(*map(F.lit, thresholds))).alias("thr"))
    z = F.col("mu") / (F.col("vol") + 1e-8)
    return runs.withColumn("pos", F.when(F.col("still"), 0.0).otherwise(clip(z / (F.col("thr") + 1e-8), -limit, limit)))


def pnl(runs: DataFrame, keys: list[str] = RUN, order: str = "off", cost_multiple: Column | float = 1.0) -> DataFrame:
    """Adds turnover and the net log return after costs."""
    turnover = F.abs(F.col("pos") - F.coalesce(F.lag("pos").over(series(*keys, order=order)), F.lit(0.0)))
    out = runs.withColumn("turnover", turnover)
    net = F.expm1("r") * F.col("pos") - (COST + SLIP) * cost_multiple * F.col("turnover")
    return out.withColumn("net", F.log1p(F.greatest(net, F.lit(-0.9999))))


def backtests(trace: DataFrame, keys: list[str] = RUN) -> DataFrame:
    """Risk of the net returns with turnover, rebalances and round turns, by run."""
    trades = F.sum("turnover").alias("turnover"), F.count_if(F.col("turnover") > 1e-6).alias("rebalances"), (F.sum("turnover") / 2).alias("round_turns")
    return risk(trace, keys, order="off", r="net", more=trades)


def objectives(tests: DataFrame, low: float = 0.01, high: float = 0.6) -> DataFrame:
    """Both objectives, to be minimised, with penalties for thresholds out of range and for no activity."""
    penalty = 10 * F.greatest(F.col("thr") - high, low - F.col("thr"), F.lit(0.0)) + F.when(F.col("rebalances") == 0, 0.5).otherwise(0.0)
    return tests.withColumn("penalty", penalty).withColumns({"f0": -F.col("sharpe") + F.col("penalty"), "f1": F.col("mdd") + F.col("penalty")})


def hysteresis(rows: DataFrame, keys: list[str], block: list[str], q: float = 0.7, pred: str = "pred", order: str = "off") -> DataFrame:
    """Long from a prediction in the block's top share until one falls well below, if it stands out from the
    median. Entry and exit exclude each other, so the position is the last of them that happened."""
    b = Window.partitionBy(*keys, *block)
    p = rows.withColumns({"_enter": F.percentile(pred, F.lit(q)).over(b), "_exit": F.percentile(pred, F.lit(q - 0.05)).over(b), "_mid": F.percentile(pred, F.lit(0.5)).over(b)}).withColumn("_far", F.abs(F.col(pred) - F.col("_mid")))
    p = p.withColumn("_strong", F.col("_far") >= 0.5 * F.percentile("_far", F.lit(0.5)).over(b))
    event = F.when((F.col(pred) >= F.col("_enter")) & F.col("_strong"), 1.0).when((F.col(pred) < F.col("_exit")) | ~F.col("_strong"), 0.0)
    p = p.withColumn("_event", event)
    pos = F.coalesce(F.last("_event", ignorenulls=True).over(upto(series(*keys, order=order))), F.lit(0.0))
    return p.withColumn("pos", pos).drop("_enter", "_exit", "_mid", "_far", "_strong", "_event")


def moves(rows: DataFrame, block: list[str], low: float, high: float, pred: str = "pred") -> DataFrame:
    """up, down: predictions above the upper and below the lower quantile of their block."""
    b = Window.partitionBy(*block)
    return rows.withColumns({"up": F.col(pred) > F.percentile(pred, F.lit(high)).over(b), "down": F.col(pred) < F.percentile(pred, F.lit(low)).over(b)})


def streak_state(up: bool, down: bool, state: tuple[int, int, int, int], enter_k: int, exit_k: int, hold: int) -> tuple[int, int, int, int]:
    """One step of the signal with streaks: position, days held, rising and falling streaks."""
    pos, held, rise, fall = state
    rise, fall = (rise + 1 if up else 0), (fall + 1 if down else 0)
    if not pos and rise >= enter_k:
        return 1, 1, rise, fall
    if pos and fall >= exit_k and held >= hold:
        return 0, 0, rise, fall
    return pos, held + 1 if pos else 0, rise, fall


def streak_signal(rows: DataFrame, keys: list[str], enter_k: int = 2, exit_k: int = 2, hold: int = 3) -> DataFrame:
    """Enter after enter_k rising rows, leave after exit_k falling ones once held long enough. Counters start
    anew with every block, the position is carried over. rows: keys, off, block, up, down."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, pos, block, out = pdf.sort_values("off"), 0, None, []
        state = (0, 0, 0, 0)
        for at, up, down in zip(pdf["block"], pdf["up"], pdf["down"], strict=True):
            if at != block:
                block, state = at, (pos, 0, 0, 0)
            state = streak_state(up, down, state, enter_k, exit_k, hold)
            pos = state[0]
            out.append(pos)
        return pdf[[*keys, "off"]].assign(pos=out)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in (*keys, "off"))
    return rows.groupBy(*keys).applyInPandas(work, f"{fields}, pos int")


def turnover_cap(trace: DataFrame, keys: list[str], cap: float) -> DataFrame:
    """Scales the turnover that is paid for so that a run's total stays within cap * rows / 252; by block,
    the share that the budget still covers. Positions stay."""
    w = series(*keys, order="block")
    by = trace.groupBy(*keys, "block").agg(F.sum("turnover").alias("block_turnover"), F.count("*").alias("_n"))
    budget = cap * F.sum("_n").over(Window.partitionBy(*keys)) / 252
    spent = F.least(budget, F.sum("block_turnover").over(upto(w)))
    by = by.withColumn("_spent", spent).withColumn("paid", F.col("_spent") - F.coalesce(F.lag("_spent").over(w), F.lit(0.0)))
    return by.select(*keys, "block", "block_turnover", "paid", F.when(F.col("block_turnover") > 0, F.col("paid") / F.col("block_turnover")).otherwise(1.0).alias("scale"))


def parameter_grid(spark, champions: DataFrame, low: int = 1, high: int = 7) -> DataFrame:
    """Neighbours of each champion (p, q) in steps of one, clipped to the range, without repeats."""
    near = lambda c: F.explode(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda d: F.least(F.greatest(F.col(c) + d, F.lit(low)), F.lit(high))))
    return champions.select("fold_id", near("p").alias("p"), "q").select("fold_id", "p", near("q").alias("q")).distinct()
