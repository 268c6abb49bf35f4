"""Indicators over rows of one entity, ordered by time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import TINY, YEAR, full, last_rows, series, upto


def lags(df: DataFrame, columns: list[str], ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    return df.withColumns({f"{c}_lag_{k}": F.lag(c, k).over(series()) for c in columns for k in ks})


def sma(column: str, n: int, w=None) -> Column:
    w = w or series()
    return full(F.avg(column).over(last_rows(w, n)), F.col(column), w, n)


def bollinger(df: DataFrame, column: str = "close", sizes: tuple[int, ...] = (10, 20), ks: tuple[float, ...] = (1.5, 2.0)) -> DataFrame:
    w, out = series(), {}
    for n in sizes:
        mid, spread = sma(column, n, w), full(F.stddev_samp(column).over(last_rows(w, n)), F.col(column), w, n)
        out[f"bb_mid_{n}"] = mid
        for k in ks:
            name = f"{n}_{k:g}".replace(".", "_")
            out[f"bb_upper_{name}"], out[f"bb_lower_{name}"] = mid + k * spread, mid - k * spread
    return df.withColumns(out)


def obv(df: DataFrame) -> DataFrame:
    """On-balance volume: the running sum of volume signed by the change of close."""
    w = series()
    signed = F.coalesce(F.signum(F.col("close") - F.lag("close").over(w)), F.lit(0.0)) * F.col("volume")
    return df.withColumn("_v", signed).withColumn("obv", F.sum("_v").over(upto(w))).drop("_v")


def hlc3(df: DataFrame) -> DataFrame:
    return df.withColumn("hlc3", (F.col("high") + F.col("low") + F.col("close")) / 3)


def regime(df: DataFrame, column: str = "close", band: float = 0.002) -> DataFrame:
    """bull or bear where the mean of 20 rows is off that of 50 by more than the band, else sideways."""
    w = series()

    def mean(n: int, least: int) -> Column:
        return F.when(F.count(column).over(last_rows(w, n)) >= least, F.avg(column).over(last_rows(w, n)))

    spread = (mean(20, 5) - mean(50, 10)) / mean(50, 10)
    return df.withColumn("regime", F.when(spread > band, "bull").when(spread < -band, "bear").otherwise("sideways"))


def equity(df: DataFrame, w=None) -> DataFrame:
    """Adds equity (exp of summed log returns), its peak's drawdown, and the cumulated simple return."""
    w = w or series()
    out = df.withColumn("equity", F.exp(F.sum("r").over(upto(w))))
    peak = F.max("equity").over(upto(w))
    return out.withColumns({"drawdown": (peak - F.col("equity")) / (peak + TINY), "cum_return": F.exp(F.sum(F.log1p(F.expm1("r"))).over(upto(w))) - 1})


def rolling_risk(df: DataFrame, n: int = 63, w=None) -> DataFrame:
    """Rolling Sharpe and annualised volatility, null until the frame is full."""
    w = w or series()
    mean, spread = F.avg("r").over(last_rows(w, n)), F.stddev_samp("r").over(last_rows(w, n))
    return df.withColumns({"rolling_sharpe": full(F.when(spread > 0, mean / spread * YEAR**0.5).otherwise(0.0), F.col("r"), w, n), "rolling_vol": full(spread * YEAR**0.5, F.col("r"), w, n)})


def rebase(df: DataFrame, column: str = "close") -> DataFrame:
    """Each entity's values as percent of its first one."""
    first = F.first(column, ignorenulls=True).over(series().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return df.withColumn("rebased", F.col(column) / first * 100)


def top_n(df: DataFrame, n: int, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def windows(df: DataFrame, features: list[str], target: str, length: int) -> DataFrame:
    """For each row with `length` rows before it: their feature rows as an array, and the row's own target."""
    w = series().rowsBetween(-length, -1)
    block = F.collect_list(F.array(*features)).over(w)
    return df.withColumn("block", block).where(F.size("block") == length).select("entity", "ts", "block", F.col(target).alias("y"))
