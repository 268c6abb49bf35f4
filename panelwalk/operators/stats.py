"""Risk metrics, distribution tables and test statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import TINY, YEAR, series, sharpe, upto
from .quantiles import quantiles


def risk(df: DataFrame, keys: list[str], order: str = "ts", r: str = "r", more: tuple[Column, ...] = ()) -> DataFrame:
    """Sharpe, largest drawdown, annual return and volatility, and rows, of log returns by key; more aggregates after them."""
    w = series(*keys, order=order)
    run = df.withColumn("_c", F.exp(F.sum(r).over(upto(w)))).withColumn("_p", F.max("_c").over(upto(w)))
    return run.groupBy(*keys).agg(sharpe(r).alias("sharpe"), F.max((F.col("_p") - F.col("_c")) / (F.col("_p") + TINY)).alias("mdd"), (F.avg(r) * YEAR).alias("ann_return"), (F.stddev_samp(r) * YEAR**0.5).alias("ann_vol"), F.count("*").alias("n_points"), *more)


def describe(returns: DataFrame) -> DataFrame:
    """Moments and percentiles by entity over the dates that all entities have."""
    entities = returns.select("entity").distinct().count()
    common = returns.groupBy("ts").agg(F.count("r").alias("n")).where(F.col("n") == entities).select("ts")
    rows = returns.join(common, "ts", "left_semi")
    out = rows.groupBy("entity").agg(F.count("*").alias("n"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("std"), F.min("r").alias("least"), F.max("r").alias("most"))
    points = quantiles(rows, "r", [0.05, 0.5, 0.95], ["entity"]).groupBy("entity").agg(*[F.max(F.when(F.col("q") == q, F.col("value"))).alias(name) for q, name in ((0.05, "p5"), (0.5, "p50"), (0.95, "p95"))])
    return out.join(points, "entity").select("entity", "n", "mean", "std", "least", "p5", "p50", "p95", "most")


def tail_events(returns: DataFrame, limits: tuple[float, ...] = (0.05, 0.10)) -> DataFrame:
    size = F.abs("r")
    return returns.groupBy("entity").agg((F.stddev_samp("r") * YEAR**0.5).alias("ann_vol"), *[x for t in limits for x in (F.count_if(size > t).alias(f"n_{round(100 * t)}"), F.avg((size > t).cast("double")).alias(f"share_{round(100 * t)}"))])


def coverage(bars: DataFrame) -> DataFrame:
    return bars.agg(F.countDistinct("entity").alias("entities"), F.countDistinct("ts").alias("dates"), F.count("*").alias("n"))


def cagr(bars: DataFrame) -> DataFrame:
    days = F.date_diff(F.max("ts"), F.min("ts"))
    return bars.groupBy("entity").agg((F.pow(F.max_by("close", "ts") / F.min_by("close", "ts"), 365 / days) - 1).alias("cagr"), F.count_distinct("ts").alias("dates"))


def acf(df: DataFrame, most: int = 20, r: str = "r") -> DataFrame:
    """Autocorrelations by lag with the biased denominator: for each lag the products of rows that far apart."""
    mean = Window.partitionBy("entity")
    d = df.select("entity", F.row_number().over(series()).alias("i"), (F.col(r) - F.avg(r).over(mean)).alias("d"))
    total = d.groupBy("entity").agg(F.sum(F.col("d") * F.col("d")).alias("ss"), F.count("*").alias("n"))
    ahead = d.select("entity", "i", "d", F.explode(F.sequence(F.lit(1), F.lit(most))).alias("lag")).select("entity", (F.col("i") + F.col("lag")).alias("i"), "lag", F.col("d").alias("e"))
    return ahead.join(d, ["entity", "i"]).groupBy("entity", "lag").agg(F.sum(F.col("d") * F.col("e")).alias("s")).join(total, "entity").select("entity", "lag", (F.col("s") / F.col("ss")).alias("acf"), "n")


def pacf(acfs: DataFrame) -> DataFrame:
    """Partial autocorrelations by the Durbin-Levinson recursion over each entity's array of lags."""
    rho = acfs.groupBy("entity").agg(F.sort_array(F.collect_list(F.struct("lag", "acf"))).alias("pairs")).select("entity", F.transform("pairs", lambda p: p["acf"]).alias("rho"))

    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    def step(state: Column, k: Column) -> Column:
        phi, rho = state["phi"], state["rho"]
        past = F.reverse(F.slice(rho, 1, k - 1))
        new = (F.element_at(rho, k) - dot(phi, past)) / (1 - dot(phi, F.slice(rho, 1, k - 1)))
        return F.struct(F.concat(F.zip_with(phi, F.reverse(phi), lambda a, b: a - new * b), F.array(new)).alias("phi"), rho.alias("rho"), F.concat(state["out"], F.array(new)).alias("out"))

    none = F.array().cast("array<double>")
    run = F.aggregate(F.sequence(F.lit(1), F.size("rho")), F.struct(none.alias("phi"), F.col("rho").alias("rho"), none.alias("out")), step, lambda s: s["out"])
    return rho.select("entity", F.posexplode(run).alias("lag", "pacf")).select("entity", (F.col("lag") + 1).alias("lag"), "pacf")


def ljung_box(acfs: DataFrame) -> DataFrame:
    return acfs.groupBy("entity").agg((F.max("n") * (F.max("n") + 2) * F.sum(F.pow("acf", F.lit(2)) / (F.col("n") - F.col("lag")))).alias("q"))


def jarque_bera(df: DataFrame, r: str = "r") -> DataFrame:
    return df.groupBy("entity").agg((F.count(r) / 6 * (F.pow(F.skewness(r), F.lit(2)) + F.pow(F.kurtosis(r), F.lit(2)) / 4)).alias("jb"))


def dickey_fuller(df: DataFrame, column: str = "close") -> DataFrame:
    """t statistic of the slope in: change on last value, with intercept and no lags. Centred sums suffice."""
    x = df.select("entity", F.lag(column).over(series()).alias("x"), (F.col(column) - F.lag(column).over(series())).alias("y")).where("x is not null")
    s = x.groupBy("entity").agg(F.count("*").alias("n"), F.regr_sxx("y", "x").alias("sxx"), F.regr_sxy("y", "x").alias("sxy"), F.regr_syy("y", "x").alias("syy"))
    slope = F.col("sxy") / F.col("sxx")
    error = F.sqrt((F.col("syy") - slope * F.col("sxy")) / (F.col("n") - 2) / F.col("sxx"))
    return s.select("entity", "n", (slope / error).alias("t_stat"), (slope / error < -2.86).alias("stationary"))


def kpss(df: DataFrame, column: str = "r") -> DataFrame:
    """Level statistic: squared partial sums of deviations over n squared times the variance."""
    d = df.withColumn("_d", F.col(column) - F.avg(column).over(Window.partitionBy("entity"))).withColumn("_s", F.sum("_d").over(upto(series())))
    n = F.count("*")
    return d.groupBy("entity").agg((F.sum(F.col("_s") * F.col("_s")) / (n * n) / F.var_pop(column)).alias("kpss"))


def box_stats(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Quartiles, mean and the extremes within 1.5 quartile ranges."""
    q = df.groupBy(*keys).agg(F.percentile(column, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.avg(column).alias("mean"), F.count(column).alias("n"))
    reach = 1.5 * (F.col("q")[2] - F.col("q")[0])
    inside = df.join(q, keys).where(F.col(column).between(F.col("q")[0] - reach, F.col("q")[2] + reach)).groupBy(*keys).agg(F.min(column).alias("low"), F.max(column).alias("high"))
    return q.join(inside, keys).select(*keys, "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "mean", "low", "high")


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    edges = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    at = F.least(F.floor((F.col(column) - F.col("_lo")) / ((F.col("_hi") - F.col("_lo")) / bins)), F.lit(bins - 1))
    return df.crossJoin(F.broadcast(edges)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of all pairs of columns, in one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("corr")) for a, b in pairs])).alias("x")).select("x.*")


def summary(df: DataFrame, column: str, levels: list[list[str]]) -> DataFrame:
    """Median, mean, deviation and count for several groupings in one job."""
    keys = list(dict.fromkeys(k for level in levels for k in level))
    return df.groupingSets([[F.col(k) for k in level] for level in levels], *[F.col(k) for k in keys]).agg(F.median(column).alias("median"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.count("*").alias("n"))
