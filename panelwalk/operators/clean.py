"""Calendar alignment, gaps, outliers, returns, labels and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import finite, last_rows, series, upto
from ..sources.panels import PRICES
from .quantiles import quantiles


def calendar_align(bars: DataFrame) -> DataFrame:
    """Every entity on every date; what an entity lacks is null. Dates and entities are small dimensions."""
    grid = bars.select("ts").distinct().crossJoin(bars.select("entity").distinct())
    return grid.join(bars, ["entity", "ts"], "left")


def listed(bars: DataFrame, listing: DataFrame) -> DataFrame:
    """Rows from the entity's listing date on; listing: entity, listed."""
    return bars.join(listing, "entity", "left").where(F.col("ts") >= F.coalesce("listed", F.lit("1900-01-01").cast("date"))).drop("listed")


def forward_fill(bars: DataFrame, columns: list[str] = PRICES) -> DataFrame:
    return bars.withColumns({c: F.last(c, ignorenulls=True).over(upto(series())) for c in columns})


def fill_volume(bars: DataFrame) -> DataFrame:
    return bars.withColumn("volume", F.coalesce("volume", F.lit(0.0)))


def no_gaps(bars: DataFrame) -> DataFrame:
    """Aligned, filled, and without rows before an entity's first bar."""
    return fill_volume(forward_fill(calendar_align(bars))).dropna("any")


def first_of_each(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first in a total order."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_nth = 1").drop("_nth")


def replace_outliers(bars: DataFrame, columns: list[str] = [*PRICES, "volume"], window: int = 30, k_sigma: float = 8.0) -> DataFrame:
    """Values beyond k_sigma deviations of the rolling mean, or below 1, become that mean. In a frame of 30
    rows that holds the value itself no value lies beyond 5.3 deviations, so only the floor acts at 8."""
    w = last_rows(series(), window)

    def fixed(c: str) -> Column:
        mean, spread = F.avg(c).over(w), F.stddev_samp(c).over(w)
        return F.when((F.col(c) > mean + k_sigma * spread) | (F.col(c) < mean - k_sigma * spread) | (F.col(c) < 1), mean).otherwise(F.col(c))

    return bars.select(*[fixed(c).alias(c) if c in columns else F.col(c) for c in bars.columns])


def log_returns(bars: DataFrame, column: str = "close") -> DataFrame:
    """Adds r = ln(x / previous x) and drops each entity's first row."""
    return bars.withColumn("r", F.log(F.col(column) / F.lag(column).over(series()))).where("r is not null")


def power_transform(df: DataFrame, column: str, low: int = -20, high: int = 20) -> DataFrame:
    """Box-Cox with the lambda of a grid of tenths that has the largest profile log-likelihood, over all entities
    together: the whole grid is one aggregate. Returns lambda and its likelihood."""
    x, logs, n = F.col(column), F.sum(F.log(column)), F.count("*")
    grid = [lam / 10 for lam in range(low, high + 1)]
    marks = [(lam - 1) * logs - n / 2 * F.log(F.var_pop((F.pow(x, F.lit(lam)) - 1) / lam if lam else F.log(x))) for lam in grid]
    fit = df.where(x > 0).agg(*[m.alias(f"l{i}") for i, m in enumerate(marks)])
    each = F.explode(F.array(*[F.struct(F.lit(lam).alias("lam"), F.col(f"l{i}").alias("llf")) for i, lam in enumerate(grid)]))
    return fit.select(each.alias("x")).agg(F.max_by("x.lam", "x.llf").alias("lam"), F.max("x.llf").alias("llf"))


def split(df: DataFrame, cutoff: str) -> DataFrame:
    return df.withColumn("split", F.when(F.col("ts") <= F.lit(cutoff).cast("date"), "train").otherwise("test"))


def label(returns: DataFrame, q: float = 0.7) -> DataFrame:
    """Adds next (the next return) and target: whether it exceeds the quantile of all entities' next returns."""
    ahead = returns.withColumn("next", F.lead("r").over(series())).where("next is not null")
    mark = quantiles(ahead, "next", [q]).select(F.col("value").alias("thr"))
    return ahead.crossJoin(F.broadcast(mark)).withColumn("target", (F.col("next") > F.col("thr")).cast("int"))


def label_distribution(returns: DataFrame, shares: tuple[float, ...] = (0.6, 0.7, 0.8)) -> DataFrame:
    ahead = returns.withColumn("next", F.lead("r").over(series())).where("next is not null")
    marks = quantiles(ahead, "next", list(shares)).select("q", F.col("value").alias("thr"))
    counted = ahead.crossJoin(F.broadcast(marks)).groupBy("q", (F.col("next") > F.col("thr")).cast("int").alias("target")).agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("q")))


def non_finite(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts of null, NaN and infinite values by column."""
    return df.agg(*[F.count_if(finite(F.col(c).cast("double")).isNull()).alias(c) for c in columns])


def repaired_target(df: DataFrame, column: str, mode: str) -> DataFrame:
    """target from the next value: mode drop leaves the tail out, zero fills it, both needs column and target."""
    out = df.withColumn("target", F.lead(column).over(series()))
    return {"drop": out.where("target is not null"), "zero": out.fillna(0.0, ["target"]), "both": out.dropna("any", subset=[column, "target"])}[mode]


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """df itself; raises with the names of columns that it lacks."""
    if lacking := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    return df


def feature_columns(df: DataFrame, keep: tuple[str, ...] = ("entity", "ts", "target", "next", "thr"), locked: list[str] | None = None) -> list[str]:
    """Numeric columns that aren't kept aside; principal components alone where there are any; in the order
    of `locked` once that is fixed."""
    numeric = [c for c, t in df.dtypes if t in ("double", "float", "int", "bigint") and c not in keep]
    numeric = [c for c in numeric if c.startswith("pc")] or numeric
    return [c for c in locked if c in numeric] if locked else numeric


def return_column(df: DataFrame, preferred: tuple[str, ...] = ("r", "log_returns", "log_return"), prices: tuple[str, ...] = ("close", "adj_close")) -> DataFrame:
    """Adds ret: a preferred column, else any named like a return that isn't scaled, else ln of the first price's ratio."""
    names = [c for c in df.columns if "scaled" not in c.lower()]
    found = next((c for c in preferred if c in names), None) or next((c for c in names if "return" in c.lower()), None)
    if found:
        return df.withColumn("ret", F.col(found))
    price = next(c for c in prices if c in df.columns)
    return df.withColumn("ret", F.log(F.col(price) / F.lag(price).over(series())))


def without_twins(df: DataFrame, first: str, second: str, tolerance: float = 1e-12) -> DataFrame:
    """Drops `second` if it nowhere differs from `first`."""
    gap = df.agg(F.max(F.abs(F.col(first) - F.col(second)))).first()[0]
    return df.drop(second) if gap is not None and gap <= tolerance else df


def date_slice(df: DataFrame, entity: str, start: str, end: str) -> DataFrame:
    """One entity, whatever the case of its name, between two dates, with the date as text."""
    return df.where((F.upper("entity") == entity.upper()) & F.col("ts").between(start, end)).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
