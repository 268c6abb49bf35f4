"""Windows and expressions used by several operators."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

YEAR = 252
TINY = 2.220446049250313e-16


def series(*keys: str, order: str = "ts") -> WindowSpec:
    """The one window of a panel: chained windows over it share an exchange and a sort."""
    return Window.partitionBy(*(keys or ("entity",))).orderBy(order)


def upto(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def last_rows(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(1 - n, 0)


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def full(value: Column, counted: Column, w: WindowSpec, n: int) -> Column:
    """A rolling value, null until its frame has n values."""
    return F.when(F.count(counted).over(last_rows(w, n)) == n, value)


def sharpe(r: str | Column) -> Column:
    """Mean over sample deviation, annualised; 0 for fewer than two values or none that differ."""
    r = F.col(r) if isinstance(r, str) else r
    return F.when((F.count(r) < 2) | (F.coalesce(F.stddev_samp(r), F.lit(0.0)) == 0), 0.0).otherwise(F.avg(r) / F.stddev_samp(r) * F.sqrt(F.lit(float(YEAR))))


def significant(x: Column, digits: int) -> Column:
    """Rounded to so many significant digits; 0 stays."""
    unit = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(x))) - (digits - 1))
    return F.when(x == 0, 0.0).otherwise(F.round(x / unit) * unit)


def finite(x: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def rounded(df, digits: int = 6, **own: int):
    """Doubles rounded for comparison, at the outermost projection; no negative zero."""
    return df.select(*[(F.round(c, own.get(c, digits)) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
