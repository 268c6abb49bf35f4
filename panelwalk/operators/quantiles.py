"""Exact quantiles by selection: no task reads all distinct values.

A mergeable sketch brackets each quantile. Values up to the bracket's end are counted by bins of the bracket, those
below it as one; the running count says which bin holds the wanted ranks. Only that bin's values are ranked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The sketch's accuracy; ranks are off by a ten-thousandth of the rows, the bracket reaches ten times as far.
ACCURACY, REACH = 10_000, 10
BINS = 4096


def quantiles(df: DataFrame, column: str, shares: list[float], keys: list[str] | None = None) -> DataFrame:
    """keys, q, n, value: interpolated quantiles as F.percentile gives them. Nulls don't count; a key without values
    has no row."""
    keys = keys or []
    base = df.select(*keys, F.col(column).cast("double").alias("_x")).where("_x IS NOT NULL")
    reach = REACH / ACCURACY
    marks = [max(0.0, q - reach) for q in shares] + [min(1.0, q + reach) for q in shares]
    sketch = base.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_x").alias("_min"), F.max("_x").alias("_max"), F.percentile_approx("_x", F.array(*map(F.lit, marks)), F.lit(ACCURACY)).alias("_m"))
    if not keys:
        sketch = sketch.where("n > 0")
    few = F.col("n") * reach < 4  # a bracket of a few ranks may miss the one above the wanted one

    def end(mark: float, extreme: str, at: int):
        return F.col(extreme) if mark in (0, 1) else F.when(few, F.col(extreme)).otherwise(F.col("_m")[at])

    each = [F.struct(F.lit(q).alias("q"), end(marks[i], "_min", i).alias("lo"), end(marks[len(shares) + i], "_max", len(shares) + i).alias("hi")) for i, q in enumerate(shares)]
    brackets = sketch.select(*keys, "n", F.explode(F.array(*each)).alias("b")).select(*keys, "n", "b.*").withColumn("pos", F.col("q") * (F.col("n") - 1))
    bracketed = _meet(base, brackets, keys).where("_x <= hi")
    width = F.col("hi") - F.col("lo")
    at = F.when(F.col("_x") < F.col("lo"), -1).when(width > 0, F.least(F.floor((F.col("_x") - F.col("lo")) / width * BINS), F.lit(BINS - 1))).otherwise(0)
    bins = bracketed.groupBy(*keys, "q", "pos", at.cast("int").alias("bin")).agg(F.count("*").alias("c"))
    after = F.sum("c").over(Window.partitionBy(*keys, "q").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    low, high = F.floor("pos"), F.ceil("pos")
    ranked = bins.withColumn("after", after).withColumn("before", F.col("after") - F.col("c")).where((F.col("before") <= high) & (F.col("after") > low))
    chosen = ranked.groupBy(*keys, "q").agg(F.min("bin").alias("first"), F.max("bin").alias("last"), F.min("before").alias("before"))
    inside = _meet(base, brackets.join(chosen, [*keys, "q"]), keys).where("_x <= hi").withColumn("bin", at).where("bin BETWEEN first AND last")
    values = inside.groupBy(*keys, "q", "n", "pos", "before", "_x").agg(F.count("*").alias("c"))
    upto = F.col("before") + F.sum("c").over(Window.partitionBy(*keys, "q").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0))
    ends = values.withColumn("upto", upto).groupBy(*keys, "q", "n", "pos").agg(F.min(F.when(F.col("upto") > low, F.col("_x"))).alias("a"), F.min(F.when(F.col("upto") > high, F.col("_x"))).alias("b"))
    value = F.when(low == high, F.col("a")).otherwise((high - F.col("pos")) * F.col("a") + (F.col("pos") - low) * F.col("b"))
    missed = F.raise_error(F.lit("a quantile lies outside the bracket of its sketch")).cast("double")
    return ends.select(*keys, "q", "n", F.when(F.col("a").isNull() | F.col("b").isNull(), missed).otherwise(value).alias("value"))


def _meet(base: DataFrame, marks: DataFrame, keys: list[str]) -> DataFrame:
    """Every value with its key's marks: a row for each share."""
    return base.join(marks, keys) if keys else base.crossJoin(F.broadcast(marks))
