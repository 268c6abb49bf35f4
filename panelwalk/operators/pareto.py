"""Fronts, knees, hypervolume and choices between runs; f0 and f1 are minimised."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def front(df: DataFrame, keys: list[str], f0: str = "f0", f1: str = "f1") -> DataFrame:
    """Rows that no other dominates; equal rows all stay. A row stays if it has the least f1 of its f0 and
    less than every row of smaller f0: two windows instead of all pairs."""
    w = Window.partitionBy(*keys)
    best = F.min(f1).over(Window.partitionBy(*keys, f0))
    ranked = df.withColumns({"_best": best, "_rank": F.dense_rank().over(w.orderBy(f0))})
    before = F.min(f1).over(w.orderBy("_rank").rangeBetween(Window.unboundedPreceding, -1))
    return ranked.withColumn("_before", before).where((F.col(f1) == F.col("_best")) & (F.col("_before").isNull() | (F.col(f1) < F.col("_before")))).drop("_best", "_rank", "_before")


def front_by_join(df: DataFrame, keys: list[str]) -> DataFrame:
    """The same by definition, for checks on small inputs."""
    other = df.select(*keys, F.col("f0").alias("g0"), F.col("f1").alias("g1"))
    worse = (F.col("g0") <= F.col("f0")) & (F.col("g1") <= F.col("f1")) & ((F.col("g0") < F.col("f0")) | (F.col("g1") < F.col("f1")))
    on = worse
    for k in keys:
        on = on & (df[k] == other[k])
    return df.join(other, on, "left_anti")


def frontier(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Least x, most y by a sorted scan with strict improvement: equal points come once."""
    w = Window.partitionBy(*keys).orderBy(F.col(x), F.desc(y)).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_most", F.max(y).over(w)).where(F.col("_most").isNull() | (F.col(y) > F.col("_most"))).drop("_most")


def scaled(df: DataFrame, keys: list[str], f0: str = "f0", f1: str = "f1") -> DataFrame:
    """Adds s0 and s1: both objectives by their range in the group; 0 where it has none."""
    w = Window.partitionBy(*keys)

    def unit(c: str):
        low, high = F.min(c).over(w), F.max(c).over(w)
        return F.when(high > low, (F.col(c) - low) / (high - low)).otherwise(0.0)

    return df.withColumns({"s0": unit(f0), "s1": unit(f1)})


def knees(fronts: DataFrame, keys: list[str], ties: list[str]) -> DataFrame:
    """The row of each front nearest to the ideal corner; ties by the parameters."""
    near = F.sqrt(F.pow("s0", F.lit(2)) + F.pow("s1", F.lit(2)))
    w = Window.partitionBy(*keys).orderBy(F.round("_d", 9), *ties)
    return scaled(fronts, keys).withColumn("_d", near).withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_d", "_nth", "s0", "s1")


def chord_knees(fronts: DataFrame, keys: list[str], ties: list[str]) -> DataFrame:
    """The row of each front farthest from the chord between the front's ends."""
    w = Window.partitionBy(*keys).orderBy("f0", "f1").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = fronts.withColumns({"a0": F.first("f0").over(w), "a1": F.first("f1").over(w), "b0": F.last("f0").over(w), "b1": F.last("f1").over(w)})
    dx, dy = F.col("b0") - F.col("a0"), F.col("b1") - F.col("a1")
    far = F.coalesce(F.abs(dx * (F.col("f1") - F.col("a1")) - dy * (F.col("f0") - F.col("a0"))) / F.nullif(F.sqrt(dx * dx + dy * dy), F.lit(0.0)), F.lit(0.0))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(F.round("far", 9)), *ties))
    return ends.withColumn("far", far).withColumn("_nth", nth).where("_nth = 1").drop("_nth", "a0", "a1", "b0", "b1")


def references(points: DataFrame, keys: list[str], mode: str = "scale") -> DataFrame:
    """The reference point: the worst of each objective times 1.1 and a little more. For negative values
    that lies inside; mode offset adds a tenth of the size instead."""
    worst = lambda c: F.max(c) * 1.1 + 1e-6 if mode == "scale" else F.max(c) + 0.1 * F.abs(F.max(c)) + 1e-6
    return points.groupBy(*keys).agg(worst("f0").alias("ref0"), worst("f1").alias("ref1"))


def hypervolume(fronts: DataFrame, refs: DataFrame, keys: list[str]) -> DataFrame:
    """Area between the front and the reference: rectangles by lag along the sorted front."""
    inside = fronts.join(refs, keys).where("f0 < ref0 and f1 < ref1").select(*keys, "f0", "f1", "ref0", "ref1").distinct()
    prior = F.coalesce(F.lag("f1").over(Window.partitionBy(*keys).orderBy("f0", "f1")), F.col("ref1"))
    area = inside.withColumn("_a", (F.col("ref0") - F.col("f0")) * (prior - F.col("f1"))).groupBy(*keys).agg(F.sum("_a").alias("hv"), F.count("*").alias("n_front"))
    return refs.join(area, keys, "left").fillna({"hv": 0.0, "n_front": 0})


def gains(hv: DataFrame, keys: list[str], stage: str, before: str, after: str) -> DataFrame:
    """Change of hypervolume between two stages."""
    value = lambda s: F.max(F.when(F.col(stage) == s, F.col("hv")))
    return hv.groupBy(*keys).agg(value(before).alias("hv_before"), value(after).alias("hv_after")).withColumn("gain", F.col("hv_after") - F.col("hv_before"))


def gain_summary(gain: DataFrame, key: str, tiny: float = 1e-12) -> DataFrame:
    better = F.col("gain") > tiny
    up = F.when(better, F.col("gain"))
    return gain.groupBy(key).agg(F.count_if(better).alias("improved"), F.count("*").alias("n"), F.avg(better.cast("double")).alias("rate"), F.avg(up).alias("mean_gain"), F.median(up).alias("median_gain"))


def final_interval(gain: DataFrame, key: str) -> DataFrame:
    """Interval with the best median gain against its spread; without spread there is no score, which sorts last."""
    spread = F.nullif(F.stddev_samp("gain"), F.lit(0.0))
    scored = gain.groupBy(key).agg((F.median("gain") / (spread + 1e-9)).alias("score"), F.median("gain").alias("median_gain"), F.count("*").alias("n"))
    return scored.orderBy(F.col("score").desc_nulls_last(), F.desc("median_gain"), F.desc("n"), key).limit(1)


def interval_by_sharpe(tests: DataFrame, key: str) -> DataFrame:
    """Interval with the best median Sharpe of its tests, for want of hypervolumes."""
    by = tests.groupBy(key).agg(F.median("sharpe").alias("median_sharpe"), F.count("*").alias("n"))
    return by.orderBy(F.desc(F.round("median_sharpe", 9)), F.desc("n"), key).limit(1)


def scalarised(df: DataFrame, keys: list[str], weights: list[float]) -> DataFrame:
    """Augmented Chebyshev value of each row for each weight."""
    runs = scaled(df, keys).select("*", F.explode(F.array(*map(F.lit, weights))).alias("lam"))
    a, b = F.col("lam") * F.col("s0"), (1 - F.col("lam")) * F.col("s1")
    return runs.withColumn("value", F.greatest(a, b) + 0.05 * (a + b))
