"""Joins that are checked, picks from fronts, sweeps and report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import TINY, YEAR, clip, full, last_rows, series, upto


def many_to_one(left: DataFrame, right: DataFrame, keys: list[str], name: str = "entity", unknown: str = "UNK") -> DataFrame:
    """Left join whose right keys must be unique: a second row for a key ends the job with its name. `name` is
    filled from the right where the left lacks it, then by `unknown`."""
    once = right.groupBy(*keys).agg(F.count("*").alias("_n"), *[F.first(c, ignorenulls=True).alias(f"_{c}") for c in right.columns if c not in keys])
    repeated = F.concat(F.lit("repeated key on the right: "), F.concat_ws(",", *[F.col(k).cast("string") for k in keys]))
    once = once.withColumn("_ok", F.when(F.col("_n") == 1, F.lit(True)).otherwise(F.raise_error(repeated).cast("boolean"))).where("_ok").drop("_n", "_ok")
    out = left.join(once, keys, "left").withColumn(name, F.coalesce(name, f"_{name}", F.lit(unknown)))
    return out.drop(f"_{name}").withColumnsRenamed({f"_{c}": c for c in right.columns if c not in (*keys, name)})


def improvement(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Least value of two models by key, and how many percent the second is below the first."""
    best = lambda df, n: df.groupBy(key).agg(F.min(value).alias(n))
    return best(a, "first").join(best(b, "second"), key).withColumn("percent", (F.col("first") - F.col("second")) / F.col("first") * 100)


def lookup(wanted: DataFrame, known: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Known rows of the wanted ids, and the wanted ids that aren't known."""
    ids = wanted.select(key).distinct()
    return known.join(ids, key, "left_semi"), ids.join(known.select(key), key, "left_anti")


def first_evaluations(df: DataFrame, keys: list[str], value: str, order: str, digits: int = 4) -> DataFrame:
    """One row for each key and rounded value (half to even), the first in order."""
    w = Window.partitionBy(*keys, F.bround(value, digits)).orderBy(order)
    return df.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def unique_seeds(df: DataFrame, params: list[str], score: str, n: int) -> DataFrame:
    """The n parameter settings of least score, each once; the order has no ties."""
    return df.groupBy(*params).agg(F.min(score).alias(score)).orderBy(F.round(score, 9), *params).limit(n)


def running_best(df: DataFrame, keys: list[str], order: str, score: str) -> DataFrame:
    """Adds best_so_far (no later than this row), is_best_so_far and is_best of the whole key."""
    w = series(*keys, order=order)
    out = df.withColumns({"best_so_far": F.min(score).over(upto(w)), "_all": F.min(score).over(Window.partitionBy(*keys))})
    return out.withColumns({"is_best_so_far": F.col(score) <= F.col("best_so_far"), "is_best": F.col(score) == F.col("_all")}).drop("_all")


def sample_per_key(df: DataFrame, keys: list[str], identity: Column, n: int, seed: int = 42) -> DataFrame:
    """n rows of each key by the digest of their identity and the seed: the same rows however the table is dealt."""
    w = Window.partitionBy(*keys).orderBy(F.md5(F.concat_ws("|", identity, F.lit(seed))), identity)
    return df.withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") <= n).drop("_nth")


def in_order(df: DataFrame, column: str, categories: list[str]) -> DataFrame:
    """Adds place: where a category stands in the list; others come last, by name."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, categories)), F.col(column)), F.lit(0)), F.lit(len(categories) + 1))
    return df.withColumn("place", place).orderBy("place", column)


def flagged_knees(fronts: DataFrame, keys: list[str], flag: str, ties: list[str]) -> DataFrame:
    """The row of each front that is flagged as its knee, else the one nearest to the ideal corner."""
    w = Window.partitionBy(*keys)
    unit = lambda c: F.coalesce((F.col(c) - F.min(c).over(w)) / F.nullif(F.max(c).over(w) - F.min(c).over(w), F.lit(0.0)), F.lit(0.0))
    near = fronts.withColumns({"_s0": unit("f0"), "_s1": unit("f1")}).withColumn("_d", F.round(F.sqrt(F.col("_s0") * F.col("_s0") + F.col("_s1") * F.col("_s1")), 9))
    nth = F.row_number().over(w.orderBy(F.desc(F.coalesce(flag, F.lit(False))), "_d", *ties))
    return near.withColumn("_nth", nth).where("_nth = 1").drop("_nth", "_d", "_s0", "_s1")


def medoids(fronts: DataFrame, keys: list[str], ties: list[str]) -> DataFrame:
    """The row of each front with the least sum of distances to the others (a front is as long as the list of
    parameters that were tried)."""
    w = Window.partitionBy(*keys)
    points = fronts.withColumn("_points", F.collect_list(F.struct("f0", "f1")).over(w))
    far = F.aggregate("_points", F.lit(0.0), lambda s, p: s + F.sqrt((p["f0"] - F.col("f0")) * (p["f0"] - F.col("f0")) + (p["f1"] - F.col("f1")) * (p["f1"] - F.col("f1"))))
    nth = F.row_number().over(w.orderBy(F.round("_far", 9), *ties))
    return points.withColumn("_far", far).withColumn("_nth", nth).where("_nth = 1").drop("_points", "_far", "_nth")


def seed_picks(fronts: DataFrame, keys: list[str], ties: list[str], flag: str = "is_knee") -> DataFrame:
    """Seeds of a search from each front: best by either objective, knee and medoid."""
    w = Window.partitionBy(*keys)

    def least(first: str, then: str, pick: str) -> DataFrame:
        return fronts.withColumn("_nth", F.row_number().over(w.orderBy(first, then, *ties))).where("_nth = 1").select(*keys, *ties, F.lit(pick).alias("pick"))

    knee = flagged_knees(fronts.withColumn(flag, F.lit(False)), keys, flag, ties).select(*keys, *ties, F.lit("knee").alias("pick"))
    return least("f0", "f1", "f0").unionByName(least("f1", "f0", "f1")).unionByName(knee).unionByName(medoids(fronts, keys, ties).select(*keys, *ties, F.lit("medoid").alias("pick")))


def marker_sizes(df: DataFrame, keys: list[str], column: str, low: float = 20.0, high: float = 120.0) -> DataFrame:
    """Adds size: the column by its range in the key, between low and high; the middle where it has no range."""
    w = Window.partitionBy(*keys)
    least, most = F.min(column).over(w), F.max(column).over(w)
    return df.withColumn("size", F.when(most > least, low + (high - low) * (F.col(column) - least) / (most - least)).otherwise((low + high) / 2))


def progression(hv: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and deviation (0 for one value) of the hypervolume by key."""
    return hv.groupBy(*keys).agg(F.avg("hv").alias("mean"), F.coalesce(F.stddev_samp("hv"), F.lit(0.0)).alias("std"), F.count("*").alias("n"))


def drawdowns(df: DataFrame, column: str, kind: str, keys: list[str] = ["entity"], order: str = "ts") -> DataFrame:
    """Largest drawdown of prices, simple returns or log returns; auto takes returns as log where one is -1 or less."""
    w = series(*keys, order=order)
    x = F.col(column)
    simple, logs = F.exp(F.sum(F.log1p(F.greatest(x, F.lit(-1 + 1e-12)))).over(upto(w))), F.exp(F.sum(x).over(upto(w)))
    curve = {"price": x, "simple": simple, "log": logs, "auto": F.when(F.min(x).over(Window.partitionBy(*keys)) <= -1, logs).otherwise(simple)}[kind]
    run = df.withColumn("_c", curve).withColumn("_p", F.max("_c").over(upto(w)))
    return run.groupBy(*keys).agg(F.max((F.col("_p") - F.col("_c")) / (F.col("_p") + TINY)).alias("mdd"))


def arch_lm(df: DataFrame, column: str = "r") -> DataFrame:
    """Rows times the squared correlation of squared residuals with those one row before: the test of one lag."""
    e = df.withColumn("_e", F.col(column) - F.avg(column).over(Window.partitionBy("entity"))).withColumn("_y", F.col("_e") * F.col("_e"))
    e = e.withColumn("_x", F.lag("_y").over(series())).where("_x is not null")
    return e.groupBy("entity").agg((F.count("*") * F.pow(F.corr("_x", "_y"), F.lit(2))).alias("lm"), F.count("*").alias("n"))


def yeo_johnson(x: Column, lam: Column) -> Column:
    up, down = F.pow(x + 1, lam), F.pow(1 - x, 2 - lam)
    return F.when((x >= 0) & (lam != 0), (up - 1) / lam).when(x >= 0, F.log1p(x)).when(lam != 2, -(down - 1) / (2 - lam)).otherwise(-F.log1p(-x))


def yeo_johnson_fit(df: DataFrame, column: str, low: int = -20, high: int = 20) -> DataFrame:
    """The lambda of a grid of tenths with the largest profile log-likelihood: all of the grid in one aggregate."""
    x = F.col(column)
    jacobian = F.sum(F.signum(x) * F.log1p(F.abs(x)))
    marks = [((lam / 10 - 1) * jacobian - F.count(x) / 2 * F.log(F.var_pop(yeo_johnson(x, F.lit(lam / 10))))).alias(f"l{lam + 100}") for lam in range(low, high + 1)]
    one = df.agg(*marks).select(F.explode(F.array(*[F.struct(F.lit(lam / 10).alias("lam"), F.col(f"l{lam + 100}").alias("llf")) for lam in range(low, high + 1)])).alias("x"))
    return one.select("x.*").agg(F.max_by("lam", "llf").alias("lam"), F.max("llf").alias("llf"))


def power_column(df: DataFrame, column: str, fit: DataFrame) -> DataFrame:
    """Box-Cox with the fitted lambda; log1p for all rows where the column has values of 0 or less."""
    x, marks = F.col(column), fit.select(F.col("lam").alias("_lam")).crossJoin(df.agg(F.min(column).alias("_min")))
    moved = F.when(F.col("_min") <= 0, F.log1p(x)).when(F.col("_lam") == 0, F.log(x)).otherwise((F.pow(x, F.col("_lam")) - 1) / F.col("_lam"))
    return df.crossJoin(F.broadcast(marks)).withColumn(f"transformed_{column}", moved).drop("_lam", "_min")


def rolling_turnover(trace: DataFrame, keys: list[str], n: int = 21, annual: bool = False) -> DataFrame:
    """Rolling mean turnover, null until full; annual: times 252 / n."""
    w = series(*keys, order="off")
    return trace.withColumn("rolling_turnover", full(F.avg("turnover").over(last_rows(w, n)) * (YEAR / n if annual else 1.0), F.col("turnover"), w, n))


def block_penalties(trace: DataFrame, keys: list[str], least_vol: float = 0.0015) -> DataFrame:
    """calm, idle, failed by run: twice what still blocks lack of the least volatility, blocks that hold nothing though
    they aren't still, and blocks without a finite forecast. trace: keys, block, r, mu, pos, still."""
    fails = F.max((F.col("mu").isNull() | F.isnan("mu") | (F.abs("mu") == float("inf"))).cast("int"))
    by = trace.groupBy(*keys, "block").agg(F.max("still").alias("still"), F.stddev_pop("r").alias("vol"), F.coalesce(F.sum(F.abs("pos")), F.lit(0.0)).alias("held"), fails.alias("fails"))
    live = ~F.col("still")
    return by.groupBy(*keys).agg(
        F.sum(F.when(F.col("still"), 2 * (least_vol - F.col("vol"))).otherwise(0.0)).alias("calm"),
        F.count_if(live & (F.col("fails") == 0) & (F.col("held") == 0)).alias("idle"),
        F.count_if(live & (F.col("fails") == 1)).alias("failed"),
    )


def first_penalties(tests: DataFrame, by_block: DataFrame, keys: list[str], low: float, high: float) -> DataFrame:
    """Threshold out of range, a fit that failed, still blocks, no activity at all."""
    out = 10 * F.greatest(F.col("thr") - high, low - F.col("thr"), F.lit(0.0))
    fails = F.when(F.col("failed") > 0, 5.0).otherwise(0.0)
    return tests.join(by_block, keys).withColumn("penalty", out + fails + F.col("calm") + F.when(F.col("rebalances") == 0, 0.5).otherwise(0.0))


def second_penalties(by_block: DataFrame) -> DataFrame:
    """Twenty for each block without a trade and for each that failed, and the still blocks' lack."""
    return by_block.withColumn("penalty", 20.0 * (F.col("idle") + F.col("failed")) + F.col("calm"))


def scaled_position(forecasts: DataFrame, thr: Column) -> DataFrame:
    z = F.col("mu") / (F.col("vol") + 1e-8)
    return forecasts.withColumn("pos", F.when(F.col("still"), 0.0).otherwise(clip(z / (thr + 1e-8), -1.0, 1.0)))
