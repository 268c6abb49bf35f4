"""Walk-forward folds as rows: fold_id, entity, k, split, off. No join and no file for each fold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import TINY, series, upto

TRAIN, VAL, STEP = 252, 42, 21
#: Ids that are numbered together.
STRETCH = 4096


def fold_rows(df: DataFrame, train: int = TRAIN, val: int = VAL, step: int = STEP) -> DataFrame:
    """Each row once for every fold that holds it; off counts from the fold's first row.

    Fold k of an entity covers rows k * step to k * step + train + val - 1 and exists if all are there. Ids
    run over the entities in order; the running sum is over one row for each entity."""
    w, size = series(), train + val
    numbered = df.withColumn("i", F.row_number().over(w) - 1)
    n = df.groupBy("entity").agg(F.count("*").alias("n")).withColumn("folds", F.greatest(F.floor((F.col("n") - size) / step) + 1, F.lit(0)))
    n = n.withColumn("before", F.sum("folds").over(Window.orderBy("entity").rowsBetween(Window.unboundedPreceding, 0)) - F.col("folds")).where("folds > 0").select("entity", "folds", "before")
    first = F.greatest(F.ceil((F.col("i") - (size - 1)) / step), F.lit(0))
    last = F.least(F.floor(F.col("i") / step), F.col("folds") - 1)
    out = numbered.join(n, "entity").where(first <= last).withColumn("k", F.explode(F.sequence(first, last)))
    off = (F.col("i") - F.col("k") * step).cast("int")
    return out.select((F.col("before") + F.col("k")).alias("fold_id"), *df.columns, off.alias("off"), F.when(off < train, "train").otherwise("val").alias("split"))


def complete_folds(rows: DataFrame, features: list[str]) -> DataFrame:
    """Folds without a null feature, numbered anew in the order of their ids: within stretches of ids, after what the
    stretches before hold."""
    gap = F.greatest(*[F.col(c).isNull().cast("int") for c in features]) if len(features) > 1 else F.col(features[0]).isNull().cast("int")
    good = rows.groupBy("fold_id").agg(F.max(gap).alias("gap")).where("gap = 0").select("fold_id")
    good = good.withColumn("stretch", F.floor(F.col("fold_id") / STRETCH))
    counts = good.groupBy("stretch").agg(F.count("*").alias("n"))
    before = counts.select("stretch", (F.sum("n").over(Window.orderBy("stretch")) - F.col("n")).alias("before"))  # a row for STRETCH ids
    nth = F.row_number().over(Window.partitionBy("stretch").orderBy("fold_id")) - 1
    good = good.withColumn("nth", nth).join(before, "stretch").select("fold_id", (F.col("before") + F.col("nth")).alias("new_id"))
    return rows.join(good, "fold_id").drop("fold_id").withColumnRenamed("new_id", "fold_id")


def fold_summary(rows: DataFrame) -> DataFrame:
    """Dates of both parts, share of positive targets and volatility of the validation part."""
    val, train = F.col("split") == "val", F.col("split") == "train"
    out = rows.groupBy("fold_id", "entity").agg(
        F.min(F.when(train, F.col("ts"))).alias("train_start"), F.max(F.when(train, F.col("ts"))).alias("train_end"), F.min(F.when(val, F.col("ts"))).alias("val_start"), F.max(F.when(val, F.col("ts"))).alias("val_end"),
        F.avg(F.when(val, F.col("target"))).alias("val_pos_ratio"), F.stddev_samp(F.when(val, F.col("r"))).alias("val_vol"),
    )
    return out.withColumn("extreme", (F.col("val_pos_ratio") < 0.02) | (F.col("val_pos_ratio") > 0.98))


def blocks(rows: DataFrame, intervals: tuple[int, ...] = (10, 20, 42), train: int = TRAIN) -> DataFrame:
    """Validation rows cut into retraining blocks for each interval; still marks blocks of low volatility."""
    grid = F.explode(F.array(*map(F.lit, intervals))).alias("interval")
    val = rows.where("split = 'val'").select("*", grid).withColumn("block", F.floor((F.col("off") - train) / F.col("interval")))
    vol = F.stddev_pop("r").over(Window.partitionBy("fold_id", "interval", "block"))
    return val.withColumn("still", vol < 0.0015)


def random_walk_rmse(rows: DataFrame) -> DataFrame:
    """Error of predicting each validation return by the mean of the fold's training returns. With the sums
    of the validation part no row needs the mean."""
    val = F.when(F.col("split") == "val", F.col("r"))
    drift = F.avg(F.when(F.col("split") == "train", F.col("r")))
    out = rows.groupBy("fold_id", "entity").agg(drift.alias("drift"), F.avg(val).alias("m"), F.var_pop(val).alias("v"))
    return out.select("fold_id", "entity", "drift", F.sqrt(F.col("v") + F.pow(F.col("m") - F.col("drift"), 2)).alias("rmse"))


def meta_features(rows: DataFrame, scope: str = "val") -> DataFrame:
    """One row for each fold: moments, drawdown, trend, autocorrelation, regime shares and days."""
    part = rows if scope == "all" else rows.where(F.col("split") == scope)
    w = series("fold_id", order="off")
    run = part.withColumns({"peak": F.max("close").over(upto(w)), "x": F.row_number().over(w).cast("double"), "l1": F.lag("r", 1).over(w), "l5": F.lag("r", 5).over(w), "l21": F.lag("r", 21).over(w)})
    n, skew, kurt = F.count("r"), F.skewness("r"), F.kurtosis("r")
    return run.groupBy("fold_id", "entity").agg(
        F.avg("target").alias("positive_ratio"), F.stddev_samp("r").alias("volatility"), F.coalesce(F.stddev_samp(F.when(F.col("r") < 0, F.col("r"))), F.lit(0.0)).alias("downside_volatility"),
        (-F.min(F.col("close") / F.col("peak") - 1)).alias("max_drawdown"), (skew * F.sqrt(n * (n - 1)) / (n - 2)).alias("skewness"),
        ((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * kurt + 6)).alias("kurtosis"),
        F.when(n < 10, 0.0).otherwise(F.abs(F.corr("x", "close")) * F.sqrt((n - 1) / n)).alias("trend_strength"),
        *[F.coalesce(F.corr("r", f"l{k}"), F.lit(0.0)).alias(f"acf_lag_{k}") for k in (1, 5, 21)],
        *[F.avg((F.col("regime") == g).cast("double")).alias(f"{g}_ratio") for g in ("bull", "bear", "sideways")],
        F.min("ts").alias("date_min"), F.max("ts").alias("date_max"), F.sort_array(F.collect_set("ts")).alias("date_list"),
    )


def drawdown(column: str, w) -> tuple:
    """Peak so far and the fall below it."""
    peak = F.max(column).over(upto(w))
    return peak, (peak - F.col(column)) / (peak + TINY)
