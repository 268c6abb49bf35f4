"""Quality control of folds: thresholds, outliers, restored minima, weights and reasons.

Input: fold_id, entity, ratio, vol."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import clip

LOW, HIGH, VOL = 0.05, 0.95, 0.001
MIN_FOLDS = 5


def merge_meta(folds: DataFrame, meta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ratio and volatility from the summary, else from the meta table; folds without a ratio apart."""
    both = folds.join(meta.select("fold_id", F.col("positive_ratio").alias("_r"), F.col("volatility").alias("_v")), "fold_id", "left")
    both = both.withColumns({"ratio": F.coalesce("ratio", "_r"), "vol": F.coalesce("vol", "_v")}).drop("_r", "_v")
    return both.where("ratio is not null"), both.where("ratio is null").withColumn("reason", F.lit("missing_target_or_meta"))


def thresholds(folds: DataFrame, min_folds: int = MIN_FOLDS) -> DataFrame:
    """By entity: 10 and 90 percent points of the ratio, widened by 0.02, and the 10 percent point of the
    volatility, within the global limits; entities with few folds have these limits themselves."""
    own = F.count("*") >= max(20, 3 * min_folds)
    pct = lambda c, q: F.percentile(c, F.lit(q))
    return folds.groupBy("entity").agg(
        F.when(own, F.greatest(pct("ratio", 0.1) - 0.02, F.lit(LOW))).otherwise(F.lit(LOW)).alias("low"),
        F.when(own, F.least(pct("ratio", 0.9) + 0.02, F.lit(HIGH))).otherwise(F.lit(HIGH)).alias("high"),
        F.when(own, F.greatest(pct("vol", 0.1), F.lit(VOL))).otherwise(F.lit(VOL)).alias("least_vol"),
    )


def rule(folds: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds rule_ok; a missing volatility fails."""
    return folds.join(limits, "entity", "left").withColumn("rule_ok", F.col("ratio").between(F.col("low"), F.col("high")) & (F.coalesce("vol", F.lit(float("-inf"))) >= F.col("least_vol")))


def iqr_outliers(folds: DataFrame) -> DataFrame:
    """Adds outlier: a ratio more than 1.5 quartile ranges outside the entity's quartiles."""
    w = Window.partitionBy("entity")
    q1, q3 = F.percentile("ratio", F.lit(0.25)).over(w), F.percentile("ratio", F.lit(0.75)).over(w)
    out = folds.withColumns({"_q1": q1, "_q3": q3})
    reach = 1.5 * (F.col("_q3") - F.col("_q1"))
    return out.withColumn("outlier", ~F.col("ratio").between(F.col("_q1") - reach, F.col("_q3") + reach)).drop("_q1", "_q3")


def _distance(w) -> F.Column:
    mid = F.percentile("vol", F.lit(0.5)).over(w)
    return 0.7 * F.abs(F.col("ratio") - 0.5) / 0.5 + 0.3 * F.coalesce(F.abs(F.col("vol") - mid) / F.nullif(F.abs(mid), F.lit(0.0)), F.lit(1.0))


def restore(folds: DataFrame, min_folds: int = MIN_FOLDS) -> DataFrame:
    """Adds kept: passed both rules, or among the nearest that bring its entity to the least number. The
    nearest are taken from all that passed the first rule, kept ones too."""
    passed = F.col("rule_ok") & ~F.col("outlier")
    have = F.sum(passed.cast("int")).over(Window.partitionBy("entity"))
    ranked = folds.withColumns({"_have": have, "_far": _distance(Window.partitionBy("entity"))})
    nth = F.row_number().over(Window.partitionBy("entity", "rule_ok").orderBy("_far", "fold_id"))
    restored = F.col("rule_ok") & (nth <= min_folds - F.col("_have"))
    return ranked.withColumn("kept", passed | restored).drop("_have", "_far")


def weights(folds: DataFrame) -> DataFrame:
    """Adds weight by closeness of the ratio to one half and of the volatility to the median."""
    mid = folds.agg(F.percentile("vol", F.lit(0.5)).alias("_mid"))
    near = 1 - clip(F.abs(F.col("vol") - F.col("_mid")) / F.nullif(F.abs("_mid"), F.lit(0.0)), 0, 1)
    weight = 0.7 * clip(1 - 1.2 * F.abs(F.col("ratio") - 0.5), 0.2, 1) + 0.3 * F.coalesce(near, F.lit(0.0))
    return folds.crossJoin(F.broadcast(mid)).withColumn("weight", clip(weight, 0.2, 1)).drop("_mid")


def reasons(folds: DataFrame) -> DataFrame:
    """Why each dropped fold went."""
    why = F.array_compact(F.array(F.when(~F.col("ratio").between(F.col("low"), F.col("high")), "ratio_out_of_range"), F.when(F.col("vol").isNull(), "missing_vol"), F.when(F.col("vol") < F.col("least_vol"), "low_vol"), F.when(F.col("outlier"), "iqr_outlier")))
    return folds.where("not kept").select("fold_id", "entity", why.alias("reasons"))
