"""Scaling, principal components, similarity of folds and the choice of representative folds."""

from __future__ import annotations

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import clip
from ..sources.files import stored

TRAITS = ["volatility", "downside_volatility", "max_drawdown", "skewness", "kurtosis", "trend_strength", "acf_lag_1", "acf_lag_5", "acf_lag_21"]


def scale(df: DataFrame, fitted_on: DataFrame, standard: list[str], minmax: list[str] = []) -> DataFrame:
    """Columns scaled by population moments or by range of `fitted_on`: one aggregate, then a projection."""
    marks = fitted_on.agg(*[f(c).alias(f"_{n}_{c}") for c in standard for n, f in (("m", F.avg), ("s", F.stddev_pop))], *[f(c).alias(f"_{n}_{c}") for c in minmax for n, f in (("m", F.min), ("s", lambda x: F.max(x) - F.min(x)))])
    out = df.crossJoin(F.broadcast(marks))
    return out.withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}")) for c in (*standard, *minmax)}).select(*df.columns)


def principal(df: DataFrame, columns: list[str], target: float = 0.95) -> tuple[DataFrame, list[float], list[list[float]]]:
    """Rows with as many components as explain the target share, these shares, and the loadings."""
    means = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    vectors = VectorAssembler(inputCols=columns, outputCol="_v").transform(df.withColumns({c: F.col(c) - means[c] for c in columns}))
    model = PCA(k=len(columns), inputCol="_v", outputCol="_pc").fit(vectors)
    shares, k, total = [float(x) for x in model.explainedVariance], 0, 0.0
    while k < len(shares) and total < target:
        total, k = total + shares[k], k + 1
    parts = vector_to_array("_pc")
    keep = [c for c in df.columns if c not in columns]
    return model.transform(vectors).select(*keep, *[parts[i].alias(f"pc{i + 1}") for i in range(k)]), shares, model.pc.toArray().T[:k].tolist()


def loadings(columns: list[str], rows: list[list[float]], spark, n: int) -> DataFrame:
    """The n largest loadings of each component."""
    long = spark.createDataFrame([(f"pc{i + 1}", c, abs(x)) for i, row in enumerate(rows) for c, x in zip(columns, row, strict=True)], "component string, feature string, loading double")
    return long.withColumn("rank", F.row_number().over(Window.partitionBy("component").orderBy(F.desc("loading"), "feature"))).where(F.col("rank") <= n)


def traits(meta: DataFrame, columns: list[str] = TRAITS) -> DataFrame:
    """fold_id, entity and z-scores (sample deviation, 0 where there is none) as an array of unit length."""
    marks = meta.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_samp(c).alias(f"_s_{c}") for c in columns])
    z = F.array(*[F.coalesce((F.col(c) - F.col(f"_m_{c}")) / F.nullif(F.col(f"_s_{c}"), F.lit(0.0)), F.lit(0.0)) for c in columns])
    rows = meta.crossJoin(F.broadcast(marks)).select("fold_id", "entity", "date_list", z.alias("z"))
    norm = F.sqrt(F.aggregate("z", F.lit(0.0), lambda a, x: a + x * x))
    return rows.withColumn("_n", norm).select("fold_id", "entity", "date_list", F.transform("z", lambda x: x / F.col("_n")).alias("z"))


#: Days of a bucket of dates: folds whose dates share a bucket are compared by their days.
BUCKET = 64


def overlaps(folds: DataFrame) -> DataFrame:
    """i < j, overlap (Jaccard) of folds with common days. folds: fold_id, date_list (sorted). A fold lies in each
    bucket from its first day to its last; a pair meets in the first bucket that both have."""
    low, high = (F.floor(F.unix_date(F.element_at("date_list", k)) / BUCKET) for k in (1, -1))
    spans = folds.where(F.size("date_list") > 0).select("fold_id", "date_list", low.alias("low"), F.explode(F.sequence(low, high)).alias("bucket"))
    a, b = (spans.select(F.col("fold_id").alias(i), F.col("date_list").alias(f"days_{i}"), F.col("low").alias(f"low_{i}"), "bucket") for i in "ij")
    met = a.join(b, "bucket").where((F.col("i") < F.col("j")) & (F.col("bucket") == F.greatest("low_i", "low_j")))
    common = F.size(F.array_intersect("days_i", "days_j"))
    return met.select("i", "j", common.alias("c"), (common / (F.size("days_i") + F.size("days_j") - common)).alias("overlap")).where("c > 0").drop("c")


def similar_pairs(meta: DataFrame) -> DataFrame:
    """i < j, cosine similarity clipped to 0..1, Jaccard overlap of days, and the penalised dissimilarity.

    Every pair of folds is a row of the result, which is what this report is for; the choice of folds (`facility`)
    makes no such table."""
    t = stored(traits(meta), "traits")
    a, b = t.select(F.col("fold_id").alias("i"), F.col("entity").alias("e"), F.col("z").alias("x")), t.select(F.col("fold_id").alias("j"), F.col("entity").alias("f"), F.col("z").alias("y"))
    dot = F.aggregate(F.zip_with("x", "y", lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    pairs = a.join(b, F.col("i") < F.col("j")).select("i", "j", clip(dot, 0.0, 1.0).alias("sim"), (F.col("e") == F.col("f")).alias("same_entity"))
    out = pairs.join(overlaps(t), ["i", "j"], "left").fillna({"overlap": 0.0})
    penalty = 0.9 * F.col("overlap") + 0.25 * F.col("same_entity").cast("double")
    return out.withColumn("dissim", 1 - clip(F.col("sim") - penalty, 0.0, 1.0))


def elbow(curve: DataFrame, tiny: float) -> DataFrame:
    """The first k whose step up from the k before it is below `tiny`."""
    step = F.col("coverage") - F.lag("coverage").over(Window.orderBy("nth"))
    return curve.withColumn("step", step).where(F.col("step") < tiny).agg(F.min("nth").alias("k"))
