"""File sources and sinks: bars by entity, fold summaries, logs, champions, ragged results."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .panels import PRICES

CHAMPION = "struct<champion:struct<p:int,d:int,q:int>,best_params:struct<p:int,d:int,q:int>,layers:int,num_layers:int>"
#: Names that result files use for the same column.
ALIASES = {"interval": "retrain_interval", "retrain": "retrain_interval", "ticker": "entity", "fold": "fold_id", "test_sharpe": "sharpe", "test_mdd": "mdd", "thr": "threshold"}


#: Folders that this process has asked for.
_FOLDERS: list[str] = []


def drop_folders(spark: SparkSession) -> None:
    """Removes what this process has written to the shared folder. Results that read it have to be written by then."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _FOLDERS:
        path = jvm.org.apache.hadoop.fs.Path(_FOLDERS.pop())
        path.getFileSystem(conf).delete(path, True)


def folder(spark: SparkSession, name: str) -> str:
    """A new place in the folder that all executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    _FOLDERS.append(f"{root or spark.conf.get('spark.sql.warehouse.dir') + '/_steps'}/{name}-{uuid.uuid4().hex}")
    return _FOLDERS[-1]


def stored(df: DataFrame, name: str = "step", **options) -> DataFrame:
    """Written and read again: the plan starts anew from the files."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_bars(bars: DataFrame, path: str) -> None:
    """One folder of text lines for each entity, the first lines being headers that no date begins."""
    line = F.concat_ws(",", F.date_format("ts", "yyyy-MM-dd"), *[F.col(c).cast("string") for c in (*PRICES, "volume")])
    heads = bars.select("entity").distinct().select("entity", F.explode(F.array(F.lit("Price,Open,High,Low,Close,Adj Close,Volume"), F.concat(F.lit("Ticker,"), "entity"), F.lit("Date,,,,,,"))).alias("value"))
    bars.select("entity", line.alias("value")).unionByName(heads).write.partitionBy("entity").text(path)


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    """All entities' lines in one scan with a fixed schema; the entity comes from the file's place, lines
    without a date are headers."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("day", *PRICES, "volume")])
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).csv(path)
    entity = F.regexp_extract(F.col("_metadata.file_path"), "entity=([^/]+)", 1)
    return rows.select(entity.alias("entity"), F.expr("try_to_date(day, 'yyyy-MM-dd')").alias("ts"), *[F.col(c).try_cast("double").alias(c) for c in (*PRICES, "volume")]).where("ts is not null")


def read_folds(spark: SparkSession, path: str, record: str) -> DataFrame:
    """Fold summaries, a JSON text for each line: a list, or a dict that wraps one under a known key."""
    keys = ("folds", "arima", "lstm", "data", "results")
    wrapped = F.from_json("value", f"struct<{','.join(f'{k}:array<{record}>' for k in keys)}>")
    bare = F.when(F.col("value").startswith("["), F.from_json("value", f"array<{record}>"))
    return spark.read.text(path).select(F.coalesce(bare, *[wrapped[k] for k in keys]).alias("folds")).select(F.explode("folds").alias("f")).select("f.*")


def champion(text: Column) -> list[Column]:
    """p, q and layers of a champion's JSON, whichever names it uses."""
    c = F.from_json(text, CHAMPION)
    best = F.coalesce(c["champion"], c["best_params"])
    return [best["p"].alias("p"), best["q"].alias("q"), F.coalesce(c["layers"], c["num_layers"], F.lit(1)).alias("layers")]


def dict_text(text: Column, schema: str) -> Column:
    """A dict as Python prints it."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\bNone\b", "null"), r"\bTrue\b", "true"), r"\bFalse\b", "false")
    return F.from_json(plain, schema, {"allowSingleQuotes": "true"})


def known_columns(df: DataFrame, keep: list[str]) -> DataFrame:
    """Lower-case names, synonyms replaced, numbers coerced, known columns only."""
    named = df.toDF(*[ALIASES.get(c.strip().lower(), c.strip().lower()) for c in df.columns])
    return named.select(*[F.col(c) if c in ("entity", "source") else F.col(c).cast("string").try_cast("double").alias(c) for c in keep if c in named.columns])


def source_tag(c: Column) -> Column:
    tag = F.regexp_replace(F.trim(c), "[_-]", "+")
    return F.when(F.lower(tag).isin("knee+union", "ga+bo", "ga+bo+knee"), "GA+BO").when(F.lower(tag).isin("ga", "ga+knee"), "GA").otherwise(tag)


def interval_of(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c.cast("string"), r"(\d+)", 1), F.lit("")).cast("int")


def scan_log(spark: SparkSession, path: str) -> DataFrame:
    """k, coverage and diversity of the log lines that hold them."""
    pattern = r"k=(\d+).*cov_mean=([\d.]+).*diversity_mean=([\d.]+)"
    lines = spark.read.text(path).where(F.col("value").rlike(pattern))
    return lines.select(F.regexp_extract("value", pattern, 1).cast("int").alias("k"), F.regexp_extract("value", pattern, 2).cast("double").alias("coverage"), F.regexp_extract("value", pattern, 3).cast("double").alias("diversity"))


def read_ragged(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows that fit the schema, and the lines that don't."""
    full = T.StructType.fromDDL(schema).add("_corrupt_record", "string")
    rows = stored(spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").csv(path), "ragged")
    return rows.where("_corrupt_record is null").drop("_corrupt_record"), rows.where("_corrupt_record is not null").select("_corrupt_record")


def append_new(batch: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Appends the rows of a batch whose keys the table lacks, one for each key (the least by all columns); returns the
    table."""
    spark = batch.sparkSession
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        done = spark.read.schema(batch.schema).parquet(path)
        batch = batch.join(done.select(*keys).distinct(), keys, "left_anti").select(*batch.columns)
    least = F.min(F.struct(*batch.columns)).alias("row")
    batch.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(least).select("row.*").write.mode("append").parquet(path)
    return spark.read.schema(batch.schema).parquet(path)


def fold_slice(spark: SparkSession, path: str, split: str, schema: str) -> DataFrame:
    """One part of a table of fold rows kept in folders by part; the filter decides which folders are read."""
    return spark.read.schema(schema).parquet(path).where(F.col("split") == split)


def by_file_id(spark: SparkSession, path: str, schema: str, pattern: str) -> DataFrame:
    """All files below a folder with fold_id from each file's place; files that can't be read are left out."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).parquet(path)
    return rows.withColumn("fold_id", F.nullif(F.regexp_extract(F.col("_metadata.file_path"), pattern, 1), F.lit("")).try_cast("long")).where("fold_id is not null")
