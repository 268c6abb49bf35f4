"""Panels of bars built from the tables at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PRICES = ["open", "high", "low", "close", "adj_close"]
BAR_SCHEMA = "entity string, ts date, open double, high double, low double, close double, adj_close double, volume double"


def _bars(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows: entity, ts, price, quantity and the order columns."""
    at = F.struct(*order, "price")
    return rows.groupBy("entity", "ts").agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.max_by("price", at).alias("adj_close"), F.sum("quantity").alias("volume")
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars: entity is return flag and line status, price is extended price by quantity."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return _bars(items.select(F.concat("l_returnflag", "l_linestatus").alias("entity"), F.to_date("l_shipdate").alias("ts"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("quantity"), "l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of event values by event type; volume counts events."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return _bars(events.select(F.col("event_type").alias("entity"), F.date_trunc("hour", "ts").alias("ts"), F.col("value").alias("price"), F.lit(1.0).alias("quantity"), F.col("ts").alias("at"), "event_id"), ["at", "event_id"])
