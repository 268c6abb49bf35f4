"""Stream forms: hourly bars with a watermark, and the streak signal as keyed state with timers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from ..operators.backtest import streak_state

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"

#: State in RocksDB holds more than memory; keyed state with timers needs it.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Milliseconds of rows that are released together.
SPAN_MS = 3_600_000
_ROW = np.dtype([("us", "<i8"), ("no_id", "?"), ("id", "<i8"), ("up", "?"), ("down", "?")])


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events file as a stream of files."""
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", "events*").parquet(sf_dir)


def hourly_bars(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Bars by event time; rows later than the watermark are left out once their hour is closed."""
    at = F.struct("ts", "event_id", "value")
    bars = events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), F.col("event_type").alias("entity"))
    return bars.agg(F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count("*").alias("n")).select("entity", F.col("w.start").alias("ts"), "open", "high", "low", "close", "n")


class StreakProcessor(StatefulProcessor):
    """Rows wait in keyed state, those of a span of event time together, until the watermark has passed the span's end;
    then a timer releases them in order of time. A task holds the rows of one entity and span at most."""

    def __init__(self, enter_k: int, exit_k: int, hold: int):
        self.rule = (enter_k, exit_k, hold)

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "span long", "rows binary")
        self.now = handle.getValueState("now", "pos int, held int, rise int, fall int, span long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            batch = batch[batch["ts"].notna()]
            some = np.zeros(len(batch), _ROW)
            some["us"] = batch["ts"].to_numpy("datetime64[us]").view(np.int64)
            some["no_id"], some["id"] = batch["event_id"].isna(), batch["event_id"].astype("Int64").fillna(0).to_numpy(np.int64)
            some["up"], some["down"] = batch["up"].eq(True), batch["down"].eq(True)
            spans = some["us"] // (1000 * SPAN_MS)
            for span in np.unique(spans).tolist():
                held = self.waiting.getValue((span,))[0] if self.waiting.containsKey((span,)) else None
                if held is None:
                    self.handle.registerTimer((span + 1) * SPAN_MS)
                self.waiting.updateValue((span,), ((held or b"") + some[spans == span].tobytes(),))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        span = expiredTimerInfo.getExpiryTimeInMs() // SPAN_MS - 1
        *state, last = self.now.get() if self.now.exists() else (0, 0, 0, 0, span - 1)
        if span <= last:
            raise ValueError("spans have to be released in order of time")
        rows = np.sort(np.frombuffer(bytes(self.waiting.getValue((span,))[0]), _ROW), order=["us", "no_id", "id", "up", "down"])
        self.waiting.removeKey((span,))
        state, pos = tuple(state), []
        for up, down in zip(rows["up"].tolist(), rows["down"].tolist(), strict=True):
            state = streak_state(up, down, state, *self.rule)
            pos.append(state[0])
        self.now.update((*state, span))
        ids = pd.Series(rows["id"], dtype="Int64").mask(rows["no_id"])
        yield pd.DataFrame({"entity": key[0], "ts": rows["us"].view("datetime64[us]").astype("datetime64[ns]"), "event_id": ids, "pos": np.array(pos, np.int32)})

    def close(self) -> None:
        pass


def signals(changes: DataFrame, enter_k: int = 2, exit_k: int = 2, hold: int = 3, late: str = "0 seconds") -> DataFrame:
    """The streak signal of each entity by event time. changes: entity, ts, event_id, up, down; rows go by ts and event_id,
    those without an id last. Batches may bring rows in any order: the signal is that of all rows in order of time, as
    long as no row comes later than `late` behind the latest one; later ones are left out by the watermark, as are
    rows without ts. Rows of spans that the watermark hasn't passed wait in the state."""
    waiting = changes.withWatermark("ts", late).groupBy("entity")
    return waiting.transformWithStateInPandas(StreakProcessor(enter_k, exit_k, hold), "entity string, ts timestamp, event_id long, pos int", "Append", "EventTime")


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and returns what it wrote."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def run_updates(stream: DataFrame, keys: list[str], path: str, checkpoint: str) -> DataFrame:
    """Runs an aggregation over what is there and returns every key's last state, windows that the watermark hasn't
    closed included. Each batch's changed rows have a folder of their own, so a batch that is run again replaces it."""

    def put(batch: DataFrame, nth: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={nth}")

    stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    rest = [c for c in stream.columns if c not in keys]
    rows = stream.sparkSession.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(path)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_last")).select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest])
