"""Recursive means by a chunked affine scan.

A mean that refers to its own last value is an affine map of its state: over a chunk of rows the state s becomes
A s + b, where A depends on the number of rows only and b is what the chunk gives from state 0. Chunks of an entity
give their b in parallel, these are composed in order, one small row for each chunk, and each chunk is filled in from
the state that it begins with. No task holds more than a chunk's rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.common import series
from ..sources.files import stored

CHUNK = 1 << 16
#: Means of means of means: an average, its smoothing and that one's.
LEVELS = 3


def _step(alpha: float) -> np.ndarray:
    """The levels' map for a row, without the row's own value."""
    d = 1 - alpha
    return np.array([[alpha ** (i - j) * d if j <= i else 0.0 for j in range(LEVELS)] for i in range(LEVELS)])


def _mean(x: np.ndarray, alpha: float, start: float) -> np.ndarray:
    return pd.Series(np.r_[start, x]).ewm(alpha=alpha, adjust=False).mean().to_numpy()[1:]


def _levels(x: np.ndarray, alpha: float, start: np.ndarray) -> list[np.ndarray]:
    out = []
    for level in range(LEVELS):
        x = _mean(x, alpha, start[level])
        out.append(x)
    return out


def recursive_means(df: DataFrame, column: str = "close", ema: tuple[int, ...] = (12, 26), tema: tuple[int, ...] = (12, 26), rsi: tuple[int, ...] = (7, 14), chunk: int = CHUNK) -> DataFrame:
    """EMA, TEMA and Wilder's RSI of each entity by ts. Means begin with the first value, those of rises and falls with
    the second row's; RSI is null for the first n rows and where nothing has changed. Rows without a value get nulls and
    are passed over by the means."""
    spans = sorted({*ema, *tema})
    names = [*(f"ema_{n}" for n in ema), *(f"tema_{n}" for n in tema), *(f"rsi_{n}" for n in rsi)]
    schema = "entity string, ts date, " + ", ".join(f"{n} double" for n in names)
    x = F.col(column).cast("double")
    rows = df.where(x.isNotNull()).select("entity", "ts", x.alias("x"), (x - F.lag(x).over(series())).alias("change"), (F.row_number().over(series()) - 1).alias("i"))
    rows = stored(rows.withColumn("chunk", F.floor(F.col("i") / chunk)), "series")

    def systems(rows: pd.DataFrame) -> list[tuple[np.ndarray, float]]:
        """The value and weight of each system: LEVELS states for a span, then one each for rises and falls."""
        change = rows["change"].to_numpy()[rows["i"].to_numpy() > 0]
        return [(rows["x"].to_numpy(), 2 / (n + 1)) for n in spans] + [(v, 1 / n) for n in rsi for v in (np.maximum(change, 0), np.maximum(-change, 0))]

    def summary(rows: pd.DataFrame) -> pd.DataFrame:
        rows, b = rows.sort_values("i"), []
        for k, (v, alpha) in enumerate(systems(rows)):
            if k < len(spans):
                b += [y[-1] for y in _levels(v, alpha, np.zeros(LEVELS))]
            else:
                b.append(_mean(v, alpha, 0.0)[-1] if len(v) else 0.0)
        moves = rows["change"].to_numpy()[rows["i"].to_numpy() > 0]
        firsts = [rows["x"].iloc[0], moves[0] if len(moves) else np.nan]
        return pd.DataFrame({"entity": [rows["entity"].iloc[0]], "chunk": [rows["chunk"].iloc[0]], "size": [len(rows)], "first": [firsts[0]], "move": [firsts[1]], "b": [b]})

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The state at the beginning of each chunk; chunks of an entity come one after the other."""
        state, wait = np.zeros(0), True
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["chunk"] == 0:
                    state, wait = np.array([r["first"]] * (LEVELS * len(spans)) + [0.0, 0.0] * len(rsi)), True
                if wait and r["move"] is not None and not np.isnan(r["move"]):
                    # Means of rises and falls begin with the first change, which chunks of one row don't have.
                    state[LEVELS * len(spans) :] = [max(r["move"], 0.0), max(-r["move"], 0.0)] * len(rsi)
                    wait = False
                out.append(state.tolist())
                b, at = np.array(r["b"]), 0
                new = state.copy()
                for n in spans:
                    new[at : at + LEVELS] = np.linalg.matrix_power(_step(2 / (n + 1)), r["size"]) @ state[at : at + LEVELS] + b[at : at + LEVELS]
                    at += LEVELS
                moved = r["size"] - (r["chunk"] == 0)
                for n in rsi:
                    new[at : at + 2] = (1 - 1 / n) ** moved * state[at : at + 2] + b[at : at + 2]
                    at += 2
                state = new
            yield pa.RecordBatch.from_arrays([batch.column("entity"), batch.column("chunk"), pa.array(out, pa.list_(pa.float64()))], ["entity", "chunk", "state"])

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i")
        state, at, found = np.array(rows["state"].iloc[0]), 0, {}
        out, i = rows[["entity", "ts"]].copy(), rows["i"].to_numpy()
        of = systems(rows)
        for n, (v, alpha) in zip(spans, of, strict=False):
            found[n] = _levels(v, alpha, state[at : at + LEVELS])
            at += LEVELS
        for n in ema:
            out[f"ema_{n}"] = found[n][0]
        for n in tema:
            out[f"tema_{n}"] = 3 * found[n][0] - 3 * found[n][1] + found[n][2]
        for k, n in enumerate(rsi):
            up, down = (_mean(*of[len(spans) + 2 * k + side], state[at + side]) for side in (0, 1))
            at += 2
            with np.errstate(divide="ignore", invalid="ignore"):
                value = 100 - 100 / (1 + up / down)
            whole = np.full(len(rows), np.nan)
            whole[len(rows) - len(value) :] = value
            out[f"rsi_{n}"] = np.where(i >= n, whole, np.nan)
        return out

    summaries = rows.groupBy("entity", "chunk").applyInPandas(summary, "entity string, chunk long, size long, first double, move double, b array<double>")
    states = summaries.repartition("entity").sortWithinPartitions("entity", "chunk").mapInArrow(starts, "entity string, chunk long, state array<double>")
    found = rows.join(states, ["entity", "chunk"]).groupBy("entity", "chunk").applyInPandas(fill, schema)
    out = found.select("entity", "ts", *[F.nanvl(n, F.lit(None)).alias(n) for n in names])
    return out.unionByName(df.where(x.isNull()).select("entity", "ts", *[F.lit(None).cast("double").alias(n) for n in names]))
