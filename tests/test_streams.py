"""The streak signal by event time: the same for any split into batches, late rows left out."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from panelwalk.operators.backtest import streak_state
from panelwalk.streaming import streams

SCHEMA = "entity string, ts timestamp, event_id long, up boolean, down boolean"
START = datetime.datetime(2020, 1, 1)


def expected(rows, until):
    out = []
    for e in {r[0] for r in rows}:
        state = (0, 0, 0, 0)
        for _, ts, i, up, down in sorted((r for r in rows if r[0] == e and r[1] is not None), key=lambda r: (r[1], r[2] is None, r[2] or 0, bool(r[3]), bool(r[4]))):
            state = streak_state(bool(up), bool(down), state, 2, 2, 3)
            if ts.replace(minute=0, second=0, microsecond=0) + datetime.timedelta(hours=1) <= until:
                out.append((e, ts, i, state[0]))
    return sorted(map(str, out))


def run(spark, tmp_path, name, batches, late):
    source = f"{tmp_path}/{name}"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{source}/in/{k:03d}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{source}/in")
    return sorted(map(str, map(tuple, streams.run_once(streams.signals(stream, late=late), f"{source}/out", f"{source}/state").collect())))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    out = []
    for i in range(700):
        e = rng.choice(["hot"] * 8 + ["b", "c"])
        ts = START + datetime.timedelta(seconds=rng.randint(0, 6 * 3600), microseconds=rng.choice([0, 0, 1, 999]))
        up = rng.random() < 0.6
        out.append((e, ts, i if i % 50 else None, up, not up if i % 9 else None))
    return [*out, ("b", START + datetime.timedelta(hours=9), 9999, True, False), ("b", None, 5, True, False)]


@pytest.mark.parametrize("split", [1, 3])
def test_signals_do_not_depend_on_batches(spark, tmp_path, rows, split):
    shuffled = [r for r in rows]
    random.Random(split).shuffle(shuffled)
    until = max(r[1] for r in rows if r[1])
    # With a day's grace nothing is late; a last row, two days on, moves the watermark past all others.
    last = ("z", until + datetime.timedelta(days=2), 1, True, False)
    batches = [shuffled[k::split] for k in range(split)] + [[last]]
    assert run(spark, tmp_path, f"s{split}", batches, "1 day") == expected([*rows, last], last[1] - datetime.timedelta(days=1))


def test_late_rows_are_left_out(spark, tmp_path):
    at = lambda h, i, up: ("a", START + datetime.timedelta(hours=h), i, up, not up)
    first, second, third = [at(0, 1, True), at(1, 2, True), at(5, 3, True)], [at(4.5, 6, True), at(8, 5, True)], [at(0.5, 4, False), at(7.5, 7, False)]
    got = run(spark, tmp_path, "late", [first, second, third], "1 hour")
    kept = [r for r in [*first, *second, *third] if r[2] != 4]  # half past midnight comes after the watermark of four o'clock
    assert got == expected(kept, START + datetime.timedelta(hours=7))
