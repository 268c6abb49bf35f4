"""Chunked recursions against pandas, quantiles by selection against numpy."""

import datetime
import random

import numpy as np
import pandas as pd
import pytest

from panelwalk.operators import quantiles, scan


@pytest.mark.parametrize("chunk", [1, 2, 7, 500, 1 << 16])
def test_means_equal_pandas_for_any_chunk(spark, chunk):
    rng, day = np.random.default_rng(chunk), datetime.date(1990, 1, 1)
    sizes = {"a": 60 if chunk < 500 else 1700, "b": 1, "c": 2, "d": 31}
    data, wanted = [], {}
    for e, n in sizes.items():
        x = 50 + np.cumsum(rng.normal(size=n)).round(1)
        if e == "d":
            x[:] = 7.0
        s = pd.Series(x)
        mean = lambda v, span: v.ewm(span=span, adjust=False).mean()
        one = mean(s, 12)
        two = mean(one, 12)
        change = s.diff()
        up, down = (v.ewm(alpha=1 / 14, min_periods=14, adjust=False).mean() for v in (change.clip(lower=0), -change.clip(upper=0)))
        wanted[e] = list(zip(mean(s, 26), 3 * one - 3 * two + mean(two, 12), 100 - 100 / (1 + up / down), strict=True))
        data += [(e, day + datetime.timedelta(t), float(v)) for t, v in enumerate(x)]
    random.Random(1).shuffle(data)
    data.append(("a", day - datetime.timedelta(1), None))
    got = scan.recursive_means(spark.createDataFrame(data, "entity string, ts date, close double").repartition(3), ema=(26,), tema=(12,), rsi=(14,), chunk=chunk).collect()
    assert len(got) == len(data)
    for r in got:
        t = (r.ts - day).days
        if t < 0:
            assert (r.ema_26, r.tema_12, r.rsi_14) == (None, None, None)
            continue
        for value, w in zip((r.ema_26, r.tema_12, r.rsi_14), wanted[r.entity][t], strict=True):
            assert (value is None) == bool(np.isnan(w)) and (value is None or abs(value - w) < 1e-8), (r, w)


@pytest.mark.parametrize("bins", [4096, 3])
def test_quantiles_equal_numpy(spark, monkeypatch, bins):
    monkeypatch.setattr(quantiles, "BINS", bins)
    rng = np.random.default_rng(4)
    groups = {"n": rng.normal(size=3000), "t": rng.integers(0, 3, 500).astype(float), "c": np.full(9, -2.5), "one": np.array([4.0]), "two": np.array([1.0, 2.0]), "big": rng.lognormal(0, 3, 4000)}
    df = spark.createDataFrame([(g, float(x)) for g, v in groups.items() for x in v] + [("n", None), ("none", None)], "g string, x double").repartition(5)
    shares = [0.0, 0.0005, 0.1, 0.5, 0.7, 0.9995, 1.0]
    got = {(r.g, r.q): r.value for r in quantiles.quantiles(df, "x", shares, ["g"]).collect()}
    assert len(got) == len(groups) * len(shares)
    for (g, q), value in got.items():
        assert np.isclose(value, np.quantile(groups[g], q), rtol=1e-12, atol=1e-12), (g, q)
    every = np.concatenate(list(groups.values()))
    for r in quantiles.quantiles(df, "x", shares).collect():
        assert r.n == len(every) and np.isclose(r.value, np.quantile(every, r.q), rtol=1e-12, atol=1e-12)
    assert quantiles.quantiles(df.limit(0), "x", [0.5]).collect() == []


def test_no_task_reads_all_values(spark):
    df = spark.range(200_000).selectExpr("cast(id * 7919 % 200003 AS double) AS x")
    plan = quantiles.quantiles(df, "x", [0.7])._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan
    assert quantiles.quantiles(df, "x", [0.7]).first().value == pytest.approx(np.quantile(np.arange(200_000) * 7919 % 200003, 0.7))


def test_steps_are_removed(spark):
    import __spark_entry__
    from panelwalk.sources import files

    made = files.stored(spark.range(3).toDF("x"), "gone")
    place = files._FOLDERS[-1].removeprefix("file://")
    assert made.count() == 3
    __spark_entry__.finish(spark)
    import os

    assert not os.path.exists(place) and files._FOLDERS == []
