"""Panel operators: queries against their SQL, and properties on small frames."""

import math
import random

import pytest
from pyspark.sql import functions as F

from panelwalk.operators import backtest, clean, folds, pareto, select
from panelwalk.plans import queries as Q
from panelwalk.sources import files

from .oracle import differences, duck

#: One or two of each family; all are compared by the driver, and with this list emptied, here.
FAMILIES = "bars calendar_align ffill_prices dedup_first log_return label_quantile rsi obv rolling_sharpe fold_generate fold_summary qc_restore meta_features bh_metrics acf kpss_stat backtest_summary hysteresis_signal pareto_front hypervolume interval_report csv_round_trip ragged_csv validated_join lookup_ids sample_per_entity category_order drawdown_kinds arch_lm yeo_johnson_lambda power_column outlier_default locked_features fold_slice ar1_forecast hybrid_scale stream_hourly_bars representative_folds best_swap ar2_forecast parameter_sweep streak_signal block_penalties window_regression_1".split()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", FAMILIES)
def test_query_equals_its_sql(spark, sf, con, name):
    assert differences(Q.QUERIES[name](spark, sf), con, Q.ORACLES[name]) == []


def test_every_query_has_a_plan(spark, sf):
    eager = {"csv_round_trip", "json_fold_summaries", "log_scan", "ragged_csv", "append_resume", "stream_hourly_bars", "stream_signals", "representative_folds", "coverage_stats", "best_swap", "coverage_elbow", "coverage_sweep", "adaptive_folds", "improved_folds", "pca_components", "pca_loadings", "describe_returns", "hv_progression", "seed_picks", "fold_slice", "fold_files", "locked_features", "parameter_sweep", "random_search_summary", "arma_sweep", "parameter_draws", "order_champions", "ar2_forecast", "ar_forecast", "all_penalties", "block_penalties"}
    for name in set(Q.QUERIES) - eager:
        assert Q.QUERIES[name](spark, sf).columns, name


@pytest.mark.parametrize("name", ["hypervolume", "cosine_pairs", "pareto_front", "backtest_summary", "interval_report", "best_and_knee", "resume_anti_join"])
def test_plans_read_stored_steps(spark, sf, name):
    plan = Q.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and 1 <= plan.count("Relation [") <= 8


def test_front_window_equals_dominance_join(spark):
    random.seed(2)
    rows = [(g, float(random.randint(0, 6)), float(random.randint(0, 6))) for g in range(40) for _ in range(12)]
    df = spark.createDataFrame(rows, "g int, f0 double, f1 double")
    assert sorted(map(tuple, pareto.front(df, ["g"]).collect())) == sorted(map(tuple, pareto.front_by_join(df, ["g"]).collect()))


def test_folds_are_full(spark, sf):
    from panelwalk.plans import frames

    counts = frames.fold_rows(spark, sf).groupBy("fold_id").pivot("split", ["train", "val"]).count()
    assert counts.where("train <> 252 or val <> 42").count() == 0 and counts.count() > 50


def test_outlier_rule_cannot_fire_at_eight_deviations(spark):
    df = spark.createDataFrame([("a", i, 5.0, 1e6 if i == 40 else 5.0) for i in range(60)], "entity string, ts int, close double, volume double")
    out = clean.replace_outliers(df, ["volume"]).where("ts = 40").first()
    assert out.volume == 1e6
    assert clean.replace_outliers(df, ["volume"], k_sigma=5.0).where("ts = 40").first().volume < 1e6


def test_hysteresis_equals_the_sequential_rule(spark):
    random.seed(4)
    rows = [(r, off, off // 10, random.gauss(0, 1)) for r in range(5) for off in range(40)]
    df = spark.createDataFrame(rows, "run int, off int, block int, pred double")
    got = {(x.run, x.off): x.pos for x in backtest.hysteresis(df, ["run"], ["block"]).collect()}

    def pct(xs, q):
        xs, at = sorted(xs), q * (len(xs) - 1)
        return xs[int(at)] + (xs[min(int(at) + 1, len(xs) - 1)] - xs[int(at)]) * (at - int(at))

    for r in range(5):
        pos = 0.0
        for b in range(4):
            block = [x for x in rows if x[0] == r and x[2] == b]
            preds = [x[3] for x in block]
            mid = pct(preds, 0.5)
            mad = pct([abs(p - mid) for p in preds], 0.5)
            for _, off, _, p in block:
                strong = abs(p - mid) >= 0.5 * mad
                pos = 1.0 if p >= pct(preds, 0.7) and strong else 0.0 if p < pct(preds, 0.65) or not strong else pos
                assert got[r, off] == pos


def test_streaks_and_holding():
    state, seen = (0, 0, 0, 0), []
    for up, down in [(1, 0), (1, 0), (0, 1), (0, 1), (0, 1)]:
        state = backtest.streak_state(bool(up), bool(down), state, 2, 2, 3)
        seen.append(state[0])
    assert seen == [0, 1, 1, 1, 0]  # held too briefly at the first chance to leave


def test_hypervolume_of_a_staircase(spark):
    front = spark.createDataFrame([(1, 0.0, 2.0), (1, 1.0, 1.0), (1, 2.0, 0.0), (1, 9.0, 9.0)], "g int, f0 double, f1 double")
    refs = spark.createDataFrame([(1, 3.0, 3.0), (2, 1.0, 1.0)], "g int, ref0 double, ref1 double")
    assert sorted((x.g, x.hv, x.n_front) for x in pareto.hypervolume(front, refs, ["g"]).collect()) == [(1, 6.0, 3), (2, 0.0, 0)]


def test_drawdown_and_sharpe_of_constant_returns(spark):
    from panelwalk.operators import stats

    df = spark.createDataFrame([("a", i, 0.0) for i in range(5)] + [("b", i, x) for i, x in enumerate([0.1, -0.2, 0.1])], "entity string, ts int, r double")
    got = {x.entity: x for x in stats.risk(df, ["entity"]).collect()}
    assert got["a"].sharpe == 0 and got["a"].mdd == 0
    assert math.isclose(got["b"].mdd, 1 - math.exp(-0.2), rel_tol=1e-9)


def test_results_do_not_depend_on_partitions(spark, sf):
    from panelwalk.plans import frames

    panel = frames.rets(spark, sf)
    a = folds.fold_rows(panel).agg(F.sum("off"), F.sum(F.col("fold_id") * F.col("off"))).first()
    b = folds.fold_rows(panel.orderBy(F.rand(3)).repartition(7)).agg(F.sum("off"), F.sum(F.col("fold_id") * F.col("off"))).first()
    assert tuple(a) == tuple(b)


def test_required_columns_are_named(spark):
    with pytest.raises(ValueError, match="b, c"):
        clean.require(spark.range(1).toDF("a"), ["a", "b", "c"])


def test_dict_text(spark):
    df = spark.createDataFrame([("{'p': 5, 'd': None, 'q': 4}",)], "x string")
    assert tuple(df.select(files.dict_text(F.col("x"), "struct<p:int,d:int,q:int>").alias("y")).select("y.*").first()) == (5, None, 4)


def test_streak_signal_covers_every_interval(spark, sf):
    from panelwalk.plans import frames

    keys = ["fold_id", "interval", "off"]
    got = Q.QUERIES["streak_signal"](spark, sf)
    assert set(keys) <= set(got.columns)
    expected = sorted(map(tuple, frames.forecasts(spark, sf).select(*keys).collect()))
    assert {k[1] for k in expected} == {10, 20, 42}
    assert sorted(map(tuple, got.select(*keys).collect())) == expected


def test_repeated_keys_end_a_many_to_one_join(spark):
    from panelwalk.operators import report

    left = spark.createDataFrame([(1, None), (2, "a"), (3, None)], "k int, entity string")
    right = spark.createDataFrame([(1, "x", 5)], "k int, entity string, v int")
    assert sorted(map(tuple, report.many_to_one(left, right, ["k"]).collect())) == [(1, "x", 5), (2, "a", None), (3, "UNK", None)]
    with pytest.raises(Exception, match="repeated key"):
        report.many_to_one(left, right.union(right), ["k"]).collect()


def test_first_evaluations_round_half_to_even(spark):
    from panelwalk.operators import report

    df = spark.createDataFrame([(1, 0.125, 0), (1, 0.12, 1), (1, 0.13, 2)], "g int, t double, seq int")
    assert sorted(x.seq for x in report.first_evaluations(df, ["g"], "t", "seq", 2).collect()) == [0, 2]


def test_elbow_is_the_first_small_step(spark):
    curve = spark.createDataFrame([(1, 0.4), (2, 0.7), (3, 0.75), (4, 0.9), (5, 0.91)], "nth int, coverage double")
    assert select.elbow(curve, 0.1).first().k == 3


def test_partial_autocorrelations_solve_the_normal_equations(spark):
    import numpy as np

    from panelwalk.operators import stats

    random.seed(3)
    rows = [(e, i, random.gauss(0, 1) + (i % 7) * k) for e, k in (("a", 0.1), ("b", 0.4)) for i in range(80)]
    acf = stats.acf(spark.createDataFrame(rows, "entity string, ts int, r double"), 6)
    rho = {(x.entity, x.lag): x.acf for x in acf.collect()}
    value = "pacf"
    for x in stats.pacf(acf).collect():
        row = [1.0, *[rho[x.entity, k] for k in range(1, x.lag + 1)]]
        wanted = np.linalg.solve([[row[abs(i - j)] for j in range(x.lag)] for i in range(x.lag)], row[1:])[-1]
        assert math.isclose(x[value], wanted, abs_tol=1e-9)


def test_components_equal_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 4)) * [3, 2, 1, 0.1]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id int, a double, b double, c double, d double")
    parts, shares, _ = select.principal(df, list("abcd"), 0.95)
    _, size, axes = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(shares, size**2 / (size**2).sum())
    got = np.array([list(r)[1:] for r in parts.orderBy("id").collect()])
    assert np.allclose(np.abs(got), np.abs((x - x.mean(0)) @ axes[: got.shape[1]].T))


def test_overlaps_of_days_equal_brute_force(spark):
    import datetime

    rng, day = random.Random(8), datetime.date(1999, 11, 1)
    folds_ = [sorted(rng.sample(range(s, s + w), min(w, n))) for s, w, n in ((rng.randint(0, 300), rng.choice([5, 60, 150]), rng.randint(0, 40)) for _ in range(40))]
    df = spark.createDataFrame([(i, [day + datetime.timedelta(d) for d in x]) for i, x in enumerate(folds_)], "fold_id long, date_list array<date>")
    got = {(r.i, r.j): r.overlap for r in select.overlaps(df).collect()}
    wanted = {(i, j): len(set(a) & set(b)) / len(set(a) | set(b)) for i, a in enumerate(folds_) for j, b in enumerate(folds_) if i < j and set(a) & set(b)}
    assert got.keys() == wanted.keys() and all(math.isclose(got[k], wanted[k]) for k in wanted)


def test_components_of_chosen_rows_equal_numpy(spark):
    import numpy as np

    from panelwalk.operators import components

    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 4)) @ np.diag([3.0, 2.0, 1.0, 0.1]) @ rng.normal(size=(4, 4)) + 100
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)] + [(99, None, 1.0, 2.0, 3.0)], "id int, a double, b double, c double, d double")
    train = df.where("id < 60 or id = 99")
    model = components.fit(train, list("abcd"), 0.97)
    _, size, axes = np.linalg.svd(x[:60] - x[:60].mean(0), full_matrices=False)
    k = int(np.searchsorted(np.cumsum(size**2) / (size**2).sum(), 0.97)) + 1
    assert np.allclose(model.shares, size**2 / (size**2).sum()) and len(model.axes) == k
    assert all(max(a, key=abs) > 0 for a in model.axes)
    got = np.array([list(r)[1:] for r in components.project(df.where("id < 80"), model, ["id"]).orderBy("id").collect()])
    wanted = (x - x[:60].mean(0)) @ axes[:k].T
    assert np.allclose(np.abs(got), np.abs(wanted)) and np.allclose(got, (x - x[:60].mean(0)) @ np.array(model.axes).T)
    table = components.variance_table(spark, model).collect()
    assert len(table) == 20 and math.isclose(table[-1].cumulative, 1) and table[4].share == 0
    top = components.loadings(spark, model, 2).where("component = 'pc1'").orderBy("rank").collect()
    assert [abs(r.loading) for r in top] == sorted((abs(v) for v in model.axes[0]), reverse=True)[:2]
    assert components.fit(df.limit(0), ["a", "b"]).axes == [] and components.fit(df.withColumn("a", F.lit(1.0)).withColumn("b", F.lit(2.0)), ["a", "b"]).axes == []


def test_append_keeps_one_row_for_each_key(spark, tmp_path):
    first = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], "k int, v string")
    files.append_new(first, f"{tmp_path}/t", ["k"])
    got = files.append_new(spark.createDataFrame([(2, "x"), (3, "z"), (3, "y")], "k int, v string"), f"{tmp_path}/t", ["k"])
    assert sorted(map(tuple, got.collect())) == [(1, "a"), (2, "c"), (3, "y")]


def test_complete_folds_are_numbered_in_order(spark, monkeypatch):
    monkeypatch.setattr(folds, "STRETCH", 4)
    rows = [(f, t, None if f % 5 == 2 and t == 1 else 1.0) for f in range(23) for t in range(3)]
    got = folds.complete_folds(spark.createDataFrame(rows, "fold_id long, off int, x double").withColumn("old", F.col("fold_id")), ["x"]).select("fold_id", "old").distinct().collect()
    assert sorted(map(tuple, got)) == list(enumerate(f for f in range(23) if f % 5 != 2))
