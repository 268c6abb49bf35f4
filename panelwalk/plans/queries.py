"""Registered queries: one for each operator, with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.common import clip, series, sharpe
from ..operators import backtest, clean, folds, indicators, pareto, qc, scan, select, stats
from ..sources import files, panels
from ..streaming import streams
from . import frames as fr
from . import components, lagged, models, reports, selection  # noqa: F401  register their own
from .registry import ORACLES, QUERIES, query  # noqa: F401

BARS = "SELECT entity, ts, open, high, low, close, adj_close, volume FROM "


def _listing(spark: SparkSession, day: str) -> DataFrame:
    return spark.createDataFrame([("AF", day)], "entity string, listed string").withColumn("listed", F.col("listed").cast("date"))


# Sources and cleaning
query("bars", BARS + "bars", exact=True)(panels.bars)
query("event_bars", """SELECT event_type AS entity, date_trunc('hour', ts)::TIMESTAMP AS ts, min_by(value, {'a': ts, 'b': event_id, 'c': value}) AS open, max(value) AS high, min(value) AS low,
  max_by(value, {'a': ts, 'b': event_id, 'c': value}) AS close, max_by(value, {'a': ts, 'b': event_id, 'c': value}) AS adj_close, count(*)::DOUBLE AS volume FROM events GROUP BY ALL""", exact=True)(panels.event_bars)
query("calendar_align", BARS + "aligned", exact=True)(lambda s, d: clean.calendar_align(panels.bars(s, d)).select("entity", "ts", *panels.PRICES, "volume"))
query("listing_filter", BARS + "bars WHERE entity <> 'AF' OR ts >= DATE '1994-01-01'", exact=True)(lambda s, d: clean.listed(panels.bars(s, d), _listing(s, "1994-01-01")))
query("listing_filter_late", BARS + "bars WHERE entity <> 'AF' OR ts >= DATE '1996-05-01'", exact=True)(lambda s, d: clean.listed(panels.bars(s, d), _listing(s, "1996-05-01")))
query("ffill_prices", BARS + "(SELECT f.* EXCLUDE (volume), a.volume FROM filled f JOIN aligned a USING (entity, ts))", exact=True)(lambda s, d: clean.forward_fill(clean.calendar_align(panels.bars(s, d))))
query("fill_volume", "SELECT entity, ts, coalesce(volume, 0) AS volume FROM aligned")(lambda s, d: clean.fill_volume(clean.calendar_align(panels.bars(s, d))).select("entity", "ts", "volume"))
query("drop_gaps", BARS + "panel", exact=True)(lambda s, d: fr.panel(s, d).select("entity", "ts", *panels.PRICES, "volume"))
query("dedup_first", "SELECT l_returnflag, ts, l_orderkey, l_linenumber, l_extendedprice AS price FROM (SELECT *, l_shipdate::DATE AS ts FROM lineitem) QUALIFY row_number() OVER (PARTITION BY l_returnflag, ts ORDER BY l_orderkey, l_linenumber, l_extendedprice) = 1", exact=True)(
    lambda s, d: clean.first_of_each(s.read.parquet(f"{d}/lineitem.parquet").select("l_returnflag", F.to_date("l_shipdate").alias("ts"), "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("price")), ["l_returnflag", "ts"], [F.col("l_orderkey"), F.col("l_linenumber"), F.col("price")])
)
query("outlier_replace", "SELECT entity, ts, " + ", ".join(f"round(CASE WHEN {c} > avg({c}) OVER w + 2 * stddev_samp({c}) OVER w OR {c} < avg({c}) OVER w - 2 * stddev_samp({c}) OVER w OR {c} < 1 THEN avg({c}) OVER w ELSE {c} END, 6) AS {c}" for c in ("close", "volume")) + " FROM panel WINDOW w AS (PARTITION BY entity ORDER BY ts ROWS 29 PRECEDING)", digits=7)(
    lambda s, d: clean.replace_outliers(fr.panel(s, d).select("entity", "ts", "close", "volume"), ["close", "volume"], k_sigma=2.0)
)
query("log_return", "SELECT entity, ts, round(r, 6) AS r FROM rets")(lambda s, d: fr.rets(s, d).select("entity", "ts", "r"))
query("boxcox_lambda", """SELECT round(max_by(lam, llf), 6) AS lam, round(max(llf), 4) AS llf FROM (SELECT lam, (lam - 1) * sum(ln(close)) - count(*) / 2 * ln(var_pop(CASE WHEN lam = 0 THEN ln(close) ELSE (pow(close, lam) - 1) / lam END)) AS llf
  FROM panel, (SELECT unnest(range(-20, 21)) / 10 AS lam) GROUP BY lam)""")(lambda s, d: clean.power_transform(fr.panel(s, d), "close").withColumn("llf", F.round("llf", 4)))
query("temporal_split", "SELECT entity, CASE WHEN ts <= DATE '1996-12-31' THEN 'train' ELSE 'test' END AS split, count(*) AS n, max(ts) AS last FROM rets GROUP BY ALL")(lambda s, d: clean.split(fr.rets(s, d), "1996-12-31").groupBy("entity", "split").agg(F.count("*").alias("n"), F.max("ts").alias("last")))
query("label_quantile", "SELECT entity, ts, round(next, 6) AS next, round(thr, 6) AS thr, target FROM labelled")(lambda s, d: fr.labelled(s, d).select("entity", "ts", "next", "thr", "target"))
query("label_distribution", """SELECT q::DOUBLE AS q, target, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY q), 6) AS share FROM (SELECT q, (next > quantile)::INT AS target FROM nexts,
  (SELECT q, CASE q WHEN 0.6 THEN a WHEN 0.7 THEN b ELSE c END AS quantile FROM (SELECT unnest([0.6, 0.7, 0.8]) AS q), (SELECT quantile_cont(next, 0.6) AS a, quantile_cont(next, 0.7) AS b, quantile_cont(next, 0.8) AS c FROM nexts))) GROUP BY q, target""")(lambda s, d: clean.label_distribution(fr.rets(s, d)))
query("non_finite_guard", "SELECT count(*) FILTER (close IS NULL) AS close, count(*) FILTER (volume IS NULL) AS volume FROM aligned")(lambda s, d: clean.non_finite(clean.calendar_align(panels.bars(s, d)), ["close", "volume"]))
@query("numeric_coercion", """SELECT event_type, count(TRY_CAST(x AS DOUBLE)) AS ok, count(*) - count(TRY_CAST(x AS DOUBLE)) AS bad
FROM (SELECT event_type, CASE WHEN event_id % 9 = 0 THEN props ELSE json_extract_string(props, '$.k') END AS x FROM events) GROUP BY event_type""")
def numeric_coercion(s: SparkSession, d: str) -> DataFrame:
    """Every ninth text is no number."""
    text = F.when(F.col("event_id") % 9 == 0, F.col("props")).otherwise(F.get_json_object("props", "$.k"))
    events = s.read.parquet(f"{d}/events.parquet").withColumn("k", text.try_cast("double"))
    return events.groupBy("event_type").agg(F.count("k").alias("ok"), F.count_if(F.col("k").isNull()).alias("bad"))


for _mode, _sql in (("drop", "SELECT entity, ts, round(next, 6) AS target FROM nexts"), ("zero", "SELECT entity, ts, round(coalesce(lead(r) OVER (PARTITION BY entity ORDER BY ts), 0), 6) AS target FROM rets")):
    query(f"target_repair_{_mode}", _sql)(lambda s, d, m=_mode: clean.repaired_target(fr.rets(s, d), "r", m).select("entity", "ts", "target"))
query("return_column", "SELECT entity, ts, round(ln(adj_close / lag(adj_close) OVER (PARTITION BY entity ORDER BY ts)), 6) AS ret FROM panel")(lambda s, d: clean.return_column(fr.panel(s, d).select("entity", "ts", "adj_close")).select("entity", "ts", "ret"))
query("date_slice", "SELECT entity, ts, round(close, 6) AS close, strftime(ts, '%Y-%m-%d') AS day FROM panel WHERE upper(entity) = 'RF' AND ts BETWEEN DATE '1996-03-01' AND DATE '1996-06-30'")(lambda s, d: clean.date_slice(fr.panel(s, d), "rf", "1996-03-01", "1996-06-30").select("entity", "ts", "close", "day"))

# Window indicators
query("lags", "SELECT entity, ts, " + ", ".join(f"round(lag({c}, {k}) OVER w, 6) AS {c}_lag_{k}" for c in ("close", "r") for k in (1, 3, 5)) + " FROM rets WINDOW w AS (PARTITION BY entity ORDER BY ts)", digits=8)(lambda s, d: (lambda x: x.select("entity", "ts", *[c for c in x.columns if "_lag_" in c]))(indicators.lags(fr.rets(s, d), ["close", "r"])))
query("lead_return", "SELECT entity, ts, round(next, 6) AS next FROM nexts")(lambda s, d: fr.rets(s, d).select("entity", "ts", F.lead("r").over(series()).alias("next")).where("next is not null"))
query("sma", "SELECT entity, ts, CASE WHEN count(close) OVER w = 5 THEN round(avg(close) OVER w, 6) END AS sma_5 FROM panel WINDOW w AS (PARTITION BY entity ORDER BY ts ROWS 4 PRECEDING)")(lambda s, d: fr.panel(s, d).select("entity", "ts", indicators.sma("close", 5).alias("sma_5")))
_BANDS = ", ".join(
    f"CASE WHEN count(close) OVER w{n} = {n} THEN round(avg(close) OVER w{n}, 6) END AS bb_mid_{n}, " + ", ".join(f"CASE WHEN count(close) OVER w{n} = {n} THEN round(avg(close) OVER w{n} {sign} {k} * stddev_samp(close) OVER w{n}, 6) END AS bb_{side}_{n}_{str(k).replace('.', '_')}" for k in (1.5, 2) for side, sign in (("upper", "+"), ("lower", "-"))) for n in (10, 20)
)
query("bollinger", f"SELECT entity, ts, {_BANDS} FROM panel WINDOW w10 AS (PARTITION BY entity ORDER BY ts ROWS 9 PRECEDING), w20 AS (PARTITION BY entity ORDER BY ts ROWS 19 PRECEDING)")(lambda s, d: (lambda x: x.select("entity", "ts", *[c for c in x.columns if c.startswith("bb_")]))(indicators.bollinger(fr.panel(s, d))))
query("obv", "SELECT entity, ts, round(sum(v) OVER (PARTITION BY entity ORDER BY ts), 6) AS obv FROM (SELECT entity, ts, coalesce(sign(close - lag(close) OVER (PARTITION BY entity ORDER BY ts)), 0) * volume AS v FROM panel)")(lambda s, d: indicators.obv(fr.panel(s, d)).select("entity", "ts", "obv"))
query("hlc3", "SELECT entity, ts, round((high + low + close) / 3, 6) AS hlc3 FROM panel", digits=8)(lambda s, d: indicators.hlc3(fr.panel(s, d)).select("entity", "ts", "hlc3"))
query("regime_tag", "SELECT entity, ts, regime FROM tagged")(lambda s, d: indicators.regime(fr.labelled(s, d)).select("entity", "ts", "regime"))
query("drawdown_path", """SELECT entity, ts, round(ln(c), 6) AS log_equity, round((p - c) / (p + 2.220446049250313e-16), 6) AS drawdown FROM (SELECT *, max(c) OVER (PARTITION BY entity ORDER BY ts) AS p FROM (SELECT entity, ts, exp(sum(r) OVER (PARTITION BY entity ORDER BY ts)) AS c FROM rets))""")(
    lambda s, d: indicators.equity(fr.rets(s, d)).select("entity", "ts", F.log("equity").alias("log_equity"), "drawdown")
)
query("cumulative_return", "SELECT entity, ts, round(exp(sum(ln(1 + exp(r) - 1)) OVER (PARTITION BY entity ORDER BY ts)) - 1, 6) AS cum_return FROM rets")(lambda s, d: indicators.equity(fr.rets(s, d)).select("entity", "ts", "cum_return"))
query("rolling_sharpe", """SELECT entity, ts, CASE WHEN count(r) OVER w = 63 THEN round(avg(r) OVER w / stddev_samp(r) OVER w * sqrt(252), 6) END AS rolling_sharpe, CASE WHEN count(r) OVER w = 63 THEN round(stddev_samp(r) OVER w * sqrt(252), 6) END AS rolling_vol
FROM rets WINDOW w AS (PARTITION BY entity ORDER BY ts ROWS 62 PRECEDING)""")(lambda s, d: indicators.rolling_risk(fr.rets(s, d)).select("entity", "ts", "rolling_sharpe", "rolling_vol"))
query("rebase_100", "SELECT entity, ts, round(close / first_value(close) OVER (PARTITION BY entity ORDER BY ts) * 100, 6) AS rebased FROM panel")(lambda s, d: indicators.rebase(fr.panel(s, d)).select("entity", "ts", "rebased"))
query("sliding_blocks", "SELECT entity, ts, round(s, 6) AS total, n, round(r, 6) AS y FROM (SELECT entity, ts, r, sum(r + close) OVER w AS s, count(*) OVER w AS n FROM rets WINDOW w AS (PARTITION BY entity ORDER BY ts ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)) WHERE n = 10")(
    lambda s, d: indicators.windows(fr.rets(s, d), ["r", "close"], "r", 10).select("entity", "ts", F.aggregate(F.flatten("block"), F.lit(0.0), lambda a, x: a + x).alias("total"), F.size("block").cast("long").alias("n"), "y")
)
_EMA = "SELECT a.entity, a.ts, a.i, sum(CASE WHEN b.i = {first} THEN 1.0 ELSE {alpha} END * pow(1 - {alpha}, a.i - b.i) * b.{x}) AS {x} FROM {t} a JOIN {t} b ON a.entity = b.entity AND b.i <= a.i GROUP BY ALL"
query("ema", "WITH p AS (SELECT entity, ts, close AS x, row_number() OVER (PARTITION BY entity ORDER BY ts) AS i FROM panel) SELECT entity, ts, round(x, 6) AS ema_12 FROM (" + _EMA.format(first=1, alpha="(2 / 13)", x="x", t="p") + ")", digits=7)(lambda s, d: scan.recursive_means(fr.panel(s, d)).select("entity", "ts", "ema_12"))
query("tema", "WITH p AS (SELECT entity, ts, close AS x, row_number() OVER (PARTITION BY entity ORDER BY ts) AS i FROM panel), e1 AS (" + _EMA.format(first=1, alpha="(2 / 13)", x="x", t="p") + "), e2 AS (" + _EMA.format(first=1, alpha="(2 / 13)", x="x", t="e1") + "), e3 AS (" + _EMA.format(first=1, alpha="(2 / 13)", x="x", t="e2") + ") SELECT entity, e1.ts, round(3 * e1.x - 3 * e2.x + e3.x, 6) AS tema_12 FROM e1 JOIN e2 USING (entity, i) JOIN e3 USING (entity, i)", digits=5)(
    lambda s, d: scan.recursive_means(fr.panel(s, d)).select("entity", "ts", "tema_12")
)
query("rsi", "WITH p AS (SELECT entity, ts, greatest(g, 0) AS u, greatest(-g, 0) AS v, row_number() OVER (PARTITION BY entity ORDER BY ts) - 1 AS i FROM (SELECT entity, ts, close - lag(close) OVER (PARTITION BY entity ORDER BY ts) AS g FROM panel)), q AS (SELECT * FROM p WHERE i > 0), a AS (" + _EMA.format(first=1, alpha="(1 / 14)", x="u", t="q") + "), b AS (" + _EMA.format(first=1, alpha="(1 / 14)", x="v", t="q") + ") SELECT p.entity, p.ts, CASE WHEN p.i >= 14 THEN round(100 - 100 / (1 + a.u / b.v), 6) END AS rsi_14 FROM p LEFT JOIN a USING (entity, i) LEFT JOIN b USING (entity, i)")(
    lambda s, d: scan.recursive_means(fr.panel(s, d)).select("entity", "ts", "rsi_14")
)
query("share_in_group", "SELECT entity, regime, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY entity) * 100, 6) AS share FROM tagged GROUP BY entity, regime")(lambda s, d: indicators.regime(fr.labelled(s, d)).groupBy("entity", "regime").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("entity")) * 100))

# Folds
query("fold_generate", "SELECT fold_id, entity, ts, off, split FROM fold_rows")(lambda s, d: fr.fold_rows(s, d).select("fold_id", "entity", "ts", "off", "split"))
query("fold_summary", "SELECT fold_id, entity, train_start, train_end, val_start, val_end, round(val_pos_ratio, 6) AS val_pos_ratio, round(val_vol, 6) AS val_vol, val_pos_ratio < 0.02 OR val_pos_ratio > 0.98 AS extreme FROM folds")(fr.fold_table)
_COMPLETE = """SELECT (row_number() OVER (ORDER BY fold_id) - 1)::BIGINT AS fold_id, n, last FROM (SELECT fold_id, count(*) AS n, max(ts) AS last FROM (SELECT *, CASE WHEN ts < DATE '{day}' THEN NULL ELSE r END AS f FROM fold_rows) GROUP BY fold_id HAVING count(f) = count(*))"""
for _name, _day in (("complete_folds", "1993-06-01"), ("complete_folds_late", "1995-06-01")):
    query(_name, _COMPLETE.format(day=_day))(
        lambda s, d, day=_day: folds.complete_folds(fr.fold_rows(s, d).withColumn("f", F.when(F.col("ts") >= day, F.col("r"))), ["f", "close"]).groupBy("fold_id").agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    )
query("retrain_blocks", """SELECT fold_id, interval_ AS "interval", floor((off - 252) / interval_)::BIGINT AS block, count(*) AS n, round(stddev_pop(r), 6) AS vol, stddev_pop(r) < 0.0015 AS still FROM fold_rows, (SELECT unnest([10, 20, 42]) AS interval_) WHERE split = 'val' GROUP BY ALL""")(
    lambda s, d: folds.blocks(fr.fold_rows(s, d)).groupBy("fold_id", "interval", "block").agg(F.count("*").alias("n"), F.stddev_pop("r").alias("vol"), F.first("still").alias("still"))
)
query("warm_up", "SELECT entity, count(*) AS n, min(ts) AS first FROM numbered WHERE i >= 252 GROUP BY entity")(lambda s, d: fr.labelled(s, d).withColumn("i", F.row_number().over(series()) - 1).where("i >= 252").groupBy("entity").agg(F.count("*").alias("n"), F.min("ts").alias("first")))
query("rwd_rmse", "SELECT fold_id, entity, round(drift, 6) AS drift, round(sqrt(avg((r - drift) * (r - drift))), 6) AS rmse FROM fold_rows JOIN (SELECT fold_id, avg(r) AS drift FROM fold_rows WHERE split = 'train' GROUP BY fold_id) USING (fold_id) WHERE split = 'val' GROUP BY ALL")(lambda s, d: folds.random_walk_rmse(fr.fold_rows(s, d)))
_META = ["positive_ratio", "volatility", "downside_volatility", "max_drawdown", "skewness", "kurtosis", "trend_strength", "acf_lag_1", "acf_lag_5", "acf_lag_21", "bull_ratio", "bear_ratio", "sideways_ratio"]
query("meta_features", "SELECT fold_id, entity, " + ", ".join(f"round({c}, 6) AS {c}" for c in _META) + ", date_min, date_max, len(date_list)::BIGINT AS days FROM meta")(lambda s, d: fr.meta(s, d).withColumn("days", F.size("date_list").cast("long")).drop("date_list"))

# Quality control


def _gappy(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Summaries and meta rows with gaps: every seventh ratio and fifth volatility of the first, every fourteenth
    ratio of the second."""
    rows = fr.fold_rows(s, d)
    gap = lambda c, n: F.when(F.col("fold_id") % n != 0, F.col(c))
    summary = fr.qc_table(s, d, rows).withColumns({"ratio": gap("ratio", 7), "vol": gap("vol", 5)})
    return summary, fr.meta(s, d, rows).withColumns({"positive_ratio": gap("positive_ratio", 14), "volatility": F.round("volatility", 9)})


@query("qc_merge_meta", """SELECT fold_id, round(coalesce(CASE WHEN fold_id % 7 <> 0 THEN ratio END, CASE WHEN fold_id % 14 <> 0 THEN positive_ratio END), 6) AS ratio,
  round(CASE WHEN fold_id % 5 <> 0 THEN vol ELSE round(volatility, 9) END, 6) AS vol, CASE WHEN fold_id % 14 = 0 THEN 'missing_target_or_meta' END AS reason FROM qc JOIN meta USING (fold_id)""")
def qc_merge_meta(s: SparkSession, d: str) -> DataFrame:
    merged, dropped = qc.merge_meta(*_gappy(s, d))
    return merged.withColumn("reason", F.lit(None).cast("string")).select("fold_id", "ratio", "vol", "reason").unionByName(dropped.select("fold_id", "ratio", "vol", "reason"))


query("qc_thresholds", "SELECT entity, round(low, 6) AS low, round(high, 6) AS high, round(least_vol, 6) AS least_vol FROM limits")(lambda s, d: qc.thresholds(fr.qc_table(s, d)))


def _ruled(s: SparkSession, d: str) -> DataFrame:
    table = fr.qc_table(s, d)
    return qc.iqr_outliers(qc.rule(table, qc.thresholds(table)))


query("qc_rule", "SELECT fold_id, rule_ok FROM ruled")(lambda s, d: _ruled(s, d).select("fold_id", "rule_ok"))
query("qc_iqr", "SELECT fold_id, outlier FROM ruled")(lambda s, d: _ruled(s, d).select("fold_id", "outlier"))
query("qc_restore", "SELECT fold_id, kept FROM restored")(lambda s, d: qc.restore(_ruled(s, d)).select("fold_id", "kept"))
query("qc_weights", """SELECT fold_id, round(least(greatest(0.7 * least(greatest(1 - 1.2 * abs(ratio - 0.5), 0.2), 1) + 0.3 * coalesce(1 - least(greatest(abs(vol - mid) / abs(mid), 0), 1), 0), 0.2), 1), 6) AS weight FROM qc, (SELECT quantile_cont(vol, 0.5) AS mid FROM qc)""")(lambda s, d: qc.weights(fr.qc_table(s, d)).select("fold_id", "weight"))
query("qc_reasons", """SELECT fold_id, entity, concat_ws(',', CASE WHEN NOT ratio BETWEEN low AND high THEN 'ratio_out_of_range' END, CASE WHEN vol IS NULL THEN 'missing_vol' END, CASE WHEN vol < least_vol THEN 'low_vol' END, CASE WHEN outlier THEN 'iqr_outlier' END) AS reasons FROM restored WHERE NOT kept""")(
    lambda s, d: qc.reasons(qc.restore(_ruled(s, d))).withColumn("reasons", F.concat_ws(",", "reasons"))
)
query("qc_summary", "SELECT entity, count(*) AS n, sum(kept::INT)::BIGINT AS kept, sum(outlier::INT)::BIGINT AS outliers FROM restored GROUP BY entity")(lambda s, d: qc.restore(_ruled(s, d)).groupBy("entity").agg(F.count("*").alias("n"), F.sum(F.col("kept").cast("long")).alias("kept"), F.sum(F.col("outlier").cast("long")).alias("outliers")))

# Statistics
_RISK = "CASE WHEN coalesce(stddev_samp(r), 0) = 0 THEN 0 ELSE round(avg(r) / stddev_samp(r) * sqrt(252), 6) END AS sharpe, round(max((p - c) / (p + 2.220446049250313e-16)), 6) AS mdd, round(avg(r) * 252, 6) AS ann_return, round(stddev_samp(r) * sqrt(252), 6) AS ann_vol, count(*) AS n_points"
query("bh_metrics", f"SELECT entity, {_RISK} FROM (SELECT *, max(c) OVER (PARTITION BY entity ORDER BY ts) AS p FROM (SELECT *, exp(sum(r) OVER (PARTITION BY entity ORDER BY ts)) AS c FROM rets)) GROUP BY entity")(lambda s, d: stats.risk(fr.rets(s, d), ["entity"]))
query("describe_returns", """SELECT entity, count(*) AS n, round(avg(r), 6) AS mean, round(stddev_samp(r), 6) AS std, round(min(r), 6) AS least, round(quantile_cont(r, 0.05), 6) AS p5, round(quantile_cont(r, 0.5), 6) AS p50, round(quantile_cont(r, 0.95), 6) AS p95, round(max(r), 6) AS most
FROM rets WHERE ts IN (SELECT ts FROM rets GROUP BY ts HAVING count(r) = (SELECT count(DISTINCT entity) FROM rets)) GROUP BY entity""")(lambda s, d: stats.describe(fr.rets(s, d)))
query("tail_events", "SELECT entity, round(stddev_samp(r) * sqrt(252), 6) AS ann_vol, count(*) FILTER (abs(r) > 0.05) AS n_5, round(avg((abs(r) > 0.05)::INT), 6) AS share_5, count(*) FILTER (abs(r) > 0.1) AS n_10, round(avg((abs(r) > 0.1)::INT), 6) AS share_10 FROM rets GROUP BY entity")(lambda s, d: stats.tail_events(fr.rets(s, d)))
query("coverage_counts", "SELECT count(DISTINCT entity) AS entities, count(DISTINCT ts) AS dates, count(*) AS n FROM bars")(lambda s, d: stats.coverage(panels.bars(s, d)))
query("cagr", "SELECT entity, round(pow(max_by(close, ts) / min_by(close, ts), 365 / date_diff('day', min(ts), max(ts))) - 1, 6) AS cagr, count(DISTINCT ts) AS dates FROM panel GROUP BY entity")(lambda s, d: stats.cagr(fr.panel(s, d)))
_ACF = "WITH d AS (SELECT entity, row_number() OVER (PARTITION BY entity ORDER BY ts) AS i, r - avg(r) OVER (PARTITION BY entity) AS d FROM rets), a AS (SELECT x.entity, y.i - x.i AS lag, sum(x.d * y.d) / any_value(ss) AS acf, any_value(n) AS n FROM d x JOIN d y ON x.entity = y.entity AND y.i BETWEEN x.i + 1 AND x.i + 20 JOIN (SELECT entity, sum(d * d) AS ss, count(*) AS n FROM d GROUP BY entity) t ON t.entity = x.entity GROUP BY ALL) "
query("acf", _ACF + "SELECT entity, lag::INT AS lag, round(acf, 6) AS acf, n FROM a")(lambda s, d: stats.acf(fr.rets(s, d)))
query("pacf")(lambda s, d: stats.pacf(stats.acf(fr.rets(s, d))))
query("ljung_box", _ACF + "SELECT entity, round(max(n) * (max(n) + 2) * sum(acf * acf / (n - lag)), 6) AS q FROM a GROUP BY entity")(lambda s, d: stats.ljung_box(stats.acf(fr.rets(s, d))))
query("jarque_bera", "SELECT entity, round(n / 6 * (m3 * m3 / (m2 * m2 * m2) + pow(m4 / (m2 * m2) - 3, 2) / 4), 6) AS jb FROM (SELECT entity, count(*) AS n, avg(d * d) AS m2, avg(d * d * d) AS m3, avg(d * d * d * d) AS m4 FROM (SELECT entity, r - avg(r) OVER (PARTITION BY entity) AS d FROM rets) GROUP BY entity)")(lambda s, d: stats.jarque_bera(fr.rets(s, d)))
query("df_stat", """SELECT entity, n, round(t, 6) AS t_stat, t < -2.86 AS stationary FROM (SELECT entity, count(*) AS n, regr_slope(y, x) / sqrt((regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x)) / (count(*) - 2) / regr_sxx(y, x)) AS t
  FROM (SELECT entity, lag(close) OVER w AS x, close - lag(close) OVER w AS y FROM panel WINDOW w AS (PARTITION BY entity ORDER BY ts)) WHERE x IS NOT NULL GROUP BY entity)""")(lambda s, d: stats.dickey_fuller(fr.panel(s, d)))
query("kpss_stat", "SELECT entity, round(sum(s * s) / (count(*) * count(*)) / var_pop(r), 6) AS kpss FROM (SELECT *, sum(d) OVER (PARTITION BY entity ORDER BY ts) AS s FROM (SELECT *, r - avg(r) OVER (PARTITION BY entity) AS d FROM rets)) GROUP BY entity")(lambda s, d: stats.kpss(fr.rets(s, d)))
query("box_stats", """SELECT entity, regime, n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(mean, 6) AS mean, round(min(r), 6) AS low, round(max(r), 6) AS high FROM tagged JOIN (SELECT entity, regime, count(r) AS n, quantile_cont(r, 0.25) AS q1, quantile_cont(r, 0.5) AS median, quantile_cont(r, 0.75) AS q3, avg(r) AS mean FROM tagged GROUP BY ALL) USING (entity, regime)
WHERE r BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY ALL""")(lambda s, d: stats.box_stats(indicators.regime(fr.labelled(s, d)), ["entity", "regime"], "r"))
query("histogram", "SELECT least(floor((r - lo) / ((hi - lo) / 60)), 59)::INT AS bin, count(*) AS n FROM rets, (SELECT min(r) AS lo, max(r) AS hi FROM rets) GROUP BY ALL")(lambda s, d: stats.histogram(fr.rets(s, d), "r", 60))
query("correlation_table", "SELECT 'close' AS a, 'r' AS b, round(corr(close, r), 6) AS corr FROM rets UNION ALL SELECT 'close', 'volume', round(corr(close, volume), 6) FROM rets UNION ALL SELECT 'r', 'volume', round(corr(r, volume), 6) FROM rets")(lambda s, d: stats.correlations(fr.rets(s, d), ["close", "r", "volume"]))

# Forecasts, positions, backtests
query("ar1_forecast", 'SELECT fold_id, "interval", off, round(mu, 6) + 0 AS mu, round(vol, 6) AS vol FROM forecasts')(lambda s, d: fr.forecasts(s, d).select("fold_id", "interval", "off", "mu", "vol"))
query("zscore_position", 'SELECT fold_id, "interval", thr, off, round(pos, 6) AS pos FROM placed')(lambda s, d: backtest.positions(fr.forecasts(s, d), fr.THRESHOLDS).select("fold_id", "interval", "thr", "off", "pos"))
query("net_return", 'SELECT fold_id, "interval", thr, off, round(turnover, 6) AS turnover, round(net, 6) + 0 AS net FROM trace')(lambda s, d: fr.trace(s, d).select("fold_id", "interval", "thr", "off", "turnover", "net"))
query("backtest_summary", 'SELECT fold_id, entity, "interval", thr, ' + ", ".join(f"round({c}, 6) AS {c}" for c in ("sharpe", "mdd", "ann_return", "ann_vol", "turnover", "round_turns")) + ", n_points, rebalances FROM tests")(lambda s, d: backtest.backtests(fr.trace(s, d)))
query("penalised_objectives", 'SELECT fold_id, "interval", thr, round(penalty, 6) AS penalty, round(f0, 6) AS f0, round(f1, 6) AS f1 FROM evals', digits=7)(lambda s, d: fr.evals(s, d).select("fold_id", "interval", "thr", "penalty", "f0", "f1"))
query("sensitivity_grid", """SELECT thr_mult, cost_mult, count(*) AS n, round(avg(sharpe), 6) AS mean_sharpe, round(avg(turnover), 6) AS mean_turnover FROM (
  SELECT fold_id, thr_mult, cost_mult, avg(net) / stddev_samp(net) * sqrt(252) AS sharpe, sum(turnover) AS turnover FROM (SELECT *, ln(1 + greatest((exp(r) - 1) * pos - 0.0007 * cost_mult * turnover, -0.9999)) AS net FROM (
    SELECT *, abs(pos - coalesce(lag(pos) OVER (PARTITION BY fold_id, thr_mult, cost_mult ORDER BY off), 0)) AS turnover FROM (
      SELECT fold_id, off, r, thr_mult, cost_mult, least(greatest(mu / (vol + 1e-8) / (0.1 * thr_mult + 1e-8), -1), 1) AS pos FROM forecasts, (SELECT unnest([0.8, 1, 1.2]::DOUBLE[]) AS thr_mult), (SELECT unnest([0.5, 1, 1.5]::DOUBLE[]) AS cost_mult) WHERE "interval" = 20)))
  GROUP BY ALL) GROUP BY ALL""")(lambda s, d: _sensitivity(s, d))


def _sensitivity(s: SparkSession, d: str) -> DataFrame:
    grid = lambda xs: F.explode(F.array(*map(F.lit, xs)))
    runs = fr.forecasts(s, d).where("interval = 20").select("*", grid([0.8, 1.0, 1.2]).alias("thr_mult")).select("*", grid([0.5, 1.0, 1.5]).alias("cost_mult"))
    keys = ["fold_id", "thr_mult", "cost_mult"]
    runs = runs.withColumn("pos", clip(F.col("mu") / (F.col("vol") + 1e-8) / (0.1 * F.col("thr_mult") + 1e-8), -1.0, 1.0))
    by = backtest.pnl(runs, keys, cost_multiple=F.col("cost_mult")).groupBy(*keys).agg(sharpe("net").alias("sharpe"), F.sum("turnover").alias("turnover"))
    return by.groupBy("thr_mult", "cost_mult").agg(F.count("*").alias("n"), F.avg("sharpe").alias("mean_sharpe"), F.avg("turnover").alias("mean_turnover"))


query("hysteresis_signal", """WITH b AS (SELECT fold_id, "interval", block, off, round(mu, 9) AS r FROM forecasts WHERE "interval" = 20), q AS (SELECT fold_id, block, quantile_cont(r, 0.7) AS up, quantile_cont(r, 0.65) AS down, quantile_cont(r, 0.5) AS mid FROM b GROUP BY ALL),
m AS (SELECT fold_id, block, quantile_cont(abs(r - mid), 0.5) AS mad FROM b JOIN q USING (fold_id, block) GROUP BY ALL)
SELECT fold_id, off, coalesce(last_value(event IGNORE NULLS) OVER (PARTITION BY fold_id ORDER BY off ROWS UNBOUNDED PRECEDING), 0)::DOUBLE AS pos FROM (
  SELECT fold_id, off, CASE WHEN r >= up AND abs(r - mid) >= 0.5 * mad THEN 1 WHEN r < down OR abs(r - mid) < 0.5 * mad THEN 0 END AS event FROM b JOIN q USING (fold_id, block) JOIN m USING (fold_id, block))""")(
    lambda s, d: backtest.hysteresis(fr.forecasts(s, d).where("interval = 20").withColumn("pred", F.round("mu", 9)), ["fold_id"], ["block"]).select("fold_id", "off", "pos")
)
query("turnover_cap", """SELECT fold_id, "interval", thr, block, round(bt, 6) AS block_turnover, round(spent - coalesce(lag(spent) OVER (PARTITION BY fold_id, "interval", thr ORDER BY block), 0), 6) AS paid FROM (
  SELECT *, least(8 * sum(n) OVER (PARTITION BY fold_id, "interval", thr) / 252, sum(bt) OVER (PARTITION BY fold_id, "interval", thr ORDER BY block)) AS spent FROM (SELECT fold_id, "interval", thr, block, sum(turnover) AS bt, count(*) AS n FROM trace GROUP BY ALL))""")(
    lambda s, d: backtest.turnover_cap(fr.trace(s, d), ["fold_id", "interval", "thr"], 8.0).drop("scale")
)
query("equity_band", 'SELECT "interval", off, round(avg(c), 6) AS mean, round(stddev_pop(c), 6) AS std FROM curve WHERE thr = 0.1 GROUP BY ALL')(lambda s, d: indicators.equity(fr.trace(s, d).where("thr = 0.1").drop("r").withColumnRenamed("net", "r"), series("fold_id", "interval", "thr", order="off")).groupBy("interval", "off").agg(F.avg("equity").alias("mean"), F.stddev_pop("equity").alias("std")))

# Fronts
query("pareto_front", 'SELECT fold_id, "interval", thr, round(f0, 6) AS f0, round(f1, 6) AS f1 FROM front', digits=7)(lambda s, d: fr.fronts(s, d).select("fold_id", "interval", "thr", "f0", "f1"))
query("frontier_scan", 'SELECT fold_id, "interval", thr FROM (SELECT *, max(-f0) OVER (PARTITION BY fold_id, "interval" ORDER BY f1, f0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS most FROM evals) WHERE most IS NULL OR -f0 > most')(lambda s, d: pareto.frontier(fr.evals(s, d).withColumn("y", -F.col("f0")), fr.CASE, "f1", "y").select("fold_id", "interval", "thr"))
query("knee_point", 'SELECT fold_id, "interval", thr FROM knees')(lambda s, d: pareto.knees(fr.fronts(s, d), fr.CASE, ["thr"]).select("fold_id", "interval", "thr"))
query("chord_knee", """SELECT fold_id, "interval", thr FROM (SELECT *, coalesce(abs((b0 - a0) * (f1 - a1) - (b1 - a1) * (f0 - a0)) / nullif(sqrt((b0 - a0) * (b0 - a0) + (b1 - a1) * (b1 - a1)), 0), 0) AS far FROM (
  SELECT *, first_value(f0) OVER w AS a0, first_value(f1) OVER w AS a1, last_value(f0) OVER w AS b0, last_value(f1) OVER w AS b1 FROM front WINDOW w AS (PARTITION BY fold_id, "interval" ORDER BY f0, f1 ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)))
QUALIFY row_number() OVER (PARTITION BY fold_id, "interval" ORDER BY round(far, 9) DESC, thr) = 1""")(lambda s, d: pareto.chord_knees(fr.fronts(s, d), fr.CASE, ["thr"]).select("fold_id", "interval", "thr"))
query("hypervolume", 'SELECT fold_id, "interval", stage, round(hv, 6) AS hv, n_front FROM hv')(fr.hypervolumes)
query("hv_gain", 'SELECT fold_id, "interval", round(hv_before, 6) AS hv_before, round(hv_after, 6) AS hv_after, round(gain, 6) AS gain FROM gains')(fr.gains)
query("hv_gain_summary", 'SELECT "interval", count(*) FILTER (gain > 1e-12) AS improved, count(*) AS n, round(avg((gain > 1e-12)::INT), 6) AS rate, round(avg(gain) FILTER (gain > 1e-12), 6) AS mean_gain, round(median(gain) FILTER (gain > 1e-12), 6) AS median_gain FROM gains GROUP BY "interval"')(lambda s, d: pareto.gain_summary(fr.gains(s, d), "interval"))
query("final_interval", 'SELECT "interval", round(median(gain) / (nullif(stddev_samp(gain), 0) + 1e-9), 6) AS score, round(median(gain), 6) AS median_gain, count(*) AS n FROM gains GROUP BY "interval" ORDER BY median(gain) / (nullif(stddev_samp(gain), 0) + 1e-9) DESC NULLS LAST, median_gain DESC, n DESC, "interval" LIMIT 1')(lambda s, d: pareto.final_interval(fr.gains(s, d), "interval"))
query("scalarised", 'SELECT fold_id, "interval", thr, lam, round(greatest(lam * s0, (1 - lam) * s1) + 0.05 * (lam * s0 + (1 - lam) * s1), 6) AS value FROM ranged, (SELECT unnest([0.25, 0.5, 0.75]::DOUBLE[]) AS lam)')(lambda s, d: pareto.scalarised(fr.fronts(s, d), fr.CASE, [0.25, 0.5, 0.75]).select("fold_id", "interval", "thr", "lam", "value"))
query("best_and_knee", """SELECT fold_id, "interval", thr, 'best' AS pick FROM front QUALIFY row_number() OVER (PARTITION BY fold_id, "interval" ORDER BY f0, f1, thr) = 1 UNION ALL SELECT fold_id, "interval", thr, 'knee' FROM knees""")(
    lambda s, d: (lambda x: clean.first_of_each(x, fr.CASE, [F.col("f0"), F.col("f1"), F.col("thr")]).select("fold_id", "interval", "thr", F.lit("best").alias("pick")).unionByName(pareto.knees(x, fr.CASE, ["thr"]).select("fold_id", "interval", "thr", F.lit("knee").alias("pick"))))(files.stored(fr.fronts(s, d), "fronts"))
)

# Reports
query("interval_report", """SELECT "interval", thr, round(median(sharpe), 6) AS median, round(avg(sharpe), 6) AS mean, round(stddev_samp(sharpe), 6) AS std, count(*) AS n FROM tests GROUP BY GROUPING SETS (("interval"), ("interval", thr), ())""")(lambda s, d: stats.summary(backtest.backtests(fr.trace(s, d)), "sharpe", [["interval"], ["interval", "thr"], []]).select("interval", "thr", "median", "mean", "std", "n"))
query("knee_report", 'SELECT "interval", round(median(sharpe), 6) AS sharpe, round(median(mdd), 6) AS mdd, count(DISTINCT fold_id) AS folds FROM knees GROUP BY "interval"')(lambda s, d: pareto.knees(fr.fronts(s, d), fr.CASE, ["thr"]).groupBy("interval").agg(F.median("sharpe").alias("sharpe"), F.median("mdd").alias("mdd"), F.countDistinct("fold_id").alias("folds")))
query("mode_by_interval", """SELECT "interval", thr, n, round(n / sum(n) OVER (PARTITION BY "interval") * 100, 6) AS share, row_number() OVER (PARTITION BY "interval" ORDER BY n DESC, thr) = 1 AS is_mode FROM (SELECT "interval", thr, count(*) AS n FROM knees GROUP BY ALL)""")(
    lambda s, d: pareto.knees(fr.fronts(s, d), fr.CASE, ["thr"]).groupBy("interval", "thr").agg(F.count("*").alias("n")).withColumns({"share": F.col("n") / F.sum("n").over(Window.partitionBy("interval")) * 100, "is_mode": F.row_number().over(Window.partitionBy("interval").orderBy(F.desc("n"), "thr")) == 1})
)
query("pivot_interval", 'SELECT fold_id, round(max(sharpe) FILTER ("interval" = 10), 6) AS i10, round(max(sharpe) FILTER ("interval" = 20), 6) AS i20, round(max(sharpe) FILTER ("interval" = 42), 6) AS i42 FROM knees GROUP BY fold_id')(lambda s, d: pareto.knees(fr.fronts(s, d), fr.CASE, ["thr"]).groupBy("fold_id").pivot("interval", [10, 20, 42]).agg(F.first("sharpe")).select("fold_id", F.col("10").alias("i10"), F.col("20").alias("i20"), F.col("42").alias("i42")))
query("source_delta_top3", """SELECT a.fold_id, a."interval", round(b.f0 - a.f0, 6) AS delta FROM evals a JOIN evals b ON a.fold_id = b.fold_id AND a."interval" = b."interval" AND a.thr = 0.05 AND b.thr = 0.2 ORDER BY round(abs(b.f0 - a.f0), 6) DESC, a.fold_id, a."interval" LIMIT 3""")(
    lambda s, d: fr.evals(s, d).groupBy("fold_id", "interval").agg((F.max(F.when(F.col("thr") == 0.2, F.col("f0"))) - F.max(F.when(F.col("thr") == 0.05, F.col("f0")))).alias("delta")).orderBy(F.desc(F.round(F.abs("delta"), 6)), "fold_id", "interval").limit(3)
)
query("resume_anti_join", 'SELECT fold_id, "interval", thr FROM evals EXCEPT SELECT fold_id, "interval", thr FROM front')(lambda s, d: (lambda x: x.select("fold_id", "interval", "thr").join(pareto.front(x, fr.CASE).select("fold_id", "interval", "thr"), ["fold_id", "interval", "thr"], "left_anti"))(files.stored(fr.evals(s, d), "evals")))
query("top_n_per_entity", "SELECT entity, fold_id, rank::INT AS rank, round(rmse, 6) AS rmse FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY round(rmse, 8), fold_id) AS rank FROM (SELECT fold_id, entity, sqrt(avg((r - drift) * (r - drift))) AS rmse FROM fold_rows JOIN (SELECT fold_id, avg(r) AS drift FROM fold_rows WHERE split = 'train' GROUP BY fold_id) USING (fold_id) WHERE split = 'val' GROUP BY ALL)) WHERE rank <= 5")(
    lambda s, d: indicators.top_n(folds.random_walk_rmse(fr.fold_rows(s, d)), 5, ["entity"], [F.round("rmse", 8), F.col("fold_id")]).select("entity", "fold_id", "rank", "rmse")
)


# Scaling, similarity, selection
query("minmax_scale", "SELECT entity, ts, round((close - lo) / (hi - lo), 6) AS close FROM rets, (SELECT min(close) AS lo, max(close) AS hi FROM rets)")(lambda s, d: (lambda x: select.scale(x, x, [], ["close"]))(fr.rets(s, d).select("entity", "ts", "close")))
query("hybrid_scale", """SELECT fold_id, off, round((r - m) / sd, 6) AS r, round((close - lo) / (hi - lo), 6) AS close FROM fold_rows, (SELECT avg(r) AS m, stddev_pop(r) AS sd, min(close) AS lo, max(close) AS hi FROM fold_rows WHERE split = 'train')""")(
    lambda s, d: (lambda x: select.scale(x, x.where("split = 'train'"), ["r"], ["close"]).select("fold_id", "off", "r", "close"))(fr.fold_rows(s, d).select("fold_id", "off", "split", "r", "close"))
)


@query("hybrid_scale_summary", """SELECT fold_id, split, count(*) AS n, round(avg((r - m) / sd), 6) AS r_mean, round(min((r - m) / sd), 6) AS r_min, round(max((r - m) / sd), 6) AS r_max,
  round(avg((close - lo) / (hi - lo)), 6) AS close_mean, round(max((close - lo) / (hi - lo)), 6) AS close_max
FROM fold_rows, (SELECT avg(r) AS m, stddev_pop(r) AS sd, min(close) AS lo, max(close) AS hi FROM fold_rows WHERE split = 'train') GROUP BY fold_id, split""")
def hybrid_scale_summary(s: SparkSession, d: str) -> DataFrame:
    """Scaled by the training rows' marks, then summed up by fold and split."""
    rows = fr.fold_rows(s, d).select("fold_id", "split", "r", "close")
    scaled = select.scale(rows, rows.where("split = 'train'"), ["r"], ["close"])
    marks = F.count("*").alias("n"), F.avg("r").alias("r_mean"), F.min("r").alias("r_min"), F.max("r").alias("r_max"), F.avg("close").alias("close_mean"), F.max("close").alias("close_max")
    return scaled.groupBy("fold_id", "split").agg(*marks)


query("cosine_pairs", "SELECT i, j, round(sim, 6) AS sim, same_entity FROM pairs")(lambda s, d: select.similar_pairs(files.stored(fr.meta(s, d), "meta")).select("i", "j", "sim", "same_entity"))
query("penalised_pairs", "SELECT i, j, round(overlap, 6) AS overlap, round(dissim, 6) AS dissim FROM penalised")(lambda s, d: select.similar_pairs(files.stored(fr.meta(s, d), "meta")).select("i", "j", "overlap", "dissim"))


_WIDE = ["open", "high", "low", "close", "volume", "r"]
query("pca_components")(lambda s, d: (lambda x: select.principal(select.scale(x, x, _WIDE), _WIDE)[0])(fr.rets(s, d).select("entity", "ts", *_WIDE)))
query("parameter_neighbours", "SELECT DISTINCT fold_id, least(greatest(p + a, 1), 7)::INT AS p, least(greatest(q + b, 1), 7)::INT AS q FROM (SELECT fold_id, (fold_id % 7 + 1)::INT AS p, (fold_id % 5 + 1)::INT AS q FROM folds), (SELECT unnest([-1, 0, 1]) AS a), (SELECT unnest([-1, 0, 1]) AS b)")(
    lambda s, d: backtest.parameter_grid(s, fr.fold_table(s, d).select("fold_id", (F.col("fold_id") % 7 + 1).cast("int").alias("p"), (F.col("fold_id") % 5 + 1).cast("int").alias("q")))
)

# Files and streams


def _csv(s: SparkSession, d: str) -> DataFrame:
    files.write_bars(panels.bars(s, d), path := files.folder(s, "bars"))
    return files.read_bars(s, path)


def _json_folds(s: SparkSession, d: str) -> DataFrame:
    record = F.struct("fold_id", "entity", F.date_format("val_start", "yyyy-MM-dd").alias("val_start"))
    listed = fr.fold_table(s, d).groupBy("entity").agg(F.collect_list(record).alias("folds"))
    value = F.when(F.col("entity").startswith("A"), F.to_json(F.struct(F.col("folds").alias("arima")))).otherwise(F.to_json("folds"))
    listed.select(value.alias("value")).write.text(path := files.folder(s, "folds"))
    return files.read_folds(s, path, "struct<fold_id:bigint,entity:string,val_start:string>")


def _log(s: SparkSession, d: str) -> DataFrame:
    by = fr.fold_table(s, d).groupBy("entity").agg(F.count("*").alias("k"), F.round(F.avg("val_vol"), 4).alias("v"))
    by.select(F.concat(F.lit("INFO k="), "k", F.lit(" cov_mean="), F.col("v").cast("string"), F.lit(" diversity_mean=0.5 selected="), "entity").alias("value")).union(by.select(F.concat(F.lit("DEBUG skipped "), "entity"))).write.text(path := files.folder(s, "log"))
    return files.scan_log(s, path)


def _ragged(s: SparkSession, d: str) -> DataFrame:
    nation = s.read.parquet(f"{d}/nation.parquet")
    good = F.concat_ws(",", F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("string"), F.lit("1.5"))
    nation.select(F.when(F.col("n_nationkey") % 6 == 5, F.concat(good, F.lit(","), good)).otherwise(good)).write.text(path := files.folder(s, "ragged"))
    fit, bad = files.read_ragged(s, path, "a long, b long, c double")
    return fit.select(F.lit("fit").alias("kind"), F.col("a").cast("string").alias("line")).unionByName(bad.select(F.lit("bad").alias("kind"), F.col("_corrupt_record").alias("line")))


def _appended(s: SparkSession, d: str) -> DataFrame:
    tests, path = fr.fold_table(s, d).select("fold_id", "entity"), files.folder(s, "results")
    files.append_new(tests.where("entity < 'N'"), path, ["fold_id"])
    return files.append_new(tests, path, ["fold_id"])


query("csv_round_trip", BARS + "bars", exact=True)(_csv)
query("json_fold_summaries", "SELECT fold_id, entity, strftime(val_start, '%Y-%m-%d') AS val_start FROM folds")(_json_folds)
query("log_scan", "SELECT count(*)::INT AS k, round(avg(val_vol), 4) AS coverage, 0.5::DOUBLE AS diversity FROM folds GROUP BY entity")(_log)
query("ragged_csv", "SELECT CASE WHEN n_nationkey % 6 = 5 THEN 'bad' ELSE 'fit' END AS kind, CASE WHEN n_nationkey % 6 = 5 THEN concat_ws(',', n_nationkey, n_regionkey, '1.5', n_nationkey, n_regionkey, '1.5') ELSE n_nationkey::VARCHAR END AS line FROM nation")(_ragged)
query("append_resume", "SELECT fold_id, entity FROM folds")(_appended)
query("dict_text", "SELECT event_id, (event_id % 7)::INT AS p, (event_id % 3)::INT AS q FROM events")(
    lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", files.dict_text(F.concat(F.lit("{'p': "), F.col("event_id") % 7, F.lit(", 'd': None, 'q': "), F.col("event_id") % 3, F.lit("}")), "struct<p:int,d:int,q:int>").alias("x")).select("event_id", "x.p", "x.q")
)
query("champion_fallbacks", "SELECT event_id, (event_id % 7)::INT AS p, 2 AS q, CASE WHEN event_id % 2 = 0 THEN 3 ELSE 1 END AS layers FROM events")(
    lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", *files.champion(F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"champion": {"p": '), F.col("event_id") % 7, F.lit(', "q": 2}, "num_layers": 3}'))).otherwise(F.concat(F.lit('{"best_params": {"p": '), F.col("event_id") % 7, F.lit(', "q": 2}}')))))
)
query("source_tags", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'GA+BO' WHEN 1 THEN 'GA' WHEN 2 THEN 'GA+BO' ELSE 'RS' END AS source FROM events")(lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", files.source_tag(F.element_at(F.array(F.lit("knee_union"), F.lit("GA_knee"), F.lit("GA-BO"), F.lit("RS")), (F.col("event_id") % 4 + 1).cast("int"))).alias("source")))
query("interval_text", "SELECT event_id, [10, 20, 42][(event_id % 3 + 1)::INT] AS \"interval\" FROM events")(lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", files.interval_of(F.element_at(F.array(F.lit("10"), F.lit("20 RS"), F.lit("every 42")), (F.col("event_id") % 3 + 1).cast("int"))).alias("interval")))
query("column_aliases", "SELECT event_id::DOUBLE AS fold_id, event_type AS entity, value AS sharpe FROM events", exact=True)(lambda s, d: files.known_columns(s.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias(" Fold"), F.col("event_type").alias("Ticker"), F.col("value").alias("Test_Sharpe"), "props"), ["fold_id", "entity", "sharpe"]))


def _stream_bars(s: SparkSession, d: str) -> DataFrame:
    """All hours, those that the watermark has not closed as they stand at the end."""
    return streams.run_updates(streams.hourly_bars(streams.event_stream(s, d)), ["entity", "ts"], files.folder(s, "stream"), files.folder(s, "stream-state"))


def _stream_signals(s: SparkSession, d: str) -> DataFrame:
    changes = streams.event_stream(s, d).select(F.col("event_type").alias("entity"), "ts", "event_id", (F.col("value") > 50).alias("up"), (F.col("value") < 50).alias("down"))
    return streams.run_once(streams.signals(changes), files.folder(s, "stream"), files.folder(s, "stream-state"))


query("stream_hourly_bars", """SELECT event_type AS entity, date_trunc('hour', ts)::TIMESTAMP AS ts, min_by(value, {'a': ts, 'b': event_id, 'c': value}) AS open, max(value) AS high, min(value) AS low,
  max_by(value, {'a': ts, 'b': event_id, 'c': value}) AS close, count(*) AS n FROM events GROUP BY ALL""", exact=True)(_stream_bars)
query("stream_signals", """WITH RECURSIVE rows_ AS (SELECT event_type AS entity, ts, event_id, value > 50 AS up, value < 50 AS down, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events
  WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(ts)) FROM events)),
states AS (SELECT entity, NULL::TIMESTAMP AS ts, NULL::BIGINT AS event_id, 0::BIGINT AS i, 0 AS pos, 0 AS held, 0 AS rise, 0 AS fall FROM (SELECT DISTINCT entity FROM rows_)
  UNION ALL
  SELECT entity, ts, event_id, i, CASE WHEN pos = 0 AND rise >= 2 THEN 1 WHEN pos = 1 AND fall >= 2 AND held >= 3 THEN 0 ELSE pos END,
    CASE WHEN pos = 0 AND rise >= 2 THEN 1 WHEN pos = 1 AND fall >= 2 AND held >= 3 THEN 0 WHEN pos = 1 THEN held + 1 ELSE 0 END, rise, fall FROM (
    SELECT r.entity, r.ts, r.event_id, r.i, s.pos, s.held, CASE WHEN up THEN rise + 1 ELSE 0 END AS rise, CASE WHEN down THEN fall + 1 ELSE 0 END AS fall
    FROM states s JOIN rows_ r ON r.entity = s.entity AND r.i = s.i + 1))
SELECT entity, ts, event_id, pos FROM states WHERE i > 0""", exact=True)(_stream_signals)
