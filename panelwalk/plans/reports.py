"""Queries of checked joins, picks, sweeps and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.common import series
from ..operators import backtest, clean, folds, indicators, pareto, report, stats
from ..sources import files, panels
from . import frames as fr
from .models import sweep
from .registry import query

RUN = ["fold_id", "entity", "interval", "thr"]


@query("random_search_summary", """SELECT model, "interval", round(median(sharpe), 6) AS median_sharpe, round(median(mdd), 6) AS median_mdd, count(DISTINCT fold_id) AS folds, count(*) AS n
FROM (SELECT 'sampled' AS model, fold_id, "interval", sharpe, mdd FROM swept UNION ALL SELECT 'grid', fold_id, "interval", sharpe, mdd FROM evals) GROUP BY ALL""")
def random_search(s: SparkSession, d: str) -> DataFrame:
    rows = lambda df, name: df.select(F.lit(name).alias("model"), "fold_id", "interval", "sharpe", "mdd")
    held = files.stored(fr.fold_rows(s, d), "rows")
    both = rows(sweep(s, d, held), "sampled").unionByName(rows(fr.evals(s, d, held), "grid"))
    return both.groupBy("model", "interval").agg(F.median("sharpe").alias("median_sharpe"), F.median("mdd").alias("median_mdd"), F.countDistinct("fold_id").alias("folds"), F.count("*").alias("n"))


@query("hv_progression", """SELECT "interval", gen, round(avg(hv), 6) AS mean, round(coalesce(stddev_samp(hv), 0), 6) AS std, count(*) AS n FROM (
  SELECT fold_id, "interval", gen, coalesce(hv, 0) AS hv FROM (SELECT fold_id, "interval", gen FROM refs, (SELECT unnest(range(1, 6)) AS gen)) LEFT JOIN (
    SELECT fold_id, "interval", gen, sum((ref0 - f0) * (coalesce(prior, ref1) - f1)) AS hv FROM (
      SELECT *, lag(f1) OVER (PARTITION BY fold_id, "interval", gen ORDER BY f0, f1) AS prior FROM (
        SELECT DISTINCT fold_id, "interval", gen, f0, f1, ref0, ref1 FROM grown a JOIN refs USING (fold_id, "interval") WHERE f0 < ref0 AND f1 < ref1 AND NOT EXISTS (
          SELECT 1 FROM grown b WHERE a.fold_id = b.fold_id AND a."interval" = b."interval" AND a.gen = b.gen AND b.f0 <= a.f0 AND b.f1 <= a.f1 AND (b.f0 < a.f0 OR b.f1 < a.f1)))) GROUP BY ALL)
  USING (fold_id, "interval", gen)) GROUP BY ALL""")
def hv_progression(s: SparkSession, d: str) -> DataFrame:
    """Each generation adds a threshold to those before it."""
    evals = files.stored(fr.evals(s, d), "evals")
    first = F.array_position(F.array(*map(F.lit, fr.THRESHOLDS)), F.col("thr"))
    grown = evals.select("*", F.explode(F.sequence(first, F.lit(len(fr.THRESHOLDS)).cast("long"))).alias("gen"))
    refs = pareto.references(evals, fr.CASE).select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(len(fr.THRESHOLDS)).cast("long"))).alias("gen"))
    return report.progression(pareto.hypervolume(pareto.front(grown, [*fr.CASE, "gen"]), refs, [*fr.CASE, "gen"]), ["interval", "gen"])


query("final_hv_by_stage", """SELECT "interval", round(avg(hv) FILTER (stage = 'GA'), 6) AS ga, round(avg(hv) FILTER (stage = 'GA+BO'), 6) AS ga_bo FROM hv GROUP BY "interval\"""")(
    lambda s, d: fr.hypervolumes(s, d).groupBy("interval").pivot("stage", ["GA", "GA+BO"]).agg(F.avg("hv")).select("interval", F.col("GA").alias("ga"), F.col("`GA+BO`").alias("ga_bo"))
)
query("validated_join", """SELECT fold_id, "interval", thr, coalesce(CASE WHEN fold_id % 2 = 0 THEN e.entity END, f.entity, 'UNK') AS entity, round(val_vol, 6) AS val_vol FROM evals e LEFT JOIN (SELECT * FROM folds WHERE fold_id % 5 <> 0) f USING (fold_id)""")(
    lambda s, d: (lambda rows: report.many_to_one(fr.evals(s, d, rows).select("fold_id", "interval", "thr", F.when(F.col("fold_id") % 2 == 0, F.col("entity")).alias("entity")), fr.fold_table(s, d, rows).where("fold_id % 5 <> 0").select("fold_id", "entity", "val_vol"), ["fold_id"]))(fr.fold_rows(s, d))
)
_RMSE = 'SELECT fold_id, entity, sqrt(avg((r - drift) * (r - drift))) AS rmse FROM fold_rows JOIN (SELECT fold_id, avg(r) AS drift FROM fold_rows WHERE split = \'train\' GROUP BY fold_id) USING (fold_id) WHERE split = \'val\' GROUP BY ALL'


@query("best_of_two_models", f"""SELECT entity, round(first, 6) AS first, round(second, 6) AS second, round((first - second) / first * 100, 6) AS percent
FROM (SELECT entity, min(rmse) AS first FROM ({_RMSE}) GROUP BY entity) JOIN (SELECT entity, min(rmse) AS second FROM (SELECT entity, fold_id, "interval", sqrt(avg((r - mu) * (r - mu))) AS rmse FROM forecasts GROUP BY ALL) GROUP BY entity) USING (entity)""")
def two_models(s: SparkSession, d: str) -> DataFrame:
    error = F.sqrt(F.avg((F.col("r") - F.col("mu")) * (F.col("r") - F.col("mu"))))
    rows = fr.fold_rows(s, d)
    ar1 = fr.forecasts(s, d, rows).groupBy("entity", "fold_id", "interval").agg(error.alias("rmse"))
    return report.improvement(folds.random_walk_rmse(rows), ar1, "entity", "rmse")


@query("lookup_ids", """SELECT 'found' AS kind, count(*) AS n, min(fold_id) AS least, max(fold_id) AS most FROM folds WHERE fold_id IN (SELECT DISTINCT user_id FROM events)
UNION ALL SELECT 'missing', count(*), min(user_id), max(user_id) FROM (SELECT DISTINCT user_id FROM events) WHERE user_id NOT IN (SELECT fold_id FROM folds)""")
def looked_up(s: SparkSession, d: str) -> DataFrame:
    found, missing = report.lookup(s.read.parquet(f"{d}/events.parquet").select(F.col("user_id").cast("long").alias("fold_id")), fr.fold_table(s, d), "fold_id")
    count = lambda df, kind: df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.min("fold_id").alias("least"), F.max("fold_id").alias("most"))
    return count(found, "found").unionByName(count(missing, "missing"))


query("paired_folds", "SELECT a.entity, count(*) AS n, round(avg(a.val_vol - b.val_vol), 6) AS mean_delta, round(stddev_samp(a.val_vol - b.val_vol), 6) AS std FROM folds a JOIN folds b ON a.entity = b.entity AND a.fold_id % 2 = 0 AND b.fold_id % 2 = 1 GROUP BY a.entity")(
    lambda s, d: (lambda f: f.where("fold_id % 2 = 0").select("entity", F.col("val_vol").alias("a")).join(f.where("fold_id % 2 = 1").select("entity", F.col("val_vol").alias("b")), "entity").groupBy("entity").agg(F.count("*").alias("n"), F.avg(F.col("a") - F.col("b")).alias("mean_delta"), F.stddev_samp(F.col("a") - F.col("b")).alias("std")))(fr.fold_table(s, d))
)
query("first_evaluations", """SELECT fold_id, "interval", round(t, 6) AS t, seq FROM (SELECT *, thr + seq * 0.00002 AS t FROM evals, (SELECT unnest(range(0, 4)) AS seq)) QUALIFY row_number() OVER (PARTITION BY fold_id, "interval", round_even(t, 4) ORDER BY seq) = 1""")(
    lambda s, d: report.first_evaluations(fr.evals(s, d).select("fold_id", "interval", "thr", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("seq")).withColumn("t", F.col("thr") + F.col("seq") * 0.00002), fr.CASE, "t", "seq").select("fold_id", "interval", "t", "seq")
)
query("unique_seeds", 'SELECT "interval", thr, round(f0, 6) AS f0 FROM (SELECT "interval", thr, min(f0) AS f0 FROM evals GROUP BY ALL) ORDER BY round(f0, 9), "interval", thr LIMIT 7', digits=7)(lambda s, d: report.unique_seeds(fr.evals(s, d), ["interval", "thr"], "f0", 7))
query("running_best", 'SELECT fold_id, "interval", thr, round(best, 6) AS best_so_far, f0 <= best AS is_best_so_far, f0 = min(f0) OVER (PARTITION BY fold_id, "interval") AS is_best FROM (SELECT *, min(f0) OVER (PARTITION BY fold_id, "interval" ORDER BY thr ROWS UNBOUNDED PRECEDING) AS best FROM evals)', digits=7)(
    lambda s, d: report.running_best(fr.evals(s, d), fr.CASE, "thr", "f0").select("fold_id", "interval", "thr", "best_so_far", "is_best_so_far", "is_best")
)
query("sample_per_entity", "SELECT entity, ts, round(r, 6) AS r FROM rets QUALIFY row_number() OVER (PARTITION BY entity ORDER BY md5(strftime(ts, '%Y-%m-%d') || '|42'), ts) <= 50")(
    lambda s, d: report.sample_per_key(fr.rets(s, d), ["entity"], F.date_format("ts", "yyyy-MM-dd"), 50).select("entity", "ts", "r")
)
query("category_order", "SELECT regime, n, CASE regime WHEN 'bull' THEN 1 WHEN 'sideways' THEN 2 WHEN 'bear' THEN 3 ELSE 4 END AS place FROM (SELECT regime, count(*) AS n FROM tagged GROUP BY regime)")(
    lambda s, d: report.in_order(indicators.regime(fr.labelled(s, d)).groupBy("regime").agg(F.count("*").alias("n")), "regime", ["bull", "sideways", "bear"]).withColumn("place", F.col("place").cast("int"))
)
query("flagged_knees", """SELECT fold_id, "interval", thr FROM ranged QUALIFY row_number() OVER (PARTITION BY fold_id, "interval" ORDER BY (fold_id % 3 = 0 AND thr = 0.1)::INT DESC, round(sqrt(s0 * s0 + s1 * s1), 9), thr) = 1""")(
    lambda s, d: report.flagged_knees(fr.fronts(s, d).withColumn("is_knee", F.when(F.col("thr") == 0.1, F.col("fold_id") % 3 == 0)), fr.CASE, "is_knee", ["thr"]).select("fold_id", "interval", "thr")
)
query("union_front", """SELECT fold_id, "interval", thr, round(f0, 6) AS f0, round(f1, 6) AS f1 FROM stacked a WHERE NOT EXISTS (SELECT 1 FROM stacked b WHERE a.fold_id = b.fold_id AND a."interval" = b."interval" AND b.f0 <= a.f0 AND b.f1 <= a.f1 AND (b.f0 < a.f0 OR b.f1 < a.f1))""", digits=7)(
    lambda s, d: (lambda e: pareto.front(pareto.front(e.where("thr < 0.15"), fr.CASE).unionByName(pareto.front(e.where("thr > 0.07"), fr.CASE)).distinct(), fr.CASE).select("fold_id", "interval", "thr", "f0", "f1"))(files.stored(fr.evals(s, d).select(*fr.CASE, "thr", "f0", "f1"), "evals"))
)
query("seed_picks", """SELECT fold_id, "interval", thr, 'f0' AS pick FROM front QUALIFY row_number() OVER (PARTITION BY fold_id, "interval" ORDER BY f0, f1, thr) = 1
UNION ALL SELECT fold_id, "interval", thr, 'f1' FROM front QUALIFY row_number() OVER (PARTITION BY fold_id, "interval" ORDER BY f1, f0, thr) = 1
UNION ALL SELECT fold_id, "interval", thr, 'knee' FROM knees
UNION ALL SELECT fold_id, "interval", thr, 'medoid' FROM (SELECT a.fold_id, a."interval", a.thr, sum(sqrt((a.f0 - b.f0) * (a.f0 - b.f0) + (a.f1 - b.f1) * (a.f1 - b.f1))) AS far FROM front a JOIN front b ON a.fold_id = b.fold_id AND a."interval" = b."interval" GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY fold_id, "interval" ORDER BY round(far, 9), thr) = 1""")(
    lambda s, d: report.seed_picks(files.stored(fr.fronts(s, d), "fronts"), fr.CASE, ["thr"])
)
query("marker_sizes", """SELECT fold_id, "interval", thr, round(CASE WHEN max(turnover) OVER w > min(turnover) OVER w THEN 20 + 100 * (turnover - min(turnover) OVER w) / (max(turnover) OVER w - min(turnover) OVER w) ELSE 70 END, 6) AS size FROM evals WINDOW w AS (PARTITION BY fold_id, "interval")""")(
    lambda s, d: report.marker_sizes(fr.evals(s, d), fr.CASE, "turnover").select("fold_id", "interval", "thr", "size")
)
query("drawdown_kinds", " UNION ALL ".join(
    f"SELECT entity, '{kind}' AS kind, round(max((p - c) / (p + 2.220446049250313e-16)), 6) AS mdd FROM (SELECT *, max(c) OVER (PARTITION BY entity ORDER BY ts) AS p FROM (SELECT entity, ts, {c} AS c FROM rets)) GROUP BY entity"
    for kind, c in (("price", "close"), ("simple", "exp(sum(ln(1 + r)) OVER (PARTITION BY entity ORDER BY ts))"), ("log", "exp(sum(r) OVER (PARTITION BY entity ORDER BY ts))"), ("auto", "exp(sum(CASE WHEN least_r <= -1 THEN r ELSE ln(1 + greatest(r, -0.999999999999)) END) OVER (PARTITION BY entity ORDER BY ts))"))
).replace("THEN r ELSE ln(1 + greatest(r, -0.999999999999)) END) OVER (PARTITION BY entity ORDER BY ts)) AS c FROM rets", "THEN r ELSE ln(1 + greatest(r, -0.999999999999)) END) OVER (PARTITION BY entity ORDER BY ts)) AS c FROM (SELECT *, min(r) OVER (PARTITION BY entity) AS least_r FROM rets)").replace("ln(1 + r)", "ln(1 + greatest(r, -0.999999999999))"))(
    lambda s, d: (lambda x: report.drawdowns(x, "close", "price").withColumn("kind", F.lit("price")).unionByName(report.drawdowns(x, "r", "simple").withColumn("kind", F.lit("simple"))).unionByName(report.drawdowns(x, "r", "log").withColumn("kind", F.lit("log"))).unionByName(report.drawdowns(x, "r", "auto").withColumn("kind", F.lit("auto"))))(fr.rets(s, d))
)
query("arch_lm", "SELECT entity, round(count(*) * corr(x, y) * corr(x, y), 6) AS lm, count(*) AS n FROM (SELECT entity, e * e AS y, lag(e * e) OVER (PARTITION BY entity ORDER BY ts) AS x FROM (SELECT *, r - avg(r) OVER (PARTITION BY entity) AS e FROM rets)) WHERE x IS NOT NULL GROUP BY entity")(lambda s, d: report.arch_lm(fr.rets(s, d)))
query("yeo_johnson_lambda", """SELECT round(max_by(lam, llf), 6) AS lam, round(max(llf), 4) AS llf FROM (SELECT lam, (lam - 1) * sum(sign(r) * ln(1 + abs(r))) - count(*) / 2 * ln(var_pop(CASE WHEN r >= 0 AND lam <> 0 THEN (pow(r + 1, lam) - 1) / lam WHEN r >= 0 THEN ln(1 + r) WHEN lam <> 2 THEN -(pow(1 - r, 2 - lam) - 1) / (2 - lam) ELSE -ln(1 - r) END)) AS llf
FROM rets, (SELECT unnest(range(-20, 21)) / 10 AS lam) GROUP BY lam)""")(lambda s, d: report.yeo_johnson_fit(fr.rets(s, d), "r").withColumn("llf", F.round("llf", 4)))
query("power_column", """SELECT entity, ts, round(CASE WHEN lam = 0 THEN ln(close) ELSE (pow(close, lam) - 1) / lam END, 6) AS transformed_close FROM panel, (SELECT max_by(lam, llf) AS lam FROM (
  SELECT lam, (lam - 1) * sum(ln(close)) - count(*) / 2 * ln(var_pop(CASE WHEN lam = 0 THEN ln(close) ELSE (pow(close, lam) - 1) / lam END)) AS llf FROM panel, (SELECT unnest(range(-20, 21)) / 10 AS lam) GROUP BY lam))""")(
    lambda s, d: (lambda p: report.power_column(p, "close", clean.power_transform(p, "close")).select("entity", "ts", "transformed_close"))(fr.panel(s, d))
)
query("rolling_turnover", 'SELECT fold_id, "interval", thr, off, CASE WHEN count(turnover) OVER w = 21 THEN round(avg(turnover) OVER w * 12, 6) END AS rolling_turnover FROM trace WINDOW w AS (PARTITION BY fold_id, "interval", thr ORDER BY off ROWS 20 PRECEDING)')(
    lambda s, d: report.rolling_turnover(fr.trace(s, d), ["fold_id", "interval", "thr"], annual=True).select("fold_id", "interval", "thr", "off", "rolling_turnover")
)
@query("sensitivity_intervals", """SELECT "interval", thr_mult, cost_mult, count(*) AS n, round(avg(sharpe), 6) AS mean_sharpe, round(avg(mdd), 6) AS mean_mdd, round(avg(turnover), 6) AS mean_turnover FROM (
  SELECT fold_id, "interval", thr_mult, cost_mult, CASE WHEN coalesce(stddev_samp(net), 0) = 0 THEN 0 ELSE avg(net) / stddev_samp(net) * sqrt(252) END AS sharpe, max((p - c) / (p + 2.220446049250313e-16)) AS mdd, sum(turnover) AS turnover FROM (
    SELECT *, max(c) OVER g AS p FROM (SELECT *, exp(sum(net) OVER g) AS c FROM (SELECT *, ln(1 + greatest((exp(r) - 1) * pos - 0.0007 * cost_mult * turnover, -0.9999)) AS net FROM (
      SELECT *, abs(pos - coalesce(lag(pos) OVER g, 0)) AS turnover FROM (
        SELECT fold_id, "interval", off, r, thr_mult, cost_mult, CASE WHEN still THEN 0 ELSE least(greatest(mu / (vol + 1e-8) / (0.1 * thr_mult + 1e-8), -1), 1) END AS pos FROM forecasts, (SELECT unnest([0.8, 1, 1.2]::DOUBLE[]) AS thr_mult), (SELECT unnest([0.5, 1, 1.5]::DOUBLE[]) AS cost_mult))
      WINDOW g AS (PARTITION BY fold_id, "interval", thr_mult, cost_mult ORDER BY off))) WINDOW g AS (PARTITION BY fold_id, "interval", thr_mult, cost_mult ORDER BY off)) WINDOW g AS (PARTITION BY fold_id, "interval", thr_mult, cost_mult ORDER BY off)) GROUP BY ALL) GROUP BY ALL""")
def sensitivity(s: SparkSession, d: str) -> DataFrame:
    grid = lambda xs: F.explode(F.array(*map(F.lit, xs)))
    runs = fr.forecasts(s, d).select("*", grid([0.8, 1.0, 1.2]).alias("thr_mult")).select("*", grid([0.5, 1.0, 1.5]).alias("cost_mult"))
    keys = ["fold_id", "interval", "thr_mult", "cost_mult"]
    trace = backtest.pnl(report.scaled_position(runs, 0.1 * F.col("thr_mult")), keys, cost_multiple=F.col("cost_mult"))
    by = backtest.backtests(trace, keys)
    return by.groupBy("interval", "thr_mult", "cost_mult").agg(F.count("*").alias("n"), F.avg("sharpe").alias("mean_sharpe"), F.avg("mdd").alias("mean_mdd"), F.avg("turnover").alias("mean_turnover"))


query("warm_start_windows", """SELECT fold_id, off, round(s, 6) AS total, n FROM (SELECT fold_id, split, off, sum(r) OVER w AS s, count(*) OVER w AS n FROM fold_rows WINDOW w AS (PARTITION BY fold_id ORDER BY off ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)) WHERE split = 'val'""")(
    lambda s, d: (lambda x, w: x.select("fold_id", "off", "split", F.collect_list("r").over(w).alias("block")).where("split = 'val'").select("fold_id", "off", F.aggregate("block", F.lit(0.0), lambda a, v: a + v).alias("total"), F.size("block").cast("long").alias("n")))(fr.fold_rows(s, d), series("fold_id", order="off").rowsBetween(-10, -1))
)
query("outlier_default", "SELECT entity, ts, " + ", ".join(f"round(CASE WHEN {c} > avg({c}) OVER w + 8 * stddev_samp({c}) OVER w OR {c} < avg({c}) OVER w - 8 * stddev_samp({c}) OVER w OR {c} < 1 THEN avg({c}) OVER w ELSE {c} END, 6) AS {c}" for c in ("close", "volume")) + " FROM panel WINDOW w AS (PARTITION BY entity ORDER BY ts ROWS 29 PRECEDING)", digits=7)(
    lambda s, d: clean.replace_outliers(fr.panel(s, d).select("entity", "ts", "close", "volume"), ["close", "volume"])
)
query("hysteresis_intervals", """WITH b AS (SELECT fold_id, "interval", block, off, round(mu, 9) AS r FROM forecasts), q AS (SELECT fold_id, "interval", block, quantile_cont(r, 0.7) AS up, quantile_cont(r, 0.65) AS down, quantile_cont(r, 0.5) AS mid FROM b GROUP BY ALL),
m AS (SELECT fold_id, "interval", block, quantile_cont(abs(r - mid), 0.5) AS mad FROM b JOIN q USING (fold_id, "interval", block) GROUP BY ALL)
SELECT fold_id, "interval", off, coalesce(last_value(event IGNORE NULLS) OVER (PARTITION BY fold_id, "interval" ORDER BY off ROWS UNBOUNDED PRECEDING), 0)::DOUBLE AS pos FROM (
  SELECT fold_id, "interval", off, CASE WHEN r >= up AND abs(r - mid) >= 0.5 * mad THEN 1 WHEN r < down OR abs(r - mid) < 0.5 * mad THEN 0 END AS event FROM b JOIN q USING (fold_id, "interval", block) JOIN m USING (fold_id, "interval", block))""")(
    lambda s, d: backtest.hysteresis(fr.forecasts(s, d).withColumn("pred", F.round("mu", 9)), ["fold_id", "interval"], ["block"]).select("fold_id", "interval", "off", "pos")
)
_COMPLETE_META = "SELECT fold_id, round(volatility, 6) AS volatility, round(max_drawdown, 6) AS max_drawdown, date_min, date_max FROM (SELECT (row_number() OVER (ORDER BY fold_id) - 1)::BIGINT AS fold_id, volatility, max_drawdown, date_min, date_max FROM meta JOIN (SELECT fold_id FROM (SELECT fold_id, CASE WHEN ts < DATE '{day}' THEN NULL ELSE r END AS x FROM fold_rows) GROUP BY fold_id HAVING count(x) = count(*)) USING (fold_id))"


def _complete_meta(s: SparkSession, d: str, day: str) -> DataFrame:
    rows = fr.fold_rows(s, d).withColumn("x", F.when(F.col("ts") >= day, F.col("r")))
    return folds.meta_features(folds.complete_folds(rows, ["x", "close"])).select("fold_id", "volatility", "max_drawdown", "date_min", "date_max")


for _name, _day in (("complete_fold_meta", "1993-06-01"), ("complete_fold_meta_late", "1995-06-01")):
    query(_name, _COMPLETE_META.format(day=_day))(lambda s, d, day=_day: _complete_meta(s, d, day))


@query("fold_slice", "SELECT fold_id, count(*) AS n, round(sum(r), 6) AS total FROM fold_rows WHERE split = 'val' GROUP BY fold_id")
def fold_slice(s: SparkSession, d: str) -> DataFrame:
    """The validation slice of a table kept in folders by part: the other folder isn't read."""
    fr.fold_rows(s, d).select("fold_id", "off", "r", "split").write.partitionBy("split").parquet(path := files.folder(s, "fold-table"))
    return files.fold_slice(s, path, "val", "fold_id long, off int, r double, split string").groupBy("fold_id").agg(F.count("*").alias("n"), F.sum("r").alias("total"))


@query("fold_files", "SELECT fold_id, entity, round(val_vol, 6) AS val_vol FROM folds")
def fold_files(s: SparkSession, d: str) -> DataFrame:
    """One file or more for each fold, whose id is in the file's place only, beside one that can't be read."""
    path = files.folder(s, "fold-files")
    fr.fold_table(s, d).select("entity", "val_vol", F.concat(F.lit("meta_fold_"), "fold_id").alias("name")).repartition(4, "name").write.partitionBy("name").parquet(path)
    panels.bars(s, d).groupBy().agg(F.count("*").cast("string")).write.mode("append").text(path)
    return files.by_file_id(s, path, "entity string, val_vol double", r"fold_(\d+)").select("fold_id", "entity", "val_vol")


@query("locked_features", """SELECT nth::INT AS nth, name, count(x) AS n, round(avg(x), 6) AS mean, round(max(x), 6) AS most FROM (
  SELECT 1 AS nth, 'close' AS name, close AS x FROM rets UNION ALL SELECT 2, 'volume', volume FROM rets UNION ALL SELECT 3, 'r', r FROM rets) GROUP BY nth, name""", digits=6)
def locked_features(s: SparkSession, d: str) -> DataFrame:
    """The numeric columns of the panel in a fixed order, a copy of one of them left out, with their marks."""
    x = files.stored(fr.rets(s, d).select("entity", "ts", "r", "volume", "close", F.col("close").alias("close_copy")), "wide")
    names = clean.feature_columns(clean.without_twins(x, "close", "close_copy"), locked=["close", "volume", "close_copy", "r"])
    each = F.posexplode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in names]))
    long = x.select(each.alias("nth", "f")).select((F.col("nth") + 1).alias("nth"), "f.name", "f.x")
    return long.groupBy("nth", "name").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.max("x").alias("most"))
