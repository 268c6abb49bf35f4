"""DuckDB SQL for the registered queries: common tables by name, put before a query as far as it names them."""

from __future__ import annotations

import re

TABLES: dict[str, str] = {
    "bars": """SELECT l_returnflag || l_linestatus AS entity, l_shipdate::DATE AS ts,
  min_by(l_extendedprice / l_quantity, {'a': l_orderkey, 'b': l_linenumber, 'c': l_extendedprice / l_quantity}) AS open,
  max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
  max_by(l_extendedprice / l_quantity, {'a': l_orderkey, 'b': l_linenumber, 'c': l_extendedprice / l_quantity}) AS close,
  max_by(l_extendedprice / l_quantity, {'a': l_orderkey, 'b': l_linenumber, 'c': l_extendedprice / l_quantity}) AS adj_close,
  sum(l_quantity) AS volume FROM lineitem GROUP BY ALL""",
    "aligned": "SELECT * FROM (SELECT DISTINCT entity FROM bars) CROSS JOIN (SELECT DISTINCT ts FROM bars) LEFT JOIN bars USING (entity, ts)",
    "filled": """SELECT entity, ts, last_value(open IGNORE NULLS) OVER w AS open, last_value(high IGNORE NULLS) OVER w AS high, last_value(low IGNORE NULLS) OVER w AS low,
  last_value(close IGNORE NULLS) OVER w AS close, last_value(adj_close IGNORE NULLS) OVER w AS adj_close, coalesce(volume, 0) AS volume
FROM aligned WINDOW w AS (PARTITION BY entity ORDER BY ts ROWS UNBOUNDED PRECEDING)""",
    "panel": "SELECT * FROM filled WHERE open IS NOT NULL AND close IS NOT NULL",
    "rets": "SELECT * FROM (SELECT *, ln(close / lag(close) OVER (PARTITION BY entity ORDER BY ts)) AS r FROM panel) WHERE r IS NOT NULL",
    "nexts": "SELECT * FROM (SELECT *, lead(r) OVER (PARTITION BY entity ORDER BY ts) AS next FROM rets) WHERE next IS NOT NULL",
    "labelled": "SELECT nexts.*, thr, (next > thr)::INT AS target FROM nexts, (SELECT quantile_cont(next, 0.7) AS thr FROM nexts)",
    "tagged": """SELECT *, CASE WHEN (m20 - m50) / m50 > 0.002 THEN 'bull' WHEN (m20 - m50) / m50 < -0.002 THEN 'bear' ELSE 'sideways' END AS regime FROM (
  SELECT *, CASE WHEN count(close) OVER a >= 5 THEN avg(close) OVER a END AS m20, CASE WHEN count(close) OVER b >= 10 THEN avg(close) OVER b END AS m50
  FROM labelled WINDOW a AS (PARTITION BY entity ORDER BY ts ROWS 19 PRECEDING), b AS (PARTITION BY entity ORDER BY ts ROWS 49 PRECEDING))""",
    "numbered": "SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ts) - 1 AS i FROM tagged",
    "fold_counts": "SELECT entity, n, sum(n) OVER (ORDER BY entity) - n AS before FROM (SELECT entity, greatest(floor((count(*) - 294) / 21) + 1, 0)::BIGINT AS n FROM tagged GROUP BY entity)",
    "fold_rows": """SELECT (before + k)::BIGINT AS fold_id, t.*, (i - 21 * k)::INT AS off, CASE WHEN i - 21 * k < 252 THEN 'train' ELSE 'val' END AS split
FROM numbered t JOIN (SELECT entity, before, unnest(range(0, n)) AS k FROM fold_counts) f ON t.entity = f.entity AND t.i BETWEEN 21 * k AND 21 * k + 293""",
    "folds": """SELECT fold_id, entity, min(ts) FILTER (split = 'train') AS train_start, max(ts) FILTER (split = 'train') AS train_end, min(ts) FILTER (split = 'val') AS val_start,
  max(ts) FILTER (split = 'val') AS val_end, avg(target) FILTER (split = 'val') AS val_pos_ratio, stddev_samp(r) FILTER (split = 'val') AS val_vol FROM fold_rows GROUP BY ALL""",
    "qc": "SELECT fold_id, entity, round(val_pos_ratio, 9) AS ratio, round(val_vol, 9) AS vol FROM folds",
    "limits": """SELECT entity, CASE WHEN count(*) >= 20 THEN greatest(quantile_cont(ratio, 0.1) - 0.02, 0.05) ELSE 0.05 END AS low,
  CASE WHEN count(*) >= 20 THEN least(quantile_cont(ratio, 0.9) + 0.02, 0.95) ELSE 0.95 END AS high, CASE WHEN count(*) >= 20 THEN greatest(quantile_cont(vol, 0.1), 0.001) ELSE 0.001 END AS least_vol FROM qc GROUP BY entity""",
    "ruled": """SELECT q.*, low, high, least_vol, ratio BETWEEN low AND high AND coalesce(vol, '-inf'::DOUBLE) >= least_vol AS rule_ok,
  NOT ratio BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS outlier
FROM qc q JOIN limits USING (entity) JOIN (SELECT entity, quantile_cont(ratio, 0.25) AS q1, quantile_cont(ratio, 0.75) AS q3 FROM qc GROUP BY entity) USING (entity)""",
    "restored": """SELECT * EXCLUDE (have, far, nth), rule_ok AND NOT outlier OR rule_ok AND nth <= 5 - have AS kept FROM (
  SELECT *, row_number() OVER (PARTITION BY entity, rule_ok ORDER BY far, fold_id) AS nth FROM (
    SELECT r.*, sum((rule_ok AND NOT outlier)::INT) OVER (PARTITION BY entity) AS have, 0.7 * abs(ratio - 0.5) / 0.5 + 0.3 * coalesce(abs(vol - mid) / abs(mid), 1) AS far
    FROM ruled r JOIN (SELECT entity, quantile_cont(vol, 0.5) AS mid FROM qc GROUP BY entity) USING (entity)))""",
    "history": """SELECT *, count(x) OVER p AS h_n, sum(x) OVER p AS h_x, sum(y) OVER p AS h_y, sum(x * y) OVER p AS h_xy, sum(x * x) OVER p AS h_xx, stddev_samp(r) OVER p AS h_vol, x AS h_last
FROM (SELECT *, lag(r) OVER w AS x, CASE WHEN lag(r) OVER w IS NOT NULL THEN r END AS y FROM fold_rows WINDOW w AS (PARTITION BY fold_id ORDER BY off))
WINDOW p AS (PARTITION BY fold_id ORDER BY off ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "heads": "SELECT *, floor((off - 252) / interval_)::BIGINT AS block FROM history, (SELECT unnest([10, 20, 42]) AS interval_) WHERE split = 'val'",
    "forecasts": """SELECT v.fold_id, v.entity, v.ts, v.off, v.interval_ AS "interval", v.block, v.r, m + pow(phi, v.off - 252 - v.block * v.interval_ + 1) * (last - m) AS mu, vol,
  stddev_pop(v.r) OVER (PARTITION BY v.fold_id, v.interval_, v.block) < 0.0015 AS still
FROM heads v JOIN (SELECT *, (h_y - phi * h_x) / h_n / (1 - phi) AS m FROM (
  SELECT fold_id, interval_, block, h_n, h_x, h_y, h_last AS last, h_vol AS vol, (h_n * h_xy - h_x * h_y) / (h_n * h_xx - h_x * h_x) AS phi FROM heads WHERE off - 252 = block * interval_)) h
ON v.fold_id = h.fold_id AND v.interval_ = h.interval_ AND v.block = h.block""",
    "placed": """SELECT f.*, thr, CASE WHEN still THEN 0 ELSE least(greatest(mu / (vol + 1e-8) / (thr + 1e-8), -1), 1) END AS pos FROM forecasts f, (SELECT unnest([0.02, 0.05, 0.1, 0.2, 0.4]::DOUBLE[]) AS thr)""",
    "trace": """SELECT *, ln(1 + greatest((exp(r) - 1) * pos - 0.0007 * turnover, -0.9999)) AS net FROM (
  SELECT *, abs(pos - coalesce(lag(pos) OVER (PARTITION BY fold_id, "interval", thr ORDER BY off), 0)) AS turnover FROM placed)""",
    "curve": """SELECT *, max(c) OVER (PARTITION BY fold_id, "interval", thr ORDER BY off) AS p FROM (SELECT *, exp(sum(net) OVER (PARTITION BY fold_id, "interval", thr ORDER BY off)) AS c FROM trace)""",
    "tests": """SELECT fold_id, entity, "interval", thr, CASE WHEN coalesce(stddev_samp(net), 0) = 0 THEN 0 ELSE avg(net) / stddev_samp(net) * sqrt(252) END AS sharpe, max((p - c) / (p + 2.220446049250313e-16)) AS mdd,
  avg(net) * 252 AS ann_return, stddev_samp(net) * sqrt(252) AS ann_vol, count(*) AS n_points, sum(turnover) AS turnover, count(*) FILTER (turnover > 1e-6) AS rebalances, sum(turnover) / 2 AS round_turns FROM curve GROUP BY ALL""",
    "evals": """SELECT *, round(-sharpe + penalty, 7) AS f0, round(mdd + penalty, 7) AS f1 FROM (SELECT *, 10 * greatest(thr - 0.3, 0.03 - thr, 0) + CASE WHEN rebalances = 0 THEN 0.5 ELSE 0 END AS penalty FROM tests)""",
    "front": """SELECT * FROM evals a WHERE NOT EXISTS (SELECT 1 FROM evals b WHERE a.fold_id = b.fold_id AND a."interval" = b."interval" AND b.f0 <= a.f0 AND b.f1 <= a.f1 AND (b.f0 < a.f0 OR b.f1 < a.f1))""",
    "ranged": """SELECT *, CASE WHEN max(f0) OVER w > min(f0) OVER w THEN (f0 - min(f0) OVER w) / (max(f0) OVER w - min(f0) OVER w) ELSE 0 END AS s0,
  CASE WHEN max(f1) OVER w > min(f1) OVER w THEN (f1 - min(f1) OVER w) / (max(f1) OVER w - min(f1) OVER w) ELSE 0 END AS s1 FROM front WINDOW w AS (PARTITION BY fold_id, "interval")""",
    "knees": """SELECT * FROM ranged QUALIFY row_number() OVER (PARTITION BY fold_id, "interval" ORDER BY round(sqrt(s0 * s0 + s1 * s1), 9), thr) = 1""",
    "refs": """SELECT fold_id, "interval", max(f0) * 1.1 + 1e-6 AS ref0, max(f1) * 1.1 + 1e-6 AS ref1 FROM evals GROUP BY ALL""",
    "stages": """SELECT *, 'GA' AS stage FROM front WHERE thr < 0.15 UNION ALL SELECT *, 'GA+BO' AS stage FROM front""",
    "inside": """SELECT DISTINCT fold_id, "interval", stage, f0, f1, ref0, ref1 FROM stages JOIN refs USING (fold_id, "interval") WHERE f0 < ref0 AND f1 < ref1""",
    "volumes": """SELECT fold_id, "interval", stage, sum((ref0 - f0) * (prior - f1)) AS hv, count(*) AS n_front FROM (
  SELECT *, coalesce(lag(f1) OVER (PARTITION BY fold_id, "interval", stage ORDER BY f0, f1), ref1) AS prior FROM inside) GROUP BY ALL""",
    "hv": """SELECT fold_id, "interval", stage, coalesce(hv, 0) AS hv, coalesce(n_front, 0)::BIGINT AS n_front FROM (SELECT fold_id, "interval", stage FROM refs, (SELECT unnest(['GA', 'GA+BO']) AS stage)) LEFT JOIN volumes USING (fold_id, "interval", stage)""",
    "gains": """SELECT fold_id, "interval", max(hv) FILTER (stage = 'GA') AS hv_before, max(hv) FILTER (stage = 'GA+BO') AS hv_after, max(hv) FILTER (stage = 'GA+BO') - max(hv) FILTER (stage = 'GA') AS gain FROM hv GROUP BY ALL""",
    "meta": """SELECT fold_id, entity, avg(target) AS positive_ratio, stddev_samp(r) AS volatility, coalesce(stddev_samp(r) FILTER (r < 0), 0) AS downside_volatility, -min(close / peak - 1) AS max_drawdown,
  skewness(r) AS skewness, kurtosis(r) AS kurtosis, abs(corr(x, close)) * sqrt((count(*) - 1) / count(*)) AS trend_strength, coalesce(corr(r, l1), 0) AS acf_lag_1, coalesce(corr(r, l5), 0) AS acf_lag_5, coalesce(corr(r, l21), 0) AS acf_lag_21,
  avg((regime = 'bull')::INT) AS bull_ratio, avg((regime = 'bear')::INT) AS bear_ratio, avg((regime = 'sideways')::INT) AS sideways_ratio, min(ts) AS date_min, max(ts) AS date_max, list_sort(list(ts)) AS date_list
FROM (SELECT *, max(close) OVER w AS peak, row_number() OVER w AS x, lag(r, 1) OVER w AS l1, lag(r, 5) OVER w AS l5, lag(r, 21) OVER w AS l21 FROM fold_rows WHERE split = 'val' WINDOW w AS (PARTITION BY fold_id ORDER BY off)) GROUP BY ALL""",
    "traits": """SELECT fold_id, entity, f AS feature, coalesce((v - avg(v) OVER w) / nullif(stddev_samp(v) OVER w, 0), 0) AS z FROM (
  UNPIVOT (SELECT fold_id, entity, volatility, downside_volatility, max_drawdown, skewness, kurtosis, trend_strength, acf_lag_1, acf_lag_5, acf_lag_21 FROM meta) ON COLUMNS(* EXCLUDE (fold_id, entity)) INTO NAME f VALUE v) WINDOW w AS (PARTITION BY f)""",
    "norms": "SELECT fold_id, entity, sqrt(sum(z * z)) AS norm FROM traits GROUP BY ALL",
    "pairs": """SELECT a.fold_id AS i, b.fold_id AS j, greatest(least(sum(a.z * b.z) / any_value(p.norm) / any_value(q.norm), 1), 0) AS sim, any_value(a.entity = b.entity) AS same_entity
FROM traits a JOIN traits b ON a.feature = b.feature AND a.fold_id < b.fold_id JOIN norms p ON p.fold_id = a.fold_id JOIN norms q ON q.fold_id = b.fold_id GROUP BY ALL""",
    "days": "SELECT fold_id, unnest(date_list) AS d FROM meta",
    "day_overlaps": "SELECT a.fold_id AS i, b.fold_id AS j, count(*) AS c FROM days a JOIN days b ON a.d = b.d AND a.fold_id < b.fold_id GROUP BY ALL",
    "penalised": """SELECT i, j, sim, coalesce(c / (84 - c), 0) AS overlap, same_entity, 1 - least(greatest(sim - 0.9 * coalesce(c / (84 - c), 0) - 0.25 * same_entity::INT, 0), 1) AS dissim FROM pairs LEFT JOIN day_overlaps USING (i, j)""",
}

# Second-order forecasts: sums of lagged returns before each row, read where blocks begin, solved by Cramer's rule.
TABLES["history2"] = """SELECT *, count(y) OVER p AS n, sum(x1) OVER p AS s1, sum(x2) OVER p AS s2, sum(y) OVER p AS sy, sum(x1 * x1) OVER p AS s11, sum(x1 * x2) OVER p AS s12, sum(x2 * x2) OVER p AS s22,
  sum(x1 * y) OVER p AS s1y, sum(x2 * y) OVER p AS s2y, stddev_samp(r) OVER q AS h_vol FROM (
  SELECT *, CASE WHEN b IS NOT NULL THEN a END AS x1, b AS x2, CASE WHEN b IS NOT NULL THEN r END AS y FROM (SELECT *, lag(r) OVER w AS a, lag(r, 2) OVER w AS b FROM fold_rows WINDOW w AS (PARTITION BY fold_id ORDER BY off)))
WINDOW p AS (PARTITION BY fold_id ORDER BY off ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), q AS (PARTITION BY fold_id ORDER BY off ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
TABLES["solved2"] = """SELECT fold_id, interval_, block, x1 AS last1, x2 AS last2, h_vol, f1, f2, (sy - f1 * s1 - f2 * s2) / n AS f0 FROM (
  SELECT *, (c1y * c22 - c2y * c12) / (c11 * c22 - c12 * c12) AS f1, (c2y * c11 - c1y * c12) / (c11 * c22 - c12 * c12) AS f2 FROM (
    SELECT *, s11 - s1 * s1 / n AS c11, s12 - s1 * s2 / n AS c12, s22 - s2 * s2 / n AS c22, s1y - s1 * sy / n AS c1y, s2y - s2 * sy / n AS c2y FROM (
      SELECT h.*, interval_, floor((off - 252) / interval_)::BIGINT AS block FROM history2 h, (SELECT unnest([10, 20, 42]) AS interval_) WHERE split = 'val') WHERE off - 252 = block * interval_))"""
TABLES["ahead2"] = """SELECT fold_id, interval_, block, 0 AS h, last1 AS mu, last2 AS prior, h_vol, f0, f1, f2 FROM solved2
  UNION ALL SELECT fold_id, interval_, block, h + 1, f0 + f1 * mu + f2 * prior, mu, h_vol, f0, f1, f2 FROM ahead2 WHERE h < interval_"""
TABLES["forecasts2"] = """SELECT v.fold_id, v.entity, v."interval", v.off, v.block, v.r, a.mu, a.h_vol AS vol, v.still FROM forecasts v
  JOIN ahead2 a ON a.fold_id = v.fold_id AND a.interval_ = v."interval" AND a.block = v.block AND a.h = v.off - 252 - v.block * v."interval" + 1"""
TABLES["orders"] = """SELECT fold_id, entity, "interval", 1 AS ar, off, block, r, mu, vol, still FROM forecasts UNION ALL SELECT fold_id, entity, "interval", 2, off, block, r, mu, vol, still FROM forecasts2"""
TABLES["winners"] = """SELECT fold_id, ar AS p0 FROM (SELECT fold_id, ar, round(sqrt(avg((r - mu) * (r - mu))), 12) AS rmse FROM orders WHERE "interval" = 42 GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY fold_id ORDER BY rmse, ar) = 1"""


def _chance(name: str) -> str:
    """A draw from the digest of its keys, as the operator makes it."""
    return f"""(('0x' || md5(concat_ws('|', fold_id, "interval", k, '{name}', 42))[1:8])::BIGINT / 4294967296.0)"""


# Drawn orders and thresholds, evaluated as the grid's are.
TABLES["samples"] = f"""SELECT fold_id, "interval", k, CASE WHEN k < 3 THEN 1 + floor(2 * {_chance("p")}) ELSE greatest(1, least(2, p0 + floor(3 * {_chance("p")}) - 1)) END::INT AS ar,
  round(0.01 + (0.6 - 0.01) * {_chance("thr")}, 6) AS thr FROM winners, (SELECT unnest([10, 20, 42]) AS "interval"), (SELECT unnest(range(0, 6)) AS k)"""
TABLES["swept_placed"] = """SELECT f.*, k, thr, CASE WHEN still THEN 0 ELSE least(greatest(mu / (vol + 1e-8) / (thr + 1e-8), -1), 1) END AS pos FROM orders f JOIN samples USING (fold_id, "interval", ar)"""
_K = 'PARTITION BY fold_id, "interval", k ORDER BY off'
TABLES["swept_trace"] = f"""SELECT *, ln(1 + greatest((exp(r) - 1) * pos - 0.0007 * turnover, -0.9999)) AS net FROM (SELECT *, abs(pos - coalesce(lag(pos) OVER ({_K}), 0)) AS turnover FROM swept_placed)"""
TABLES["swept_curve"] = f"""SELECT *, max(c) OVER ({_K}) AS p FROM (SELECT *, exp(sum(net) OVER ({_K})) AS c FROM swept_trace)"""
TABLES["swept_tests"] = TABLES["tests"].replace('"interval", thr,', '"interval", thr, k, ar,').replace("curve", "swept_curve")
TABLES["swept"] = TABLES["evals"].replace("FROM tests", "FROM swept_tests")
TABLES["swept_front"] = TABLES["front"].replace("evals", "swept")
TABLES["grown"] = """SELECT e.*, gen FROM evals e, (SELECT unnest(range(1, 6)) AS gen) WHERE list_position([0.02, 0.05, 0.1, 0.2, 0.4]::DOUBLE[], thr) <= gen"""
TABLES["small"] = "SELECT * FROM evals WHERE thr < 0.15"
TABLES["large"] = "SELECT * FROM evals WHERE thr > 0.07"
TABLES["stacked"] = f"""SELECT fold_id, "interval", thr, f0, f1 FROM ({TABLES["front"].replace("evals", "small")}) UNION SELECT fold_id, "interval", thr, f0, f1 FROM ({TABLES["front"].replace("evals", "large")})"""


def sql(body: str) -> str:
    """The query with the tables that it needs before it."""
    names, todo = set(), [body]
    while todo:
        text = todo.pop()
        for name in TABLES:
            if name not in names and re.search(rf"(?<![\w.'])(?<!AS ){name}(?![\w'(])", text):
                names.add(name)
                todo.append(TABLES[name])
    tables = ",\n".join(f"{n} AS {'' if n == 'ahead2' else 'MATERIALIZED '}({TABLES[n]})" for n in TABLES if n in names)
    own = body.removeprefix("WITH RECURSIVE " if body.startswith("WITH RECURSIVE ") else "WITH ")
    first = "WITH RECURSIVE " if body.startswith("WITH RECURSIVE ") or "ahead2" in names else "WITH "
    return f"{first}{tables}{', ' if own != body else ''}\n{own}" if names else body
