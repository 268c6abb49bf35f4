"""Queries of the choice of representative folds, with their SQL."""

from __future__ import annotations

from dataclasses import astuple

from pyspark.sql import DataFrame, SparkSession

from ..operators import facility, select
from ..sources import files
from . import frames as fr
from .registry import query
from .sql import TABLES

K = (11, 14)

TABLES["ways"] = """SELECT i, j, 1 - dissim AS sim, overlap FROM penalised UNION ALL SELECT j, i, 1 - dissim, overlap FROM penalised
UNION ALL SELECT fold_id, fold_id, 1.0, 0.0 FROM meta"""

#: A row for each step of the greedy choice; `chosen` grows by one fold.
_GREEDY = """WITH RECURSIVE steps AS (
  SELECT 0 AS nth, []::BIGINT[] AS chosen, 0.0::DOUBLE AS gain
  UNION ALL
  SELECT nth + 1, list_append(chosen, best.i), best.gain FROM (
    SELECT s.nth, s.chosen, arg_max({'i': w.i, 'gain': w.gain}, {'g': round(w.gain, 9), 'i': -w.i}) AS best FROM steps s, (
      SELECT w.i, sum(greatest(w.sim - coalesce(c.cover, 0), 0)) AS gain FROM ways w
      LEFT JOIN (SELECT x.j, max(x.sim) AS cover FROM ways x, steps y WHERE list_contains(y.chosen, x.i) GROUP BY x.j) c ON c.j = w.j
      WHERE w.i NOT IN (SELECT x.j FROM ways x, steps y WHERE list_contains(y.chosen, x.i) AND (x.overlap > 0.5 OR x.i = x.j))
        AND w.i NOT IN (SELECT m.fold_id FROM meta m, (SELECT t.entity FROM meta t, steps y WHERE list_contains(y.chosen, t.fold_id) GROUP BY t.entity HAVING count(*) >= 3) f WHERE m.entity = f.entity)
      GROUP BY w.i) w WHERE s.nth < 14 GROUP BY s.nth, s.chosen) WHERE best IS NOT NULL)"""

_PICKS = _GREEDY + """, picks AS (
  SELECT nth, chosen[-1] AS fold_id, entity, gain, sum(gain) OVER (ORDER BY nth) / (SELECT count(*) FROM meta) AS coverage FROM steps JOIN meta ON fold_id = chosen[-1])"""

_STATS = """, sizes AS (SELECT unnest([11, 14]) AS k),
  cover AS (SELECT k, j, max(sim) AS cover FROM sizes, ways w JOIN picks p ON p.fold_id = w.i WHERE nth <= k GROUP BY ALL),
  apart AS (SELECT k, avg(1 - sim) AS diversity FROM sizes, ways w JOIN picks p ON p.fold_id = w.i JOIN picks q ON q.fold_id = w.j WHERE p.nth < q.nth AND q.nth <= k GROUP BY k)
SELECT k, (SELECT count(*)::INT FROM picks WHERE nth <= k) AS selected, round(avg(cover), 6) AS mean, round(min(cover), 6) AS least, round(quantile_cont(cover, 0.05), 6) AS p05, round(quantile_cont(cover, 0.25), 6) AS p25,
  round(quantile_cont(cover, 0.5), 6) AS p50, round(quantile_cont(cover, 0.95), 6) AS p95, round(any_value(diversity), 6) AS diversity FROM cover JOIN apart USING (k) GROUP BY k"""

_SWAP = """, mine AS (SELECT fold_id AS out, entity FROM picks WHERE nth <= 11),
  tops AS (SELECT j, max(sim) AS s1, arg_max(i, {'s': sim, 'i': -i}) AS top FROM ways JOIN mine ON i = out GROUP BY j),
  seconds AS (SELECT t.j, s1, top, coalesce(max(sim), 0) AS s2 FROM tops t LEFT JOIN (ways JOIN mine ON i = out) w ON w.j = t.j AND w.i <> t.top GROUP BY ALL),
  swap_gains AS (SELECT m.out, w.i AS "into", sum(greatest(w.sim, CASE WHEN t.top = m.out THEN s2 ELSE s1 END) - s1) AS gain FROM ways w JOIN seconds t ON t.j = w.j, mine m WHERE w.i NOT IN (SELECT out FROM mine) GROUP BY ALL),
  allowed AS (SELECT * FROM swap_gains g WHERE gain > 1e-9 * (SELECT count(*) FROM meta)
    AND NOT EXISTS (SELECT 1 FROM ways w JOIN mine m ON m.out = w.j WHERE w.i = g."into" AND m.out <> g.out AND w.overlap > 0.5)
    AND (SELECT count(*) FROM mine m JOIN meta f ON f.entity = m.entity WHERE f.fold_id = g."into" AND m.out <> g.out) < 3)
SELECT 1 AS nth, out, "into", round(gain, 6) AS gain, round((SELECT coverage FROM picks WHERE nth = 11) + gain / (SELECT count(*) FROM meta), 6) AS coverage
FROM allowed ORDER BY round(gain, 9) DESC, out, "into" LIMIT 1"""


def packed_folds(s: SparkSession, d: str) -> DataFrame:
    return facility.packed(files.stored(select.traits(fr.meta(s, d)), "traits"))


def _table(s: SparkSession, picks: list[facility.Pick]) -> DataFrame:
    return s.createDataFrame([astuple(p) for p in picks], "nth int, fold_id long, entity string, gain double, coverage double")


def _swap_table(s: SparkSession, swaps: list[facility.Swap]) -> DataFrame:
    return s.createDataFrame([astuple(x) for x in swaps], "nth int, out long, into long, gain double, coverage double")


@query("representative_folds", _PICKS + " SELECT nth, fold_id, entity, round(gain, 6) AS gain, round(coverage, 6) AS coverage FROM picks")
def representative_folds(s: SparkSession, d: str) -> DataFrame:
    return _table(s, facility.greedy(packed_folds(s, d), max(K))[0])


@query("adaptive_folds", _PICKS + """ SELECT nth, fold_id, entity, round(gain, 6) AS gain, round(coverage, 6) AS coverage FROM picks
WHERE nth <= (SELECT coalesce(min(nth), 14) FROM picks WHERE nth >= 3 AND gain <= 0.1 * (SELECT gain FROM picks WHERE nth = 1))""")
def adaptive_folds(s: SparkSession, d: str) -> DataFrame:
    return _table(s, facility.greedy(packed_folds(s, d), max(K), k_min=3, elbow_tol=0.1)[0])


@query("coverage_stats", _PICKS + _STATS)
def coverage_stats(s: SparkSession, d: str) -> DataFrame:
    folds = packed_folds(s, d)
    return facility.stats(folds, facility.greedy(folds, max(K))[1], list(K))


@query("coverage_sweep", _PICKS + _STATS.replace("unnest([11, 14])", "unnest(range(2, 15, 2))::INT"))
def coverage_sweep(s: SparkSession, d: str) -> DataFrame:
    folds = packed_folds(s, d)
    return facility.stats(folds, facility.greedy(folds, max(K))[1], list(range(2, 15, 2)))


@query("best_swap", _PICKS + _SWAP)
def best_swap(s: SparkSession, d: str) -> DataFrame:
    folds = packed_folds(s, d)
    return _swap_table(s, facility.swaps(folds, facility.greedy(folds, K[0])[1], most=1)[0])


@query("improved_folds")
def improved_folds(s: SparkSession, d: str) -> DataFrame:
    """All swaps until none helps; tests hold the operator against brute force."""
    folds = packed_folds(s, d)
    return _swap_table(s, facility.swaps(folds, facility.greedy(folds, K[0])[1])[0])


@query("coverage_elbow", _PICKS + ' SELECT min(nth)::INT AS k FROM (SELECT nth, coverage - lag(coverage) OVER (ORDER BY nth) AS step FROM picks) WHERE step < 0.02')
def coverage_elbow(s: SparkSession, d: str) -> DataFrame:
    return select.elbow(_table(s, facility.greedy(packed_folds(s, d), max(K))[0]), 0.02)
