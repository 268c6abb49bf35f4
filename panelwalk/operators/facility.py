"""Representative folds by facility location on penalised similarity, without a table of all pairs.

A fold covers another by 1 - dissimilarity: cosine of their unit trait vectors, less penalties for common days and
for the same entity, within 0..1; itself it covers by its cosine alone. Folds lie in a table of one row each.
A pass over it scores a batch of candidates against the chosen folds: tasks multiply their folds' matrix with the
candidates' and sum by candidate, so that a few numbers for each candidate come back.

The greedy choice is lazy. Gains only shrink as folds are chosen, so an old gain is an upper bound; only the
candidates whose bound reaches the best new gain are scored again. Before a fold is scored its bound comes from
moments: sum_j max(0, z.z_j) <= (z.s + sqrt(n z'Gz)) / 2, with s the sum of the vectors and G their Gram matrix.
Candidates are read from the table in order of their bounds, a page at a time.

Swaps are scored from each fold's best and second-best cover. No swap gains more than adding its fold would, so
the same bounds end the search. Both respect the limits by entity and by common days.

Defined results: no folds, no choice. Null entities are one entity. A fold without days overlaps none. A zero vector
covers nothing, not even itself. Equal gains (to nine digits) go to the fold that differs most from the chosen ones on
average, then to the smallest id. Ids are taken to be unique.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import stored

#: Candidates read from the table, and scored again, at once.
PAGE, AGAIN = 512, 64
#: Candidates that the driver holds at most; the others wait in the table with their bounds.
HELD = 1 << 16
EPS = 1e-9


@dataclass(frozen=True)
class Rules:
    per_entity: int = 3
    most_overlap: float | None = 0.5
    overlap_weight: float = 0.9
    entity_weight: float = 0.25


class Folds:
    """Some folds as arrays."""

    def __init__(self, ids: list, entities: list, z: list, days: list):
        self.ids, self.entities = np.array(ids, np.int64), np.array(["UNK" if e is None else e for e in entities], object)
        self.z = np.array(z, float).reshape(len(ids), -1) if len(ids) else np.zeros((0, 0))
        self.days = [np.array(d if d is not None else [], np.int64) for d in days]
        self.low = np.array([d.min() if len(d) else 1 for d in self.days], np.int64)
        self.high = np.array([d.max() if len(d) else 0 for d in self.days], np.int64)

    def some(self, which: list[int]) -> Folds:
        return Folds(self.ids[which], self.entities[which], self.z[which], [self.days[i] for i in which])

    def and_also(self, other: Folds) -> Folds:
        z = [*self.z, *other.z]
        return Folds([*self.ids, *other.ids], [*self.entities, *other.entities], z, [*self.days, *other.days])

    def overlaps(self, other: Folds) -> np.ndarray:
        """Jaccard overlap of days; only folds whose date ranges meet are compared."""
        out = np.zeros((len(self.ids), len(other.ids)))
        for j, days in enumerate(other.days):
            for i in np.flatnonzero((self.low <= other.high[j]) & (self.high >= other.low[j])).tolist():
                common = len(np.intersect1d(self.days[i], days))
                out[i, j] = common / (len(self.days[i]) + len(days) - common)
        return out

    def similarity(self, other: Folds, rules: Rules) -> np.ndarray:
        if not len(self.ids) or not len(other.ids):
            return np.zeros((len(self.ids), len(other.ids)))
        own = self.ids[:, None] == other.ids
        same = self.entities[:, None] == other.entities
        penalty = np.where(own, 0.0, rules.overlap_weight * self.overlaps(other) + rules.entity_weight * same)
        return np.clip(np.clip(self.z @ other.z.T, 0.0, 1.0) - penalty, 0.0, 1.0)


@dataclass
class Pick:
    nth: int
    fold_id: int
    entity: str
    gain: float
    coverage: float


def packed(traits: DataFrame) -> DataFrame:
    """fold_id, entity, z, days (numbers) and the bound of each fold's gain, written once."""
    width = len(traits.select("z").first().z) if traits.head(1) else 0
    z = [F.col("z")[i] for i in range(width)]
    gram = [F.sum(z[i] * z[j]) for i in range(width) for j in range(i, width)]
    marks = traits.agg(F.count("*"), *[F.sum(x) for x in z], *gram).first()
    n, s = marks[0], marks[1 : 1 + width]
    bound = F.lit(0.0)
    if width:
        at = iter(marks[1 + width :])
        square = sum(((1.0 if i == j else 2.0) * g * z[i] * z[j] for i in range(width) for j in range(i, width) for g in [next(at)]), F.lit(0.0))
        bound = (sum((s[i] * z[i] for i in range(width)), F.lit(0.0)) + F.sqrt(n * F.greatest(square, F.lit(0.0)))) / 2 * (1 + 1e-9) + 1e-9
    days = F.transform("date_list", F.unix_date)
    return stored(traits.select(F.col("fold_id").cast("long").alias("fold_id"), "entity", "z", days.alias("days"), bound.alias("bound")), "folds")


def _read(rows: list) -> Folds:
    return Folds([r.fold_id for r in rows], [r.entity for r in rows], [r.z for r in rows], [r.days for r in rows])


def _batch(batch: pa.RecordBatch) -> Folds:
    return Folds(*(batch.column(k).to_pylist() for k in range(4)))


def _cover(mine: Folds, chosen: Folds, rules: Rules) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best cover, by which chosen fold, and second-best cover."""
    sim = mine.similarity(chosen, rules)
    if not sim.shape[1]:
        return np.zeros(len(sim)), np.zeros(len(sim), np.int64), np.zeros(len(sim))
    by, first = sim.argmax(1), sim.max(1)
    second = np.sort(sim, 1)[:, -2] if sim.shape[1] > 1 else np.zeros(len(sim))
    return first, by, second


def scores(folds: DataFrame, chosen: Folds, asked: Folds, rules: Rules, swaps: bool = False) -> np.ndarray:
    """For each asked fold what adding it gains in total and, with swaps, what it gains in place of each chosen one."""
    shared = folds.sparkSession.sparkContext.broadcast((chosen, asked))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen, asked = shared.value
        out = np.zeros((len(asked.ids), 1 + (len(chosen.ids) if swaps else 0)))
        for batch in batches:
            mine = _batch(batch)
            first, by, second = _cover(mine, chosen, rules)
            sim = mine.similarity(asked, rules)
            added = np.maximum(sim - first[:, None], 0.0)
            out[:, 0] += added.sum(0)
            if swaps:
                replaced = np.maximum(sim, second[:, None]) - first[:, None]
                for c in range(len(chosen.ids)):
                    out[:, 1 + c] += added[by != c].sum(0) + replaced[by == c].sum(0)
        place, slot = np.divmod(np.arange(out.size), out.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(slot), pa.array(out.ravel())], ["place", "slot", "value"])

    sums = folds.select("fold_id", "entity", "z", "days").mapInArrow(task, "place long, slot long, value double").groupBy("place", "slot").agg(F.sum("value").alias("value"))
    out = np.zeros((len(asked.ids), 1 + (len(chosen.ids) if swaps else 0)))
    for r in sums.collect():  # PAGE candidates by chosen folds at most
        out[r.place, r.slot] = r.value
    shared.unpersist()
    return out


class Frontier:
    """Candidates in descending order of their bounds. `bounds` has those that the driver holds."""

    def __init__(self, folds: DataFrame):
        self.table, self.rest = folds, float("inf")
        self.held: dict[int, Folds] = {}
        self.bounds: dict[int, float] = {}
        self.gone: set[int] = set()
        self.last: tuple[float, int] | None = None

    def page(self) -> list[int]:
        """Holds the next candidates; none are left if it returns nothing and `rest` is minus infinity."""
        table = self.table
        if self.last:
            bound, i = self.last
            table = table.where((F.col("bound") < bound) | ((F.col("bound") == bound) & (F.col("fold_id") > i)))
        rows = table.orderBy(F.desc("bound"), "fold_id").limit(PAGE).collect()
        fresh = [r for r in rows if r.fold_id not in self.gone and r.fold_id not in self.held]
        for r in fresh:
            self.held[r.fold_id], self.bounds[r.fold_id] = _read([r]), r.bound
        self.last = (rows[-1].bound, rows[-1].fold_id) if rows else self.last
        self.rest = rows[-1].bound if len(rows) == PAGE else float("-inf")
        return [r.fold_id for r in fresh]

    def drop(self, i: int) -> Folds:
        self.gone.add(i)
        self.bounds.pop(i)
        return self.held.pop(i)

    def set_aside(self) -> None:
        """Beyond HELD candidates, the lower half goes back to the table with the bounds that it has now."""
        if len(self.held) <= HELD:
            return
        low = sorted(self.bounds, key=lambda i: (self.bounds[i], -i))[: len(self.bounds) // 2]
        spark = self.table.sparkSession
        known = spark.createDataFrame([(i, self.bounds[i]) for i in low], "fold_id long, known double")
        self.table = stored(self.table.join(F.broadcast(known), "fold_id", "left").withColumn("bound", F.least("bound", "known")).drop("known"), "folds")
        for i in low:
            self.bounds.pop(i)
            self.held.pop(i)
        self.last, self.rest = None, float("inf")

    def folds(self, ids: list[int]) -> Folds:
        out = Folds([], [], [], [])
        parts = [self.held[i] for i in ids]
        return Folds([i for p in parts for i in p.ids], [e for p in parts for e in p.entities], [z for p in parts for z in p.z], [d for p in parts for d in p.days]) if parts else out


def _allowed(candidate: Folds, chosen: Folds, rules: Rules) -> bool:
    if (chosen.entities == candidate.entities[0]).sum() >= rules.per_entity:
        return False
    return rules.most_overlap is None or not len(chosen.ids) or bool((chosen.overlaps(candidate) <= rules.most_overlap).all())


def greedy(folds: DataFrame, k: int, rules: Rules = Rules(), k_min: int = 1, coverage_target: float = 0.0, min_gain: float = 0.0, elbow_tol: float = 0.0) -> tuple[list[Pick], Folds]:
    """Up to k picks. From the k_min-th on it stops once the mean coverage reaches its target, once a gain is down to
    min_gain, or once a gain is down to that share of the first one; a zero switches the rule off."""
    n = folds.count()
    frontier, chosen, picks, covered = Frontier(folds), Folds([], [], [], []), [], 0.0
    while len(picks) < min(k, n):
        fresh: dict[int, float] = {}
        while True:
            best = max(fresh.values(), default=float("-inf"))
            stale = [i for i in frontier.bounds if i not in fresh and frontier.bounds[i] >= best - EPS]
            if stale and (frontier.rest < max(frontier.bounds[i] for i in stale) or len(stale) >= PAGE):
                stale = sorted(stale, key=lambda i: (-frontier.bounds[i], i))[: AGAIN if picks else PAGE]
                for i, gain in zip(stale, scores(folds, chosen, frontier.folds(stale), rules)[:, 0].tolist(), strict=True):
                    fresh[i] = frontier.bounds[i] = gain
            elif frontier.rest >= best - EPS and frontier.rest > float("-inf"):
                for i in frontier.page():
                    if not _allowed(frontier.held[i], chosen, rules):
                        frontier.drop(i)
            else:
                break
        if not fresh:
            break
        tied = sorted(i for i, gain in fresh.items() if gain >= best - EPS)
        if len(tied) > 1 and picks:
            apart = 1.0 - frontier.folds(tied).similarity(chosen, rules).mean(1)
            tied = [tied[int(np.argmax(np.round(apart, 9)))]]
        pick = frontier.drop(tied[0])
        covered += fresh[tied[0]]
        chosen = chosen.and_also(pick) if picks else pick
        picks.append(Pick(len(picks) + 1, int(pick.ids[0]), str(pick.entities[0]), fresh[tied[0]], covered / n))
        for i in [i for i in frontier.held if not _allowed(frontier.held[i], chosen, rules)]:
            frontier.drop(i)
        frontier.set_aside()
        gain, first = picks[-1].gain, max(1e-12, picks[0].gain)
        if len(picks) >= k_min and (0 < coverage_target <= covered / n or 0 < min_gain and gain <= min_gain or 0 < elbow_tol and gain / first <= elbow_tol):
            break
    return picks, chosen


@dataclass
class Swap:
    nth: int
    out: int
    into: int
    gain: float
    coverage: float


def swaps(folds: DataFrame, chosen: Folds, rules: Rules = Rules(), most: int = 50) -> tuple[list[Swap], Folds]:
    """The best allowed exchange of a chosen fold for another, again and again until none raises the mean coverage."""
    n = folds.count()
    done: list[Swap] = []
    if not len(chosen.ids):
        return done, chosen
    shared = folds.select("fold_id", "entity", "z", "days")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([float(sum(_cover(_batch(b), chosen, rules)[0].sum() for b in batches))])], ["cover"])

    total = shared.mapInArrow(task, "cover double").agg(F.sum("cover")).first()[0]
    while len(done) < most:
        best: tuple[float, int, int] | None = None
        frontier, here = Frontier(folds), chosen
        while frontier.rest > max(EPS * n, best[0] - EPS if best else 0.0):
            ids = [i for i in frontier.page() if i not in here.ids]
            if not ids:
                continue
            asked = frontier.folds(ids)
            gains = scores(folds, here, asked, rules, swaps=True)[:, 1:]
            for m, c in zip(*np.nonzero(gains > EPS * n), strict=True):
                others = here.some([x for x in range(len(here.ids)) if x != c])
                found = (round(float(gains[m, c]), 9), int(here.ids[c]), int(asked.ids[m]))
                if (best is None or (-found[0], *found[1:]) < (-best[0], *best[1:])) and _allowed(asked.some([m]), others, rules):
                    best, after = found, others.and_also(asked.some([m])) if len(others.ids) else asked.some([m])
            frontier.held.clear()
        if best is None:
            break
        chosen, total = after, total + best[0]
        done.append(Swap(len(done) + 1, best[1], best[2], best[0], total / n))
    return done, chosen


def covers(folds: DataFrame, chosen: Folds, rules: Rules = Rules()) -> DataFrame:
    """fold_id, k, cover: each fold's cover by the first k chosen ones, for all k."""
    shared = folds.sparkSession.sparkContext.broadcast(chosen)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine = _batch(batch)
            so_far = np.maximum.accumulate(mine.similarity(shared.value, rules), 1)
            n, k = so_far.shape
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(mine.ids, k)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(so_far.ravel())], ["fold_id", "k", "cover"])

    return folds.select("fold_id", "entity", "z", "days").mapInArrow(task, "fold_id long, k int, cover double")


def diversity(chosen: Folds, rules: Rules = Rules()) -> list[float]:
    """Mean dissimilarity between the first k chosen folds, for all k; 0 for one."""
    apart = 1.0 - chosen.similarity(chosen, rules)
    return [float(apart[:k, :k][np.triu_indices(k, 1)].mean()) if k > 1 else 0.0 for k in range(1, len(chosen.ids) + 1)]


def stats(folds: DataFrame, chosen: Folds, ks: list[int], rules: Rules = Rules()) -> DataFrame:
    """k, selected, mean, least, p05, p25, p50, p95 of the cover, and diversity, for several numbers of folds."""
    spark, have = folds.sparkSession, len(chosen.ids)
    wanted = [(k, min(k, have), d) for d_all in [diversity(chosen, rules)] for k in ks for d in [d_all[min(k, have) - 1] if have else 0.0]]
    cover = covers(folds, chosen, rules).groupBy(F.col("k").alias("selected"))
    marks = [F.percentile("cover", F.lit(q)).alias(name) for q, name in ((0.05, "p05"), (0.25, "p25"), (0.5, "p50"), (0.95, "p95"))]
    by_k = cover.agg(F.avg("cover").alias("mean"), F.min("cover").alias("least"), *marks)
    return spark.createDataFrame(wanted, "k int, selected int, diversity double").join(by_k, "selected").select("k", "selected", "mean", "least", "p05", "p25", "p50", "p95", "diversity")
