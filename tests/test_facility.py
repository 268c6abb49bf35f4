"""Choice of folds against brute force over the full penalised matrix."""

import datetime
import random

import numpy as np
import pytest

from panelwalk.operators import facility
from panelwalk.operators.facility import Rules


def world(seed, n, twins=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        z = np.array([rng.gauss(0, 1) for _ in range(4)]) + (i % 3)
        z = z / np.linalg.norm(z) if i != 1 else z * 0
        start = rng.randint(0, 60)
        days = sorted(rng.sample(range(start, start + 14), 10)) if i != 2 else []
        rows.append([i * 3, rng.choice(["A", "B", "C", None]), z.tolist(), days])
    for i in range(twins):
        rows.append([900 + i, *rows[5][1:]])
    return rows


def matrix(rows, rules):
    n = len(rows)
    sim, overlap = np.zeros((n, n)), np.zeros((n, n))
    for i in range(n):
        for j in range(n):
            a, b = set(rows[i][3]), set(rows[j][3])
            overlap[i, j] = len(a & b) / len(a | b) if a | b else 0.0
            cosine = min(max(float(np.dot(rows[i][2], rows[j][2])), 0.0), 1.0)
            same = (rows[i][1] or "UNK") == (rows[j][1] or "UNK")
            sim[i, j] = cosine if i == j else min(max(cosine - rules.overlap_weight * overlap[i, j] - rules.entity_weight * same, 0.0), 1.0)
    return sim, overlap


def valid(chosen, rows, overlap, rules):
    names = [rows[i][1] or "UNK" for i in chosen]
    if any(names.count(e) > rules.per_entity for e in names):
        return False
    return rules.most_overlap is None or all(overlap[i, j] <= rules.most_overlap for i in chosen for j in chosen if i != j)


def brute_greedy(rows, sim, overlap, k, rules):
    n, chosen, cover, gains = len(rows), [], np.zeros(len(rows)), []
    while len(chosen) < min(k, n):
        free = [i for i in range(n) if i not in chosen and valid([*chosen, i], rows, overlap, rules)]
        if not free:
            break
        gain = {i: np.maximum(cover, sim[:, i]).sum() - cover.sum() for i in free}
        best = max(gain.values())
        tied = sorted((i for i in free if gain[i] >= best - 1e-9), key=lambda i: rows[i][0])
        if len(tied) > 1 and chosen:
            apart = [round(1 - sim[i, chosen].mean(), 9) for i in tied]
            tied = [tied[int(np.argmax(apart))]]
        chosen.append(tied[0])
        gains.append(gain[tied[0]])
        cover = np.maximum(cover, sim[:, tied[0]])
    return chosen, gains


def brute_swaps(rows, sim, overlap, chosen, rules):
    chosen, out = list(chosen), []
    while True:
        now = sim[:, chosen].max(1).sum()
        best = None
        for c in chosen:
            for i in range(len(rows)):
                trial = [x for x in chosen if x != c] + [i]
                if i in chosen or not valid(trial, rows, overlap, rules):
                    continue
                gain = sim[:, trial].max(1).sum() - now
                key = (-round(gain, 9), rows[c][0], rows[i][0])
                if gain > 1e-9 * len(rows) and (best is None or key < best[0]):
                    best = (key, trial, gain)
        if best is None:
            return chosen, out
        chosen = best[1]
        out.append((best[0][1], best[0][2]))


def frame(spark, rows):
    day = datetime.date(2000, 1, 1)
    data = [(i, e, z, [day + datetime.timedelta(d) for d in days]) for i, e, z, days in rows]
    return facility.packed(spark.createDataFrame(data, "fold_id long, entity string, z array<double>, date_list array<date>").repartition(3))


@pytest.mark.parametrize(("seed", "n", "k", "rules", "page", "held"), [
    (1, 30, 8, Rules(), 512, 1 << 16), (2, 30, 8, Rules(per_entity=2, most_overlap=0.2), 4, 1 << 16), (3, 34, 30, Rules(per_entity=5), 7, 9), (4, 12, 12, Rules(99, None), 3, 1 << 16),
])
def test_greedy_and_swaps_equal_brute_force(spark, monkeypatch, seed, n, k, rules, page, held):
    for name, value in (("PAGE", page), ("AGAIN", max(2, page // 2)), ("HELD", held)):
        monkeypatch.setattr(facility, name, value)
    rows = world(seed, n, twins=2 if seed == 1 else 0)
    sim, overlap = matrix(rows, rules)
    table = frame(spark, rows)
    wanted, gains = brute_greedy(rows, sim, overlap, k, rules)
    picks, chosen = facility.greedy(table, k, rules)
    assert [p.fold_id for p in picks] == [rows[i][0] for i in wanted]
    assert np.allclose([p.gain for p in picks], gains) and np.isclose(picks[-1].coverage, sim[:, wanted].max(1).mean())
    apart = [np.mean([1 - sim[i, j] for a, i in enumerate(wanted[:m]) for j in wanted[:a]]) if m > 1 else 0 for m in range(1, len(wanted) + 1)]
    assert np.allclose(facility.diversity(chosen, rules), apart)
    got = {r.k: r for r in facility.stats(table, chosen, [1, 3, 50], rules).collect()}
    for m in (1, 3, 50):
        cover = sim[:, wanted[:m]].max(1)
        assert np.allclose([got[m][c] for c in ("mean", "least", "p05", "p25", "p50", "p95")], [cover.mean(), cover.min(), *np.quantile(cover, [0.05, 0.25, 0.5, 0.95])])
    start = wanted[:3] if seed != 2 else sorted(range(n), key=lambda i: sim[:, i].sum())[:1]
    some = facility.Folds(*zip(*[(rows[i][0], rows[i][1], rows[i][2], rows[i][3]) for i in start], strict=True))
    end, trace = brute_swaps(rows, sim, overlap, start, rules)
    done, after = facility.swaps(table, some, rules)
    assert [(s.out, s.into) for s in done] == trace and set(after.ids.tolist()) == {rows[i][0] for i in end}
    assert not done or np.isclose(done[-1].coverage, sim[:, end].max(1).mean())


def test_lazy_scores_few_folds(spark, monkeypatch):
    monkeypatch.setattr(facility, "PAGE", 64)
    rng = np.random.default_rng(0)
    z = rng.normal(size=(400, 6)) + np.array([3, 0, 0, 0, 0, 0]) * (np.arange(400) < 380)[:, None]
    rows = [[i, f"e{i % 50}", (v / np.linalg.norm(v)).tolist(), []] for i, v in enumerate(z)]
    asked = []
    real = facility.scores
    monkeypatch.setattr(facility, "scores", lambda f, c, a, r, **k: (asked.append(len(a.ids)), real(f, c, a, r, **k))[1])
    picks, _ = facility.greedy(frame(spark, rows), 3)
    sim, overlap = matrix(rows, Rules())
    assert [p.fold_id for p in picks] == brute_greedy(rows, sim, overlap, 3, Rules())[0]
    assert sum(asked) < 900  # all gains, scored in each round, would be 1,197


def test_stops(spark):
    rows = world(7, 25)
    table, rules = frame(spark, rows), Rules(99, None)
    every = facility.greedy(table, 25, rules)[0]
    target = every[4].coverage
    assert len(facility.greedy(table, 25, rules, coverage_target=target)[0]) == 5
    assert len(facility.greedy(table, 25, rules, k_min=7, coverage_target=target)[0]) == 7
    low = every[6].gain
    assert len(facility.greedy(table, 25, rules, min_gain=low)[0]) == 7
    assert len(facility.greedy(table, 25, rules, elbow_tol=low / every[0].gain * (1 + 1e-12))[0]) == 7
    none = facility.packed(spark.createDataFrame([], "fold_id long, entity string, z array<double>, date_list array<date>"))
    picks, chosen = facility.greedy(none, 3)
    assert picks == [] and facility.swaps(none, chosen) == ([], chosen) and facility.stats(none, chosen, [2]).collect() == []
