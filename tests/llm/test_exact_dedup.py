"""Exact dedup against a dictionary of texts; Misra-Gries summaries against counts."""

import collections
import hashlib
import random
import re

import pyarrow as pa
import pytest

from panelwalk.llm import exact_dedup
from panelwalk.llm.exact_dedup import MisraGries

from .test_llm import ODD


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    groups = collections.defaultdict(list)
    for (i, _), t in zip(rows, norm, strict=True):
        groups[t].append(i)
    least = {t: min(ids, key=lambda i: (i is None, i or 0)) for t, ids in groups.items()}
    left = {t: 1 for t in groups}
    out = []
    for (i, _), t in zip(rows, norm, strict=True):
        stays = i == least[t] and left[t] > 0
        left[t] -= stays
        out.append((i, least[t], len(groups[t]), stays, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(map(str, out))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    texts = ["hot text\n here"] * 400 + ["warm"] * 60 + [" hot  text here"] * 3 + ["hot text here", None, "", " ", " ", "\x1c", "\x85", *ODD]
    texts += [f"copy {rng.randint(0, 40)}" for _ in range(120)] + [f"single {i}" for i in range(100)] + ["long word " * 100_000] * 2
    rng.shuffle(texts)
    out = list(enumerate(texts, -5))
    return [*out, (None, "warm"), (None, "only null id"), (None, "only null id"), out[3], out[7], (out[3][0], "another text of the id")]


@pytest.mark.parametrize("counters", [1, 3, 20, 4096])
def test_groups_equal_brute_force(spark, rows, counters):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, digest string, row int").repartition(7)
    assert sorted(str(tuple(r)) for r in exact_dedup.groups(docs, counters).collect()) == brute(rows)
    out = exact_dedup.deduplicated(docs, counters)
    assert out.columns == docs.columns
    kept = sorted(str(t) for i, t, *_ in map(tuple, out.collect()))
    assert len(kept) == sum("True" in x for x in brute(rows))


def test_frequent_digests_are_winners_and_few(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    tagged = exact_dedup._tagged(docs)
    for counters in (1, 2, 5, 50):
        counts = collections.Counter(r.digest for r in tagged.collect())
        limit = len(rows) // (counters + 1)
        got = {bytes(r.digest): r["size"] for r in exact_dedup.winners(tagged, counters).collect()}
        assert got == {bytes(d): n for d, n in counts.items() if n > max(1, limit)} and len(got) <= counters


def test_summary_bounds():
    rng = random.Random(1)
    stream = [bytes([min(rng.randint(0, 255), rng.randint(0, 255))]) for _ in range(5000)]
    summary = MisraGries(20)
    for i in range(0, 5000, 137):
        found = collections.Counter(stream[i : i + 137])
        summary.add(pa.array(list(found), pa.binary()), list(found.values()))
    counts, held = collections.Counter(stream), dict(zip(summary.digests.to_pylist(), summary.counts.tolist(), strict=True))
    assert len(held) <= 20 and summary.taken <= 5000 // 21
    assert all(counts[d] - summary.taken <= n <= counts[d] for d, n in held.items())
    assert all(d in held for d, n in counts.items() if n > 5000 / 21)


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string, size int")
    assert exact_dedup.groups(none).collect() == [] and exact_dedup.deduplicated(none).collect() == []
