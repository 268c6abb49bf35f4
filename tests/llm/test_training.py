"""Classifiers learn from every labelled document of the training part, however many there are."""

import zlib

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelwalk.llm import quality, toxicity


def learnt(i):
    return zlib.crc32(str(i).encode()) % 5 != 0


def test_all_labelled_rows_are_taken(spark):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    more = spark.createDataFrame([(1, "text 1"), (1, "another"), (2, None), (None, "x")], "doc_id long, text string")
    labels = spark.range(0, 30_000, 2).select(F.col("id").alias("doc_id"), (F.col("id") % 3 == 0).cast("int").alias("toxic"))
    labels = labels.unionByName(spark.createDataFrame([(1, 1), (3, None), (None, 1)], "doc_id long, toxic int"))
    got = sorted(map(tuple, toxicity.labelled(docs.unionByName(more), labels, "toxic").select("doc_id", "text", "label").collect()))
    wanted = [(i, f"text {i}", int(i % 3 == 0)) for i in range(0, 30_000, 2)] + [(1, "text 1", 1), (1, "another", 1), (2, "", 0)]
    wanted = sorted(r for r in wanted if learnt(r[0]))
    assert len(got) > 10_000 and got == wanted


@pytest.mark.parametrize(("module", "label"), [(toxicity, "toxic"), (quality, "quality")])
def test_what_only_late_documents_show_is_learnt(spark, module, label):
    """One of forty documents has the mark; with the first 6,000 by hash as plain texts the old sample saw none of it."""
    ids = spark.range(30_000).select(F.col("id").alias("doc_id"), F.row_number().over(Window.orderBy(F.xxhash64("id"))).alias("nth"))
    marked = (F.col("nth") > 15_000) & (F.col("nth") % 20 == 0)
    plain = F.concat(F.lit("a plain row of words "), "doc_id")
    docs = ids.select("doc_id", F.when(marked, F.concat(plain, F.lit(" zzqx#zzqx#"))).otherwise(plain).alias("text"), marked.alias("marked"))
    labels = docs.select("doc_id", (F.col("marked") | (F.col("doc_id") % 97 == 0)).cast("int").alias(label))
    model = module.fit(docs.select("doc_id", "text"), labels, label)
    held = [r for r in module.score(docs, model).collect() if not learnt(r.doc_id)]
    with_mark, without = (np.mean([r.score for r in held if r.marked == m]) for m in (True, False))
    assert with_mark > 0.9 and with_mark > without + 0.4


def test_pairs_hold_every_document():
    for ones, zeros in ((1000, 7), (7, 1000), (24, 1), (1, 1)):
        good, bad = np.arange(1, ones + 1, dtype=float)[:, None], -np.arange(1, zeros + 1, dtype=float)[:, None] * 10_000
        sums = np.concatenate(list(quality._pairs(good, bad)))[:, 0]
        assert set(sums % 10_000) == set(good[:, 0]) and set(sums // 10_000) == set(-bad[:, 0] // 10_000)


def test_parts_hold_every_row_and_both_labels(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE", 100)
    rows = spark.createDataFrame([(i, int(i < 3), np.array([float(i)]).tobytes()) for i in range(1000)], "doc_id long, label int, x binary")
    parts = [(np.frombuffer(r.good), np.frombuffer(r.bad)) for r in quality._parts(rows, 3, 997).collect()]
    assert len(parts) == 10 and all(sorted(good) == [0, 1, 2] for good, _ in parts)
    assert sorted(x for _, bad in parts for x in bad) == list(range(3, 1000))


def test_fits_reach_the_least_loss(spark):
    rng = np.random.default_rng(3)
    bits = rng.random((400, 16)) < 0.4
    y = (bits @ rng.normal(0, 1, 16) + rng.normal(0, 1, 400) > 0).astype(int)
    scale = rng.uniform(0.5, 2, 16)
    rows = spark.createDataFrame([(int(a), np.packbits(b).tobytes()) for a, b in zip(y, bits, strict=True)], "label int, held binary")
    w, bias = toxicity.fit_logistic(rows, 400, scale)
    x = bits * scale
    error = 1 / (1 + np.exp(-(x @ w + bias))) - y
    assert np.abs(x.T @ error / 400 + toxicity.PENALTY * w).max() < 1e-4 and abs(error.mean()) < 1e-4


def test_scores_by_rank(spark):
    rng = np.random.default_rng(5)
    for values in (rng.normal(0, 1, 3000) ** 5, np.repeat(rng.normal(0, 1, 9), 50), np.array([2.0]), np.r_[1e300, np.arange(20) * 1e-300]):
        scores = spark.createDataFrame([(float(v),) for v in values], "z double")
        for rank in {0, len(values) // 7, len(values) - 1}:
            assert quality._of_rank(scores, rank) == sorted(values)[rank]
