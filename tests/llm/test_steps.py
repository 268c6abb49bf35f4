"""Steps and shuffle files that nothing reads any more are gone, and what a result reads is still there."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from panelwalk.llm import jaccard_join, substring_dedup, text, toxicity


@pytest.fixture
def docs(spark):
    rng = random.Random(5)
    plain = lambda n: " ".join(f"w{rng.randrange(300)}" for _ in range(n))
    shared = plain(60)
    rows = [(i, plain(80)) for i in range(20)] + [(20, f"{plain(20)} {shared}"), (21, f"{shared} {plain(30)}")]
    rows += [(22, rows[3][1] + " end"), (23, rows[4][1]), (None, plain(40)), (24, None)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def names(before):
    return [os.path.basename(x).rsplit("-", 1)[0] for x in text._STEPS if x not in before]


def test_links_leave_their_result_alone(spark, docs):
    before = list(text._STEPS)
    got = jaccard_join.links(docs)
    assert names(before) == ["linked"]
    found = {r.doc_id: r.component_id for r in got.collect()}
    assert found[22] == 3 and found[23] == 4 and found[5] == 5 and got.count() == 26


def test_spans_leave_their_result_alone(spark, docs):
    before = list(text._STEPS)
    got = substring_dedup.report(docs)
    assert names(before) == ["spans"]
    assert {r.doc_id: r.n_removed for r in got.where("doc_id in (5, 20, 21)").collect()} == {5: 0, 20: 60, 21: 60}


def test_the_classifier_leaves_nothing(spark, docs):
    before = list(text._STEPS)
    labels = docs.where("doc_id is not null").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    weights, _ = toxicity.fit(docs, labels)
    assert weights.any() and names(before) == []


def test_steps_of_a_failure_wait_for_the_end_and_outer_ones_stay(spark):
    before = list(text._STEPS)
    with pytest.raises(ValueError, match="no"), text.passing(spark):
        text.kept(spark.range(3), "lost")
        raise ValueError("no")
    assert names(before) == ["lost"]
    with text.passing(spark) as mine:
        inner = text.settled(spark, lambda: text.kept(spark.range(3), "way").where("id > 0"), "inner")
        assert len(mine) == 1 and inner.count() == 2
    assert names(before) == ["lost"]


def test_shuffle_files_go_when_their_step_is_written(spark):
    files = lambda: sum(x.startswith("shuffle_") for d in (spark.conf.get("spark.local.dir", "/tmp"),) for top in os.listdir(d) if top.startswith("blockmgr-") for _, _, found in os.walk(f"{d}/{top}") for x in found)
    before, setting = files(), spark.conf.get(text.CLEANUP)
    step = text.kept(spark.range(50_000).groupBy((F.col("id") % 999).alias("k")).count(), "counted")
    end = time.time() + 10
    while files() > before and time.time() < end:
        time.sleep(0.2)
    assert files() <= before and step.count() == 999 and spark.conf.get(text.CLEANUP) == setting
