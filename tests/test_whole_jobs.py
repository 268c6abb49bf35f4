"""Queries whose marks lie before the tables' first day keep every row; marks within the tables are queries of their own."""

from panelwalk.plans import frames
from panelwalk.plans import queries as Q
from panelwalk.sources import panels

from .oracle import differences, duck


def check(spark, sf, name, whole, late):
    con = duck(sf)
    assert differences(Q.QUERIES[name](spark, sf), con, Q.ORACLES[name]) == []
    assert differences(Q.QUERIES[late](spark, sf), con, Q.ORACLES[late]) == []
    assert Q.QUERIES[name](spark, sf).count() == whole > Q.QUERIES[late](spark, sf).count() > 0


def test_complete_fold_meta_keeps_every_fold(spark, sf):
    check(spark, sf, "complete_fold_meta", frames.fold_table(spark, sf).count(), "complete_fold_meta_late")


def test_listing_filter_keeps_every_bar(spark, sf):
    check(spark, sf, "listing_filter", panels.bars(spark, sf).count(), "listing_filter_late")


def test_complete_folds_keeps_every_fold(spark, sf):
    check(spark, sf, "complete_folds", frames.fold_table(spark, sf).count(), "complete_folds_late")


def test_hybrid_scale_returns_every_row_of_every_fold(spark, sf):
    check(spark, sf, "hybrid_scale", frames.fold_rows(spark, sf).count(), "hybrid_scale_summary")
