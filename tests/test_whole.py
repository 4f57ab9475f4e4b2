"""Queries that must cover all of their rows, none skipped by a stride, a filter or a pool."""

import pytest

from wickflow.plans import catalog


def ends(spark, sf):
    """Every window end of each symbol."""
    return {(r.symbol, e) for r in catalog.src.series(spark, sf).groupBy("symbol").agg({"idx": "max"}).withColumnRenamed("max(idx)", "last").collect() for e in range(19, r.last + 1)}


@pytest.mark.parametrize("name", ["price_levels_v2", "story_tokens", "story_explanations"])
def test_every_window_has_levels_and_a_story(spark, sf, name):
    assert {(r.symbol, r.end) for r in catalog.QUERIES[name](spark, sf).select("symbol", "end").collect()} == ends(spark, sf)


def test_events_come_from_every_window_that_has_some(spark, sf):
    counts = catalog.QUERIES["price_levels_v2"](spark, sf).where("interaction_count > 0").select("symbol", "end").collect()
    found = catalog.QUERIES["level_events"](spark, sf).select("symbol", "end").distinct().collect()
    assert set(found) == set(counts) and len(found) > len(ends(spark, sf)) / 2
