"""A series that is dealt to tasks by blocks gives the rows that it gives as one block."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from wickflow.plans import catalog
from wickflow.sources import candles as src

NAMES = ["candle_features", "add_features", "behaviour_prepare", "window_states", "knn_windows", "forward_outcomes", "endpoint_baseline", "reversal_outcomes", "prior_level_interactions", "screened_windows", "neighbour_context", "pattern_vector_last"]


@pytest.mark.parametrize("name", NAMES)
def test_small_blocks_change_nothing(spark, sf, monkeypatch, name):
    tidy = lambda d: d.sort_values(list(d.columns), ignore_index=True)
    want = tidy(catalog.QUERIES[name](spark, sf).toPandas())
    monkeypatch.setattr(src, "BLOCK", 37)
    monkeypatch.setattr(src, "SPAN_MS", 7 * 86_400_000)
    pd.testing.assert_frame_equal(tidy(catalog.QUERIES[name](spark, sf).toPandas()), want)


def test_one_series_uses_many_tasks(spark, sf, monkeypatch):
    monkeypatch.setattr(src, "BLOCK", 50)
    one = catalog.featured(spark, sf).where("symbol = 'view'")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = catalog.wd.described(one).select(F.spark_partition_id().alias("task"), "end").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    by_task = pd.Series([r.task for r in rows]).value_counts()
    assert len(by_task) > 1 and by_task.max() < 0.7 * len(rows) and len({r.end for r in rows}) == len(rows)


def test_places_of_a_series_are_whole_numbers_in_order(spark):
    rows = [("A", "1h", i * 3_600_000) for i in range(0, 3000, 2)] + [("B", "1h", 5 * 3_600_000)]
    got = src.indexed(spark.createDataFrame(rows, "symbol string, timeframe string, open_time long").repartition(7)).orderBy("symbol", "open_time").collect()
    assert [r.idx for r in got] == [*range(1500), 0]
