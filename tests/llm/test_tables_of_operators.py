"""Operators remove their tables with the scope around them, and run side by side on threads."""

import os
from concurrent.futures import ThreadPoolExecutor

import pytest

from wickflow import tables
from wickflow.llm import queries


def stored(spark):
    folder = f"{tables.shared_dir(spark)}/wickflow"
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


@pytest.mark.parametrize("name", ["op1_mix_sources", "op5_token_counts", "op7_quality_rules", "op9_warc_round_trip", "op11_conversation_repair", "op13_spelling_variants"])
def test_no_table_outlives_its_scope(spark, sf, name):
    before = stored(spark)
    with tables.scratch(spark):
        assert queries.QUERIES[name](spark, sf).count() > 0
    assert stored(spark) == before


def test_queries_on_threads_give_the_rows_they_give_alone(spark, sf):
    names = ["op5_token_counts", "op6_jaccard_join", "op9_warc_round_trip"]
    run = lambda name: sorted(map(str, queries.QUERIES[name](spark, sf).collect()))
    with ThreadPoolExecutor(3) as pool:
        together = list(pool.map(run, names))
    assert together == [run(x) for x in names]
