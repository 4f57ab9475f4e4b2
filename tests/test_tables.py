"""Tables between steps are removed with their scope, kept ones by their caller, and threads don't share scopes."""

import os
from concurrent.futures import ThreadPoolExecutor

from wickflow import tables
from wickflow.plans import catalog


def stored(spark):
    folder = f"{tables.shared_dir(spark)}/wickflow"
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def test_scopes_remove_what_they_do_not_keep(spark):
    before = stored(spark)
    with tables.scratch(spark) as keep:
        with tables.scratch(spark) as inner:
            tables.written(spark.range(3), "inner")
            kept = inner(tables.written(spark.range(4), "kept"))
        assert len(stored(spark) - before) == 1 and kept.count() == 4
        out = keep(tables.written(kept, "out"))
    assert len(stored(spark) - before) == 1 and out.count() == 4
    tables.release(spark)
    assert not any(x.startswith("out-") for x in stored(spark) - before)


def test_a_failure_removes_them_too(spark):
    before = stored(spark)
    try:
        with tables.scratch(spark):
            tables.written(spark.range(3), "failed")
            raise ValueError
    except ValueError:
        assert stored(spark) == before


def test_threads_have_scopes_of_their_own(spark):
    def run(n):
        with tables.scratch(spark) as keep:
            rows = spark.range(n)
            for _ in range(5):
                rows = tables.written(rows, f"thread-{n}")
            return keep(tables.written(rows, f"thread-{n}"))

    with ThreadPoolExecutor(4) as pool:
        assert [x.count() for x in pool.map(run, range(10, 18))] == list(range(10, 18))
    tables.release(spark)
    assert not any(x.startswith("thread-") for x in stored(spark))


def test_queries_leave_only_what_their_result_reads(spark, sf):
    before = stored(spark)
    with tables.scratch(spark):
        assert catalog.QUERIES["kmeans_clusters"](spark, sf).count() > 0
        assert len(stored(spark) - before) == 2  # the windows, and the last centres
    assert stored(spark) == before
