"""Every registered query that has SQL returns what DuckDB returns for it; the others return rows of a stable schema."""

import duckdb
import pandas as pd
import pytest

from wickflow.plans import catalog

TABLES = ("events", "embeddings", "orders")


@pytest.fixture(scope="module")
def db(sf):
    with duckdb.connect() as found:
        for t in TABLES:
            found.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        yield found


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, db, name):
    got = catalog.QUERIES[name](spark, sf).toPandas()
    assert got.columns.is_unique
    if name in catalog.ORACLE_SQL:
        want = db.sql(catalog.ORACLE_SQL[name]).df()
        columns = sorted(want.columns)
        tidy = lambda d: d[columns].sort_values(columns, ignore_index=True)
        pd.testing.assert_frame_equal(tidy(got), tidy(want), check_dtype=False, atol=2e-6)
