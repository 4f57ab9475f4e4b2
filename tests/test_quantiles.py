"""Selection by digits equals Spark's percentile, whatever the values."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from wickflow.operators import quantiles

QS = [0.0, 0.25, 0.5, 0.9, 0.99, 1.0]


def rows(rng):
    some = [0.0, -0.0, 1.0, -1.0, 1e300, -1e300, 5e-324, 2.5, 2.5, 2.5, float("inf"), None]
    out = [("empty", None, 1.0), ("one", 7.0, None), ("two", -2.0, 3.0), ("two", 5.0, 3.0)]
    out += [("odd", rng.choice(some), rng.gauss(0, 1e-3)) for _ in range(301)]
    out += [("wide", rng.choice([1, -1]) * 10 ** rng.uniform(-20, 20), float(rng.randrange(3))) for _ in range(500)]
    return out + [(None, float(i), 1.0 + i * 2**-52) for i in range(50)]


def test_equal_to_percentile(spark):
    df = spark.createDataFrame(rows(random.Random(15)), "g string, x double, y double").repartition(3)
    got = {r.g: (r.x, r.y) for r in quantiles.quantiles(df, ["g"], ["x", "y"], QS).collect()}
    want = {r.g: (r.x, r.y) for r in df.groupBy("g").agg(*(F.percentile(c, F.lit(QS)).alias(c) for c in "xy")).collect()}
    assert {k: v for k, v in got.items() if k is not None} == {k: v for k, v in want.items() if k is not None}


def test_bits_keep_the_order_and_come_back(spark):
    rng = random.Random(16)
    xs = [struct.unpack("<d", rng.randbytes(8))[0] for _ in range(500)] + [0.0, 1.5, -1.5, float("inf"), float("-inf")]
    xs = [x for x in xs if x == x]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", quantiles.ordered_bits(F.col("x")).alias("b"))
    got = df.withColumn("y", quantiles.double_of(F.col("b"))).collect()
    assert all(r.x == r.y for r in got) and [r.x for r in sorted(got, key=lambda r: r.b)] == sorted(xs)


@pytest.mark.parametrize("n", [0, 1])
def test_few_rows(spark, n):
    df = spark.createDataFrame([("a", 1.0)][:n], "g string, x double")
    assert [(r.g, r.x) for r in quantiles.quantiles(df, ["g"], ["x"], [0.5]).collect()] == [("a", [1.0])][:n]
