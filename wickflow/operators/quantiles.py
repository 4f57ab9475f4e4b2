"""Exact quantiles of groups of any size, by selecting ranks digit by digit.

A double's bits, read as a whole number whose order is that of the doubles, are cut into digits. The values that share the digits found
so far are counted by their next digit, which tells the digit of each rank; after the last digit the value itself is known. The
state is counts of digits, which are summed before they are shuffled: no task holds the values of a group, however many there are, and
however many are equal. Interpolation is that of Spark's percentile, so results are equal to its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import scratch, written

#: Bits of each digit, from the highest: sign, exponent and 8 of the fraction; then the rest of it.
DIGITS = (20, 15, 15, 14)


def ordered_bits(x: Column) -> Column:
    """A double as a long of the same order; -0.0 is 0.0."""
    bits = F.call_function("java_method", F.lit("java.lang.Double"), F.lit("doubleToLongBits"), x + F.lit(0.0)).cast("long")
    return F.when(bits < 0, bits.bitwiseXOR(F.lit(2**63 - 1))).otherwise(bits)


def double_of(bits: Column) -> Column:
    raw = F.when(bits < 0, bits.bitwiseXOR(F.lit(2**63 - 1))).otherwise(bits)
    return F.call_function("java_method", F.lit("java.lang.Double"), F.lit("longBitsToDouble"), raw).cast("double")


def quantiles(rows: DataFrame, by: list[str], columns: list[str], qs: list[float]) -> DataFrame:
    """A row for each group of by that has one: for each column an array of its quantiles (null if the group has no value of it).

    Nulls don't count; groups with a null in by are left out.
    """
    if not columns:
        return rows.select(*by).distinct()
    with scratch(rows.sparkSession) as keep:
        each = F.explode(F.array(*(F.struct(F.lit(i).alias("_c"), F.col(c).cast("double").alias("_x")) for i, c in enumerate(columns))))
        long = written(rows.select(*by, each.alias("_")).select(*by, "_._c", "_._x").where("_x IS NOT NULL").select(*by, "_c", ordered_bits(F.col("_x")).alias("_bits")), "bits")
        keys = [F.col(x) for x in [*by, "_c"]]
        # Ranks of each group and column: the places next to each quantile, from 0.
        place = lambda q: (F.col("_n") - 1) * F.lit(float(q))
        ranks = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(place(q)).cast("long"), F.ceil(place(q)).cast("long")) for q in qs))))
        ranked = long.groupBy(*by, "_c").agg(F.count("*").alias("_n"))
        at = ranked.select(*by, "_c", F.explode(ranks).alias("_rank")).withColumns({"_left": F.col("_rank"), "_prefix": F.lit(0).cast("long")})
        shift = 64
        for digit in DIGITS:
            above = shift
            shift -= digit
            prefix = F.shiftright("_bits", above) if above < 64 else F.lit(0).cast("long")
            wanted = at.select(*by, "_c", "_prefix").distinct()
            counted = long.withColumn("_prefix", prefix).join(wanted, [*by, "_c", "_prefix"], "left_semi").groupBy(*keys, "_prefix", F.shiftright("_bits", shift).alias("_next")).agg(F.count("*").alias("_k"))
            so_far = Window.partitionBy(*by, "_c", "_prefix").orderBy("_next").rowsBetween(Window.unboundedPreceding, -1)
            counted = counted.withColumn("_before", F.coalesce(F.sum("_k").over(so_far), F.lit(0)))
            found = at.join(counted, [*by, "_c", "_prefix"]).where((F.col("_before") <= F.col("_left")) & (F.col("_left") < F.col("_before") + F.col("_k")))
            at = written(found.select(*by, "_c", "_rank", (F.col("_left") - F.col("_before")).alias("_left"), F.col("_next").alias("_prefix")), "ranks")
        values = at.withColumn("_x", double_of(F.col("_prefix"))).groupBy(*by, "_c").agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_x"))).alias("_v"))
        of = values.join(ranked, [*by, "_c"])

        def interpolated(q: float) -> Column:
            low, high = F.floor(place(q)), F.ceil(place(q))
            a, b = (F.element_at("_v", x.cast("long")) for x in (low, high))
            return F.when((low == high) | (a == b), a).otherwise((high - place(q)) * a + (place(q) - low) * b)

        of = of.select(*by, "_c", F.array(*(interpolated(q) for q in qs)).alias("_q"))
        out = of.groupBy(*by).agg(*(F.max(F.when(F.col("_c") == i, F.col("_q"))).alias(c) for i, c in enumerate(columns)))
        return keep(written(out, "quantiles"))
