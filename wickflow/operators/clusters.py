"""Clusters of windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.candles import SERIES
from ..tables import scratch, written


def nearest(centres: Column, v: Column) -> Column:
    """struct(distance, cluster) of the nearest centre by mean squared difference; the first of equal ones."""
    far = lambda c: F.aggregate(F.zip_with(c, v, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x) / F.size(v)
    return F.array_min(F.transform(centres, lambda c, i: F.struct(far(c).alias("distance"), i.alias("cluster"))))


def kmeans(points: DataFrame, k: int = 8, rounds: int = 25) -> DataFrame:
    """(series, centres) of points (series, end, v), by Lloyd's rounds from evenly spaced points of each series; k at most as many as points.

    The points are written once. The centres of a series are k short arrays in one row; that table is joined on the series, by
    broadcast if Spark finds it small enough. Each round is one aggregate. It ends when no centre of any series moves.
    """
    with scratch(points.sparkSession) as keep:
        return keep(rounds_of(written(points, "points"), k, rounds))


def rounds_of(points: DataFrame, k: int, rounds: int) -> DataFrame:
    w, whole = Window.partitionBy(*SERIES).orderBy("end"), Window.partitionBy(*SERIES)
    ranked = points.withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count("*").over(whole)})
    seeds = ranked.withColumn("_j", F.explode(F.sequence(F.lit(0), F.least(F.lit(k), "_n") - 1))).where(F.col("_i") == F.floor(F.col("_j") * F.coalesce(F.try_divide(F.col("_n") - 1, F.least(F.lit(k), "_n") - 1), F.lit(0.0))).cast("int"))
    centres = seeds.groupBy(*SERIES).agg(F.transform(F.array_sort(F.collect_list(F.struct("_j", "v"))), lambda x: x["v"]).alias("centres"))
    before = None
    for _ in range(rounds):
        centres = written(centres, "centres")
        now = centres.agg(F.sum(F.xxhash64("centres").cast("decimal(38,0)"))).first()[0]
        if now == before:
            break
        before = now
        at = points.join(centres, SERIES).withColumn("_", nearest(F.col("centres"), F.col("v")))
        sums = at.select(*SERIES, F.col("_.cluster").alias("cluster"), F.posexplode("v").alias("pos", "x")).groupBy(*SERIES, "cluster", "pos").agg(F.avg("x").alias("x"))
        new = sums.groupBy(*SERIES, "cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("_v"))
        new = new.groupBy(*SERIES).agg(F.map_from_entries(F.collect_list(F.struct("cluster", "_v"))).alias("_new"))
        centres = centres.join(new, SERIES).select(*SERIES, F.transform("centres", lambda c, i: F.coalesce(F.try_element_at(F.col("_new"), i), c)).alias("centres"))
    return written(centres, "centres")


def assigned(points: DataFrame, centres: DataFrame) -> DataFrame:
    """points with the cluster of the nearest of their series' centres, and its distance."""
    out = points.join(centres, SERIES).withColumn("_", nearest(F.col("centres"), F.col("v")))
    return out.select(*points.columns, F.col("_.cluster").alias("cluster"), F.col("_.distance").alias("distance"))


def cluster_name(v: Column) -> Column:
    """By a centre's first, second and fourth value: balance of direction, alternation and range."""
    three = lambda i, high, low, mid: F.when(F.get(v, i) > 0.20, high).when(F.get(v, i) < -0.20, low).otherwise(mid)
    return F.concat_ws(" | ", three(0, "BULL_BIASED", "BEAR_BIASED", "BALANCED"), three(3, "WIDE_RANGE", "TIGHT_RANGE", "MID_RANGE"), three(1, "HIGH_ALTERNATION", "LOW_ALTERNATION", "MID_ALTERNATION"))


def summary(history: DataFrame, current: DataFrame, centres: DataFrame) -> DataFrame:
    """A row for each cluster: name, windows, share, distance from the current window, and whether that is in it."""
    sizes = assigned(history, centres).groupBy(*SERIES, "cluster").agg(F.count("*").alias("windows"))
    far = F.aggregate(F.zip_with("centre", "v", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x) / F.size("v")
    each = centres.select(*SERIES, F.posexplode("centres").alias("cluster", "centre")).join(current.select(*SERIES, "v"), SERIES).withColumn("distance_from_current", far)
    first = Window.partitionBy(*SERIES).orderBy("distance_from_current", "cluster")
    out = each.withColumn("is_current_cluster", F.row_number().over(first) == 1).join(sizes, [*SERIES, "cluster"], "left").fillna(0, ["windows"])
    share = F.col("windows") * 100.0 / F.sum("windows").over(Window.partitionBy(*SERIES))
    return out.select(*SERIES, "cluster", cluster_name(F.col("centre")).alias("name"), "windows", share.alias("share_pct"), "distance_from_current", "is_current_cluster")


def rarity(history: DataFrame, current: DataFrame, centres: DataFrame) -> DataFrame:
    """For each series' current window: its cluster, distance, and the share of windows that are no farther from their own cluster."""
    now = assigned(current, centres).select(*SERIES, F.col("cluster").alias("current_cluster"), F.col("distance").alias("current_distance"))
    out = assigned(history, centres).join(now, SERIES)
    return out.groupBy(*SERIES, "current_cluster", "current_distance").agg(F.count("*").alias("windows"), (F.avg((F.col("distance") <= F.col("current_distance")).cast("double")) * 100).alias("rarity_pct"))
