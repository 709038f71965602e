"""Ways from nodes, and multipolygon relations from ways."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ways(nodes: DataFrame) -> DataFrame:
    """way, points in order, and whether it is a ring (four points at least, the last equal to the first); ways of one point go."""
    point = F.struct("pos", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    whole = nodes.groupBy("way").agg(F.array_sort(F.collect_list(point)).alias("p"))
    points = F.transform("p", lambda p: F.struct(p["x"], p["y"]))
    out = whole.select("way", points.alias("points")).where(F.size("points") >= 2)
    return out.withColumn("closed", (F.size("points") >= 4) & (F.element_at("points", 1) == F.element_at("points", -1)))


def resolve(refs: DataFrame, places: DataFrame) -> DataFrame:
    """way, pos, x, y from node references (way, pos, node); unknown nodes are left out."""
    return refs.join(places, "node").select("way", "pos", "x", "y")


def relations(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """relation, numbers and area of its outer and inner ways; any role but inner is outer; unknown ways are left out."""
    held = members.join(sizes, "way")  # sizes have the closed ways only: open members are not put together
    inner = F.col("role") == "inner"
    outer = ~F.coalesce(inner, F.lit(False))
    return held.groupBy("relation").agg(
        F.count_if(outer).alias("outers"), F.count_if(inner).alias("inners"),
        (F.coalesce(F.sum(F.when(outer, F.col("area"))), F.lit(0.0)) - F.coalesce(F.sum(F.when(inner, F.col("area"))), F.lit(0.0))).alias("net_area"),
    )
