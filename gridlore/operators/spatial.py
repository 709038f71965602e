"""Spatial joins on grid cells: an equi-join on the cell, then the exact predicate.

The cell's side is taken from the boxes themselves (their mean extent), and a large box is put on a coarser level whose
cells are as large as it is: a box has at most four cells a level, however large it is, and is met by the boxes of its
own and of finer levels. Each pair is met in every cell that both boxes touch on the coarser one's level; it is
kept in one, the cell of the lower left corner of what the boxes have in common, so no distinct is needed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlore.functions import plane
from gridlore.functions.geometry import clip_interval
from gridlore.operators.tables import settled
from gridlore.profiles import OVERLAP

#: Levels of the grid; the coarsest has cells of 2**(LEVELS - 1) times the finest ones' side.
LEVELS = 24


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt to all tasks before work that is dear a row: a table of few octets is read in few tasks. The number of
    parts is named, since the engine would join small ones again."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _extent(side: str) -> Column:
    return F.greatest(F.col(f"{side}x1") - F.col(f"{side}x0"), F.col(f"{side}y1") - F.col(f"{side}y0")).cast("double")


def _sizes(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: the finest cell's side, a power of two of at least the mean extent, and the coarsest level that a box needs."""
    both = a.select(_extent("a").alias("e")).unionAll(b.select(_extent("b").alias("e")))
    one = both.agg(F.avg("e").alias("mean"), F.max("e").alias("most"))
    size = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest("mean", F.lit(1e-6)))))
    return one.select(size.alias("_size"), _level(F.col("most"), size).alias("_top"))


def _level(extent: Column, size: Column) -> Column:
    """The finest level whose cells are as large as the box."""
    return F.least(F.lit(LEVELS - 1), F.when(extent > size, F.ceil(F.log2(extent / size))).otherwise(0)).cast("int")


def _with_cells(df: DataFrame, side: str, sizes: DataFrame) -> DataFrame:
    """The rows once for each cell that the box touches on its own level and on each coarser one."""
    x = df.crossJoin(F.broadcast(sizes)).withColumn(f"_{side}", _level(_extent(side), F.col("_size")))
    x = x.withColumn("_l", F.explode(F.sequence(F.col(f"_{side}"), F.col("_top")))).withColumn("_cell", F.col("_size") * F.pow(F.lit(2.0), F.col("_l")))
    span = lambda c: F.explode(F.sequence(F.floor(F.col(f"{side}{c}0") / F.col("_cell")), F.floor(F.col(f"{side}{c}1") / F.col("_cell"))))
    return x.withColumn("_cx", span("x")).withColumn("_cy", span("y")).drop("_size", "_top")


def _meet(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame, Column]:
    """Both sides by cell, and whether two rows of a cell are a pair that this cell keeps."""
    sizes = _sizes(a, b)
    a, b = _with_cells(a, "a", sizes), _with_cells(b, "b", sizes).drop("_cell")
    meet = (F.col("ax0") <= F.col("bx1")) & (F.col("bx0") <= F.col("ax1")) & (F.col("ay0") <= F.col("by1")) & (F.col("by0") <= F.col("ay1"))
    here = lambda c: F.floor(F.greatest(f"a{c}0", f"b{c}0") / F.col("_cell")) == F.col(f"_c{c}")
    return a, b, meet & here("x") & here("y") & (F.greatest("_a", "_b") == F.col("_l"))


def box_join(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of boxes that meet, edges included. a has ax0, ay0, ax1, ay1, b the same with b."""
    a, b, kept = _meet(a, b)
    return a.join(b, ["_l", "_cx", "_cy"]).where(kept).drop("_l", "_cx", "_cy", "_cell", "_a", "_b")


def overlap_area() -> Column:
    side = lambda c: F.least(f"a{c}1", f"b{c}1") - F.greatest(f"a{c}0", f"b{c}0")
    return (F.greatest(side("x"), F.lit(0)) * F.greatest(side("y"), F.lit(0))).cast("double")


def crossings(segments: DataFrame, waters: DataFrame) -> DataFrame:
    """way, pos and the part t0..t1 of a segment in each water box that it meets; length is the segment's."""
    s = segments.withColumns({"ax0": F.least("x1", "x2"), "ay0": F.least("y1", "y2"), "ax1": F.greatest("x1", "x2"), "ay1": F.greatest("y1", "y2")})
    t0, t1 = clip_interval(*(F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2", "bx0", "by0", "bx1", "by1")))
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return box_join(s, waters).withColumns({"t0": t0, "t1": t1, "length": F.sqrt((dx * dx + dy * dy).cast("double"))}).where("t0 <= t1").select("way", "pos", "t0", "t1", "length")


def crossing_ways(segments: DataFrame, waters: DataFrame) -> DataFrame:
    """The ways of which a segment meets a water box: a semi-join, so a segment's search ends at its first box."""
    s = segments.withColumns({"ax0": F.least("x1", "x2"), "ay0": F.least("y1", "y2"), "ax1": F.greatest("x1", "x2"), "ay1": F.greatest("y1", "y2")})
    t0, t1 = clip_interval(*(F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2", "bx0", "by0", "bx1", "by1")))
    a, b, kept = _meet(s, waters)
    b = b.select("bx0", "by0", "bx1", "by1", "_b", *(F.col(c).alias(f"b{c}") for c in ("_l", "_cx", "_cy")))
    same = (F.col("_l") == F.col("b_l")) & (F.col("_cx") == F.col("b_cx")) & (F.col("_cy") == F.col("b_cy"))
    return a.join(b, same & kept & (t0 <= t1), "left_semi").select("way").distinct()


def covered_length(parts: DataFrame) -> DataFrame:
    """way and the length in the union of the waters: each segment's intervals are merged."""
    order = Window.partitionBy("way", "pos").orderBy("t0", "t1")
    reach = F.max("t1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.col("t1") - F.greatest("t0", F.coalesce(reach, F.lit(0.0))), F.lit(0.0))
    return parts.withColumn("more", new * F.col("length")).groupBy("way").agg(F.sum("more").alias("water_length"))


def bridges(roads: DataFrame, crossing_ways: DataFrame) -> DataFrame:
    """The tagged roads that cross water; all crossing roads if no road has the tag."""
    tagged = roads.agg(F.max(F.col("bridge").cast("int")).alias("any"))
    wanted = roads.crossJoin(F.broadcast(tagged)).where((F.coalesce("any", F.lit(0)) == 0) | F.col("bridge")).drop("any")
    return wanted.join(crossing_ways, "way", "left_semi")


def dominated_ids(losers: DataFrame, winners: DataFrame, share: float) -> DataFrame:
    """a_id of the losers (a_id and boxes as in box_join) that a single winner covers by more than `share`: a semi-join, so a search ends at the first such winner."""
    a, b, _ = _meet(losers, winners)
    b = b.select("bx0", "by0", "bx1", "by1", *(F.col(c).alias(f"b{c}") for c in ("_l", "_cx", "_cy")))
    same = (F.col("_l") == F.col("b_l")) & (F.col("_cx") == F.col("b_cx")) & (F.col("_cy") == F.col("b_cy"))
    area = (F.col("ax1") - F.col("ax0")) * (F.col("ay1") - F.col("ay0"))
    return a.join(b, same & (overlap_area() > share * area), "left_semi").select("a_id").distinct()


def dominated(losers: DataFrame, winners: DataFrame, share: float = OVERLAP) -> DataFrame:
    """losers without those that a single winner covers by more than `share` (columns as in box_join; losers have a_id)."""
    winners = winners.select("bx0", "by0", "bx1", "by1").distinct()
    return losers.join(dominated_ids(losers, winners, share), "a_id", "left_anti")


#: A box of more finest cells than this along a side is not cut.
CELLS_A_SIDE = 8


def disjoint(boxes: DataFrame) -> DataFrame:
    """Boxes (bx0, by0, bx1, by1) that take the same place, edges included, with few overlaps: they are united by cells of twice their mean
    extent or more. Boxes much larger than a cell, and those without an area, stay as they are."""
    boxes = boxes.select("bx0", "by0", "bx1", "by1")
    x = boxes.crossJoin(F.broadcast(_sizes(boxes.toDF("ax0", "ay0", "ax1", "ay1"), boxes).select((F.col("_size") * 2).alias("_cell"))))
    flat = (F.col("bx0") >= F.col("bx1")) | (F.col("by0") >= F.col("by1"))
    whole = flat | (_extent("b") > F.col("_cell") * CELLS_A_SIDE)
    span = lambda c: F.explode(F.sequence(F.floor(F.col(f"b{c}0") / F.col("_cell")), F.floor(F.col(f"b{c}1") / F.col("_cell"))))
    cells = x.where(~whole).withColumn("_cx", span("x")).withColumn("_cy", span("y"))
    low = [F.greatest(F.col(f"b{c}0"), F.col(f"_c{c}") * F.col("_cell")).cast("double").alias(f"b{c}0") for c in "xy"]
    high = [F.least(F.col(f"b{c}1"), (F.col(f"_c{c}") + 1) * F.col("_cell")).cast("double").alias(f"b{c}1") for c in "xy"]
    names = ("bx0", "by0", "bx1", "by1")

    def one(table: pa.Table) -> pa.Table:
        out = plane.disjoint_boxes(np.stack([table.column(c).to_numpy() for c in names], 1))
        return pa.table({c: out[:, k] for k, c in enumerate(names)})

    cut = cells.select("_cx", "_cy", *low, *high).distinct().groupBy("_cx", "_cy").applyInArrow(one, ", ".join(f"{c} double" for c in names))
    return cut.unionByName(x.where(whole).select(*(F.col(c).cast("double").alias(c) for c in names)).distinct())


def nearest_max(points: DataFrame, grid: DataFrame, k: int = 8, reach: int = 2) -> DataFrame:
    """id and the largest z of the k nearest known grid vertices of each point (id, px, py over col, row); of equally near ones the first by row and column.

    The vertices around a cell are gathered once, in a row, and its points look through them there: no candidate of a point is
    a row, and none is shuffled. Candidates are `reach` cells around the point, or around the place on the grid's edge that is nearest to it. A vertex
    that was not looked at is farther than the reach from there; so a point that has k candidates, none of them farther,
    is done. The others, next to missing vertices, are searched again in a square of twice the reach."""
    known = grid.where("z IS NOT NULL")
    ends = known.agg(F.min("col"), F.max("col"), F.min("row"), F.max("row")).first()
    out, left = None, points.select("id", "px", "py")
    if ends[0] is None:
        return left.where("false").select("id", F.lit(None).cast("double").alias("z"))
    on_grid = lambda c, a, b: F.greatest(F.lit(float(a)), F.least(F.lit(float(b)), F.col(c)))
    left = left.where("px IS NOT NULL AND py IS NOT NULL").withColumns({"_x": on_grid("px", *ends[:2]), "_y": on_grid("py", *ends[2:])})
    left = left.withColumns({"_cx": F.floor("_x"), "_cy": F.floor("_y")})
    away = lambda x, y: (x - F.col("px")) * (x - F.col("px")) + (y - F.col("py")) * (y - F.col("py"))
    while True:
        span = lambda c, a, b: F.explode(F.sequence(F.greatest(F.col(c) - reach - 1, F.lit(a)), F.least(F.col(c) + reach + 1, F.lit(b))))  # noqa: B023, E731
        cells = left.select("_cx", "_cy").distinct().withColumn("row", span("_cy", *ends[2:])).withColumn("col", span("_cx", *ends[:2]))
        around = cells.join(known, ["row", "col"]).groupBy("_cx", "_cy").agg(F.collect_list(F.struct("row", "col", "z")).alias("around"))
        by_distance = F.transform("around", lambda v: F.struct(away(v["col"], v["row"]).alias("d"), v["row"].alias("row"), v["col"].alias("col"), v["z"].alias("z")))
        near = left.join(around, ["_cx", "_cy"], "left").withColumn("near", F.slice(F.array_sort(by_distance), 1, k)).drop("around")
        near = near.withColumns({"z": F.array_max(F.transform("near", lambda v: v["z"])), "n": F.size("near"), "d": F.array_max(F.transform("near", lambda v: v["d"]))}).drop("near")
        if reach >= max(ends[1] - ends[0], ends[3] - ends[2]):
            found = near.where("n > 0").select("id", "z")
            return found if out is None else out.unionByName(found)
        judged = settled(near.withColumn("sure", F.coalesce((F.col("n") == k) & (F.col("d") <= away(F.col("_x"), F.col("_y")) + reach * reach), F.lit(False))))
        sure = judged.where("sure").select("id", "z")
        out = sure if out is None else out.unionByName(sure)
        left, reach = judged.where("NOT sure").select("id", "px", "py", "_x", "_y", "_cx", "_cy"), reach * 2
        if left.isEmpty():
            return out
