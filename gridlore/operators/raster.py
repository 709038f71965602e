"""Rasters in long form (row, col, z), z null where missing."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_shape(df: DataFrame, grid: DataFrame) -> DataFrame:
    """df with the grid's numbers of rows and columns (one row, broadcast); nothing of an empty grid."""
    shape = grid.agg((F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols")).where("rows IS NOT NULL")
    return df.crossJoin(F.broadcast(shape))


def linspace_grid(boxes: DataFrame, resolution: int) -> DataFrame:
    """id, row, col, lat, lon: points from the south-west corner on, corners included; `resolution` along the longer
    side of the box (south, west, north, east), fewer along the other by the sides' ratio, two at least."""
    high, wide = F.col("north") - F.col("south"), F.col("east") - F.col("west")
    other = lambda short, long: F.greatest(F.lit(2), (resolution * short / long).cast("int"))
    x = boxes.withColumns({"rows": F.when(high >= wide, resolution).otherwise(other(high, wide)), "cols": F.when(high >= wide, other(wide, high)).otherwise(resolution)})
    x = x.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("rows") - 1))).withColumn("col", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)))
    step = lambda a, b, k, n: F.when(F.col(k) == F.col(n) - 1, F.col(b)).otherwise(F.col(a) + (F.col(b) - F.col(a)) * F.col(k) / (F.col(n) - 1))
    return x.select("id", "row", "col", step("south", "north", "row", "rows").alias("lat"), step("west", "east", "col", "cols").alias("lon"))


def sample_nearest(points: DataFrame, grid: DataFrame) -> DataFrame:
    """z of the cell that a point (id, u, v in 0..1 from the first row and column) is nearest to; halves go to the even cell."""
    at = lambda c, n: F.greatest(F.lit(0), F.least(F.col(n) - 1, F.bround(F.col(c) * (F.col(n) - 1)).cast("long"))).cast("long")
    placed = with_shape(points, grid).select("id", at("u", "rows").alias("row"), at("v", "cols").alias("col"))
    return placed.join(grid, ["row", "col"], "left").select("id", "row", "col", "z")


def bilinear(points: DataFrame, grid: DataFrame) -> DataFrame:
    """Interpolated z at points (id, fr, fc as fractional indexes, clamped); null if a corner is missing."""
    inside = lambda c, n: F.greatest(F.lit(0.0), F.least(F.col(c), (F.col(n) - 1).cast("double")))
    low = lambda c, n: F.greatest(F.lit(0), F.least(F.floor(c), F.col(n) - 2)).cast("long")
    base = with_shape(points, grid).withColumns({"r": inside("fr", "rows"), "c": inside("fc", "cols")}).withColumns({"r0": low("r", "rows"), "c0": low("c", "cols")})
    corner = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1))))
    x = base.select("id", "r", "c", "r0", "c0").withColumn("k", corner).withColumns({"row": F.col("r0") + F.col("k.i"), "col": F.col("c0") + F.col("k.j")})
    weight = F.when(F.col("k.i") == 1, F.col("r") - F.col("r0")).otherwise(1 - F.col("r") + F.col("r0")) * F.when(F.col("k.j") == 1, F.col("c") - F.col("c0")).otherwise(1 - F.col("c") + F.col("c0"))
    joined = x.join(grid, ["row", "col"], "left")
    return joined.groupBy("id").agg(F.when(F.count("z") == 4, F.sum(weight * F.col("z"))).alias("z"))


def smoothing_sigma(rows: int, cols: int, most: float = 1.0) -> float:
    """The width that a grid is smoothed with: less for small grids."""
    return min(most, (rows + cols) / 200)


def gaussian(grid: DataFrame, sigma: float) -> DataFrame:
    """Separable Gaussian with the edge repeated; the kernel reaches int(4 sigma + 0.5). The grid is whole, without nulls.

    Each axis is one window along a line of the grid: two shuffles, and no row is copied."""
    radius = int(4 * sigma + 0.5)
    kernel = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-radius, radius + 1)]

    def along(x: DataFrame, axis: str) -> DataFrame:
        line = Window.partitionBy("col" if axis == "row" else "row").orderBy(axis)
        whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        x = x.withColumns({"_first": F.first("z").over(whole), "_last": F.last("z").over(whole)})
        at = lambda d: F.coalesce(F.lag("z", -d).over(line), F.col("_first")) if d < 0 else F.coalesce(F.lead("z", d).over(line), F.col("_last")) if d else F.col("z")
        z = sum((at(d) * (w / sum(kernel)) for d, w in zip(range(-radius, radius + 1), kernel, strict=True)), F.lit(0.0))
        return x.select("row", "col", z.alias("z"))

    return along(along(grid, "row"), "col")


def fill_missing(grid: DataFrame, key: str = "grid") -> DataFrame:
    """key, row, col, z without nulls, grid by grid: linear interpolation inside the known points' hull, their mean outside.

    The interpolation is over a triangulation of the known points by circumcircles (Delaunay), as of scattered data. A grid
    of three known points or fewer, or of points in one line, takes the mean, one without any zeros; a grid of which over a
    tenth was missing is smoothed by the median of 3 by 3 cells, the edge repeated. A grid must fit a task's memory."""
    import pyarrow as pa

    from gridlore.functions.gridfill import filled

    def work(table: pa.Table) -> pa.Table:
        row, col = (table.column(c).to_numpy() for c in ("row", "col"))
        z = table.column("z").to_numpy(zero_copy_only=False).astype(float)
        return pa.table({key: table.column(key), "row": pa.array(row, pa.int64()), "col": pa.array(col, pa.int64()), "z": pa.array(filled(row, col, z), pa.float64())})

    kind = grid.schema[key].dataType.simpleString()
    return grid.select(key, F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("z").cast("double").alias("z")).groupBy(key).applyInArrow(work, f"{key} {kind}, row long, col long, z double")


def terrain_class(grid: DataFrame) -> DataFrame:
    """z_range, z_std and the class: flat, mountain or moderate."""
    s = grid.agg((F.max("z") - F.min("z")).alias("z_range"), F.stddev_pop("z").alias("z_std"), F.count_if(F.col("z").isNull()).alias("missing"))
    kind = F.when((F.col("z_range") < 30) & (F.col("z_std") < 10), "flat").when((F.col("z_range") > 100) | (F.col("z_std") > 30), "mountain").otherwise("moderate")
    return s.withColumn("kind", kind)


def slope(grid: DataFrame) -> DataFrame:
    """row, col and the gradient's length by forward differences; the last row and column have none."""
    right = F.lead("z").over(Window.partitionBy("row").orderBy("col"))
    up = F.lead("z").over(Window.partitionBy("col").orderBy("row"))
    dx, dy = F.col("zr") - F.col("z"), F.col("zu") - F.col("z")
    return grid.withColumn("zr", right).withColumn("zu", up).select("row", "col", F.sqrt(dx * dx + dy * dy).alias("slope")).where("slope IS NOT NULL")


def heightfield_faces(grid: DataFrame) -> DataFrame:
    """fid, v1, v2, v3: two triangles a grid cell; a vertex's number is row * cols + col."""
    row, col, cols = F.col("row"), F.col("col"), F.col("cols")
    v = row * cols + col
    tri = F.array(F.struct(F.lit(0).alias("k"), v.alias("v1"), (v + cols).alias("v2"), (v + 1).alias("v3")), F.struct(F.lit(1).alias("k"), (v + 1).alias("v1"), (v + cols).alias("v2"), (v + cols + 1).alias("v3")))
    cells = with_shape(grid, grid).where((row < F.col("rows") - 1) & (col < cols - 1))
    return cells.select((row * (cols - 1) + col).alias("cell"), F.explode(tri).alias("t")).select((F.col("cell") * 2 + F.col("t.k")).alias("fid"), "t.v1", "t.v2", "t.v3")


def boundary_loop(grid: DataFrame) -> DataFrame:
    """place, row, col: the grid's outer vertices counter-clockwise from the first one, the way a base wall runs."""
    row, col, rows, cols = F.col("row"), F.col("col"), F.col("rows"), F.col("cols")
    edge = with_shape(grid, grid).where((row == 0) | (col == 0) | (row == rows - 1) | (col == cols - 1))
    place = F.when(row == 0, col).when(col == cols - 1, cols - 1 + row).when(row == rows - 1, (cols - 1) * 2 + rows - 1 - col).otherwise((cols - 1) * 2 + (rows - 1) * 2 - row)
    return edge.select(place.alias("place"), "row", "col")


def sample_slope(points: DataFrame, grid: DataFrame, steep: float = 0.05) -> DataFrame:
    """id, slope and whether it is steep, of the cell that a point (id, u, v) is nearest to."""
    found = sample_nearest(points, slope(grid).withColumnRenamed("slope", "z"))
    return found.select("id", F.col("z").alias("slope"), (F.col("z") > steep).alias("steep"))


def boundary_edges(faces: DataFrame) -> DataFrame:
    """a < b: the edges of one face only."""
    edge = lambda p, q: F.struct(F.least(p, q).alias("a"), F.greatest(p, q).alias("b"))
    e = faces.select(F.explode(F.array(edge("v1", "v2"), edge("v2", "v3"), edge("v3", "v1"))).alias("e"))
    return e.groupBy("e.a", "e.b").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("a", "b")
