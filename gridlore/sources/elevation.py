"""Elevation grids: tiles of a window, lookup in tile rows, assembly with fall-backs, cache keys and grid files."""

from __future__ import annotations

import io

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlore.functions import scalars as S
from gridlore.operators import raster

#: Share of missing points from which the next source is asked.
TOO_FEW = 0.5


def tiles_of(windows: DataFrame) -> DataFrame:
    """id, lat, lon and name of the one-degree tiles that windows (id, south, west, north, east) reach into."""
    x = windows.withColumn("lat", F.explode(F.sequence(F.floor("south"), F.floor("north")))).withColumn("lon", F.explode(F.sequence(F.floor("west"), F.floor("east"))))
    return x.select("id", "lat", "lon", S.hgt_name(F.col("lat"), F.col("lon")).alias("name"))


def sample_tiles(points: DataFrame, tiles: DataFrame, sides: DataFrame) -> DataFrame:
    """points (id, lat, lon) with the nearest sample of the tile that owns them (half-open by degrees); tiles: lat, lon, row (0 = south), col, z; sides: lat, lon, side. A point without a tile has a null z."""
    own = points.withColumns({"tlat": F.floor("lat"), "tlon": F.floor("lon")})
    s = sides.select(F.col("lat").cast("long").alias("tlat"), F.col("lon").cast("long").alias("tlon"), "side")
    # Rows are counted from the north edge, as the files have them; halves go to the even row.
    from_north = F.bround((1 - (F.col("lat") - F.col("tlat"))) * (F.col("side") - 1))
    placed = own.join(s, ["tlat", "tlon"], "left").withColumns({"row": (F.col("side") - 1 - from_north).cast("long"), "col": F.bround((F.col("lon") - F.col("tlon")) * (F.col("side") - 1)).cast("long")})
    cells = tiles.select(F.col("lat").cast("long").alias("tlat"), F.col("lon").cast("long").alias("tlon"), F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "z")
    return placed.join(cells, ["tlat", "tlon", "row", "col"], "left").select(*points.columns, "z")


def sample_raster(points: DataFrame, grid: DataFrame, west: float, north: float, pixel: tuple[float, float], nodata: float | None = None) -> DataFrame:
    """points (id, x, y in the raster's plane) with the nearest pixel's z, clamped to the raster (row 0 = north, col, z); nodata and missing pixels are null."""
    shaped = raster.with_shape(points, grid)
    at = lambda v, n: F.greatest(F.lit(0), F.least(F.col(n) - 1, F.floor(v).cast("long"))).cast("long")
    placed = shaped.withColumns({"row": at((F.lit(north) - F.col("y")) / pixel[1], "rows"), "col": at((F.col("x") - F.lit(west)) / pixel[0], "cols")})
    z = F.col("z") if nodata is None else F.when(F.col("z") != nodata, F.col("z"))
    return placed.join(grid, ["row", "col"], "left").select("id", z.alias("z"))


def assembled(first: DataFrame, *others: DataFrame) -> DataFrame:
    """id, row, col, z of each grid from the first source (id, row, col, z) that knows over half of its points; its missing points are
    taken from the sources after it, in order. Missing points that no source knows stay null (see `raster.fill_missing`)."""
    out = first.withColumnRenamed("z", "z0")
    for k, other in enumerate(others, 1):
        out = out.join(other.select("id", "row", "col", F.col("z").alias(f"z{k}")), ["id", "row", "col"], "left")
    n = len(others) + 1
    known = out.groupBy("id").agg(*(F.avg(F.col(f"z{k}").isNotNull().cast("double")).alias(f"k{k}") for k in range(n)))
    start = F.lit(0)
    for k in reversed(range(n)):
        start = F.when(F.col(f"k{k}") > 1 - TOO_FEW, k).otherwise(start)
    picked = out.join(known.select("id", start.alias("start")), "id")
    z = F.coalesce(*(F.when(F.col("start") <= k, F.col(f"z{k}")) for k in range(n)), *(F.col(f"z{k}") for k in range(n)))
    return picked.select("id", "row", "col", z.alias("z"))


def finished(grid: DataFrame, rows: int, cols: int) -> DataFrame:
    """One grid (row, col, z) filled and smoothed, as it is handed on."""
    whole = raster.fill_missing(grid.withColumn("grid", F.lit(0)), "grid").select("row", "col", "z")
    return raster.gaussian(whole, raster.smoothing_sigma(rows, cols, 2.5))


def cache_key(south: Column, west: Column, north: Column, east: Column, resolution: Column) -> Column:
    """The name of a cached grid by its window, to four digits, and resolution."""
    return F.format_string("dem_%.4f_%.4f_%.4f_%.4f_%d.npy", south, west, north, east, resolution)


def write_npy(grid: DataFrame, path: str) -> None:
    """One grid (row, col, z; null is NaN) as a NumPy file, put together on the driver: a grid is bounded by its resolution."""
    import numpy as np

    table = grid.select("row", "col", "z").toArrow()
    row, col = (table.column(c).to_numpy() for c in ("row", "col"))
    out = np.full((int(row.max()) + 1, int(col.max()) + 1) if len(row) else (0, 0), np.nan)
    if len(row):
        out[row, col] = table.column("z").to_numpy(zero_copy_only=False).astype(float)
    np.save(path, out)


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """path, row, col, z of NumPy grid files; NaN is null."""
    import numpy as np
    import pyarrow as pa

    def work(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                z = np.load(io.BytesIO(content))
                for at in range(0, len(z), 256):
                    part = z[at : at + 256].astype(float)
                    flat = part.ravel()
                    yield pa.record_batch({
                        "path": pa.array([name] * len(flat), pa.string()), "row": pa.array(at + np.repeat(np.arange(part.shape[0]), part.shape[1]), pa.int64()),
                        "col": pa.array(np.tile(np.arange(part.shape[1]), part.shape[0]), pa.int64()), "z": pa.array(flat, pa.float64(), mask=np.isnan(flat)),
                    })

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(work, "path string, row long, col long, z double")
