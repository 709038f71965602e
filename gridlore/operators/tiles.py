"""The tile grid (integer micro-degrees), cache hits and time to live."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Micro-degrees a tile.
TILE = 50_000


def cover(boxes: DataFrame, tile: int = TILE) -> DataFrame:
    """A row for each tile that a box (lat0, lon0, lat1, lon1) reaches into, with the part of the tile inside the box."""
    last = lambda a, b: F.greatest(F.floor(a / tile), F.ceil(b / tile) - 1)
    x = boxes.withColumn("ty", F.explode(F.sequence(F.floor(F.col("lat0") / tile), last(F.col("lat0"), F.col("lat1")))))
    x = x.withColumn("tx", F.explode(F.sequence(F.floor(F.col("lon0") / tile), last(F.col("lon0"), F.col("lon1")))))
    return x.withColumns({
        "lat0": F.greatest("lat0", F.col("ty") * tile), "lat1": F.least("lat1", (F.col("ty") + 1) * tile),
        "lon0": F.greatest("lon0", F.col("tx") * tile), "lon1": F.least("lon1", (F.col("tx") + 1) * tile),
    })


def hits_and_misses(wanted: DataFrame, manifest: DataFrame) -> DataFrame:
    """The wanted tiles (ty, tx) with whether the manifest has them."""
    return wanted.join(manifest.select("ty", "tx").distinct().withColumn("hit", F.lit(True)), ["ty", "tx"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def is_valid(age: Column, ttl: Column) -> Column:
    """A negative time to live never ends, 0 has always ended."""
    return F.when(ttl < 0, True).when(ttl == 0, False).otherwise(age < ttl)


def age_text(age: Column) -> Column:
    whole = lambda n: F.floor(age / n).cast("string")
    return F.when(age < 60, F.concat(whole(1), F.lit("s"))).when(age < 3600, F.concat(whole(60), F.lit("m"))).when(age < 86400, F.concat(whole(3600), F.lit("h"))).otherwise(F.concat(whole(86400), F.lit("d")))


def choose_path(paths: DataFrame, floor_gb: float = 1.0) -> DataFrame:
    """By strategy, of the writable paths (path, priority, free_gb) with room: the first, and the roomiest."""
    ok = paths.where("writable AND free_gb >= " + str(floor_gb))
    return ok.agg(F.min_by("path", "priority").alias("by_priority"), F.max_by("path", F.struct("free_gb", "path")).alias("by_capacity"))
