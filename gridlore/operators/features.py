"""Feature tables: dedupe, clipping, ranking, thresholds and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlore.profiles import DEFAULT_LINE_WIDTH


def dedupe_first(df: DataFrame, key: str = "osm_id", order: str = "seq") -> DataFrame:
    """One row a key, the first by order; null keys count as equal. Unchanged without the column."""
    if key not in df.columns:
        return df
    pick = Window.partitionBy(key).orderBy(order)
    return df.withColumn("_n", F.row_number().over(pick)).where("_n = 1").drop("_n")


def clip_boxes(df: DataFrame, window: tuple) -> DataFrame:
    """Boxes cut to a window; those that do not meet its inside go."""
    a, b, c, d = window
    met = df.where((F.col("xmin") < c) & (F.col("xmax") > a) & (F.col("ymin") < d) & (F.col("ymax") > b))
    return met.withColumns({"xmin": F.greatest("xmin", F.lit(a)), "ymin": F.greatest("ymin", F.lit(b)), "xmax": F.least("xmax", F.lit(c)), "ymax": F.least("ymax", F.lit(d))})


def box_area():
    return ((F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin"))).cast("double")


def estimated_area(is_line, length, width=None):
    """A polygon's area, a line's length times its width."""
    return F.when(is_line, length * (F.lit(DEFAULT_LINE_WIDTH) if width is None else width)).otherwise(box_area())


def top_by_size(df: DataFrame, size: str, key: str, k: int) -> DataFrame:
    return df.orderBy(F.desc(size), key).limit(k)


def union_all(*parts: DataFrame) -> DataFrame:
    first, *rest = parts
    for x in rest:
        first = first.unionByName(x, allowMissingColumns=True)
    return first


def skipped(df: DataFrame, **reasons) -> DataFrame:
    """How many rows are kept and how many go for each reason (name = condition); a row counts for the first reason that holds."""
    why = F.lit("kept")
    for name, condition in reversed(list(reasons.items())):
        why = F.when(condition, name).otherwise(why)
    return df.groupBy(why.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def report_lines(title: str, counts: DataFrame, label: str, n: str = "n") -> DataFrame:
    """place and line: a title and a line a label, the most frequent first."""
    head = counts.agg(F.sum(n).alias("all")).select(F.lit(0).cast("long").alias("place"), F.concat(F.lit(f"{title}: "), F.coalesce("all", F.lit(0)).cast("string")).alias("line"))
    order = Window.orderBy(F.desc(n), label)
    return head.unionAll(counts.select(F.row_number().over(order).cast("long").alias("place"), F.concat(F.lit("  "), F.col(label).cast("string"), F.lit(": "), F.col(n).cast("string")).alias("line")))


def frequency(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def threshold_panel(df: DataFrame, thresholds: tuple, is_line, area, length, width: float = DEFAULT_LINE_WIDTH) -> DataFrame:
    """By threshold, counts and sizes of kept and skipped polygons and lines; a line counts by length times width."""
    each = df.select(F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"), is_line.alias("line"), area.alias("area"), length.alias("length"))
    kept = F.when(F.col("line"), F.col("length") * width).otherwise(F.col("area")) >= F.col("threshold")
    total = lambda cond, x: F.coalesce(F.sum(F.when(cond, x)), F.lit(0.0))
    line = F.col("line")
    return each.groupBy("threshold").agg(
        F.count_if(~line & kept).alias("polygons_kept"), F.count_if(~line & ~kept).alias("polygons_skipped"),
        F.count_if(line & kept).alias("lines_kept"), F.count_if(line & ~kept).alias("lines_skipped"),
        total(~line & kept, F.col("area")).alias("area_kept"), total(~line & ~kept, F.col("area")).alias("area_skipped"),
        total(line & kept, F.col("length")).alias("length_kept"), total(line & ~kept, F.col("length")).alias("length_skipped"),
    )


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows in the order of a seeded hash, the same on every run."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)
