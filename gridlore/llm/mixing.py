"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree, in DataFrame operations only.

1. Targets: the sources' weights share `share` times all words by water-filling under caps of `most`
   times a source's words.
2. Blocks: a source's documents fall into CELLS cells by a 64-bit hash; a cell's copy is a block. Each
   source's exact quota is the number of blocks that its target takes: all cells once a whole pass,
   then cells in hash order, the last one document by document.
3. Splitting tree: each node hands a uniformly random half of its quota tokens, drawn without
   replacement, to the left and the rest to the right, so the sources' counts in a child are
   multivariate hypergeometric and add up exactly. The half is found in two steps, by a hash's slices and
   then inside the slice that the half ends in, so that no task orders all tokens of a node.
4. Each source's blocks are permuted and cut by the leaves' quotas, so shards draw disjoint blocks; a
   hash orders the documents in a shard (`order_key`), so the shuffle is local.

A hot source is spread over its cells, and sums are aggregated before each shuffle; the tables of
cells and tokens have at most CELLS rows a source and pass, whatever the corpus. The cell that a quota ends in is
taken document by document: its part cells are summed first, so that only the documents of one of them, about one
in CELLS squared of a source, are ordered in one task.

Edge cases: a null text has no words; a null source is a source of its own, the last; documents without
words are taken as often as their cell; rows with a null doc_id are documents with one key; repeated rows are
documents of their own with equal keys, and the order of equal keys is that of their sizes; an empty table gives
an empty result; extra columns are ignored, or kept if `carry` names them, whatever their names: `source`, `size`
and the other columns of the result cannot be carried.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlore.llm.common import cut

#: Cells a source: the finest unit of the tree.
CELL_BITS = 10
#: Levels of the tree: 2**LEVELS output shards.
LEVELS = 4

#: The table of cells is broadcast up to so many rows (about 40 MB), and joined by a shuffle beyond; rows are the same.
SMALL_ROWS = 200_000
#: Slices of a node's tokens.
SLICE_BITS = 10

WEIGHTS = (5.0, 2.0, 1.0)
RESULT = ("doc_id", "source", "size", "source_size", "target", "draws")


def word_count(text: Column) -> Column:
    """The number of [^\\x20\\x09-\\x0D]+ in a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t-\\r]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target; sizes has source and source_size."""
    names = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(names) - 1) % len(weights) + 1).cast("int"))
    x = sizes.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    below = F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing))
    whole = F.sum("source_size").over(Window.partitionBy())
    x = x.withColumn("level", (share * whole - below) / rest)
    x = x.withColumn("full", F.col("level") * F.col("weight") >= F.col("cap"))
    level = F.first(F.when(~F.col("full"), F.col("level")), ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return x.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.least("cap", level * F.col("weight")))).select("source", "source_size", "target")


def split_quotas(tokens: DataFrame, levels: int, seed: int, rows: int | None = None) -> DataFrame:
    """shard, source, quota: the tree over tokens (about so many rows, if known), a row a block with its source and token number."""
    x = tokens.select("source", "token", F.lit(0).alias("node"))
    for level in range(levels):
        x = x.withColumn("draw", F.xxhash64(F.lit(seed + level), "source", "token"))
        x = x.withColumn("slice", F.shiftrightunsigned("draw", 64 - SLICE_BITS))
        slices = x.groupBy("node", "slice").agg(F.count(F.lit(1)).alias("n"))
        before = Window.partitionBy("node").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
        half = F.floor((F.sum("n").over(Window.partitionBy("node")) + F.col("node") % 2) / 2)
        # What is left of the half when a slice begins.
        slices = slices.select("node", "slice", (half - F.coalesce(F.sum("n").over(before), F.lit(0))).alias("left"))
        place = Window.partitionBy("node", "slice").orderBy("draw", "source", "token")
        x = x.withColumn("place", F.row_number().over(place)).join(slices, ["node", "slice"])
        x = x.select("source", "token", (F.col("node") * 2 + (F.col("place") > F.col("left")).cast("int")).alias("node"))
        if level % 4 == 3 and level + 1 < levels:
            x = cut(x, rows)
    return x.groupBy(F.col("node").alias("shard"), "source").agg(F.count(F.lit(1)).alias("quota"))


def mix_sources(docs: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 17, cell_bits: int = CELL_BITS, levels: int = LEVELS, carry: tuple = (), small_rows: int = SMALL_ROWS) -> DataFrame:
    """doc_id, source, size, source_size, target, and draws: (shard, order_key) of each copy the mix takes; carry names further columns to keep."""
    named = [c for c in carry if c in RESULT]
    if named:
        raise ValueError(f"the result has columns {named} of its own")
    kept = {c: f"_carried_{i}" for i, c in enumerate(carry)}
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), F.col("doc_id")).alias("key"), *(F.col(f"`{c}`").alias(k) for c, k in kept.items()))
    sized = sized.withColumn("cell", F.shiftrightunsigned("key", 64 - cell_bits))
    base = cut(sized.drop(*kept.values()))
    cells = cut(base.groupBy("source", "cell").agg(F.sum("size").alias("cell_size")))
    few = cells.count() * math.ceil(most)
    goal = targets(cells.groupBy("source").agg(F.sum("cell_size").alias("source_size")), weights, share, most)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    goal = goal.withColumn("passes", passes).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    in_order = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    planned = cells.join(goal.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    planned = planned.withColumn("before", F.coalesce(F.sum("cell_size").over(in_order), F.lit(0)))
    planned = planned.withColumn("need", F.col("rest") - F.col("before")).withColumn("more", (F.col("need") > 0).cast("int"))
    planned = cut(planned.withColumn("blocks", F.col("passes") + F.col("more")), few)

    block = planned.where(F.col("blocks") > 0).select("source", "cell", F.explode(F.sequence(F.lit(1), "blocks")).alias("copy"))
    permuted = block.withColumn("token", F.row_number().over(Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed + 100), "cell", "copy"), "cell", "copy")))
    quotas = split_quotas(permuted, levels, seed + 200, few)
    # A block goes to the first shard whose quota, summed over the shards before it, reaches the block's number.
    last = F.sum("quota").over(Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0))
    marks = quotas.select("source", last.alias("token"), "shard", F.lit(None).cast("long").alias("cell"), F.lit(None).cast("int").alias("copy"))
    marks = marks.unionByName(permuted.select("source", F.col("token").cast("long").alias("token"), F.lit(None).cast("int").alias("shard"), "cell", "copy"))
    down = Window.partitionBy("source").orderBy(F.desc("token"), F.col("cell").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    drawn = marks.withColumn("shard", F.last("shard", ignorenulls=True).over(down)).where(F.col("cell").isNotNull())
    shards = drawn.groupBy(F.col("source").alias("s"), F.col("cell").alias("c")).agg(F.transform(F.array_sort(F.collect_list(F.struct("copy", "shard"))), lambda x: x["shard"]).alias("shards"))

    plan = planned.join(shards, F.col("source").eqNullSafe(F.col("s")) & (F.col("cell") == F.col("c")), "left")
    plan = plan.select(F.col("source").alias("s"), F.col("cell").alias("c"), "cell_size", "source_size", "target", "passes", "need", "more", F.coalesce("shards", F.array().cast("array<int>")).alias("shards"))
    plan = cut(plan, few)
    small = plan.count() <= small_rows
    if small:
        plan = F.broadcast(plan)
    x = (sized if carry else base).join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("cell") == F.col("c")))
    partly = (F.col("more") == 1) & (F.col("need") < F.col("cell_size"))
    whole = x.where(~partly).withColumn("copies", F.size("shards"))

    # The cell that a quota ends in: its part cells' sums tell how much is left when a part cell begins.
    part = F.shiftrightunsigned(F.shiftleft("key", cell_bits), 64 - cell_bits)
    ends = planned.where(partly).select(F.col("source").alias("s"), F.col("cell").alias("c"), "need")
    ends = base.join(F.broadcast(ends) if small else ends, F.col("source").eqNullSafe(F.col("s")) & (F.col("cell") == F.col("c")))
    sums = ends.groupBy("s", part.alias("p")).agg(F.sum("size").alias("part_size"), F.first("need").alias("need"))
    before = Window.partitionBy("s").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("s").alias("ps"), "p", "part_size", (F.col("need") - F.coalesce(F.sum("part_size").over(before), F.lit(0))).alias("left"))
    cut_cell = x.where(partly).withColumn("part", part).join(sums, F.col("source").eqNullSafe(F.col("ps")) & (F.col("part") == F.col("p")))
    split = (F.col("left") > 0) & (F.col("left") < F.col("part_size"))
    clear = cut_cell.where(~split).withColumn("copies", F.size("shards") - (F.col("left") <= 0).cast("int"))
    edge = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    last = cut_cell.where(split).withColumn("upto", F.sum("size").over(edge))
    last = last.withColumn("copies", F.size("shards") - (F.col("upto") - F.col("size") / 2 > F.col("left")).cast("int")).drop("upto")
    extra = ("part", "ps", "p", "part_size", "left")
    draws = F.transform(F.slice("shards", F.lit(1), F.col("copies")), lambda s, i: F.struct(s.alias("shard"), F.xxhash64(F.lit(seed + 300), F.col("doc_id"), i).alias("order_key")))
    taken = whole.unionByName(clear.drop(*extra)).unionByName(last.drop(*extra))
    return taken.select("doc_id", "source", "size", "source_size", "target", draws.alias("draws"), *(F.col(k).alias(c) for c, k in kept.items()))
