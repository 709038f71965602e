"""Session helpers shared by the text operators."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder. Where none is set, local mode has a private one; a cluster raises."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    where = spark.sparkContext.getCheckpointDir()
    if not where:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + os.path.join(tempfile.gettempdir(), "gridlore-checkpoints")
        spark.sparkContext.setCheckpointDir(where)
    return where


#: Rows a file of a narrow table.
FILE_ROWS = 1 << 17


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back, so that lost executors cost no recomputation.

    rows: about how many narrow rows it has, where that is known; it is then written in as many files as they need, not one
    a shuffle partition. The folder is removed by `release`, or else when the driver's JVM ends."""
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(rows // FILE_ROWS + 1)
    path = f"{shared_checkpoint_dir(spark).rstrip('/')}/gridlore-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where, system = _files(spark, path)
    system.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def release(*tables: DataFrame) -> None:
    """Remove the folders of tables that `cut` wrote and that no plan will read again."""
    for x in tables:
        if getattr(x, "cut_path", None):
            where, system = _files(x.sparkSession, x.cut_path)
            system.delete(where, True)


def sweep(spark: SparkSession) -> None:
    """Let the engine remove the shuffle files that no plan will read again. It does so when the driver's JVM collects its
    garbage, which a driver that holds little may not do for a whole stage."""
    gc.collect()
    spark._jvm.System.gc()


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that the table does not have."""
    while stem in df.columns:
        stem += "_"
    return stem


#: The most frequent keys of a join that are looked at; any other key has at most one in HOT_KEYS of the rows.
HOT_KEYS = 4096
#: Rows from which one of them is dealt to parts, and the parts.
HOT_ROWS, HOT_PARTS = 256, 64


def spread_join(rows: DataFrame, table: DataFrame, key: str, how: str = "inner", keys: DataFrame | None = None) -> DataFrame:
    """rows joined to table, which has a row a key, by `key`; no task gets all rows of a hot key.

    The HOT_KEYS most frequent keys are broadcast, a bound that does not depend on the data. Rows of one with over
    HOT_ROWS rows are dealt to HOT_PARTS parts, and the table's row for it is copied to each. keys has the keys of
    rows, where rows themselves are dear to compute twice."""
    part, hot = fresh(rows, "_part"), fresh(rows, "_hot")
    counts = (rows if keys is None else keys).groupBy(F.col(key).alias(hot)).agg(F.count(F.lit(1)).alias("n"))
    hottest = counts.orderBy(F.desc("n"), hot).limit(HOT_KEYS).where(F.col("n") > HOT_ROWS).select(hot)
    # One more key, hot or not, keeps the plan the same where nothing is hot.
    hottest = F.broadcast(hottest.unionAll(rows.sparkSession.range(1).select(F.lit("0").cast(hottest.schema[0].dataType))).distinct())
    dealt = rows.join(hottest, F.col(key) == F.col(hot), "left")
    dealt = dealt.withColumn(part, F.when(F.col(hot).isNotNull(), F.pmod(F.xxhash64(*rows.columns), F.lit(HOT_PARTS))).otherwise(F.lit(0)).cast("int")).drop(hot)
    copies = table.join(hottest, F.col(key) == F.col(hot), "left")
    copies = copies.withColumn(part, F.explode(F.when(F.col(hot).isNotNull(), F.sequence(F.lit(0), F.lit(HOT_PARTS - 1))).otherwise(F.array(F.lit(0))))).drop(hot)
    return dealt.join(copies, [key, part], how).drop(part)


def total_bytes(df: DataFrame, column: str = "text") -> int:
    """Octets of a text column over the whole table."""
    return df.agg(F.sum(F.octet_length(F.col(column)))).first()[0] or 0


def column_bytes(array) -> list[bytes]:
    """A pyarrow text column as UTF-8 byte strings, null as empty."""
    import pyarrow as pa

    return [x or b"" for x in array.cast(pa.binary() if not pa.types.is_large_string(array.type) else pa.large_binary()).to_pylist()]


def byte_chunks(batches, column: str, limit: int = 2 << 20):
    """Yield (record batch slice, texts as bytes) of at most `limit` octets, one row at least; no text is cut.

    Only a slice's texts are copied out of the batch at a time."""
    import pyarrow.compute as pc

    for batch in batches:
        start, size = 0, 0
        for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
            if i > start and size + n > limit:
                part = batch.slice(start, i - start)
                yield part, column_bytes(part.column(column))
                start, size = i, 0
            size += n
        if start < batch.num_rows:
            part = batch.slice(start)
            yield part, column_bytes(part.column(column))
    give_back()


def give_back() -> None:
    """Return memory that a task no longer uses to the system: a worker is kept for later tasks, next to the engine's own memory."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library
