"""Helpers shared by the corpus operators: shared-folder tables and distributed ranks."""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_LEFT: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. A local master, with one machine, may do without it."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='marlstone-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def stash(df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, and survives lost executors.

    Files go when the application ends, or earlier by drop(). zstd keeps the tables small on disk.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/marlstone-{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    _LEFT.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._stashed = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete stashed tables that no later plan reads."""
    for df in tables:
        path = getattr(df, "_stashed", None)
        if path:
            _delete(df.sparkSession, path)
            _LEFT[:] = [x for x in _LEFT if x[1] != path]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _sweep() -> None:
    for spark, path in _LEFT:
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # the JVM has ended already
            return


def trim() -> None:
    """Gives a worker's unused memory back to the system, at the end of a task: workers outlive tasks and share a machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def trimmed(task):
    """A task's function that trims at its end."""

    @functools.wraps(task)
    def run(*args, **more):
        yield from task(*args, **more)
        trim()

    return run


def word_pattern() -> str:
    return r"[^\x20\x09-\x0D]+"


def ranked(df: DataFrame, by: list[str], order: list[Column], cell: Column, cells: int, name: str) -> DataFrame:
    """Adds the rank (from 0) of each row within ``by``, ordered by (cell, order), without one task per group.

    ``cell`` is an int in [0, cells) that grows with the wanted order; each (by, cell) is ranked in a task of its own
    and starts at the rows before it. The table of starts has at most groups * cells rows; groups must be bounded.
    """
    at = df.withColumn("__cell", cell)
    sizes = at.groupBy(*by, "__cell").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*by).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*by, "__cell", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    own = Window.partitionBy(*by, "__cell").orderBy(*order)
    return (
        at.withColumn("__rn", F.row_number().over(own).cast("long") - 1)
        .join(F.broadcast(starts), [*by, "__cell"])
        .withColumn(name, F.col("__rn") + F.col("__start"))
        .drop("__rn", "__start", "__cell")
    )


BITS_A_ROW = 32768  # of a bitmap of bitmap_construct_agg: 4 KiB
BITMAPS = 4096


def among(df: DataFrame, hashes: DataFrame, col: str, count: int) -> DataFrame:
    """df with ``__hit``: false only if the long ``col`` isn't in the column ``h`` of hashes, which has about ``count`` rows.

    The hashes go out as a bitmap of at most BITMAPS rows of 4 KiB, 16 MiB, however many they are; with very many the
    bitmap fills and lets more rows pass. What is hit still has to be joined.
    """
    rows = 1
    while rows < BITMAPS and rows * BITS_A_ROW < 16 * count:
        rows *= 2
    cell = lambda c: F.pmod(F.xxhash64(c, F.lit(77)), F.lit(rows * BITS_A_ROW))
    at = hashes.select(cell(F.col("h")).alias("c")).select(F.floor(F.col("c") / BITS_A_ROW).cast("int").alias("__map"), F.pmod("c", F.lit(BITS_A_ROW)).alias("bit"))
    maps = at.groupBy("__map").agg(F.bitmap_construct_agg("bit").alias("__bits"))
    rowed = df.withColumn("__cell", cell(F.col(col))).withColumn("__at", F.floor(F.col("__cell") / BITS_A_ROW).cast("int"))
    byte = F.expr(f"cast(conv(hex(substring(__bits, cast(pmod(__cell, {BITS_A_ROW}) / 8 as int) + 1, 1)), 16, 10) as int)")
    hit = byte.bitwiseAND(F.expr("shiftleft(1, cast(pmod(__cell, 8) as int))")) != 0
    out = rowed.join(F.broadcast(maps), F.col("__at") == F.col("__map"), "left")
    return out.withColumn("__hit", F.coalesce(hit, F.lit(False))).drop("__cell", "__at", "__map", "__bits")
