"""Label pyramids: each level made of the one below, in files that a window prunes.

A level's pixels are written in ranges of their Morton keys (the bits of row and column interleaved), sorted, so
that a window is a range of keys, which Parquet's statistics answer, and a test of what is within.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BITS = 24


def spread(v: Column) -> Column:
    """The bits of a whole number below 2^BITS at the even places of a long."""
    v = v.cast("long")
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = (v.bitwiseOR(F.shiftleft(v, shift))).bitwiseAND(F.lit(mask))
    return v


def morton(r: Column, c: Column) -> Column:
    return F.shiftleft(spread(r), 1).bitwiseOR(spread(c))


def spread_int(v: int) -> int:
    return reduce(lambda out, i: out | ((v >> i & 1) << 2 * i), range(BITS), 0)


def write_pyramid(px: DataFrame, path: str, levels: int, key: str = "scene", cls: str = "cls") -> None:
    """Write px(key, r, c, cls), rows and columns below 2^BITS, as level 0 and `levels` coarser ones under path/z=N.

    A pixel of the next level is what most of its up to four pixels are, of equals the lowest class; it is read from the files of
    the level below.
    """
    spark = px.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    now = px.select(key, F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), cls)
    for z in range(levels + 1):
        at = now.withColumn("morton", morton(F.col("r"), F.col("c")))
        at.repartitionByRange(max(1, parts >> (2 * z)), key, "morton").sortWithinPartitions(key, "morton").write.option("compression", "zstd").parquet(f"{path}/z={z}")
        below = spark.read.parquet(f"{path}/z={z}")
        half = lambda c: F.shiftright(c, 1)
        now = below.groupBy(key, half("r").alias("r"), half("c").alias("c")).agg(F.mode(cls, True).alias(cls))


def read_window(spark: SparkSession, path: str, z: int, r0: int, c0: int, r1: int, c1: int) -> DataFrame:
    """The pixels r0 <= r < r1, c0 <= c < c1 of a level: keys between those of the window's first and last corner, then the window itself."""
    rows = spark.read.parquet(f"{path}/z={z}")
    lo, hi = (spread_int(r) << 1 | spread_int(c) for r, c in ((r0, c0), (r1 - 1, c1 - 1)))
    return rows.where(F.col("morton").between(lo, hi) & F.col("r").between(r0, r1 - 1) & F.col("c").between(c0, c1 - 1)).drop("morton")
