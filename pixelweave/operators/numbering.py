"""Numbers of rows in a global order, without a task that sees all of them.

Rows are dealt to ranges of the order and sorted within; a range is numbered by itself, and begins where the rows of the ranges
before it end. Only the counts of the ranges go through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelweave.scratch import stage

LOCAL = (1 << 33) - 1


def number_rows(df: DataFrame, order: list[str | Column], name: str = "place", start: int = 1) -> DataFrame:
    """df, sorted by `order` into ranges, with a column `name`: the number of each row, from `start`.

    Rows equal in `order` are numbered in any order, and may be dealt to several ranges. The sorted rows are written to
    the shared folder, so that numbers stay as they are when a task is repeated.
    """
    taken = [*df.columns, name]
    place, tie = ("_".join([n, *taken]) for n in ("at", "tie"))
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    marked = df.withColumn(tie, F.monotonically_increasing_id())
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = marked.repartitionByRange(parts, *by, tie).sortWithinPartitions(*by, tie).drop(tie)
    held = stage(dealt.withColumn(place, F.monotonically_increasing_id()), "numbered")
    part = F.shiftright(place, 33)
    before, starts = 0, []
    for r in sorted(held.groupBy(part.alias("p")).count().collect()):  # one row a range
        starts.append((r.p, before))
        before += r["count"]
    offsets = df.sparkSession.createDataFrame(starts, "p long, before long")
    out = held.join(F.broadcast(offsets), part == F.col("p"))
    return out.select(*df.columns, (F.col("before") + F.col(place).bitwiseAND(F.lit(LOCAL)) + start).alias(name))


def resume_after(df: DataFrame, order: list[str | Column], done: int) -> DataFrame:
    """df without its first `done` rows in `order`, which is unique; numbers as in number_rows(), no offset of a sorted whole."""
    at = "_".join(["place", *df.columns])
    return number_rows(df, order, at).where(F.col(at) > done).drop(at)


def batches(df: DataFrame, order: list[str | Column], size: int, name: str = "batch") -> DataFrame:
    """df with the number, from 0, of the batch of `size` consecutive rows that a row falls into."""
    at = "_".join(["place", *df.columns])
    return number_rows(df, order, at, 0).withColumn(name, F.floor(F.col(at) / size)).drop(at)
