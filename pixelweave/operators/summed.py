"""Sums over rectangles of a raster from summed areas, at four look-ups each whatever their size.

A raster is cut into blocks. A block knows the sums of its own corners' rectangles, and what lies before it: above each of its
columns, left of each of its rows, and in the blocks above and left. The running sums go along rows and columns of
blocks, never over a whole raster, and no task holds more than a block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 64


def summed_areas(px: DataFrame, key: str = "scene", value: str = "v", block: int = BLOCK) -> DataFrame:
    """(key, br, bc, sums, above, left, corner) of whole-number px(key, r >= 0, c >= 0, value); missing pixels are zero.

    sums[i * (block + 1) + j]: the block's first i rows and j columns; above[j]: all rows above the block, its first j
    columns; left[i]: its first i rows, all columns left of it; corner: what is above and left of it. Blocks without pixels
    are there too, up to the last row and column of blocks.
    """
    kind = px.schema[key].dataType.simpleString()
    n = block + 1
    at = lambda c: F.floor(F.col(c) / block)
    cut = px.select(key, at("r").alias("br"), at("c").alias("bc"), "r", "c", F.col(value).cast("long").alias("v"))

    def run(df: pd.DataFrame) -> pd.DataFrame:
        g = np.zeros((n, n), np.int64)
        np.add.at(g, (df["r"] % block + 1, df["c"] % block + 1), df["v"].fillna(0).astype(np.int64))
        return pd.DataFrame({key: [df[key].iloc[0]], "br": [df["br"].iloc[0]], "bc": [df["bc"].iloc[0]], "sums": [g.cumsum(0).cumsum(1).ravel()]})

    own = cut.groupBy(key, "br", "bc").applyInPandas(run, f"`{key}` {kind}, br long, bc long, sums array<long>")
    ends = own.groupBy(key).agg(F.max("br").alias("h"), F.max("bc").alias("w"))
    every = ends.withColumn("br", F.explode(F.sequence(F.lit(0).cast("long"), "h"))).withColumn("bc", F.explode(F.sequence(F.lit(0).cast("long"), "w"))).select(key, "br", "bc")
    full = every.join(own, [key, "br", "bc"], "left").withColumn("sums", F.coalesce("sums", F.array_repeat(F.lit(0).cast("long"), n * n)))
    # sums of the lines before, entry by entry, along columns and rows of blocks
    last_row, last_column = F.slice("sums", block * n + 1, n), F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.element_at("sums", i * n))
    down = Window.partitionBy(key, "bc", "j").orderBy("br").rowsBetween(Window.unboundedPreceding, -1)
    along = Window.partitionBy(key, "br", "j").orderBy("bc").rowsBetween(Window.unboundedPreceding, -1)
    entry = lambda what: full.select(key, "br", "bc", F.posexplode(what).alias("j", "v"))
    before = lambda rows, w: rows.select(key, "br", "bc", "j", F.coalesce(F.sum("v").over(w), F.lit(0)).alias("v"))
    packed = lambda rows, name: rows.groupBy(key, "br", "bc").agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "v"))), lambda p: p["v"]).alias(name))
    above = before(entry(last_row), down)
    corner = above.where(F.col("j") == block).withColumn("v", F.coalesce(F.sum("v").over(along), F.lit(0))).select(key, "br", "bc", F.col("v").alias("corner"))
    out = full.join(packed(above, "above"), [key, "br", "bc"]).join(packed(before(entry(last_column), along), "left"), [key, "br", "bc"])
    return out.join(corner, [key, "br", "bc"])


def box_sums(boxes: DataFrame, areas: DataFrame, key: str = "scene", box: tuple = ("box_id",), block: int = BLOCK, name: str = "total") -> DataFrame:
    """(key, box, name): the sum over rows r0 <= r < r1 and columns c0 <= c < c1 of each of boxes(key, box, r0, c0, r1, c1).

    What lies off the raster counts as zero; the same for boxes without extent. boxes are distinct in key and box.
    """
    c = F.col
    ends = areas.groupBy(key).agg(F.max("br").alias("h"), F.max("bc").alias("w"))
    b = boxes.join(ends, key)
    held = lambda v, top: F.least(F.greatest(v.cast("long"), F.lit(0).cast("long")), (c(top) + 1) * block)
    ok = (c("r0") < c("r1")) & (c("c0") < c("c1"))
    corner = lambda r, cc, sign: F.struct(held(c(r), "h").alias("r"), held(c(cc), "w").alias("c"), F.lit(sign).alias("sign"))
    four = b.where(ok).select(key, *box, "h", "w", F.explode(F.array(corner("r1", "c1", 1), corner("r0", "c1", -1), corner("r1", "c0", -1), corner("r0", "c0", 1))).alias("p"))
    # a corner on the far side belongs to the last block
    block_of = lambda v, top: F.least(F.floor(v / block), c(top))
    placed = four.select(key, *box, block_of(c("p.r"), "h").alias("br"), block_of(c("p.c"), "w").alias("bc"), c("p.r").alias("r"), c("p.c").alias("c"), c("p.sign").alias("sign"))
    i, j = (c("r") - c("br") * block).cast("int"), (c("c") - c("bc") * block).cast("int")
    met = placed.join(areas, [key, "br", "bc"])
    value = F.element_at("sums", i * (block + 1) + j + 1) + F.element_at("above", j + 1) + F.element_at("left", i + 1) + c("corner")
    found = met.select(key, *box, (value * c("sign")).alias("v")).groupBy(key, *box).agg(F.sum("v").alias(name))
    return boxes.select(key, *box).join(found, [key, *box], "left").select(key, *box, F.coalesce(c(name), F.lit(0)).alias(name))


def share(total: Column, r0: Column, c0: Column, r1: Column, c1: Column) -> Column:
    """A sum of ones over the pixels of its rectangle."""
    return total / ((r1 - r0) * (c1 - c0))
