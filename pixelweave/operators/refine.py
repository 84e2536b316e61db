"""Refinement of label tiles by a second opinion on one class."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelweave.operators.nearest import fill_nearest


def refine_class(px: DataFrame, refined: DataFrame, cls: int, key: str = "tile", nodata: int = 0) -> DataFrame:
    """(key, r, c, cls): px(key, r, c, cls) where class `cls` lies as refined(key, r, c) has it and nowhere else.

    What was of that class, or is by the refined mask, is unknown at first; unknown pixels take the label of the nearest
    known one of their key, in whatever tile; then the mask's pixels get the class. Where no label is known it is nodata.
    """
    mark = refined.select(key, "r", "c").distinct().withColumn("hit", F.lit(True))
    met = px.select(key, "r", "c", "cls").join(mark, [key, "r", "c"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    open_ = met.select(key, "r", "c", F.when(~F.col("hit") & (F.col("cls") != cls), F.col("cls")).alias("cls"))
    filled = fill_nearest(open_, key).join(mark, [key, "r", "c"], "left")
    return filled.select(key, "r", "c", F.when(F.col("hit"), cls).otherwise(F.coalesce("cls", F.lit(nodata))).cast("int").alias("cls"))
