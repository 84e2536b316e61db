"""Sinks: partitioned Parquet for tiles and rasters, CSV for lists, and idempotent stages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_tiles(tiles: DataFrame, path: str, by: str = "ortho_id") -> None:
    tiles.write.mode("overwrite").option("compression", "zstd").partitionBy(by).parquet(path)


def write_classified(raster: DataFrame, path: str, names: dict[int, str], cls: str = "cls") -> None:
    """The class names travel as metadata of the class column."""
    tagged = raster.withColumn(cls, F.col(cls).alias(cls, metadata={str(k): v for k, v in names.items()}))
    tagged.write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_csv(rows: DataFrame, path: str, one_file: bool = False) -> None:
    """A folder of CSV files, each with the header; one file through one task if asked, for short lists."""
    (rows.coalesce(1) if one_file else rows).write.mode("overwrite").option("header", True).csv(path)


def write_once(rows: DataFrame, path: str) -> None:
    """Leaves an existing output as it is."""
    rows.write.mode("ignore").parquet(path)
