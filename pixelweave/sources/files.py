"""File sources with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave import schemas


def ortho_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.ORTHO_CSV).option("header", True).csv(path)


def session_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.SESSION_CSV).option("header", True).csv(path)


def gps_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.GPS).option("header", True).csv(path)


def geojson(spark: SparkSession, path: str, layer: str) -> DataFrame:
    """(layer, feature_id, crs, part, ring, seq, x, y) of polygons and multipolygons; features without geometry give no rows."""
    kind = "type string, coordinates string"
    schema = f"crs struct<properties:struct<name:string>>, features array<struct<geometry:struct<{kind.replace(' ', ':').replace(',:', ',')}>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    f = rows.select(F.col("crs.properties.name").alias("crs"), F.posexplode("features").alias("feature_id", "f")).where("f.geometry is not null")
    multi = F.when(F.col("f.geometry.type") == "Polygon", F.concat(F.lit("["), F.col("f.geometry.coordinates"), F.lit("]"))).otherwise(F.col("f.geometry.coordinates"))
    parts = f.select("crs", "feature_id", F.posexplode(F.from_json(multi, "array<array<array<array<double>>>>")).alias("part", "p"))
    rings = parts.select("crs", "feature_id", "part", F.posexplode("p").alias("ring", "pts"))
    pts = rings.select("crs", "feature_id", "part", "ring", F.posexplode("pts").alias("seq", "xy"))
    return pts.select(F.lit(layer).alias("layer"), "feature_id", "crs", "part", "ring", "seq", F.col("xy")[0].alias("x"), F.col("xy")[1].alias("y"))


def geojson_lines(spark: SparkSession, path: str, layer: str) -> DataFrame:
    """(layer, feature_id, part, ring, seq, x, y) of features with a numeric id, one a line, read in parallel; features without geometry give no rows."""
    f = spark.read.schema("id long, geometry struct<type:string,coordinates:string>").json(path).where("geometry is not null")
    multi = F.when(F.col("geometry.type") == "Polygon", F.concat(F.lit("["), F.col("geometry.coordinates"), F.lit("]"))).when(F.col("geometry.type") == "MultiPolygon", F.col("geometry.coordinates"))
    parts = f.select(F.col("id").alias("feature_id"), F.posexplode(F.from_json(multi, "array<array<array<array<double>>>>")).alias("part", "p"))
    rings = parts.select("feature_id", "part", F.posexplode("p").alias("ring", "pts"))
    pts = rings.select("feature_id", "part", "ring", F.posexplode("pts").alias("seq", "xy"))
    return pts.select(F.lit(layer).alias("layer"), "feature_id", "part", "ring", "seq", F.col("xy")[0].alias("x"), F.col("xy")[1].alias("y"))


def env_file(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of lines key=value; a line without exactly one equals sign raises."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parts = F.split("value", "=")
    ok = F.when(F.size(parts) == 2, parts).otherwise(F.raise_error(F.concat(F.lit("not key=value: "), F.col("value"))).cast("array<string>"))
    return lines.select(ok.alias("p")).select(F.trim(F.col("p")[0]).alias("key"), F.trim(F.col("p")[1]).alias("value"))


def colour_table(spark: SparkSession, path: str) -> DataFrame:
    """(cls, r, g, b, a) of space-separated lines; nodata entries are left out."""
    p = F.split(F.trim("value"), " +")
    rows = spark.read.text(path).where(F.trim("value") != "").select(p.alias("p")).where(~F.col("p")[0].isin("-9999", "nan", "nv", "0"))
    return rows.select(F.col("p")[0].cast("int").alias("cls"), *[F.get("p", i).cast("int").alias(n) for i, n in enumerate("rgba", 1)])


def list_rasters(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of .tif files below a folder, in order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length").where(F.lower("path").endswith(".tif")).orderBy("path")


def checked(df: DataFrame, content: str, expected: str, name: str = "intact") -> DataFrame:
    """df with whether the MD5 of a text or binary column is the expected one (hex, any case); null where either is missing."""
    return df.withColumn(name, F.md5(F.col(content).cast("binary")) == F.lower(expected))
