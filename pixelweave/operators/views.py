"""Virtual rasters over the driver's star-schema tables, as DataFrames and as SQL text of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLASSES = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pixel(li: DataFrame) -> DataFrame:
    return li.select(
        F.col("l_returnflag").alias("scene"), (F.col("l_suppkey") % 32).cast("int").alias("r"), (F.col("l_partkey") % 64).cast("int").alias("c"),
        F.col("l_linenumber").cast("int").alias("cls"), F.col("l_extendedprice").alias("v"), F.col("l_linestatus").alias("status"),
    )


def prob(spark, sf_dir) -> DataFrame:
    """Class probabilities by pixel: (scene, r, c, cls, v), the best value of each class."""
    return _pixel(table(spark, sf_dir, "lineitem")).where(F.col("cls") <= CLASSES).groupBy("scene", "r", "c", "cls").agg(F.max("v").alias("v"))


def raw_prob(spark, sf_dir) -> DataFrame:
    """All labelled values before a whitelist: (scene, label, r, c, v), v null where the discount is 0."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_returnflag").alias("scene"), F.concat(F.lit("class_"), F.col("l_linenumber")).alias("label"), (F.col("l_suppkey") % 32).cast("int").alias("r"), (F.col("l_partkey") % 64).cast("int").alias("c"), F.when(F.col("l_discount") > 0, F.col("l_extendedprice")).alias("v"))


def votes(spark, sf_dir) -> DataFrame:
    """One row for each vote: (scene, r, c, cls)."""
    return _pixel(table(spark, sf_dir, "lineitem")).where((F.col("status") == "O") & (F.col("cls") <= CLASSES)).select("scene", "r", "c", "cls")


def truth_votes(spark, sf_dir) -> DataFrame:
    return _pixel(table(spark, sf_dir, "lineitem")).where((F.col("status") == "F") & (F.col("cls") <= CLASSES)).select("scene", "r", "c", "cls")


def rgb(spark, sf_dir) -> DataFrame:
    """Pixels of images: (tile, y, x, r, g, b); the quantity of a line is its blue."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.concat_ws("/", "l_returnflag", "l_linestatus").alias("tile"), F.col("l_orderkey").alias("y"), F.col("l_linenumber").alias("x"),
        (F.col("l_partkey") % 256).cast("int").alias("r"), (F.col("l_suppkey") % 256).cast("int").alias("g"), F.least(F.lit(255), F.floor(F.col("l_quantity") * 5)).cast("int").alias("b"),
    )


def labelled(spark, sf_dir) -> DataFrame:
    """Truth and prediction: (zone, gt, pred) of vectors; label 0 is nodata."""
    e = table(spark, sf_dir, "embeddings")
    best = F.array_position(F.slice("embedding", 1, 10), F.array_max(F.slice("embedding", 1, 10))) - 1
    return e.select((F.col("vec_id") % 3).cast("int").alias("zone"), F.col("label").cast("int").alias("gt"), best.cast("int").alias("pred"))


def boxes(spark, sf_dir) -> DataFrame:
    """Tile boxes from parts: (box_id, x0, y0, x1, y1)."""
    p = table(spark, sf_dir, "part")
    x, y = (F.col("p_partkey") * 37) % 1000, (F.col("p_partkey") * 91) % 1000
    return p.select(F.col("p_partkey").alias("box_id"), x.cast("double").alias("x0"), y.cast("double").alias("y0"), (x + F.col("p_size")).cast("double").alias("x1"), (y + F.col("p_size")).cast("double").alias("y1"))


def zones(spark, sf_dir) -> DataFrame:
    """Zone boxes from nations: (layer, zone_id, x0, y0, x1, y1)."""
    n = table(spark, sf_dir, "nation")
    x, y = (F.col("n_nationkey") * 173) % 900, (F.col("n_nationkey") * 311) % 900
    return n.select(F.col("n_regionkey").alias("layer"), F.col("n_nationkey").alias("zone_id"), x.cast("double").alias("x0"), y.cast("double").alias("y0"), (x + 120).cast("double").alias("x1"), (y + 120).cast("double").alias("y1"))


def orthos(spark, sf_dir) -> DataFrame:
    """Catalogue rows from suppliers: (ortho_id, place, crs, width, height, path)."""
    s = table(spark, sf_dir, "supplier")
    return s.select(
        F.col("s_suppkey").alias("ortho_id"), F.col("s_nationkey").alias("place"), F.concat(F.lit("EPSG:327"), (F.col("s_nationkey") % 2 + 40).cast("string")).alias("crs"),
        (F.col("s_suppkey") % 7 * 32 + 64).cast("long").alias("width"), (F.col("s_suppkey") % 5 * 32 + 64).cast("long").alias("height"), F.concat(F.lit("20230101_"), F.col("s_name"), F.lit("_ortho.tif")).alias("path"),
    )


def sessions(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("session_id"), F.col("c_nationkey").alias("place"), F.concat(F.lit("20230101_"), F.regexp_replace("c_mktsegment", " ", "-"), F.lit("_ASV-"), F.col("c_custkey").cast("string")).alias("session"))


def masks(spark, sf_dir) -> DataFrame:
    """Mask pixels: (mask_id, r, c, on_) on a 32 x 64 grid for each scene and class, on where the class has a value above its floor."""
    p = prob(spark, sf_dir)
    return p.select(F.concat_ws("-", "scene", F.col("cls").cast("string")).alias("mask_id"), "r", "c", (F.col("v") > 40000).cast("int").alias("on_"))


#: The same views as SQL, to be put before a query as common table expressions.
SQL = {
    "prob": "SELECT l_returnflag AS scene, CAST(l_suppkey % 32 AS INT) AS r, CAST(l_partkey % 64 AS INT) AS c, CAST(l_linenumber AS INT) AS cls, max(l_extendedprice) AS v FROM lineitem WHERE l_linenumber <= 5 GROUP BY 1, 2, 3, 4",
    "raw_prob": "SELECT l_returnflag AS scene, 'class_' || CAST(l_linenumber AS VARCHAR) AS label, CAST(l_suppkey % 32 AS INT) AS r, CAST(l_partkey % 64 AS INT) AS c, CASE WHEN l_discount > 0 THEN l_extendedprice END AS v FROM lineitem",
    "votes": "SELECT l_returnflag AS scene, CAST(l_suppkey % 32 AS INT) AS r, CAST(l_partkey % 64 AS INT) AS c, CAST(l_linenumber AS INT) AS cls FROM lineitem WHERE l_linestatus = 'O' AND l_linenumber <= 5",
    "truth_votes": "SELECT l_returnflag AS scene, CAST(l_suppkey % 32 AS INT) AS r, CAST(l_partkey % 64 AS INT) AS c, CAST(l_linenumber AS INT) AS cls FROM lineitem WHERE l_linestatus = 'F' AND l_linenumber <= 5",
    "rgb": "SELECT l_returnflag || '/' || l_linestatus AS tile, l_orderkey AS y, l_linenumber AS x, CAST(l_partkey % 256 AS INT) AS r, CAST(l_suppkey % 256 AS INT) AS g, CAST(least(255, floor(l_quantity * 5)) AS INT) AS b FROM lineitem",
    "labelled": "SELECT CAST(vec_id % 3 AS INT) AS zone, CAST(label AS INT) AS gt, CAST(list_position(embedding[1:10], list_max(embedding[1:10])) - 1 AS INT) AS pred FROM embeddings",
    "boxes": "SELECT p_partkey AS box_id, CAST((p_partkey * 37) % 1000 AS DOUBLE) AS x0, CAST((p_partkey * 91) % 1000 AS DOUBLE) AS y0, CAST((p_partkey * 37) % 1000 + p_size AS DOUBLE) AS x1, CAST((p_partkey * 91) % 1000 + p_size AS DOUBLE) AS y1 FROM part",
    "zones": "SELECT n_regionkey AS layer, n_nationkey AS zone_id, CAST((n_nationkey * 173) % 900 AS DOUBLE) AS x0, CAST((n_nationkey * 311) % 900 AS DOUBLE) AS y0, CAST((n_nationkey * 173) % 900 + 120 AS DOUBLE) AS x1, CAST((n_nationkey * 311) % 900 + 120 AS DOUBLE) AS y1 FROM nation",
    "orthos": "SELECT s_suppkey AS ortho_id, s_nationkey AS place, 'EPSG:327' || CAST(s_nationkey % 2 + 40 AS VARCHAR) AS crs, CAST(s_suppkey % 7 * 32 + 64 AS BIGINT) AS width, CAST(s_suppkey % 5 * 32 + 64 AS BIGINT) AS height, '20230101_' || s_name || '_ortho.tif' AS path FROM supplier",
    "sessions": "SELECT c_custkey AS session_id, c_nationkey AS place, '20230101_' || replace(c_mktsegment, ' ', '-') || '_ASV-' || CAST(c_custkey AS VARCHAR) AS session FROM customer",
}
SQL["masks"] = f"SELECT scene || '-' || CAST(cls AS VARCHAR) AS mask_id, r, c, CAST(v > 40000 AS INT) AS on_ FROM ({SQL['prob']})"


def with_views(names: str, query: str) -> str:
    """A query after the named views."""
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names.split()) + (", " if query.lstrip().startswith(",,") else " ") + query.lstrip().removeprefix(",,")
