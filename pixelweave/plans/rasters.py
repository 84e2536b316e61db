"""Queries of resized logits, suppression in rounds, global numbers, summed areas and pyramids."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelweave.operators import grid, numbering, summed, suppress, views
from pixelweave.operators.views import CLASSES, table, with_views
from pixelweave.plans.registry import query
from pixelweave.plans.windows_scalars import nms_sql
from pixelweave.scratch import scratch_path, stage
from pixelweave.sources import pyramid


def weight_sql(src: int, dst: int, of: str) -> str:
    """(t, s, w): targets, sources and weights of one axis, named `of`."""
    return f"{of}p AS (SELECT t, greatest((t + 0.5) * {src} / {dst} - 0.5, 0e0) AS p FROM (SELECT unnest(generate_series(0, {dst - 1})) AS t)), {of} AS (SELECT t, CAST(floor(p) AS INT) AS s, 1 - (p - floor(p)) AS w FROM {of}p UNION ALL SELECT t, least(CAST(floor(p) AS INT) + 1, {src - 1}), p - floor(p) FROM {of}p)"


def resize_sql(height: int, width: int) -> str:
    return with_views("prob", f""",,{weight_sql(32, height, 'wr')}, {weight_sql(64, width, 'wc')}, k AS (SELECT unnest(generate_series(1, {CLASSES})) AS cls),
      seen AS (SELECT scene, wr.t AS r, wc.t AS c, k.cls, round(sum(CASE WHEN prob.cls = k.cls THEN v * (wr.w * wc.w) ELSE 0 END), 4) AS v FROM prob JOIN wr ON wr.s = prob.r AND wr.w > 0 JOIN wc ON wc.s = prob.c AND wc.w > 0, k GROUP BY 1, 2, 3, 4)
      SELECT scene, r, c, CAST(arg_max(cls, row(v, -cls)) AS INT) AS cls, max(v) AS v FROM seen GROUP BY 1, 2, 3""")


def resized(spark, sf, height: int, width: int):
    out = grid.resize_bilinear(views.prob(spark, sf), CLASSES, 32, 64, height, width)
    out = out.withColumn("values", F.transform("values", lambda v: F.round(v, 4)))
    return out.select("scene", "r", "c", grid.label_of(F.col("values")).alias("cls"), F.array_max("values").alias("v"))


@query("PRJ10_bilinear_labels", resize_sql(80, 100))
def prj10_bilinear(spark, sf):
    """Logits enlarged, by different factors each way, before the label is chosen."""
    return resized(spark, sf, 80, 100)


@query("PRJ10_bilinear_reduced", resize_sql(20, 64))
def prj10_reduced(spark, sf):
    return resized(spark, sf, 20, 64)


@query("WIN05_nms_rounds", nms_sql("box_id % 3", "x0 % 150", "y0 % 150", 0.3))
def win05_rounds(spark, sf):
    x, y = F.col("x0") % 150, F.col("y0") % 150
    b = views.boxes(spark, sf).select((F.col("box_id") % 3).alias("image"), "box_id", x.alias("x0"), y.alias("y0"), (x + F.col("x1") - F.col("x0")).alias("x1"), (y + F.col("y1") - F.col("y0")).alias("y1"), (F.col("box_id") * 13 % 101 / 101).alias("score"))
    return suppress.suppress(b, "image", 0.3, small=50).select("image", "box_id")


@query("SRT01_numbered", "SELECT l_orderkey, l_linenumber, l_shipdate, row_number() OVER (ORDER BY l_shipdate, l_orderkey DESC, l_linenumber) AS place FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_shipdate FROM lineitem)")
def srt01_numbered(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate").distinct()
    return numbering.number_rows(rows, ["l_shipdate", F.desc("l_orderkey"), "l_linenumber"])


@query("SRT02_resume_numbered", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey OFFSET 1000")
def srt02_numbered(spark, sf):
    return numbering.resume_after(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], 1000)


@query("WIN09_batches_global", "SELECT p_partkey, CAST(floor((row_number() OVER (ORDER BY p_retailprice, p_partkey) - 1) / 64) AS BIGINT) AS batch FROM part")
def win09_global(spark, sf):
    """Batches of consecutive rows of the whole table."""
    return numbering.batches(table(spark, sf, "part").select("p_partkey", "p_retailprice"), ["p_retailprice", "p_partkey"], 64).select("p_partkey", "batch")


DARK = "SELECT scene, r, c, CASE WHEN max(v) < 45000 THEN 1 ELSE 0 END AS v FROM prob GROUP BY 1, 2, 3"


def dark(spark, sf):
    return views.prob(spark, sf).groupBy("scene", "r", "c").agg((F.max("v") < 45000).cast("int").alias("v"))


@query("AGG04_overlapping_tiles", with_views("prob", f",,d AS ({DARK}), t AS (SELECT scene, x.x AS tile_x, y.y AS tile_y FROM (SELECT DISTINCT scene FROM prob), (SELECT unnest(generate_series(0, 48, 3)) AS x) x, (SELECT unnest(generate_series(0, 16, 2)) AS y) y) SELECT t.scene, tile_x, tile_y, coalesce(sum(v), 0) / 256 AS share FROM t LEFT JOIN d ON d.scene = t.scene AND c >= tile_x AND c < tile_x + 16 AND r >= tile_y AND r < tile_y + 16 GROUP BY 1, 2, 3"))
def agg04_overlapping(spark, sf):
    """The dark share of tiles that overlap by most of their area, at four look-ups a tile."""
    px = dark(spark, sf)
    areas = stage(summed.summed_areas(px, block=8), "summed")
    tiles = px.select("scene").distinct().withColumn("tile_x", F.explode(F.sequence(F.lit(0), F.lit(48), F.lit(3)))).withColumn("tile_y", F.explode(F.sequence(F.lit(0), F.lit(16), F.lit(2))))
    at = tiles.select("scene", "tile_x", "tile_y", F.col("tile_y").alias("r0"), F.col("tile_x").alias("c0"), (F.col("tile_y") + 16).alias("r1"), (F.col("tile_x") + 16).alias("c1"))
    return summed.box_sums(at, areas, box=("tile_x", "tile_y"), block=8).select("scene", "tile_x", "tile_y", (F.col("total") / 256).alias("share"))


@query("AGG30_strips_summed", with_views("prob boxes", f",,d AS ({DARK}), b AS (SELECT box_id, ['A', 'N', 'R'][CAST(box_id % 3 AS INT) + 1] AS scene, CAST(x0 AS BIGINT) % 64 AS c0, CAST(y0 AS BIGINT) % 32 AS r0, CAST(x0 AS BIGINT) % 64 + CAST(x1 - x0 AS BIGINT) AS c1, CAST(y0 AS BIGINT) % 32 + CAST(y1 - y0 AS BIGINT) AS r1 FROM boxes) SELECT box_id, CAST(coalesce(sum(v), 0) AS BIGINT) AS left_sum FROM b LEFT JOIN d ON d.scene = b.scene AND r >= r0 AND r < r1 AND c >= c0 - 5 AND c < c0 WHERE b.scene IN (SELECT scene FROM prob) GROUP BY 1"))
def agg30_strips(spark, sf):
    """Dark pixels in the strip left of each box, boxes that leave the raster included."""
    areas = stage(summed.summed_areas(dark(spark, sf), block=8), "summed")
    c = F.col
    scene = F.element_at(F.array(F.lit("A"), F.lit("N"), F.lit("R")), (c("box_id") % 3).cast("int") + 1)
    b = views.boxes(spark, sf).select(scene.alias("scene"), "box_id", (c("y0") % 32).cast("long").alias("r0"), (c("x0") % 64).cast("long").alias("x"), (c("y1") - c("y0")).cast("long").alias("h"))
    at = b.select("scene", "box_id", "r0", (c("x") - 5).alias("c0"), (c("r0") + c("h")).alias("r1"), c("x").alias("c1"))
    known = at.join(areas.select("scene").distinct(), "scene", "left_semi")
    return summed.box_sums(known, areas, block=8, name="left_sum").select("box_id", "left_sum")


LEVELS = "z0 AS (SELECT scene, r, c, min(cls) AS cls FROM prob GROUP BY 1, 2, 3)" + "".join(
    f", n{z} AS (SELECT scene, r // 2 AS r, c // 2 AS c, cls, count(*) AS n FROM z{z - 1} GROUP BY 1, 2, 3, 4), z{z} AS (SELECT scene, r, c, arg_max(cls, row(n, -cls)) AS cls FROM n{z} GROUP BY 1, 2, 3)" for z in range(1, 5)
)


def pyramid_of(spark, sf) -> str:
    path = scratch_path(spark, "pyramid")
    pyramid.write_pyramid(views.prob(spark, sf).groupBy("scene", "r", "c").agg(F.min("cls").alias("cls")), path, 4)
    return path


@query("SNK13_label_pyramid", with_views("prob", f",,{LEVELS} " + " UNION ALL ".join(f"SELECT {z} AS z, scene, r, c, cls FROM z{z}" for z in range(5))))
def snk13_pyramid(spark, sf):
    """Five levels, each made of the files of the one below."""
    return spark.read.parquet(pyramid_of(spark, sf)).select("z", "scene", "r", "c", "cls")


@query("SNK13_pyramid_window", with_views("prob", f",,{LEVELS} SELECT scene, r, c, cls FROM z1 WHERE r BETWEEN 3 AND 12 AND c BETWEEN 5 AND 20"))
def snk13_window(spark, sf):
    return pyramid.read_window(spark, pyramid_of(spark, sf), 1, 3, 5, 13, 21)
