"""Queries over structures that cross tiles: regions, nearest labels, polygons with holes, unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelweave.operators import nearest, polygons, regions, views
from pixelweave.operators.views import with_views
from pixelweave.plans.registry import query
from pixelweave.scratch import scratch_path

#: Small, so that the tables' rasters of 32 x 64 pixels are cut many times.
TILE = 8


def region_sql(on: str, rest: str) -> str:
    """Least first pixel of each region of the masks' cells where `on`, passed on from neighbour to neighbour; then `rest`."""
    return with_views("masks", f""",,px AS (SELECT mask_id, r, c FROM masks WHERE {on}),
      lab AS (WITH RECURSIVE t(mask_id, r, c, l) USING KEY (mask_id, r, c) AS (
        SELECT mask_id, r, c, r * 64 + c FROM px
        UNION
        SELECT k.mask_id, k.r, k.c, min(d.l) FROM t d JOIN recurring.t k ON k.mask_id = d.mask_id AND k.r BETWEEN d.r - 1 AND d.r + 1 AND k.c BETWEEN d.c - 1 AND d.c + 1 GROUP BY k.mask_id, k.r, k.c, k.l HAVING min(d.l) < k.l)
        SELECT mask_id, r, c, l FROM t),
      area AS (SELECT mask_id, l, count(*) AS area FROM lab GROUP BY 1, 2) {rest}""")


@query("AGG31_components_tiles", region_sql("on_ = 1", "SELECT mask_id, r, c, CAST(l // 64 AS INT) AS top, CAST(l % 64 AS INT) AS leftmost, area FROM lab JOIN area USING (mask_id, l)"))
def agg31_tiles(spark, sf):
    found = regions.components(views.masks(spark, sf), tile=TILE)
    return found.select("mask_id", "r", "c", regions.first_row(F.col("region")).alias("top"), regions.first_column(F.col("region")).alias("leftmost"), "area")


def islands_sql(least: int) -> str:
    """The masks without regions below `least` pixels, or with the largest alone where all are."""
    return f"SELECT m.mask_id, m.r, m.c, CASE WHEN a.area >= {least} OR b.l = a.l THEN 1 ELSE 0 END AS on_ FROM masks m LEFT JOIN lab USING (mask_id, r, c) LEFT JOIN area a ON a.mask_id = lab.mask_id AND a.l = lab.l LEFT JOIN (SELECT mask_id, arg_max(l, row(area, -l)) AS l FROM area GROUP BY 1 HAVING max(area) < {least}) b ON b.mask_id = m.mask_id"


@query("AGG31_islands_tiles", region_sql("on_ = 1", islands_sql(12)))
def agg31_islands(spark, sf):
    return regions.remove_small(views.masks(spark, sf), 12, tile=TILE)


@query("AGG31_holes_tiles", region_sql("on_ = 0", "SELECT m.mask_id, m.r, m.c, CASE WHEN m.on_ = 1 OR a.area < 12 THEN 1 ELSE 0 END AS on_ FROM masks m LEFT JOIN lab USING (mask_id, r, c) LEFT JOIN area a ON a.mask_id = lab.mask_id AND a.l = lab.l"))
def agg31_holes(spark, sf):
    return regions.remove_small(views.masks(spark, sf), 12, "holes", tile=TILE)


MOSAIC_PX = "SELECT r, c + 64 * (ascii(scene) % 3) AS c, CASE WHEN min(cls) > 1 THEN NULL ELSE max(CASE WHEN v > 30000 THEN 2 ELSE 1 END) END AS cls FROM prob GROUP BY scene, 1, 2"


def mosaic_px(spark, sf):
    """The scenes side by side as one raster, most pixels without a label."""
    p = views.prob(spark, sf).groupBy("scene", "r", "c").agg(F.when(F.min("cls") <= 1, F.max(F.when(F.col("v") > 30000, 2).otherwise(1))).alias("cls"))
    return p.select(F.lit("all").alias("tile"), "r", (F.col("c") + 64 * (F.ascii("scene") % 3)).cast("int").alias("c"), "cls")


@query("JON17_fill_nearest_mosaic", with_views("prob", f",,t AS ({MOSAIC_PX}), k AS (SELECT r, c, cls FROM t WHERE cls IS NOT NULL) SELECT t.r, t.c, arg_min(k.cls, row((k.r - t.r) * (k.r - t.r) + (k.c - t.c) * (k.c - t.c), k.r, k.c)) AS cls FROM t LEFT JOIN k ON true GROUP BY 1, 2"))
def jon17_mosaic(spark, sf):
    """Labels cross scenes, so that no tile's border stops them."""
    return nearest.fill_nearest(mosaic_px(spark, sf)).select("r", "c", "cls")


@query("UDF04_distance_indices", with_views("prob", f",,t AS ({MOSAIC_PX}), k AS (SELECT r, c FROM t WHERE cls IS NOT NULL), d AS (SELECT t.r, t.c, min(row((k.r - t.r) * (k.r - t.r) + (k.c - t.c) * (k.c - t.c), k.r, k.c)) AS m FROM t JOIN k ON true WHERE t.cls IS NULL GROUP BY 1, 2) SELECT r, c, CAST(m[1] AS BIGINT) AS d2, CAST(m[2] AS BIGINT) AS source_r, CAST(m[3] AS BIGINT) AS source_c FROM d"))
def udf04_indices(spark, sf):
    """Squared distance to the nearest label, and which it is."""
    px = mosaic_px(spark, sf)
    found = nearest.nearest(px.where("cls IS NULL").select("tile", "r", "c"), px.where("cls IS NOT NULL").select("tile", "r", "c"))
    return found.where("d2 IS NOT NULL").select("r", "c", "d2", "source_r", "source_c")


def squares(*rings: tuple) -> str:
    """GeoJSON rings of squares (offset x, offset y, side) from a zone's corner, as SQL text of an expression."""
    one = lambda dx, dy, s: "array(" + ", ".join(f"array(x0 + {dx + i * s}, y0 + {dy + j * s})" for i, j in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))) + ")"
    return "array(" + ", ".join(one(*r) for r in rings) + ")"


def zone_layer(spark, sf, kind: str, coordinates: str):
    """The zones as GeoJSON, one feature a line, written and read again: edges (layer, feature_id, ax, ay, bx, by)."""
    from pixelweave.sources import files

    path = scratch_path(spark, "features")
    geometry = F.struct(F.lit(kind).alias("type"), F.expr(coordinates).alias("coordinates"))
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), F.col("zone_id").alias("id"), geometry.alias("geometry")))
    views.zones(spark, sf).select(F.concat(F.lit("layer="), F.col("layer").cast("string")).alias("layer"), feature.alias("value")).write.partitionBy("layer").text(path)
    return polygons.ring_edges(files.geojson_lines(spark, path, "zones"), ("feature_id",))


#: A square of 120 with a hole of 40 in it, and a square of 30 apart.
HOLED = f"array({squares((0, 0, 120), (40, 40, 40))}, {squares((150, 10, 30))})"
IN_SHELL = "(z.x0 <= b.x0 AND z.x0 + 120 >= b.x1 AND z.y0 <= b.y0 AND z.y0 + 120 >= b.y1)"
IN_PART = "(z.x0 + 150 <= b.x0 AND z.x0 + 180 >= b.x1 AND z.y0 + 10 <= b.y0 AND z.y0 + 40 >= b.y1)"
OFF_HOLE = "(b.x1 <= z.x0 + 40 OR b.x0 >= z.x0 + 80 OR b.y1 <= z.y0 + 40 OR b.y0 >= z.y0 + 80)"
AT_SHELL = "(z.x0 <= b.x1 AND z.x0 + 120 >= b.x0 AND z.y0 <= b.y1 AND z.y0 + 120 >= b.y0)"
AT_PART = "(z.x0 + 150 <= b.x1 AND z.x0 + 180 >= b.x0 AND z.y0 + 10 <= b.y1 AND z.y0 + 40 >= b.y0)"
IN_HOLE = "(b.x0 > z.x0 + 40 AND b.x1 < z.x0 + 80 AND b.y0 > z.y0 + 40 AND b.y1 < z.y0 + 80)"
CONTAINS = f"({IN_SHELL} AND {OFF_HOLE} OR {IN_PART})"
MEETS = f"({AT_SHELL} AND NOT {IN_HOLE} OR {AT_PART})"
ONE = ("feature_id",)


def holed_cells(spark, sf):
    return polygons.cover_cells(zone_layer(spark, sf, "MultiPolygon", HOLED), ONE)


@query("FLT09_holed_contains", with_views("boxes zones", f"SELECT b.box_id FROM boxes b WHERE EXISTS (SELECT 1 FROM zones z WHERE {CONTAINS})"))
def flt09_holed(spark, sf):
    return polygons.in_polygons(views.boxes(spark, sf), holed_cells(spark, sf), keys=ONE).select("box_id")


@query("FLT10_holed_intersects", with_views("boxes zones", f"SELECT b.box_id, z.zone_id FROM boxes b, zones z WHERE {MEETS}"))
def flt10_holed(spark, sf):
    return polygons.relate(views.boxes(spark, sf), holed_cells(spark, sf), keys=ONE).select("box_id", F.col("feature_id").cast("int").alias("zone_id"))


@query("JON04_tiles_in_holed", with_views("boxes zones", f"SELECT b.box_id, z.zone_id FROM boxes b, zones z WHERE {CONTAINS}"))
def jon04_holed(spark, sf):
    return polygons.relate(views.boxes(spark, sf), holed_cells(spark, sf), keys=ONE).where("contains").select("box_id", F.col("feature_id").cast("int").alias("zone_id"))


@query("JON05_any_holed_layer", with_views("boxes zones", f"SELECT b.box_id FROM boxes b WHERE EXISTS (SELECT 1 FROM zones z WHERE {MEETS})"))
def jon05_holed(spark, sf):
    return polygons.in_polygons(views.boxes(spark, sf), holed_cells(spark, sf), "intersects", keys=ONE).select("box_id")


@query("JON06_holed_split", with_views("boxes zones", f"SELECT b.box_id, EXISTS (SELECT 1 FROM zones z WHERE {MEETS}) AS touches FROM boxes b"))
def jon06_holed(spark, sf):
    """The tiles outside the polygons and, marked, the complement list."""
    return polygons.split_by(views.boxes(spark, sf), holed_cells(spark, sf), keys=ONE).select("box_id", "touches")


#: Each zone in two halves, so that boxes lie in the union which no member contains.
HALVES = "array(array(array(array(x0, y0), array(x0 + 60, y0), array(x0 + 60, y0 + 120), array(x0, y0 + 120), array(x0, y0))), array(array(array(x0 + 60, y0), array(x0 + 120, y0), array(x0 + 120, y0 + 120), array(x0 + 60, y0 + 120), array(x0 + 60, y0))))"
UNITS = "u AS (SELECT box_id, x.x AS x, y.y AS y FROM boxes b, LATERAL (SELECT unnest(generate_series(CAST(x0 AS BIGINT), CAST(x1 AS BIGINT) - 1)) AS x) x, LATERAL (SELECT unnest(generate_series(CAST(y0 AS BIGINT), CAST(y1 AS BIGINT) - 1)) AS y) y), hit AS (SELECT DISTINCT box_id, x, y FROM u JOIN zones z ON x >= z.x0 AND x < z.x1 AND y >= z.y0 AND y < z.y1)"


def half_cells(spark, sf):
    """The halves of the zones as features of their own."""
    from pixelweave.sources import files

    path = scratch_path(spark, "halves")
    parts = views.zones(spark, sf).select("zone_id", F.posexplode(F.expr(HALVES)).alias("half", "ring"))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.col("ring").alias("coordinates"))
    parts.select(F.to_json(F.struct((2 * F.col("zone_id") + F.col("half")).alias("id"), geometry.alias("geometry"))).alias("value")).write.text(path)
    return polygons.cover_cells(polygons.ring_edges(files.geojson_lines(spark, path, "halves"), ONE), ONE)


@query("AGG21_union_contains", with_views("boxes zones", f",,{UNITS}, n AS (SELECT box_id, count(*) AS n FROM hit GROUP BY 1) SELECT box_id, CAST(n AS DOUBLE) AS area, n = (x1 - x0) * (y1 - y0) AS covered FROM n JOIN boxes USING (box_id)"))
def agg21_contains(spark, sf):
    """How much of each box lies in the union, and whether all of it does."""
    found = polygons.coverage(views.boxes(spark, sf), half_cells(spark, sf), keys=ONE)
    return found.where("area > 0").select("box_id", F.round("area", 6).alias("area"), "covered")


@query("AGG21_union_area", with_views("zones", "SELECT CAST(count(*) AS DOUBLE) AS area FROM (SELECT DISTINCT x.x, y.y FROM zones z, LATERAL (SELECT unnest(generate_series(CAST(z.x0 AS BIGINT), CAST(z.x1 AS BIGINT) - 1)) AS x) x, LATERAL (SELECT unnest(generate_series(CAST(z.y0 AS BIGINT), CAST(z.y1 AS BIGINT) - 1)) AS y) y)"))
def agg21_area(spark, sf):
    """The area of the union, summed over a grid of tiles of which each is swept on its own."""
    ends = views.zones(spark, sf).agg(*[f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))])
    steps = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / 90), F.floor(F.col(hi) / 90)))
    at = ends.withColumn("i", steps("x0", "x1")).withColumn("j", steps("y0", "y1"))
    tiles = at.select((F.col("i") * 1000 + F.col("j")).alias("box_id"), (F.col("i") * 90.0).alias("x0"), (F.col("j") * 90.0).alias("y0"), (F.col("i") * 90.0 + 90).alias("x1"), (F.col("j") * 90.0 + 90).alias("y1"))
    return polygons.coverage(tiles, half_cells(spark, sf), keys=ONE).agg(F.round(F.sum("area"), 6).alias("area"))


CORNER = "greatest(z.x0 - {x}, 0, {x} - z.x1) * greatest(z.x0 - {x}, 0, {x} - z.x1) + greatest(z.y0 - {y}, 0, {y} - z.y1) * greatest(z.y0 - {y}, 0, {y} - z.y1) <= 30.25"


@query("PRJ24_round_buffer", with_views("boxes zones", "SELECT b.box_id, z.zone_id FROM boxes b, zones z WHERE " + " AND ".join(CORNER.format(x=x, y=y) for x in ("b.x0", "b.x1") for y in ("b.y0", "b.y1"))))
def prj24_round(spark, sf):
    """Boxes within zones grown by 5.5 with round corners."""
    grown = polygons.buffered(zone_layer(spark, sf, "Polygon", squares((0, 0, 120))), 5.5, ONE)
    cells = polygons.cover_cells(grown, ("feature_id", "part"))
    found = polygons.coverage(views.boxes(spark, sf), cells, keys=("feature_id", "part"), over=ONE)
    return found.where("covered").select("box_id", F.col("feature_id").cast("int").alias("zone_id"))
