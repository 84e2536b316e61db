"""Spatial predicates and joins on boxes and rings, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def boxes_touch(a: str = "", b: str = "z_") -> Column:
    """Closed boxes that share a point."""
    c = F.col
    return (c(f"{a}x0") <= c(f"{b}x1")) & (c(f"{a}x1") >= c(f"{b}x0")) & (c(f"{a}y0") <= c(f"{b}y1")) & (c(f"{a}y1") >= c(f"{b}y0"))


def box_contains(outer: str = "z_", inner: str = "") -> Column:
    c = F.col
    return (c(f"{outer}x0") <= c(f"{inner}x0")) & (c(f"{outer}x1") >= c(f"{inner}x1")) & (c(f"{outer}y0") <= c(f"{inner}y0")) & (c(f"{outer}y1") >= c(f"{inner}y1"))


def point_in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd test against a closed ring array<struct<x,y>>."""
    edges = F.zip_with(ring, F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1)), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    crosses = F.filter(edges, lambda e: ((e["p"]["y"] > y) != (e["q"]["y"] > y)) & (x < (e["q"]["x"] - e["p"]["x"]) * (y - e["p"]["y"]) / (e["q"]["y"] - e["p"]["y"]) + e["p"]["x"]))
    return F.size(crosses) % 2 == 1


def _edges(ring: Column) -> Column:
    """Edges (p, q) of a ring, closed or not."""
    return F.zip_with(ring, F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1)), lambda p, q: F.struct(p.alias("p"), q.alias("q")))


def _edge_meets_box(e: Column, box: str, closed: bool) -> Column:
    """Separating axes of a segment and a box: the box's two and the segment's normal."""
    c = F.col
    cx, cy, hx, hy = (c(f"{box}x0") + c(f"{box}x1")) / 2, (c(f"{box}y0") + c(f"{box}y1")) / 2, (c(f"{box}x1") - c(f"{box}x0")) / 2, (c(f"{box}y1") - c(f"{box}y0")) / 2
    mx, my, dx, dy = (e["p"]["x"] + e["q"]["x"]) / 2 - cx, (e["p"]["y"] + e["q"]["y"]) / 2 - cy, (e["q"]["x"] - e["p"]["x"]) / 2, (e["q"]["y"] - e["p"]["y"]) / 2
    pairs = [(F.abs(mx), hx + F.abs(dx)), (F.abs(my), hy + F.abs(dy)), (F.abs(mx * dy - my * dx), hx * F.abs(dy) + hy * F.abs(dx))]
    tests = [a <= b if closed else a < b for a, b in pairs]
    return tests[0] & tests[1] & tests[2]


def ring_touches_box(ring: Column, box: str = "") -> Column:
    """A ring's area and a closed box share a point: an edge meets the box, or the box lies inside."""
    return F.exists(_edges(ring), lambda e: _edge_meets_box(e, box, True)) | point_in_ring(F.col(f"{box}x0"), F.col(f"{box}y0"), ring)


def ring_contains_box(ring: Column, box: str = "") -> Column:
    """No edge enters the box, and its centre is inside."""
    centre = point_in_ring((F.col(f"{box}x0") + F.col(f"{box}x1")) / 2, (F.col(f"{box}y0") + F.col(f"{box}y1")) / 2, ring)
    return centre & ~F.exists(_edges(ring), lambda e: _edge_meets_box(e, box, False))


def _cells(x0: Column, x1: Column, y0: Column, y1: Column, size: float) -> Column:
    span = lambda lo, hi: F.sequence(F.floor(lo / size).cast("long"), F.floor(hi / size).cast("long"))
    return F.flatten(F.transform(span(x0, x1), lambda i: F.transform(span(y0, y1), lambda j: F.struct(i.alias("ci"), j.alias("cj")))))


def spatial_join(boxes: DataFrame, zones: DataFrame, predicate: str = "contains", how: str = "left_semi", cell: float = 128.0, key: str = "box_id") -> DataFrame:
    """Boxes in, touching or (left_anti) not touching any zone.

    Both sides are dealt to grid cells, so candidates meet in an equi-join on the cell; the exact predicate
    follows. inner gives each pair once, with z_ columns. Zones with a column ring (array<struct<x,y>>) beside their
    bounding box are tested as polygons.
    """
    z = zones.select([F.col(c).alias(f"z_{c}") for c in zones.columns])
    if "ring" in zones.columns:
        test = boxes_touch() & (ring_contains_box(F.col("z_ring")) if predicate == "contains" else ring_touches_box(F.col("z_ring")))
    else:
        test = box_contains() if predicate == "contains" else boxes_touch()
    b_cells = boxes.withColumn("cell", F.explode(_cells(F.col("x0"), F.col("x1"), F.col("y0"), F.col("y1"), cell)))
    z_cells = z.withColumn("cell", F.explode(_cells(F.col("z_x0"), F.col("z_x1"), F.col("z_y0"), F.col("z_y1"), cell)))
    if how == "inner":
        return b_cells.join(z_cells, "cell").where(test).drop("cell").distinct()
    hits = b_cells.join(z_cells, "cell").where(test).select(key).distinct()
    return boxes.join(hits, key, how)


def with_bounds(rings: DataFrame) -> DataFrame:
    """rings(ring, ...) with the bounding box of each ring."""
    x, y = F.col("ring")["x"], F.col("ring")["y"]
    return rings.withColumns({"x0": F.array_min(x), "y0": F.array_min(y), "x1": F.array_max(x), "y1": F.array_max(y)})


def in_any_layer(boxes: DataFrame, zones: DataFrame, predicate: str = "intersects", key: str = "box_id") -> DataFrame:
    """Boxes that meet some zone; all of them where there is no zone at all."""
    return spatial_join(boxes, zones, predicate, key=key) if zones.limit(1).count() else boxes


def buffer_boxes(boxes: DataFrame, by: float) -> DataFrame:
    """Boxes grown (or shrunk) on all sides; those shrunk to nothing go."""
    out = boxes.withColumns({"x0": F.col("x0") - by, "y0": F.col("y0") - by, "x1": F.col("x1") + by, "y1": F.col("y1") + by})
    return out.where("x0 <= x1 AND y0 <= y1")


def utm_zone(lon: Column) -> Column:
    return (F.floor((lon + 180) / 6) + 1).cast("int")


def utm_epsg(lon: Column, lat: Column) -> Column:
    return F.when(lat >= 0, F.lit(32600)).otherwise(F.lit(32700)) + utm_zone(lon)


def utm_project(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Easting and northing (m) on the WGS84 ellipsoid by the transverse-Mercator series."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    e2 = f * (2 - f)
    ep2 = e2 / (1 - e2)
    lat_r, lon0 = F.radians(lat), F.radians((utm_zone(lon) - 1) * 6 - 180 + 3)
    n = a / F.sqrt(1 - e2 * F.sin(lat_r) ** 2)
    t, c, aa = F.tan(lat_r) ** 2, ep2 * F.cos(lat_r) ** 2, F.cos(lat_r) * (F.radians(lon) - lon0)
    m = a * (
        (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * lat_r
        - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(2 * lat_r)
        + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(4 * lat_r)
        - (35 * e2**3 / 3072) * F.sin(6 * lat_r)
    )
    east = k0 * n * (aa + (1 - t + c) * aa**3 / 6 + (5 - 18 * t + t**2 + 72 * c - 58 * ep2) * aa**5 / 120) + 500000.0
    north = k0 * (m + n * F.tan(lat_r) * (aa**2 / 2 + (5 - t + 9 * c + 4 * c**2) * aa**4 / 24 + (61 - 58 * t + t**2 + 600 * c - 330 * ep2) * aa**6 / 720))
    return east, north + F.when(lat < 0, F.lit(10000000.0)).otherwise(F.lit(0.0))


def utm_unproject(east: Column, north: Column, zone: Column, south: Column) -> tuple[Column, Column]:
    """Longitude and latitude (degrees) of UTM coordinates, by the series for the footpoint latitude."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    e2 = f * (2 - f)
    ep2, e1 = e2 / (1 - e2), (1 - math.sqrt(1 - e2)) / (1 + math.sqrt(1 - e2))
    mu = (north - F.when(south, F.lit(10000000.0)).otherwise(F.lit(0.0))) / k0 / (a * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256))
    fp = (
        mu
        + (3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2 * mu)
        + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * mu)
        + (151 * e1**3 / 96) * F.sin(6 * mu)
        + (1097 * e1**4 / 512) * F.sin(8 * mu)
    )
    c, t, root = ep2 * F.cos(fp) ** 2, F.tan(fp) ** 2, 1 - e2 * F.sin(fp) ** 2
    n, r = a / F.sqrt(root), a * (1 - e2) / root**1.5
    d = (east - 500000.0) / (n * k0)
    lat = fp - (n * F.tan(fp) / r) * (d**2 / 2 - (5 + 3 * t + 10 * c - 4 * c**2 - 9 * ep2) * d**4 / 24 + (61 + 90 * t + 298 * c + 45 * t**2 - 252 * ep2 - 3 * c**2) * d**6 / 720)
    lon = (d - (1 + 2 * t + c) * d**3 / 6 + (5 - 2 * c + 28 * t - 3 * c**2 + 8 * ep2 + 24 * t**2) * d**5 / 120) / F.cos(fp)
    return F.degrees(lon) + (zone - 1) * 6 - 177, F.degrees(lat)


def footprint(points: DataFrame, keys: tuple = ("feature_id",)) -> DataFrame:
    """(keys, area, cx, cy) of rings points(keys, seq, x, y), by the shoelace formula."""
    w = Window.partitionBy(*keys).orderBy("seq")
    first = Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nx, ny = F.coalesce(F.lead("x").over(w), F.first("x").over(first)), F.coalesce(F.lead("y").over(w), F.first("y").over(first))
    p = points.withColumn("nx", nx).withColumn("ny", ny).withColumn("cross", F.col("x") * F.col("ny") - F.col("nx") * F.col("y"))
    out = p.groupBy(*keys).agg(F.sum("cross").alias("s"), F.sum((F.col("x") + F.col("nx")) * F.col("cross")).alias("sx"), F.sum((F.col("y") + F.col("ny")) * F.col("cross")).alias("sy"))
    return out.select(*keys, F.abs(F.col("s") / 2).alias("area"), F.try_divide(F.col("sx"), 3 * F.col("s")).alias("cx"), F.try_divide(F.col("sy"), 3 * F.col("s")).alias("cy"))
