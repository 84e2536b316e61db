"""Reference systems, refinement, windows, decimation and names against plain computations."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from pixelweave.operators import catalog, crs, grid, refine, spatial


def test_zones_against_the_other_series(spark):
    """Two different series agree within a zone to a millimetre."""
    rows = [(lon, lat) for lon in np.arange(48.1, 53.9, 0.7).tolist() for lat in np.arange(-79.5, 80, 13).tolist()]
    df = spark.createDataFrame(rows, "lon double, lat double").withColumn("epsg", F.when(F.col("lat") < 0, 32739).otherwise(32639))
    e, n = spatial.utm_project(F.col("lon"), F.col("lat"))
    got = crs.reproject(df.withColumns({"e": e, "n": n}), "lon", "lat", F.lit(4326), F.col("epsg"), ("x", "y"))
    back = crs.reproject(got, "x", "y", F.col("epsg"), F.lit(4326), ("lon2", "lat2")).collect()
    assert all(abs(r.e - r.x) < 1e-3 and abs(r.n - r.y) < 1e-3 for r in back)
    assert all(abs(r.lon - r.lon2) < 1e-10 and abs(r.lat - r.lat2) < 1e-10 for r in back)  # ten micrometres


def test_a_known_position(spark):
    """On the central meridian the northing is the meridian arc, and the easting 500 km."""
    r = crs.reproject(spark.createDataFrame([(57.0, 45.0)], "lon double, lat double"), "lon", "lat", F.lit(4326), F.lit(32640), ("e", "n")).first()
    e2 = crs.FLATTENING * (2 - crs.FLATTENING)
    lat = np.linspace(0, math.pi / 4, 200_001)
    f = crs.AXIS * (1 - e2) / (1 - e2 * np.sin(lat) ** 2) ** 1.5
    assert abs(r.e - 500000) < 1e-6 and abs(r.n - 0.9996 * np.trapezoid(f, lat)) < 1e-4


def test_same_and_both_hemispheres(spark):
    df = spark.createDataFrame([(1, 500000.0, 0.0, 32740, 32640), (2, 1.5, 2.5, 32640, 32640), (3, 1.0, 2.0, 4326, 4326)], "k int, x double, y double, a int, b int")
    got = {r.k: (r.x, r.y) for r in crs.reproject(df, "x", "y", F.col("a"), F.col("b"), ("x", "y")).collect()}
    assert abs(got[1][1] + 10_000_000) < 1e-3 and (got[2], got[3]) == ((1.5, 2.5), (1.0, 2.0))


def test_a_neighbouring_zone(spark):
    """To the next zone and back is the same place."""
    df = spark.createDataFrame([(740000.0 + 1000 * i, 2e6 + 1.5e5 * i) for i in range(20)], "x double, y double")
    there = crs.reproject(df, "x", "y", F.lit(32639), F.lit(32640), ("x2", "y2"))
    back = crs.reproject(there, "x2", "y2", F.lit(32640), F.lit(32639), ("x3", "y3")).collect()
    assert all(abs(r.x - r.x3) < 1e-5 and abs(r.y - r.y3) < 1e-5 and r.x2 < 4e5 for r in back)


def test_refinement_flow(spark):
    px = spark.createDataFrame([("t", 0, c, cls) for c, cls in enumerate([2, 1, 1, 3, 3])] + [("u", 0, 0, 1)], "tile string, r int, c int, cls int")
    hit = spark.createDataFrame([("t", 0, 2), ("t", 0, 3), ("t", 0, 3), ("t", 9, 9)], "tile string, r int, c int")
    got = {(r.tile, r.c): r.cls for r in refine.refine_class(px, hit, 1).collect()}
    # 1 was of the class and isn't: the nearest known is 2 at its left; nothing is known in the other tile
    assert got == {("t", 0): 2, ("t", 1): 2, ("t", 2): 1, ("t", 3): 1, ("t", 4): 3, ("u", 0): 0}


def test_windows_are_cut_at_all_sides(spark):
    frame = {"left": 10.0, "top": 50.0, "a": 2.0, "e": -2.0, "height": 20, "width": 15}
    tiles = [(x, y, h, w) for x in (-4.0, 9.2, 30.9, 36.0, 99.0) for y in (61.1, 50.0, 20.0, 11.0, -40.0) for h, w in ((4, 9), (40, 40))]
    df = spark.createDataFrame(tiles, "x double, y double, h int, w int")
    got = df.select("*", *[v.alias(k) for k, v in grid.mosaic_window(F.col("x"), F.col("y"), F.col("h"), F.col("w"), frame).items()]).collect()
    for r in got:
        at = {math.floor((r.y - 50) / -2 + 0.5) + i: i for i in range(r.h)}
        rows = [(k, i) for k, i in at.items() if 0 <= k < 20]
        if rows:
            assert (r.row, r.row_skip, r.row_end) == (rows[0][0], rows[0][1], rows[-1][0] + 1)
        else:
            assert r.row_end <= r.row


def test_decimation(spark):
    x = np.arange(7 * 10, dtype=float).reshape(7, 10)
    df = spark.createDataFrame([("s", r, c, float(x[r, c])) for r in range(7) for c in range(10)], "scene string, r int, c int, v double")
    got = {(r.r, r.c): (r.v, r.x, r.y) for r in grid.decimate(df, 3, 7, 10, {"a": 2.0, "c": 5.0, "e": -1.0, "f": 9.0}, hi=60.0).collect()}
    assert set(got) == {(r, c) for r in range(2) for c in range(3)}
    rows, cols = [min(r * 2 // 7, 1) for r in range(7)], [min(c * 3 // 10, 2) for c in range(10)]
    for (r, c), (v, px, py) in got.items():
        want = np.mean([x[i, j] for i in range(7) for j in range(10) if (rows[i], cols[j]) == (r, c)])
        assert (v, px, py) == (min(60.0, want), 5 + c * 20 / 3, 9 - r * 3.5)


def test_names_that_contain_names(spark):
    names = spark.createDataFrame([("banana",), ("an",), ("",), (None,), ("ba",)], "a string")
    stems = spark.createDataFrame([("an",), ("a",), ("",), (None,), ("banana!",), ("an",)], "b string")
    got = sorted((r.a, r.b) for r in catalog.contains_join(names, "a", stems, "b").collect())
    want = sorted((a, b) for (a,) in [("banana",), ("an",), ("",), ("ba",)] for b in ("an", "a", "", "banana!", "an") if b in a)
    assert got == want
    assert catalog.contains_join(names, "a", stems.where("false"), "b").collect() == []


def test_waiting_counts_evaluations(spark):
    """Epochs with gaps: three evaluations without a gain are three, not ten."""
    df = spark.createDataFrame([("a", e, x) for e, x in ((1, 3.0), (5, 2.0), (6, 2.5), (15, 2.0), (16, 2.1), (30, 1.0))], "run string, epoch int, loss double")
    got = [(r.epoch, r.best, r.waited, r.stop) for r in catalog.early_stop(df, 3).orderBy("epoch").collect()]
    assert got == [(1, 3.0, 0, False), (5, 2.0, 0, False), (6, 2.0, 1, False), (15, 2.0, 2, False), (16, 2.0, 3, True), (30, 1.0, 0, False)]
