"""Queries that must take all of their view, whatever its size."""

from __future__ import annotations

import pytest

from pixelweave.operators import catalog, views
from pixelweave.plans.all import QUERIES


def test_fill_nearest_takes_all_scenes(spark, sf):
    got = {(r.tile, r.r, r.c): r.cls for r in QUERIES["JON17_fill_nearest_scenes"](spark, sf).collect()}
    px = {}
    for p in views.prob(spark, sf).collect():
        px.setdefault((p.scene, p.r, p.c), []).append(p)
    assert set(got) == set(px)
    own = {k: max(1 + (p.v > 30000) for p in ps) for k, ps in px.items() if min(p.cls for p in ps) <= 1}
    for (tile, r, c), cls in list(got.items())[::7]:
        assert cls == own[min((k for k in own if k[0] == tile), key=lambda k: ((k[1] - r) ** 2 + (k[2] - c) ** 2, k))]


def test_upsample_takes_all_scenes(spark, sf):
    got = QUERIES["WIN11_nearest_upsample_scenes"](spark, sf)
    assert got.count() == 16 * views.prob(spark, sf).select("scene", "r", "c").distinct().count()
    assert got.select("scene").distinct().count() == views.prob(spark, sf).select("scene").distinct().count()


def test_crs_of_each_place(spark, sf):
    got = QUERIES["FLT17_single_crs_places"](spark, sf)
    assert got.count() == views.orthos(spark, sf).select("place").distinct().count()
    two = spark.createDataFrame([(0, "a"), (1, "a"), (1, "b")], "place int, crs string")
    with pytest.raises(Exception, match="more than one CRS"):
        catalog.assert_single_crs(two, ("place",)).collect()
