"""Hand-computed cases and round trips of the raster operators."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pixelweave.operators import catalog, classify, grid, imagery, masks, metrics, pandas_ops, spatial, vote


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_classify_and_nan_policies(spark):
    nan = float("nan")
    data = [(0, 0, 1, 0.2), (0, 0, 2, 0.9), (0, 1, 1, 0.5), (0, 1, 2, 0.5), (1, 0, 1, nan), (1, 0, 2, 0.3), (1, 1, 1, nan), (1, 1, 2, nan)]
    df = spark.createDataFrame([("s", *d) for d in data], "scene string, r int, c int, cls int, v double")
    assert rows(classify.classify(df), "r", "c", "cls") == [(0, 0, 2), (0, 1, 1), (1, 0, 2)]
    assert rows(classify.classify(df, nan_policy="numpy"), "r", "c", "cls") == [(0, 0, 2), (0, 1, 1), (1, 0, 1)]


def test_quantiles(spark):
    df = spark.createDataFrame([(1, float(v)) for v in (1, 2, 3, 4, 10)], "cls int, v double")
    q = classify.class_quantiles(df).first()
    assert (round(q.q_lo, 6), round(q.q_hi, 6)) == (1.04, 9.76)


def test_stretch_keeps_nodata(spark):
    df = spark.createDataFrame([("s", 0, 0, 1, None), ("s", 0, 1, 1, 5.0), ("s", 0, 2, 9, 7.0)], "scene string, r int, c int, cls int, v double")
    q = spark.createDataFrame([(1, 0.0, 10.0)], "cls int, q_lo double, q_hi double")
    got = {r.c: r.v for r in classify.stretch(df, q).collect()}
    assert got[0] is None and got[2] == 7.0 and abs(got[1] - 0.5) < 1e-6


def test_tile_grid_and_cover(spark):
    o = spark.createDataFrame([(10, 8), (3, 3)], "width int, height int")
    assert len(grid.tile_grid(o, 4).collect()) == 4
    assert len(grid.tile_grid(o, 4, 0.5, 0.5).collect()) == 12
    got = spark.range(1).select(grid.covering_origins(F.lit(5), 4, 2, 10).alias("x")).first().x
    assert got == [2, 4]
    # fan-out agrees with the tiles that cover each pixel
    px = spark.createDataFrame([(r, c) for r in range(8) for c in range(10)], "r int, c int")
    tiles = [(x, y) for x in range(0, 7, 2) for y in range(0, 5, 2)]
    assert grid.cover_tiles(px, 4, 2, 10, 8).count() == len(tiles) * 16


def test_world_round_trip(spark):
    gt = {"a": 0.5, "b": 0.0, "c": 10.0, "d": 0.0, "e": -0.5, "f": 20.0}
    x, y = grid.pixel_to_world(F.col("r"), F.col("c"), gt)
    r, c = grid.world_to_pixel(F.col("x"), F.col("y"), gt)
    df = spark.createDataFrame([(3, 7)], "r int, c int").select("r", "c", x.alias("x"), y.alias("y"))
    assert tuple(df.select(r, c).first()) == (3, 7)


@pytest.mark.parametrize(("black", "white", "kept"), [(5, 0, 1), (6, 0, 0), (0, 10, 1), (0, 11, 0)])
def test_blank_tiles(spark, black, white, kept):
    px = [(0, 0, 0)] * black + [(255, 255, 255)] * white + [(9, 9, 9)] * (100 - black - white)
    df = spark.createDataFrame([("t", *p) for p in px], "tile string, r int, g int, b int")
    assert grid.filter_blank_tiles(df).count() == kept


def test_plurality_ties(spark):
    v = [("s", 0, 0, c) for c in (1, 1, 3, 3)] + [("s", 0, 1, 2)]
    df = spark.createDataFrame(v, "scene string, r int, c int, cls int")
    assert rows(vote.plurality(vote.vote_counts(df)), "c", "cls", "n") == [(0, 1, 2), (1, 2, 1)]


def test_metrics(spark):
    pairs = [(1, 1)] * 3 + [(1, 2)] + [(2, 2)] * 2 + [(2, 0)] + [(0, 1)] * 5
    df = spark.createDataFrame(pairs, "gt int, pred int")
    cm = metrics.confusion(df)
    assert rows(cm, "gt", "pred", "n") == [(1, 1, 3), (1, 2, 1), (2, 1, 0), (2, 2, 2)]
    m = metrics.metrics(cm).first()
    assert (round(m.pixel_acc, 6), round(m.mean_acc, 6), round(m.mean_iou, 6)) == (0.833333, 0.875, 0.708333)


def test_rle(spark):
    a = [("a", r, c, v) for r, row in enumerate([[0, 1, 1], [1, 1, 0]]) for c, v in enumerate(row)]
    df = spark.createDataFrame(a, "mask_id string, r int, c int, on_ int")
    rle = masks.rle_encode(df, 2, 3)
    assert rle.first().counts == [1, 4, 1]
    assert rows(masks.rle_decode(rle), "r", "c") == sorted((r, c) for _, r, c, v in a if v)
    b = spark.createDataFrame([("b", 0, 0, 1), ("b", 0, 1, 0), ("b", 1, 0, 1), ("b", 1, 1, 0), ("e", 0, 0, 0)], "mask_id string, r int, c int, on_ int")
    got = {r.mask_id: r.counts for r in masks.rle_encode(b, 2, 2).collect()}
    assert got == {"b": [0, 2, 2], "e": [4]}


def test_widest_gap_and_gain(spark):
    hist = spark.createDataFrame([("t", "r", b, 0 if b in (3, 10, 200) else 9) for b in range(256)], "tile string, channel string, bin int, n int")
    g = imagery.widest_gap(hist, F.lit(5)).first()
    assert (g.low, g.high) == (10, 200)
    gain, offset = imagery.gain_offset(F.lit(10), F.lit(200))
    got = spark.range(1).select(gain.alias("a"), offset.alias("b")).first()
    assert (round(got.a, 6), round(got.b, 6)) == (1.347368, -0.052632)


def test_fill_nearest(spark):
    df = spark.createDataFrame([("t", 0, 0, 1), ("t", 0, 1, None), ("t", 0, 2, None), ("t", 0, 3, 2), ("u", 0, 0, 1), ("u", 0, 1, None), ("u", 0, 2, 2)], "tile string, r int, c int, cls int")
    assert [x[2] for x in rows(pandas_ops.fill_nearest(df), "tile", "c", "cls")] == [1, 1, 2, 2, 1, 1, 2]


def test_components_and_small_parts(spark):
    grid_ = [[1, 0, 0, 1], [0, 1, 0, 1], [0, 0, 0, 0], [1, 0, 0, 0]]
    df = spark.createDataFrame([("m", r, c, v) for r, row in enumerate(grid_) for c, v in enumerate(row)], "mask_id string, r int, c int, on_ int")
    got = pandas_ops.components(df)
    assert sorted(r.area for r in got.select("component", "area").distinct().collect()) == [1, 2, 2]
    assert pandas_ops.remove_small(df, 2).where("on_ = 1").count() == 4
    assert pandas_ops.remove_small(df, 9).where("on_ = 1").count() == 2


def test_spatial_predicates(spark):
    zone = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0)], "zone_id int, x0 double, y0 double, x1 double, y1 double")
    b = [(1, 2.0, 2.0, 4.0, 4.0), (2, 8.0, 8.0, 12.0, 12.0), (3, 10.0, 10.0, 12.0, 12.0), (4, 11.0, 11.0, 12.0, 12.0)]
    boxes = spark.createDataFrame(b, "box_id int, x0 double, y0 double, x1 double, y1 double")
    for cell in (3.0, 128.0):
        assert rows(spatial.spatial_join(boxes, zone, "contains", cell=cell), "box_id") == [(1,)]
        assert rows(spatial.spatial_join(boxes, zone, "intersects", cell=cell), "box_id") == [(1,), (2,), (3,)]
        assert rows(spatial.spatial_join(boxes, zone, "intersects", "left_anti", cell=cell), "box_id") == [(4,)]


def test_utm(spark):
    got = spark.range(1).select(spatial.utm_epsg(F.lit(55.24), F.lit(-21.1)).alias("e"), *[c.alias(n) for c, n in zip(spatial.utm_project(F.lit(57.0), F.lit(0.0)), "xy", strict=True)]).first()
    assert got.e == 32740 and abs(got.x - 500000) < 1e-6 and abs(got.y) < 1e-6


def test_hull_and_nms(spark):
    pts = spark.createDataFrame([("k", float(x), float(y)) for x in range(4) for y in range(4)], "k string, x double, y double")
    assert rows(pandas_ops.convex_hull(pts, "k"), "x", "y") == [(0.0, 0.0), (0.0, 3.0), (3.0, 0.0), (3.0, 3.0)]
    b = [("i", 1, 0.0, 0.0, 10.0, 10.0, 0.9), ("i", 2, 1.0, 1.0, 10.0, 10.0, 0.8), ("i", 3, 20.0, 20.0, 30.0, 30.0, 0.1)]
    df = spark.createDataFrame(b, "image string, box_id long, x0 double, y0 double, x1 double, y1 double, score double")
    assert rows(pandas_ops.nms(df, "image", 0.7), "box_id") == [(1,), (3,)]


def test_crs_guard(spark):
    df = spark.createDataFrame([("a",), ("b",)], "crs string")
    with pytest.raises(Exception, match="more than one CRS"):
        catalog.assert_single_crs(df).collect()


def test_streamed_mosaic(spark, tmp_path):
    from pixelweave.streaming import tiles

    for i in range(3):
        spark.createDataFrame([("s", 0, 0, i % 2 + 1), ("s", 0, 1, 2)], "scene string, r int, c int, cls int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = tiles.read_stream(spark, str(tmp_path / "in"), "scene string, r int, c int, cls int", 1)
    q = tiles.mosaic_stream(src, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    last = max(p.name for p in (tmp_path / "out").iterdir())
    assert rows(spark.read.parquet(str(tmp_path / "out" / last)), "c", "cls", "n") == [(0, 1, 2), (1, 2, 3)]


def test_hue_by_hand(spark):
    """h = 30 on (10, 20, 30): cosine 0.8660254, sine 0.5."""
    got = spark.range(1).select(imagery.hue_shifted_red(F.lit(10.0), F.lit(20.0), F.lit(30.0), F.lit(30.0)).alias("r")).first().r
    assert abs(got - (10 * 0.990083806 + 20 * 0.243643091 + 30 * -0.233226896)) < 1e-6


def test_blue_feeds_no_red(spark):
    df = spark.createDataFrame([("t", i, r, g, b) for i, (r, g, b) in enumerate([(100, 50, 0), (100, 50, 255)] * 40)], "tile string, y int, r int, g int, b int")
    assert len({r.r for r in imagery.colour_correct(df).collect()}) == 1


def test_quantiles_of_many_values(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    data = {1: rng.normal(size=5000), 2: rng.integers(0, 4, 3000).astype(float), 3: np.array([5.0]), 4: np.concatenate([np.zeros(999), [1e9]])}
    df = spark.createDataFrame([(k, float(v)) for k, x in data.items() for v in x] + [(1, None)], "cls int, v double")
    got = {r.cls: (r.q_lo, r.q_hi) for r in classify.class_quantiles(df, accuracy=100).collect()}
    for k, x in data.items():
        assert np.allclose(got[k], np.quantile(x, [0.01, 0.99]))


def test_rings_and_boxes(spark):
    ell = [(0, 0), (10, 0), (10, 4), (4, 4), (4, 10), (0, 10)]
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ell])
    boxes = [(1, 1.0, 1.0, 3.0, 3.0), (2, 3.0, 3.0, 6.0, 6.0), (3, 6.0, 6.0, 9.0, 9.0), (4, -1.0, -1.0, 11.0, 11.0), (5, 10.0, 2.0, 12.0, 3.0), (6, 0.0, 0.0, 4.0, 10.0)]
    df = spark.createDataFrame(boxes, "box_id int, x0 double, y0 double, x1 double, y1 double")
    got = {r.box_id: (r.c, r.t) for r in df.select("box_id", spatial.ring_contains_box(ring).alias("c"), spatial.ring_touches_box(ring).alias("t")).collect()}
    assert got == {1: (True, True), 2: (False, True), 3: (False, False), 4: (False, True), 5: (False, True), 6: (True, True)}


def test_snap_between_affines(spark):
    fine, coarse = {"a": 0.5, "b": 0.0, "c": 0.0, "d": 0.0, "e": -0.5, "f": 0.0}, {"a": 1.0, "b": 0.0, "c": 1.0, "d": 0.0, "e": -1.0, "f": 0.0}
    px = spark.createDataFrame([("s", 0, c) for c in range(6)], "scene string, r int, c int")
    labels = spark.createDataFrame([("s", 0, 0, 7), ("s", 0, 1, 0)], "scene string, r int, c int, cls int")
    got = grid.snap_labels(px, labels, fine, coarse)
    assert rows(got, "c", "cls") == [(0, None), (1, None), (2, 7), (3, 7), (4, 0), (5, 0)]
    assert rows(grid.whole_tiles(got.withColumn("tx", F.floor(F.col("c") / 2)), ("tx",)), "c") == [(2,), (3,)]


def test_boxes_grow_where_the_context_is_alike(spark):
    box = spark.createDataFrame([("i", 1, 10, 10, 30, 30), ("i", 2, 1, 1, 21, 21)], "image string, box_id int, x0 long, y0 long, x1 long, y1 long")
    like = spark.createDataFrame([("i", r, c) for r in range(64) for c in (8, 9, 30)], "image string, r int, c int")
    got = {b.box_id: (b.x0, b.y0, b.x1, b.y1) for b in masks.expand_boxes(box, like, 64, 64, 0.5).collect()}
    assert got == {1: (8, 10, 30, 30), 2: (1, 1, 21, 21)}  # half of the right strip is not more than half; box 2 stands at the edge


def test_config_sections_must_exist(spark):
    one = lambda text: spark.createDataFrame([(text,)], "config string")
    assert catalog.require_sections(one('{"a": {"b": {"c": 1}}}'), "config", ("a", "a.b")).count() == 1
    for text in ('{"a": {}}', "{}", '{"a": {"b": {}}}'):
        with pytest.raises(Exception, match="no section"):
            catalog.require_sections(one(text), "config", ("a", "a.b")).collect()


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    from pixelweave.streaming import tiles

    px = spark.createDataFrame([("s", 0, 0, 1), ("s", 0, 0, 2), ("s", 0, 1, 3)], "scene string, r int, c int, cls int")
    read, seen = [], f"file://{tmp_path}/in"
    for part in (px, px.where("cls = 2"), px.where("false")):
        part.write.mode("append").parquet(seen)
        q = tiles.mosaic_stream(tiles.read_stream(spark, seen, px.schema), f"file://{tmp_path}/rows", f"file://{tmp_path}/checkpoint")
        q.awaitTermination()
        read.append(sum(p["numInputRows"] for p in q.recentProgress))
    assert read == [3, 1, 0]  # what was read once is not read again
    assert rows(tiles.latest_batch(spark, f"file://{tmp_path}/rows"), "c", "cls", "n") == [(0, 2, 2), (1, 3, 1)]


def test_pad_and_prompt(spark):
    px = spark.createDataFrame([("t", 0, 1, 5)], "tile string, r int, c int, v int")
    assert rows(imagery.pad_square(px, 2, ("v",)), "r", "c", "v") == [(0, 0, 0), (0, 1, 5), (1, 0, 0), (1, 1, 0)]
    w = spark.createDataFrame([(1, 0.5), (1, 0.0), (0, 0.5)], "on int, w double")
    assert [r.p for r in w.select(masks.weighted_prompt(F.col("on"), F.col("w")).alias("p")).collect()] == [7.5, 15.0, -7.5]
