"""Queries of the inventory's filters and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelweave.operators import catalog, classify, grid, metrics, nearest, spatial, views, vote
from pixelweave.operators.views import table, with_views
from pixelweave.plans.registry import query

GREY = "(r + g + b) / 3"


@query("FLT01_black_tiles", with_views("rgb", f"SELECT tile, round(sum(CASE WHEN {GREY} < 60 THEN 1 ELSE 0 END) * 100.0 / count(*), 4) AS pct FROM rgb GROUP BY 1 HAVING sum(CASE WHEN {GREY} < 60 THEN 1 ELSE 0 END) * 100.0 / count(*) <= 50"))
def flt01(spark, sf):
    dark = views.rgb(spark, sf).groupBy("tile").agg((F.sum(((F.col("r") + F.col("g") + F.col("b")) / 3 < 60).cast("int")) * 100.0 / F.count("*")).alias("pct"))
    return dark.where("pct <= 50").withColumn("pct", F.round("pct", 4))


@query("FLT02_blank_tiles", with_views("rgb", f"SELECT tile, count(*) AS pixels, round(sum(CASE WHEN {GREY} = 0 THEN 1 ELSE 0 END) * 100.0 / count(*), 4) AS black_pct, round(sum(CASE WHEN {GREY} = 255 THEN 1 ELSE 0 END) * 100.0 / count(*), 4) AS white_pct FROM rgb GROUP BY 1 HAVING sum(CASE WHEN {GREY} = 0 THEN 1 ELSE 0 END) * 100.0 / count(*) <= 5 AND sum(CASE WHEN {GREY} = 255 THEN 1 ELSE 0 END) * 100.0 / count(*) <= 10"))
def flt02(spark, sf):
    return grid.filter_blank_tiles(views.rgb(spark, sf)).select("tile", "pixels", F.round("black_pct", 4).alias("black_pct"), F.round("white_pct", 4).alias("white_pct"))


@query("FLT03_missing_values", with_views("raw_prob", "SELECT scene, count(*) AS n FROM raw_prob WHERE v IS NOT NULL GROUP BY 1"))
def flt03(spark, sf):
    return classify.valid_probabilities(views.raw_prob(spark, sf)).groupBy("scene").agg(F.count("*").alias("n"))


@query("FLT04_whitelist", with_views("raw_prob", "SELECT label, count(*) AS n FROM raw_prob WHERE label IN ('class_2', 'class_5') AND v IS NOT NULL GROUP BY 1"))
def flt04(spark, sf):
    return classify.valid_probabilities(views.raw_prob(spark, sf), ["class_2", "class_5"]).groupBy("label").agg(F.count("*").alias("n"))


@query("FLT05_suffix", with_views("orthos", "SELECT ortho_id, path FROM orthos WHERE lower(path) LIKE '%1_ortho.tif'"))
def flt05(spark, sf):
    return views.orthos(spark, sf).select("ortho_id", "path").where(F.lower("path").endswith("1_ortho.tif"))


@query("FLT06_full_tiles", with_views("prob", ",,px AS (SELECT scene, r, c, max(CASE WHEN cls <= 2 THEN 1 ELSE 0 END) AS ok FROM prob GROUP BY 1, 2, 3) SELECT scene, CAST(floor(c / 2) AS BIGINT) AS tx, CAST(floor(r / 2) AS BIGINT) AS ty FROM px GROUP BY 1, 2, 3 HAVING count(*) = 4 AND min(ok) = 1"))
def flt06(spark, sf):
    px = views.prob(spark, sf).groupBy("scene", "r", "c").agg(F.bool_or(F.col("cls") <= 2).alias("ok"))
    return px.groupBy("scene", F.floor(F.col("c") / 2).alias("tx"), F.floor(F.col("r") / 2).alias("ty")).agg(F.count("*").alias("n"), F.bool_and("ok").alias("ok")).where("n = 4 AND ok").drop("n", "ok")


@query("FLT07_class_range", with_views("votes", "SELECT scene, r, c, cls FROM votes v WHERE NOT EXISTS (SELECT 1 FROM votes b WHERE b.scene = v.scene AND b.r = v.r AND b.c = v.c AND (b.cls < 1 OR b.cls > 4))"))
def flt07(spark, sf):
    return grid.drop_out_of_range_tiles(views.votes(spark, sf), 1, 4, ("scene", "r", "c"))


@query("FLT08_truth_mask", with_views("labelled", "SELECT zone, gt, pred FROM labelled WHERE gt <> 0"))
def flt08(spark, sf):
    return views.labelled(spark, sf).where("gt <> 0")


@query("FLT09_contains", with_views("boxes zones", "SELECT DISTINCT box_id FROM boxes b, zones z WHERE z.x0 <= b.x0 AND z.x1 >= b.x1 AND z.y0 <= b.y0 AND z.y1 >= b.y1"))
def flt09(spark, sf):
    return spatial.spatial_join(views.boxes(spark, sf), views.zones(spark, sf), "contains").select("box_id")


@query("FLT10_intersects", with_views("boxes zones", "SELECT b.box_id, z.zone_id FROM boxes b, zones z WHERE z.x0 <= b.x1 AND z.x1 >= b.x0 AND z.y0 <= b.y1 AND z.y1 >= b.y0"))
def flt10(spark, sf):
    return spatial.spatial_join(views.boxes(spark, sf), views.zones(spark, sf), "intersects", "inner").select("box_id", F.col("z_zone_id").alias("zone_id"))


@query("FLT11_not_aligned", "SELECT s_suppkey, s_name FROM supplier WHERE s_name NOT LIKE '%7%'")
def flt11(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", "s_name").where(~F.contains("s_name", F.lit("7")))


@query("FLT12_same_grid", with_views("orthos", "SELECT a.ortho_id, a.crs IS NOT DISTINCT FROM b.crs AND a.width IS NOT DISTINCT FROM b.width AS same FROM orthos a JOIN orthos b ON b.ortho_id = a.ortho_id + 1"))
def flt12(spark, sf):
    o = views.orthos(spark, sf).select("ortho_id", F.struct("crs", "width").alias("g"))
    b = o.select((F.col("ortho_id") - 1).alias("ortho_id"), F.col("g").alias("h"))
    return o.join(b, "ortho_id").select("ortho_id", F.col("g").eqNullSafe(F.col("h")).alias("same"))


@query("FLT13_digit_keys", "SELECT c_custkey, regexp_matches(right(c_name, 2), '^[0-9]+$') AS digits FROM customer")
def flt13(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.right("c_name", F.lit(2)).rlike("^[0-9]+$").alias("digits"))


@query("FLT14_mask_thresholds", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity / 50 > 0.88 AND 1 - l_discount >= 0.95 AND l_tax > 0")
def flt14(spark, sf):
    return table(spark, sf, "lineitem").where("l_quantity / 50 > 0.88 AND 1 - l_discount >= 0.95 AND l_tax > 0").select("l_orderkey", "l_linenumber")


@query("FLT15_near_crop_edge", with_views("boxes", "SELECT box_id, (abs(x0 - 200) <= 20 AND NOT abs(x0 - 0) <= 20) OR (abs(y0 - 0) <= 20 AND NOT abs(y0 - 0) <= 20) OR (abs(x1 - 700) <= 20 AND NOT abs(x1 - 1000) <= 20) OR (abs(y1 - 500) <= 20 AND NOT abs(y1 - 1000) <= 20) AS near FROM boxes"))
def flt15(spark, sf):
    from pixelweave.operators.masks import near_crop_edge

    box = tuple(F.col(c) for c in ("x0", "y0", "x1", "y1"))
    return views.boxes(spark, sf).select("box_id", near_crop_edge(box, tuple(map(F.lit, (200.0, 0.0, 700.0, 500.0))), tuple(map(F.lit, (0.0, 0.0, 1000.0, 1000.0)))).alias("near"))


@query("FLT16_existence", "SELECT DISTINCT d.doc_id FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def flt16(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")


@query("FLT17_single_crs", with_views("orthos", "SELECT crs, count(*) AS places FROM (SELECT place, min(crs) AS crs FROM orthos GROUP BY 1) GROUP BY 1"))
def flt17(spark, sf):
    """How many places there are of each CRS; a place with two raises."""
    return catalog.assert_single_crs(views.orthos(spark, sf), ("place",)).groupBy("crs").agg(F.count("*").alias("places"))


@query("FLT17_single_crs_places", with_views("orthos", "SELECT place, min(crs) AS crs FROM orthos GROUP BY 1"))
def flt17_places(spark, sf):
    return catalog.assert_single_crs(views.orthos(spark, sf), ("place",))


@query("FLT18_access_right", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) > 50 OR event_type = 'view' AS allowed FROM events")
def flt18(spark, sf):
    return table(spark, sf, "events").select("event_id", ((F.get_json_object("props", "$.k").cast("int") > 50) | (F.col("event_type") == "view")).alias("allowed"))


@query("FLT19_zero_wedges", with_views("labelled", ",,n AS (SELECT pred, count(*) AS n FROM labelled WHERE pred <> 0 GROUP BY 1), p AS (SELECT pred AS cls, n, round(n * 100.0 / sum(n) OVER (), 4) AS pct FROM n) SELECT cls, n, pct FROM p WHERE round(pct, 0) <> 12"))
def flt19(spark, sf):
    d = metrics.class_distribution(views.labelled(spark, sf).select(F.col("pred").alias("cls")))
    return d.withColumn("pct", F.round("pct", 4)).where(F.round("pct", 0) != 12)


@query("FLT20_positive_mean", with_views("labelled", "SELECT zone, round(avg(pred) FILTER (WHERE pred > 0), 6) AS mean FROM labelled GROUP BY 1"))
def flt20(spark, sf):
    return views.labelled(spark, sf).groupBy("zone").agg(F.round(F.avg(F.when(F.col("pred") > 0, F.col("pred"))), 6).alias("mean"))


@query("JON01_sessions_orthos", with_views("sessions orthos", "SELECT s.session_id, o.ortho_id, o.crs FROM sessions s JOIN orthos o USING (place)"))
def jon01(spark, sf):
    return catalog.match_orthos(views.sessions(spark, sf), views.orthos(spark, sf), keep=["session_id", "ortho_id", "crs"])


LAB = "SELECT scene, r, c, min(cls) AS cls FROM prob GROUP BY 1, 2, 3"


@query("JON02_grid_snap", with_views("prob", f",,lab AS ({LAB}), px AS (SELECT scene, r, c FROM prob GROUP BY 1, 2, 3) SELECT px.scene, px.r, px.c, lab.cls FROM px JOIN lab ON lab.scene = px.scene AND lab.r = CAST(floor(px.r / 2) AS INT) AND lab.c = CAST(floor(px.c / 4) AS INT)"))
def jon02(spark, sf):
    p = views.prob(spark, sf)
    lab = p.groupBy("scene", "r", "c").agg(F.min("cls").alias("cls"))
    px = p.select("scene", "r", "c").distinct().withColumn("c0", F.col("c")).withColumn("c", F.floor(F.col("c") / 2).cast("int"))
    return grid.upsample_labels(px, lab, 2, ("scene",), False, ("scene",)).select("scene", "r", F.col("c0").alias("c"), "cls")


@query("JON03_pair_examples", "SELECT d.doc_id, d.n_chars, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def jon03(spark, sf):
    return catalog.pair_examples(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id").select("doc_id", "n_chars", "quality")


@query("JON04_tiles_in_polygon", with_views("boxes zones", "SELECT b.box_id, z.zone_id FROM boxes b, zones z WHERE z.x0 <= b.x0 AND z.x1 >= b.x1 AND z.y0 <= b.y0 AND z.y1 >= b.y1"))
def jon04(spark, sf):
    return spatial.spatial_join(views.boxes(spark, sf), views.zones(spark, sf), "contains", "inner").select("box_id", F.col("z_zone_id").alias("zone_id"))


TOUCH = "z.x0 <= b.x1 AND z.x1 >= b.x0 AND z.y0 <= b.y1 AND z.y1 >= b.y0"


@query("JON05_any_layer", with_views("boxes zones", f"SELECT b.box_id FROM boxes b WHERE EXISTS (SELECT 1 FROM zones z WHERE {TOUCH})"))
def jon05(spark, sf):
    return spatial.in_any_layer(views.boxes(spark, sf), views.zones(spark, sf)).select("box_id")


@query("JON05_no_layer", with_views("boxes", "SELECT box_id FROM boxes"))
def jon05_none(spark, sf):
    """Without a layer every tile stays."""
    return spatial.in_any_layer(views.boxes(spark, sf), views.zones(spark, sf).where("layer < 0")).select("box_id")


def diamonds(spark, sf):
    """The zones as rings: squares on a corner, 60.25 from centre to corner."""
    corner = lambda dx, dy: F.struct((F.col("x0") + 60 + dx).alias("x"), (F.col("y0") + 60 + dy).alias("y"))
    ring = F.array(*[corner(dx, dy) for dx, dy in ((-60.25, 0), (0, -60.25), (60.25, 0), (0, 60.25), (-60.25, 0))])
    return spatial.with_bounds(views.zones(spark, sf).select("layer", "zone_id", ring.alias("ring")))


NEAR = "greatest(b.x0 - (z.x0 + 60), 0, (z.x0 + 60) - b.x1) + greatest(b.y0 - (z.y0 + 60), 0, (z.y0 + 60) - b.y1)"
FAR = "greatest(abs(b.x0 - (z.x0 + 60)), abs(b.x1 - (z.x0 + 60))) + greatest(abs(b.y0 - (z.y0 + 60)), abs(b.y1 - (z.y0 + 60)))"


@query("FLT09_ring_contains", with_views("boxes zones", f"SELECT b.box_id, z.zone_id FROM boxes b, zones z WHERE {FAR} <= 60.25"))
def flt09_ring(spark, sf):
    return spatial.spatial_join(views.boxes(spark, sf), diamonds(spark, sf), "contains", "inner").select("box_id", F.col("z_zone_id").alias("zone_id"))


@query("FLT10_ring_intersects", with_views("boxes zones", f"SELECT b.box_id, z.zone_id FROM boxes b, zones z WHERE {NEAR} <= 60.25"))
def flt10_ring(spark, sf):
    return spatial.spatial_join(views.boxes(spark, sf), diamonds(spark, sf), "intersects", "inner").select("box_id", F.col("z_zone_id").alias("zone_id"))


@query("JON06_ring_outside", with_views("boxes zones", f"SELECT b.box_id FROM boxes b WHERE NOT EXISTS (SELECT 1 FROM zones z WHERE z.layer = 1 AND {NEAR} <= 60.25)"))
def jon06_ring(spark, sf):
    return spatial.spatial_join(views.boxes(spark, sf), diamonds(spark, sf).where("layer = 1"), "intersects", "left_anti").select("box_id")


@query("JON06_outside_test", with_views("boxes zones", f"SELECT b.box_id FROM boxes b WHERE NOT EXISTS (SELECT 1 FROM zones z WHERE z.layer = 1 AND {TOUCH})"))
def jon06(spark, sf):
    return spatial.spatial_join(views.boxes(spark, sf), views.zones(spark, sf).where("layer = 1"), "intersects", "left_anti").select("box_id")


@query("JON07_hold_out", "SELECT d.doc_id FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels)")
def jon07(spark, sf):
    return catalog.hold_out(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select("doc_id"), "doc_id")


@query("JON08_orthos_zones", "SELECT r.r_regionkey, n.n_nationkey FROM region r CROSS JOIN nation n")
def jon08(spark, sf):
    return table(spark, sf, "region").select("r_regionkey").crossJoin(table(spark, sf, "nation").select("n_nationkey"))


@query("JON09_name_contains", "SELECT s.s_suppkey, r.r_regionkey FROM supplier s JOIN region r ON contains(s.s_name, CAST(r.r_regionkey AS VARCHAR))")
def jon09(spark, sf):
    r = table(spark, sf, "region").select("r_regionkey", F.col("r_regionkey").cast("string").alias("stem"))
    return catalog.contains_join(table(spark, sf, "supplier"), "s_name", r, "stem").select("s_suppkey", "r_regionkey")


MOSAIC = ",,nv AS (SELECT scene, r, c, cls, count(*) AS n FROM votes GROUP BY 1, 2, 3, 4), pm AS (SELECT scene, r, c, arg_max(cls, row(n, -cls)) AS cls FROM nv GROUP BY 1, 2, 3), nt AS (SELECT scene, r, c, cls, count(*) AS n FROM truth_votes GROUP BY 1, 2, 3, 4), tm AS (SELECT scene, r, c, arg_max(cls, row(n, -cls)) AS cls FROM nt GROUP BY 1, 2, 3)"


@query("JON10_align_truth", with_views("votes truth_votes", MOSAIC + " SELECT tm.scene, tm.r, tm.c, tm.cls AS gt, coalesce(pm.cls, 0) AS pred FROM tm LEFT JOIN pm USING (scene, r, c)"))
def jon10(spark, sf):
    return aligned(spark, sf)


def aligned(spark, sf):
    """Truth pixels with the mosaic's class."""
    pred = vote.plurality(vote.vote_counts(views.votes(spark, sf)))
    return metrics.align_truth(pred, vote.plurality(vote.vote_counts(views.truth_votes(spark, sf))))


@query("JON11_cover_tiles", with_views("votes", "SELECT scene, x.x AS tile_x, y.y AS tile_y, count(*) AS n FROM votes, (SELECT unnest(generate_series(0, 48, 8)) AS x) x, (SELECT unnest(generate_series(0, 16, 8)) AS y) y WHERE c >= x.x AND c < x.x + 16 AND r >= y.y AND r < y.y + 16 GROUP BY 1, 2, 3"))
def jon11(spark, sf):
    return grid.cover_tiles(views.votes(spark, sf), 16, 8, 64, 32).groupBy("scene", "tile_x", "tile_y").agg(F.count("*").alias("n"))


@query("JON12_cascade_delete", "SELECT o.o_orderkey FROM orders o WHERE o.o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def jon12(spark, sf):
    bad = table(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return table(spark, sf, "orders").select("o_orderkey").join(bad, "o_orderkey", "left_anti")


@query("JON13_label_lookup", "SELECT c.c_custkey, n.n_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey")
def jon13(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return table(spark, sf, "customer").join(F.broadcast(n), "c_nationkey").select("c_custkey", "n_name")  # nations: a fixed dimension


@query("JON14_quantile_lookup", with_views("prob", ",,q AS (SELECT cls, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM prob WHERE cls <> 3 GROUP BY 1) SELECT scene, r, c, prob.cls, round(CASE WHEN lo IS NULL THEN v ELSE greatest(0.0, least(1.0, (v - lo) / (hi - lo + 1e-6))) END, 4) AS v FROM prob LEFT JOIN q ON q.cls = prob.cls"))
def jon14(spark, sf):
    p = views.prob(spark, sf)
    return classify.stretch(p, classify.class_quantiles(p.where("cls <> 3"))).withColumn("v", F.round("v", 4))


@query("JON15_matching_images", "SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)")
def jon15(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").where("quality = 1"), "doc_id", "left_semi")


@query("JON16_derived_name", with_views("orthos", "SELECT o.ortho_id, s.s_suppkey FROM orthos o JOIN supplier s ON replace(replace(o.path, '20230101_', ''), '_ortho.tif', '') = s.s_name"))
def jon16(spark, sf):
    o = views.orthos(spark, sf).withColumn("s_name", F.replace(F.replace("path", F.lit("20230101_"), F.lit("")), F.lit("_ortho.tif"), F.lit("")))
    return o.join(table(spark, sf, "supplier"), "s_name").select("ortho_id", "s_suppkey")


LABELS = "SELECT scene || '-' || CAST(r // 16 AS VARCHAR) AS tile, r, c, CASE WHEN min(cls) > 1 THEN NULL ELSE max(CASE WHEN v > 30000 THEN 2 ELSE 1 END) END AS cls FROM prob GROUP BY 1, 2, 3"


@query("JON17_fill_nearest", with_views("prob", f",,t AS ({LABELS}), k AS (SELECT tile, r, c, cls FROM t WHERE cls IS NOT NULL) SELECT t.tile, t.r, t.c, arg_min(k.cls, row((k.r - t.r) * (k.r - t.r) + (k.c - t.c) * (k.c - t.c), k.r, k.c)) AS cls FROM t LEFT JOIN k ON k.tile = t.tile GROUP BY 1, 2, 3"))
def jon17(spark, sf):
    """Halves of scenes, each filled from its own labels."""
    half = F.concat_ws("-", "scene", F.floor(F.col("r") / 16).cast("string"))
    t = views.prob(spark, sf).groupBy(half.alias("tile"), "r", "c").agg(F.when(F.min("cls") <= 1, F.max(F.when(F.col("v") > 30000, 2).otherwise(1))).alias("cls"))
    return nearest.fill_nearest(t)


SCENES = "SELECT scene AS tile, r, c, CASE WHEN min(cls) > 1 THEN NULL ELSE max(CASE WHEN v > 30000 THEN 2 ELSE 1 END) END AS cls FROM prob GROUP BY 1, 2, 3"


@query("JON17_fill_nearest_scenes", with_views("prob", f",,t AS ({SCENES}), k AS (SELECT tile, r, c, cls FROM t WHERE cls IS NOT NULL) SELECT t.tile, t.r, t.c, arg_min(k.cls, row((k.r - t.r) * (k.r - t.r) + (k.c - t.c) * (k.c - t.c), k.r, k.c)) AS cls FROM t LEFT JOIN k ON k.tile = t.tile GROUP BY 1, 2, 3"))
def jon17_scenes(spark, sf):
    t = views.prob(spark, sf).groupBy(F.col("scene").alias("tile"), "r", "c").agg(F.when(F.min("cls") <= 1, F.max(F.when(F.col("v") > 30000, 2).otherwise(1))).alias("cls"))
    return nearest.fill_nearest(t)


@query("JON18_align_grids", with_views("prob", ",,lab AS (SELECT scene, r, c, min(cls) AS cls FROM prob GROUP BY 1, 2, 3), px AS (SELECT DISTINCT scene, r, c FROM prob) SELECT px.scene, px.r, px.c, lab.cls FROM px LEFT JOIN lab ON lab.scene = px.scene AND lab.r = CAST(floor((px.r + 0.5) * 16 / 32) AS INT) AND lab.c = CAST(floor((px.c + 0.5) * 32 / 64) AS INT)"))
def jon18(spark, sf):
    p = views.prob(spark, sf)
    lab = p.groupBy("scene", F.col("r").alias("sr"), F.col("c").alias("sc")).agg(F.min("cls").alias("cls"))
    px = p.select("scene", "r", "c").distinct().withColumn("sr", grid.snap(F.col("r"), 16, 32)).withColumn("sc", grid.snap(F.col("c"), 32, 64))
    return px.join(lab, ["scene", "sr", "sc"], "left").select("scene", "r", "c", "cls")


@query("JON19_clip_polygon", with_views("prob", "SELECT scene, r, c, cls FROM prob WHERE c + 0.5 > 10.2 AND c + 0.5 < 40.7 AND r + 0.5 > 3.1 AND r + 0.5 < 20.9"))
def jon19(spark, sf):
    pt = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    ring = F.array(pt(10.2, 3.1), pt(40.7, 3.1), pt(40.7, 20.9), pt(10.2, 20.9))
    near = views.prob(spark, sf).where("c BETWEEN 10 AND 40 AND r BETWEEN 3 AND 20")
    return near.where(spatial.point_in_ring(F.col("c") + 0.5, F.col("r") + 0.5, ring)).select("scene", "r", "c", "cls")


@query("JON20_paired_pixels", with_views("votes prob", "SELECT v.scene, v.r, v.c, v.cls, count(*) AS n, round(max(p.v), 2) AS v FROM votes v JOIN prob p ON p.scene = v.scene AND p.r = v.r AND p.c = v.c AND p.cls = v.cls GROUP BY 1, 2, 3, 4"))
def jon20(spark, sf):
    n = vote.vote_counts(views.votes(spark, sf))
    return n.join(views.prob(spark, sf), ["scene", "r", "c", "cls"]).withColumn("v", F.round("v", 2))
