"""Queries of the inventory's projections."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from pixelweave.operators import catalog, classify, crs, grid, imagery, masks, spatial, views
from pixelweave.operators.views import table, with_views
from pixelweave.plans.registry import query

GT = {"a": 0.5, "b": 0.0, "c": 1000.0, "d": 0.0, "e": -0.5, "f": 2000.0}


@query("PRJ01_tile_grid", with_views("orthos", "SELECT ortho_id, x.x AS tile_x, y.y AS tile_y FROM orthos, LATERAL (SELECT unnest(generate_series(0, width - 64, 32)) AS x) x, LATERAL (SELECT unnest(generate_series(0, height - 64, 64)) AS y) y"))
def prj01(spark, sf):
    return grid.tile_grid(views.orthos(spark, sf), 64, 0.5, 0.0).select("ortho_id", "tile_x", "tile_y")


@query("PRJ02_step", "SELECT p_partkey, CAST(floor(p_size * (1 - 0.5)) AS BIGINT) AS step FROM part")
def prj02(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.floor(F.col("p_size") * (1 - 0.5)).cast("long").alias("step"))


@query("PRJ03_window_affine", with_views("boxes", "SELECT box_id, 1000.0 + 0.5 * x0 AS c, 2000.0 - 0.5 * y0 AS f FROM boxes"))
def prj03(spark, sf):
    return views.boxes(spark, sf).select("box_id", (F.lit(GT["c"]) + GT["a"] * F.col("x0")).alias("c"), (F.lit(GT["f"]) + GT["e"] * F.col("y0")).alias("f"))


@query("PRJ04_window_bounds", with_views("boxes", "SELECT box_id, 1000.0 + 0.5 * x0 AS bx0, 2000.0 - 0.5 * (y0 + 32) AS by0, 1000.0 + 0.5 * (x0 + 32) AS bx1, 2000.0 - 0.5 * y0 AS by1 FROM boxes"))
def prj04(spark, sf):
    b = grid.tile_bounds(F.col("x0"), F.col("y0"), 32, GT)
    return views.boxes(spark, sf).select("box_id", *[v.alias(f"b{k}") for k, v in b.items()])


@query("PRJ05_pixel_to_world", with_views("prob", "SELECT DISTINCT r, c, CAST(1000.0 + 0.5 * (c + 0.5) AS DOUBLE) AS x, CAST(2000.0 - 0.5 * (r + 0.5) AS DOUBLE) AS y FROM prob"))
def prj05(spark, sf):
    x, y = grid.pixel_to_world(F.col("r"), F.col("c"), GT)
    return views.prob(spark, sf).select("r", "c", x.alias("x"), y.alias("y")).distinct()


@query("PRJ06_world_to_pixel", "SELECT o_orderkey, CAST(floor((o_totalprice / 100 - 2000.0) / -0.5) AS BIGINT) AS r, CAST(floor((o_totalprice / 50 - 1000.0) / 0.5) AS BIGINT) AS c FROM orders")
def prj06(spark, sf):
    r, c = grid.world_to_pixel(F.col("o_totalprice") / 50, F.col("o_totalprice") / 100, GT)
    return table(spark, sf, "orders").select("o_orderkey", r.alias("r"), c.alias("c"))


@query("PRJ07_quantile_stretch", with_views("prob", ",,q AS (SELECT cls, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM prob GROUP BY 1) SELECT scene, r, c, cls, round(greatest(0.0, least(1.0, (v - lo) / (hi - lo + 1e-6))), 6) AS v FROM prob JOIN q USING (cls)"))
def prj07(spark, sf):
    p = views.prob(spark, sf)
    return classify.stretch(p, classify.class_quantiles(p)).withColumn("v", F.round("v", 6))


@query("PRJ08_grey", with_views("rgb", "SELECT tile, y, x, round((r + g + b) / 3, 6) AS grey FROM rgb"))
def prj08(spark, sf):
    return views.rgb(spark, sf).select("tile", "y", "x", F.round(imagery.grey(), 6).alias("grey"))


@query("PRJ09_band_layout", with_views("rgb", "SELECT y, x, CAST(max(r) AS INT) AS b1, CAST(max(g) AS INT) AS b2, CAST(max(b) AS INT) AS b3 FROM rgb GROUP BY 1, 2"))
def prj09(spark, sf):
    bands = views.rgb(spark, sf).select("y", "x", F.explode(F.array(*[F.struct(F.lit(i).alias("band"), v.alias("v")) for i, v in enumerate((F.col("r"), F.col("g"), F.col("b"), F.lit(127)), 1)])).alias("s")).select("y", "x", "s.*")
    wide = bands.where("band <= 3").groupBy("y", "x").pivot("band", [1, 2, 3]).agg(F.max("v"))
    return wide.select("y", "x", F.col("1").alias("b1"), F.col("2").alias("b2"), F.col("3").alias("b3"))


@query("PRJ10_logits_to_label", "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) AS INT) AS cls FROM embeddings")
def prj10(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.array_position("embedding", F.array_max("embedding")).cast("int").alias("cls"))


@query("PRJ11_label_shift", with_views("labelled", "SELECT zone, gt, CASE WHEN gt = 0 THEN NULL ELSE gt - 1 END AS shifted, count(*) AS n FROM labelled GROUP BY 1, 2, 3"))
def prj11(spark, sf):
    return views.labelled(spark, sf).withColumn("shifted", F.when(F.col("gt") != 0, F.col("gt") - 1)).groupBy("zone", "gt", "shifted").agg(F.count("*").alias("n"))


@query("PRJ12_one_hot", "SELECT vec_id, " + ", ".join(f"CAST(label = {k} AS INT) AS c{k}" for k in range(10)) + " FROM embeddings")
def prj12(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", *[(F.col("label") == k).cast("int").alias(f"c{k}") for k in range(10)])


@query("PRJ13_softmax", "SELECT vec_id, round(exp(CAST(embedding[1] AS DOUBLE)) / (" + " + ".join(f"exp(CAST(embedding[{k}] AS DOUBLE))" for k in range(1, 6)) + "), 6) AS p1 FROM embeddings")
def prj13(spark, sf):
    a = F.transform(F.slice("embedding", 1, 5), lambda x: x.cast("double"))
    return table(spark, sf, "embeddings").select("vec_id", F.round(imagery.softmax(a)[0], 6).alias("p1"))


@query("PRJ14_apply_matrix", with_views("rgb", "SELECT y, x, CAST(floor(greatest(0.0, least(255.0, r * 0.9 + g * 0.2 + b * 0.1 + 0.05 * 255))) AS INT) AS r, CAST(floor(greatest(0.0, least(255.0, g * 1.5 + -0.1 * 255))) AS INT) AS g FROM rgb"))
def prj14(spark, sf):
    k = lambda v: F.lit(float(v))
    m = {"rr": k(0.9), "rg": k(0.2), "rb": k(0.1), "r0": k(0.05), "gr": k(0), "gg": k(1.5), "gb": k(0), "g0": k(-0.1), "br": k(0), "bg": k(0), "bb": k(1), "b0": k(0)}
    out = imagery.apply_matrix(m)
    return views.rgb(spark, sf).select("y", "x", out["r"].alias("r"), out["g"].alias("g"))


def hue_weight_sql(h: str) -> tuple[str, str, str]:
    u, w = f"cos({h} * pi() / 180)", f"sin({h} * pi() / 180)"
    return f"(0.299e0 + 0.701e0 * {u} + 0.168e0 * {w})", f"(0.587e0 + -0.587e0 * {u} + 0.33e0 * {w})", f"(0.114e0 + -0.114e0 * {u} + -0.497e0 * {w})"


def _hue_sql(h: str) -> str:
    r, g, b = hue_weight_sql(h)
    return f"avg_r * {r} + avg_g * {g} + avg_b * {b}"


STATS_SQL = "s AS (SELECT tile, avg(r) AS avg_r, avg(g) AS avg_g, avg(b) AS avg_b, count(*) AS pixels FROM rgb GROUP BY 1)"


@query("PRJ15_hue_shift_red", with_views("rgb", f",,{STATS_SQL} SELECT tile, round({_hue_sql('30')}, 6) AS red FROM s"))
def prj15(spark, sf):
    s = imagery.channel_stats(views.rgb(spark, sf))
    return s.select("tile", F.round(imagery.hue_shifted_red(F.col("avg_r"), F.col("avg_g"), F.col("avg_b"), F.lit(30.0)), 6).alias("red"))


@query("PRJ16_hue_search", with_views("rgb", f",,s0 AS (SELECT tile, avg(r) / 4 AS avg_r, avg(g) AS avg_g, avg(b) AS avg_b FROM rgb GROUP BY 1), h AS (SELECT unnest(generate_series(0, 120)) AS h), t AS (SELECT tile, avg_r, h, {_hue_sql('h')} AS red FROM s0, h) SELECT tile, CAST(CASE WHEN avg_r >= 60 THEN 0 ELSE coalesce(min(h) FILTER (WHERE red >= 60) + 1, 121) END AS INT) AS shift FROM t GROUP BY tile, avg_r"))
def prj16(spark, sf):
    s = imagery.channel_stats(views.rgb(spark, sf)).withColumn("avg_r", F.col("avg_r") / 4)
    return imagery.least_hue_shift(s)


@query("PRJ17_colour_relief", with_views("labelled", "SELECT gt AS cls, 25 * gt AS red, count(*) AS n FROM labelled WHERE gt BETWEEN 1 AND 9 GROUP BY 1, 2"))
def prj17(spark, sf):
    colours = spark.createDataFrame([(k, 25 * k) for k in range(1, 10)], "cls int, red int")
    return catalog.with_class_info(views.labelled(spark, sf).withColumnRenamed("gt", "cls"), colours).groupBy("cls", "red").agg(F.count("*").alias("n"))


@query("PRJ18_blend", with_views("rgb", "SELECT y, x, round(CAST(r * 0.8 + g * 0.2 AS DOUBLE), 4) AS v FROM rgb"))
def prj18(spark, sf):
    return views.rgb(spark, sf).select("y", "x", F.round(imagery.blend(F.col("r"), F.col("g"), 0.2), 4).alias("v"))


@query("PRJ19_slice_shift", with_views("orthos", "SELECT ortho_id, CAST(2000.0 - 0.5 * (height // 2) AS DOUBLE) AS f, CAST(1000.0 AS DOUBLE) AS c FROM orthos"))
def prj19(spark, sf):
    _, y = grid.pixel_to_world(F.floor(F.col("height") / 2) - 0.5, F.lit(-0.5), GT)
    return views.orthos(spark, sf).select("ortho_id", y.alias("f"), F.lit(1000.0).alias("c"))


@query("PRJ20_strips", with_views("orthos", "SELECT ortho_id, greatest(1, CAST(floor(9000 / (width * 4)) AS BIGINT)) AS rows, CAST(ceil(height / greatest(1, floor(9000 / (width * 4)))) AS BIGINT) AS strips FROM orthos"))
def prj20(spark, sf):
    rows, n = grid.strips(F.col("height"), F.col("width"), 4, 9000)
    return views.orthos(spark, sf).select("ortho_id", rows.alias("rows"), n.alias("strips"))


@query("PRJ21_mosaic_window", with_views("boxes", "SELECT box_id, greatest(0, CAST(floor(x0 - 100.5 + 0.5) AS BIGINT)) AS c0, least(500, CAST(floor(x1 - 100.5 + 0.5) AS BIGINT)) AS c1 FROM boxes WHERE greatest(0, floor(x0 - 100.5 + 0.5)) < least(500, floor(x1 - 100.5 + 0.5))"))
def prj21(spark, sf):
    at = lambda c: F.floor(F.col(c) - 100.5 + 0.5)
    return views.boxes(spark, sf).select("box_id", F.greatest(F.lit(0).cast("long"), at("x0")).alias("c0"), F.least(F.lit(500).cast("long"), at("x1")).alias("c1")).where("c0 < c1")


@query("PRJ22_utm_epsg", "SELECT o_orderkey, CAST(floor((o_orderkey % 360 - 180.0 + 180) / 6) + 1 AS INT) AS zone, CAST((CASE WHEN o_orderkey % 2 = 0 THEN 32600 ELSE 32700 END) + floor((o_orderkey % 360 - 180.0 + 180) / 6) + 1 AS INT) AS epsg FROM orders")
def prj22(spark, sf):
    lon, lat = F.col("o_orderkey") % 360 - 180.0, F.when(F.col("o_orderkey") % 2 == 0, 10.0).otherwise(-10.0)
    return table(spark, sf, "orders").select("o_orderkey", spatial.utm_zone(lon).alias("zone"), spatial.utm_epsg(lon, lat).cast("int").alias("epsg"))


UTM = crs.utm_sql("(n_nationkey * 10.0 - 120)::DOUBLE", "(n_nationkey * 5.0 - 60)::DOUBLE", "(floor((n_nationkey * 10.0 + 60) / 6) + 1)", "n_nationkey < 12")


@query("PRJ23_utm_project", f"SELECT n_nationkey, round({UTM[0]}, 3) AS east, round({UTM[1]}, 3) AS north FROM nation")
def prj23(spark, sf):
    n = table(spark, sf, "nation").select("n_nationkey", (F.col("n_nationkey") * 10.0 - 120).alias("lon"), (F.col("n_nationkey") * 5.0 - 60).alias("lat"))
    out = crs.reproject(n, "lon", "lat", F.lit(4326), spatial.utm_epsg(F.col("lon"), F.col("lat")), ("east", "north"))
    return out.select("n_nationkey", F.round("east", 3).alias("east"), F.round("north", 3).alias("north"))


@query("PRJ23_utm_round_trip", "SELECT p_partkey, round(CAST((p_partkey % 3600) / 10.0 - 180 + 0.01 AS DOUBLE), 6) AS lon, round(CAST((p_partkey % 160) - 79.5 AS DOUBLE), 6) AS lat FROM part")
def prj23_back(spark, sf):
    """Degrees to UTM and back."""
    p = table(spark, sf, "part").select("p_partkey", (F.col("p_partkey") % 3600 / 10.0 - 180 + 0.01).alias("lon"), (F.col("p_partkey") % 160 - 79.5).alias("lat"))
    e, n = spatial.utm_project(F.col("lon"), F.col("lat"))
    at = p.select("p_partkey", e.alias("e"), n.alias("n"), spatial.utm_zone(F.col("lon")).alias("zone"), (F.col("lat") < 0).alias("south"))
    lon, lat = spatial.utm_unproject(F.col("e"), F.col("n"), F.col("zone"), F.col("south"))
    return at.select("p_partkey", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


@query("PRJ24_buffer", with_views("boxes", "SELECT box_id, x0 + 5 AS x0, y0 + 5 AS y0, x1 - 5 AS x1, y1 - 5 AS y1 FROM boxes WHERE x0 + 5 <= x1 - 5 AND y0 + 5 <= y1 - 5"))
def prj24(spark, sf):
    return spatial.buffer_boxes(views.boxes(spark, sf), -5)


@query("PRJ25_class_name", with_views("orthos", "SELECT ortho_id, replace(replace(path, '20230101_', ''), '_ortho.tif', '') AS name FROM orthos"))
def prj25(spark, sf):
    return views.orthos(spark, sf).select("ortho_id", F.replace(F.replace("path", F.lit("20230101_"), F.lit("")), F.lit("_ortho.tif"), F.lit("")).alias("name"))


@query("PRJ26_place_key", with_views("sessions", "SELECT session_id, split_part(session, '_', 2) AS place_key FROM sessions"))
def prj26(spark, sf):
    return views.sessions(spark, sf).select("session_id", catalog.place_of(F.col("session")).alias("place_key"))


@query("PRJ27_box_formats", with_views("boxes", "SELECT box_id, x0 + 10 AS x, y0 + 20 AS y, x1 - x0 AS w, y1 - y0 AS h FROM boxes"))
def prj27(spark, sf):
    return views.boxes(spark, sf).select("box_id", (F.col("x0") + 10).alias("x"), (F.col("y0") + 20).alias("y"), (F.col("x1") - F.col("x0")).alias("w"), (F.col("y1") - F.col("y0")).alias("h"))


@query("PRJ28_longest_side", with_views("orthos", "SELECT ortho_id, CAST(floor(height * (1024.0 / greatest(height, width)) + 0.5) AS BIGINT) AS h, CAST(floor(width * (1024.0 / greatest(height, width)) + 0.5) AS BIGINT) AS w FROM orthos"))
def prj28(spark, sf):
    h, w = masks.longest_side(F.col("height"), F.col("width"), 1024)
    return views.orthos(spark, sf).select("ortho_id", h.alias("h"), w.alias("w"))


@query("PRJ29_point_grid", with_views("boxes", ",,g AS (SELECT CAST(l.l AS INT) AS layer, (i.i + 0.5) / (8 // CAST(power(2, l.l) AS INT)) AS x, (j.j + 0.5) / (8 // CAST(power(2, l.l) AS INT)) AS y FROM (SELECT unnest(generate_series(0, 2)) AS l) l, (SELECT unnest(generate_series(0, 7)) AS i) i, (SELECT unnest(generate_series(0, 7)) AS j) j WHERE i.i < 8 // CAST(power(2, l.l) AS INT) AND j.j < 8 // CAST(power(2, l.l) AS INT)) SELECT box_id, layer, count(*) AS points, round(min(x0 + x * (x1 - x0)), 6) AS first_x, round(sum(y0 + y * (y1 - y0)), 4) AS sum_y FROM boxes, g GROUP BY 1, 2"))
def prj29(spark, sf):
    """The grid of points of each layer, laid over each box."""
    g = masks.point_grid(spark, 8, 2, 2)
    at = views.boxes(spark, sf).crossJoin(F.broadcast(g))  # 84 points, whatever the table
    x, y = F.col("x0") + F.col("x") * (F.col("x1") - F.col("x0")), F.col("y0") + F.col("y") * (F.col("y1") - F.col("y0"))
    return at.groupBy("box_id", "layer").agg(F.count("*").alias("points"), F.round(F.min(x), 6).alias("first_x"), F.round(F.sum(y), 4).alias("sum_y"))


@query("PRJ30_crop_boxes", with_views("orthos", ",,l AS (SELECT ortho_id, width, height, 0 AS layer, 1 AS n, 0 AS ov FROM orthos UNION ALL SELECT ortho_id, width, height, 1, 2, CAST(floor(0.25 * least(width, height) * 2 / 2) AS BIGINT) FROM orthos), d AS (SELECT *, CAST(ceil((ov * (n - 1) + width) / n) AS BIGINT) AS cw, CAST(ceil((ov * (n - 1) + height) / n) AS BIGINT) AS ch FROM l) SELECT ortho_id, CAST(layer AS INT) AS layer, (cw - ov) * i.i AS x0, (ch - ov) * j.j AS y0, least((cw - ov) * i.i + cw, width) AS x1, least((ch - ov) * j.j + ch, height) AS y1 FROM d, (SELECT unnest([0, 1]) AS i) i, (SELECT unnest([0, 1]) AS j) j WHERE i.i < n AND j.j < n"))
def prj30(spark, sf):
    return masks.crop_boxes(views.orthos(spark, sf).select("ortho_id", "width", "height"), 1, 0.25).select("ortho_id", "layer", "x0", "y0", "x1", "y1")


@query("PRJ31_normalise", with_views("rgb", "SELECT y, x, round((r - 123.675) / 58.395, 6) AS r, round((g - 116.28) / 57.12, 6) AS g, round((b - 103.53) / 57.375, 6) AS b FROM rgb"))
def prj31(spark, sf):
    # fixed values: means and deviations of the three channels
    stats = {"r": (123.675, 58.395), "g": (116.28, 57.12), "b": (103.53, 57.375)}
    return views.rgb(spark, sf).select("y", "x", *[F.round((F.col(c) - m) / s, 6).alias(c) for c, (m, s) in stats.items()])


@query("PRJ32_gaussian_prompt", with_views("masks", ",,d AS (SELECT mask_id, r, c, sqrt(CAST(r * r + c * c AS DOUBLE)) AS d, on_ FROM masks), m AS (SELECT mask_id, max(d) FILTER (WHERE on_ = 1) AS dmax, sum(on_) AS area FROM d GROUP BY 1) SELECT d.mask_id, r, c, round(CASE WHEN on_ = 1 THEN exp(-power(d - dmax, 2) / area) ELSE 0.0 END, 6) AS p FROM d JOIN m USING (mask_id)"))
def prj32(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("mask_id")
    m = views.masks(spark, sf).withColumn("d", F.sqrt((F.col("r") * F.col("r") + F.col("c") * F.col("c")).cast("double")))
    p = F.when(F.col("on_") == 1, F.exp(-F.pow(F.col("d") - F.max(F.when(F.col("on_") == 1, F.col("d"))).over(w), F.lit(2)) / F.sum("on_").over(w))).otherwise(0.0)
    return m.select("mask_id", "r", "c", F.round(p, 6).alias("p"))


@query("PRJ33_signed_prompt", with_views("masks", "SELECT mask_id, r, c, CASE WHEN on_ = 1 THEN 10.0 ELSE -10.0 END * exp(0.0) AS p FROM masks"))
def prj33(spark, sf):
    return views.masks(spark, sf).select("mask_id", "r", "c", F.when(F.col("on_") == 1, 10.0).otherwise(-10.0).alias("p"))


@query("PRJ35_gaussian_kernel", with_views("masks", ",,b AS (SELECT mask_id, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1 FROM masks WHERE on_ = 1 GROUP BY 1) SELECT m.mask_id, m.r, m.c, round(exp(-(power(m.r - (r0 + r1) / 2.0, 2) / (2 * power((r1 - r0 + 1) / 4.0, 2)) + power(m.c - (c0 + c1) / 2.0, 2) / (2 * power((c1 - c0 + 1) / 4.0, 2)))), 6) AS g FROM masks m JOIN b USING (mask_id)"))
def prj35(spark, sf):
    """A Gaussian over the box of each mask: its centre in the middle, a quarter of each side its deviation."""
    m = views.masks(spark, sf)
    b = m.where("on_ = 1").groupBy("mask_id").agg(*[f(c).alias(n) for f, c, n in ((F.min, "r", "r0"), (F.max, "r", "r1"), (F.min, "c", "c0"), (F.max, "c", "c1"))])
    part = lambda v, lo, hi: F.pow(F.col(v) - (F.col(lo) + F.col(hi)) / 2, F.lit(2)) / (2 * F.pow((F.col(hi) - F.col(lo) + 1) / 4, F.lit(2)))
    return m.join(b, "mask_id").select("mask_id", "r", "c", F.round(F.exp(-(part("r", "r0", "r1") + part("c", "c0", "c1"))), 6).alias("g"))


@query("PRJ36_run_name", "SELECT event_id, left(event_type || '-' || strftime(ts, '%Y_%m_%d') || '_' || CAST(hour(ts) * 3600 + minute(ts) * 60 + CAST(floor(second(ts)) AS BIGINT) AS VARCHAR) || '-bs16', 96) AS run FROM events")
def prj36(spark, sf):
    sec = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    return table(spark, sf, "events").select("event_id", F.substring(F.concat("event_type", F.lit("-"), F.date_format("ts", "yyyy_MM_dd"), F.lit("_"), sec.cast("string"), F.lit("-bs16")), 1, 96).alias("run"))


@query("PRJ37_nearest_resize", with_views("prob", ",,l AS (SELECT scene, r, c, min(cls) AS cls FROM prob GROUP BY 1, 2, 3), g AS (SELECT scene, CAST(i.i AS INT) AS r, CAST(j.j AS INT) AS c FROM (SELECT DISTINCT scene FROM prob), (SELECT unnest(generate_series(0, 47)) AS i) i, (SELECT unnest(generate_series(0, 47)) AS j) j) SELECT g.scene, g.r, g.c, l.cls FROM g LEFT JOIN l ON l.scene = g.scene AND l.r = CAST(floor((g.r + 0.5) * 32 / 48) AS INT) AND l.c = CAST(floor((g.c + 0.5) * 64 / 48) AS INT)"))
def prj37(spark, sf):
    src = views.prob(spark, sf).groupBy("scene", "r", "c").agg(F.min("cls").alias("cls")).withColumnsRenamed({"r": "sr", "c": "sc"})
    axis = F.sequence(F.lit(0), F.lit(47))
    g = src.select("scene").distinct().withColumn("r", F.explode(axis)).withColumn("c", F.explode(axis))
    g = g.withColumn("sr", grid.snap(F.col("r"), 32, 48)).withColumn("sc", grid.snap(F.col("c"), 64, 48))
    return g.join(src, ["scene", "sr", "sc"], "left").select("scene", "r", "c", "cls")


DRAWN = "1 + (CAST('0x' || left(md5(tile || '{0}'), 8) AS BIGINT) / 4294967296.0::DOUBLE - 0.5::DOUBLE) * 0.5::DOUBLE"


@query("PRJ38_colour_jitter", with_views("rgb", "SELECT tile, y, x, " + ", ".join(f"CAST(floor(greatest(0e0, least(255e0, {c} * ({DRAWN.format('light')}) * ({DRAWN.format(c)})))) AS INT) AS {c}" for c in "rgb") + " FROM rgb"))
def prj38(spark, sf):
    """Each image lighter or darker, and each of its channels by a factor of its own, drawn from the image's name."""
    drawn = lambda what: 1 + (F.conv(F.left(F.md5(F.concat("tile", F.lit(what))), F.lit(8)), 16, 10).cast("long") / 4294967296.0 - 0.5) * 0.5
    return views.rgb(spark, sf).select("tile", "y", "x", *[imagery.clamp(F.col(c) * drawn("light") * drawn(c)).alias(c) for c in imagery.CHANNELS])

