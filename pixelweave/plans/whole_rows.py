"""Queries of inventory rows in full: two affines, context strips, prompts, artefacts, sections, padding, resumed streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelweave.operators import catalog, grid, imagery, masks, pandas_ops, views
from pixelweave.operators.views import table, with_views
from pixelweave.plans.registry import query

#: Affines of pixels half a metre wide, and of labels two metres wide and one high, that start 4 m to the right.
FINE = {"a": 0.5, "b": 0.0, "c": 1000.0, "d": 0.0, "e": -0.5, "f": 2000.0}
COARSE = {"a": 2.0, "b": 0.0, "c": 1004.0, "d": 0.0, "e": -1.0, "f": 2000.0}

LABELS = "lab AS (SELECT scene, r, c, CASE WHEN min(cls) > 4 THEN 0 ELSE min(cls) END AS cls FROM prob GROUP BY 1, 2, 3), px AS (SELECT DISTINCT scene, r, c FROM prob), snapped AS (SELECT px.scene, px.r, px.c, lab.cls FROM px LEFT JOIN lab ON lab.scene = px.scene AND lab.r = floor((2000.0 - 0.5 * (px.r + 0.5) - 2000.0) / -1.0) AND lab.c = floor((1000.0 + 0.5 * (px.c + 0.5) - 1004.0) / 2.0))"


def snapped(spark, sf):
    p = views.prob(spark, sf)
    labels = p.groupBy("scene", "r", "c").agg(F.when(F.min("cls") > 4, 0).otherwise(F.min("cls")).alias("cls"))
    return grid.snap_labels(p.select("scene", "r", "c").distinct(), labels, FINE, COARSE)


@query("JON18_align_affines", with_views("prob", f",,{LABELS} SELECT * FROM snapped"))
def jon18_affines(spark, sf):
    return snapped(spark, sf)


@query("JON02_snap_whole_tiles", with_views("prob", f",,{LABELS}, t AS (SELECT *, CAST(floor(r / 4) AS BIGINT) AS ty, CAST(floor(c / 4) AS BIGINT) AS tx FROM snapped), ok AS (SELECT scene, ty, tx FROM t GROUP BY 1, 2, 3 HAVING min(coalesce(cls, 0)) > 0) SELECT t.* FROM t JOIN ok USING (scene, ty, tx)"))
def jon02_tiles(spark, sf):
    """Tiles of 4 x 4 pixels under labels all over."""
    t = snapped(spark, sf).withColumn("ty", F.floor(F.col("r") / 4)).withColumn("tx", F.floor(F.col("c") / 4))
    return grid.whole_tiles(t, ("scene", "ty", "tx"))


DIM = "CASE WHEN tile = 'N/O' AND x = 1 THEN 0 WHEN tile = 'R/F' AND x <= 2 THEN 255 WHEN tile = 'A/F' AND x = 1 AND y % 8 = 0 THEN 0 ELSE {} END"


@query("FLT02_blank_tiles_found", with_views("rgb", ",,d AS (SELECT tile, " + ", ".join(f"{DIM.format(k)} AS {k}" for k in "rgb") + "), g AS (SELECT tile, count(*) AS pixels, sum(CASE WHEN r + g + b = 0 THEN 1 ELSE 0 END) * 100.0 / count(*) AS black, sum(CASE WHEN r + g + b = 765 THEN 1 ELSE 0 END) * 100.0 / count(*) AS white FROM d GROUP BY 1) SELECT tile, pixels, round(black, 4) AS black_pct, round(white, 4) AS white_pct FROM g WHERE black <= 5 AND white <= 10").replace("AS b), g AS", "AS b FROM rgb), g AS"))
def flt02_found(spark, sf):
    """Images of which one is too black and one too white."""
    px = views.rgb(spark, sf)
    px = px.select("tile", *[F.expr(DIM.format(k)).alias(k) for k in "rgb"])
    return grid.filter_blank_tiles(px).select("tile", "pixels", F.round("black_pct", 4).alias("black_pct"), F.round("white_pct", 4).alias("white_pct"))


@query("PRJ28_apply_boxes", with_views("orthos boxes", ",,s AS (SELECT ortho_id, height, width, floor(height * (1024.0 / greatest(height, width)) + 0.5) / height AS sy, floor(width * (1024.0 / greatest(height, width)) + 0.5) / width AS sx FROM orthos) SELECT box_id, round(x0 * sx, 6) AS x0, round(y0 * sy, 6) AS y0, round(x1 * sx, 6) AS x1, round(y1 * sy, 6) AS y1 FROM boxes JOIN s ON ortho_id = box_id"))
def prj28_boxes(spark, sf):
    b = views.boxes(spark, sf).join(views.orthos(spark, sf).select(F.col("ortho_id").alias("box_id"), "height", "width"), "box_id")
    ends = {n: v for k in "01" for n, v in zip((f"x{k}", f"y{k}"), masks.scale_point(F.col(f"x{k}"), F.col(f"y{k}"), F.col("height"), F.col("width"), 1024), strict=True)}
    return b.select("box_id", *[F.round(v, 6).alias(n) for n, v in ends.items()])


@query("PRJ31_pad_square", with_views("prob", ",,px AS (SELECT scene, r, c, round(max(v), 2) AS v FROM prob GROUP BY 1, 2, 3), s AS (SELECT DISTINCT scene FROM px), g AS (SELECT scene, CAST(i.i AS INT) AS r, CAST(j.j AS INT) AS c FROM s, (SELECT unnest(generate_series(0, 63)) AS i) i, (SELECT unnest(generate_series(0, 63)) AS j) j) SELECT g.scene, g.r, g.c, coalesce(px.v, 0.0) AS v FROM g LEFT JOIN px ON px.scene = g.scene AND px.r = g.r AND px.c = g.c"))
def prj31_pad(spark, sf):
    px = views.prob(spark, sf).groupBy("scene", "r", "c").agg(F.round(F.max("v"), 2).alias("v"))
    return imagery.pad_square(px, 64, ("v",), ("scene",))


@query("PRJ33_weighted_prompt", with_views("prob", "SELECT scene, cls, r, c, round((CASE WHEN v > 40000 THEN 15.0 ELSE -15.0 END) * (CASE WHEN v > 30000 THEN exp(-power(v / 10000 - 4, 2)) ELSE 1.0 END), 6) AS p FROM prob"))
def prj33_weighted(spark, sf):
    weight = F.when(F.col("v") > 30000, F.exp(-F.pow(F.col("v") / 10000 - 4, F.lit(2)))).otherwise(0.0)
    return views.prob(spark, sf).select("scene", "cls", "r", "c", F.round(masks.weighted_prompt((F.col("v") > 40000).cast("int"), weight), 6).alias("p"))


@query("AGG30_context_strips", with_views("prob boxes", """,,l AS (SELECT DISTINCT scene, r, c FROM prob WHERE v > 75000 AND cls <= 2),
  b AS (SELECT box_id, substr('ANR', CAST(box_id % 3 + 1 AS INT), 1) AS scene, CAST(x0 % 45 AS BIGINT) AS x0, CAST(y0 % 20 AS BIGINT) AS y0, CAST(x0 % 45 AS BIGINT) + 12 AS x1, CAST(y0 % 20 AS BIGINT) + 11 AS y1 FROM boxes),
  s AS (SELECT box_id, scene, 'x0' AS side, x0 - 1.2 AS e, CAST(trunc(x0 - 1.2) AS BIGINT) AS ax, x0 AS bx, y0 AS ya, y1 AS yb FROM b WHERE trunc(x0 - 1.2) > 0
    UNION ALL SELECT box_id, scene, 'x1', x1 + 1.2, x1, CAST(trunc(x1 + 1.2) AS BIGINT), y0, y1 FROM b WHERE trunc(x1 + 1.2) < 64
    UNION ALL SELECT box_id, scene, 'y0', y0 - 1.1, x0, x1, CAST(trunc(y0 - 1.1) AS BIGINT), y0 FROM b WHERE trunc(y0 - 1.1) > 0
    UNION ALL SELECT box_id, scene, 'y1', y1 + 1.1, x0, x1, y1, CAST(trunc(y1 + 1.1) AS BIGINT) FROM b WHERE trunc(y1 + 1.1) < 32),
  n AS (SELECT s.box_id, s.side, CAST(trunc(e) AS BIGINT) AS e FROM s JOIN l ON l.scene = s.scene AND l.c >= s.ax AND l.c < s.bx AND l.r >= s.ya AND l.r < s.yb GROUP BY s.box_id, s.side, s.e, s.ax, s.bx, s.ya, s.yb HAVING CAST(count(*) AS DOUBLE) / ((bx - ax) * (yb - ya)) > 0.5)
  SELECT box_id, scene, """ + ", ".join(f"coalesce((SELECT max(e) FROM n WHERE n.box_id = b.box_id AND n.side = '{k}'), {k}) AS {k}" for k in ("x0", "y0", "x1", "y1")) + " FROM b"))
def agg30_strips(spark, sf):
    like = views.prob(spark, sf).where("v > 75000 AND cls <= 2")
    x, y = (F.col("x0") % 45).cast("long"), (F.col("y0") % 20).cast("long")
    scene = F.substring(F.lit("ANR"), (F.col("box_id") % 3 + 1).cast("int"), F.lit(1))
    b = views.boxes(spark, sf).select("box_id", scene.alias("scene"), x.alias("x0"), y.alias("y0"), (x + 12).alias("x1"), (y + 11).alias("y1"))
    return masks.expand_boxes(b, like, 32, 64, 0.5, image="scene")


@query("AGG33_negative_prompt", with_views("masks", ",,b AS (SELECT mask_id, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1 FROM masks WHERE on_ = 1 GROUP BY 1), u AS (SELECT mask_id, i.i AS r, j.j AS c FROM b, (SELECT unnest(generate_series(0, 31)) AS i) i, (SELECT unnest(generate_series(0, 63)) AS j) j WHERE i.i >= r0 AND i.i < r1 AND j.j >= c0 AND j.j < c1 EXCEPT SELECT mask_id, r, c FROM masks WHERE on_ = 1), d AS (SELECT u.mask_id, u.r, u.c, min((u.r - m.r) * (u.r - m.r) + (u.c - m.c) * (u.c - m.c)) AS d2 FROM u JOIN masks m ON m.mask_id = u.mask_id AND m.on_ = 1 GROUP BY 1, 2, 3) SELECT mask_id, CAST(arg_min(r, row(-d2, r, c)) AS INT) AS r, CAST(arg_min(c, row(-d2, r, c)) AS INT) AS c FROM d GROUP BY 1"))
def agg33_negative(spark, sf):
    """The point outside each mask but within its box (far ends excluded) that is farthest from it, the first of equals."""
    m = views.masks(spark, sf).where("on_ = 1").select("mask_id", "r", "c")
    box = m.groupBy("mask_id").agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    axis = lambda lo, hi: F.explode(F.sequence(F.col(lo), F.col(hi)))
    cells = box.withColumn("r", axis("r0", "r1")).withColumn("c", axis("c0", "c1")).join(m.withColumn("on_", F.lit(0)), ["mask_id", "r", "c"], "left")
    d = pandas_ops.edt(cells.select("mask_id", "r", "c", F.coalesce("on_", F.lit(1)).alias("on_"))).join(box, "mask_id").where("r < r1 AND c < c1")
    return d.groupBy("mask_id").agg(F.min_by(F.struct("r", "c"), F.struct(-F.col("d"), "r", "c")).alias("p")).select("mask_id", "p.r", "p.c")


@query("JON12_cascade_artefacts", "WITH bad AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_quantity > 48 AND l_tax > 0.06) SELECT 'tile' AS artefact, o_orderkey AS k FROM orders WHERE o_orderkey NOT IN (SELECT k FROM bad) UNION ALL SELECT 'label', l_orderkey FROM lineitem WHERE l_linenumber = 1 AND l_orderkey NOT IN (SELECT k FROM bad) UNION ALL SELECT 'image', l_orderkey FROM lineitem WHERE l_linenumber = 2 AND l_orderkey NOT IN (SELECT k FROM bad) UNION ALL SELECT 'mask', l_orderkey FROM lineitem WHERE l_linenumber = 3 AND l_orderkey NOT IN (SELECT k FROM bad)")
def jon12_artefacts(spark, sf):
    li = table(spark, sf, "lineitem")
    kind = lambda name, rows: rows.select(F.lit(name).alias("artefact"), "k")
    line = lambda n: li.where(F.col("l_linenumber") == n).select(F.col("l_orderkey").alias("k"))
    bad = li.where("l_quantity > 48 AND l_tax > 0.06").select(F.col("l_orderkey").alias("k"))
    four = kind("tile", table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))), kind("label", line(1)), kind("image", line(2)), kind("mask", line(3))
    return catalog.stack_layers(*catalog.cascade_delete(bad, "k", *four))


@query("SRC07_required_sections", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def src07_sections(spark, sf):
    """Configurations with all sections that are asked for."""
    e = table(spark, sf, "events").select("event_id", F.format_string('{"train": %s, "setup": {"tiles": %s}}', "props", "props").alias("config"))
    return catalog.require_sections(e, "config", ("train", "setup", "setup.tiles")).select("event_id", F.get_json_object("config", "$.train.k").cast("int").alias("k"))


@query("STR03_resumed_mosaic", with_views("votes", ",,n AS (SELECT scene, r, c, cls, count(*) AS n FROM votes GROUP BY 1, 2, 3, 4) SELECT scene, r, c, arg_max(cls, row(n, -cls)) AS cls, max(n) AS n FROM n GROUP BY 1, 2, 3"))
def str03(spark, sf):
    """A mosaic stream that ends, finds more files, and goes on from its checkpoint."""
    from pixelweave.scratch import scratch_path
    from pixelweave.streaming.tiles import latest_batch, mosaic_stream, read_stream

    path = scratch_path(spark, "resumed")
    votes = views.votes(spark, sf)
    for even in (0, 1):
        votes.where(F.col("r") % 2 == even).write.mode("append").parquet(f"{path}/in")
        mosaic_stream(read_stream(spark, f"{path}/in", votes.schema), f"{path}/rows", f"{path}/checkpoint").awaitTermination()
    return latest_batch(spark, f"{path}/rows").select("scene", "r", "c", "cls", "n")
