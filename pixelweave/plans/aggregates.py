"""Queries of the inventory's aggregates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pixelweave.operators import catalog, classify, imagery, masks, metrics, pandas_ops, regions, spatial, views, vote
from pixelweave.operators.views import table, with_views
from pixelweave.plans.filters_joins import MOSAIC, aligned
from pixelweave.plans.projections import STATS_SQL
from pixelweave.plans.registry import query
from pixelweave.plans.structures import islands_sql, region_sql

KNOWN = "k AS (SELECT zone, gt, pred FROM labelled WHERE gt <> 0), lab AS (SELECT DISTINCT zone, label FROM (SELECT zone, gt AS label FROM k UNION ALL SELECT zone, pred FROM k) WHERE label <> 0), n AS (SELECT zone, gt, pred, count(*) AS n FROM k GROUP BY 1, 2, 3), cm AS (SELECT a.zone, a.label AS gt, b.label AS pred, coalesce(n.n, 0) AS n FROM lab a JOIN lab b ON a.zone = b.zone LEFT JOIN n ON n.zone = a.zone AND n.gt = a.label AND n.pred = b.label)"
PER = "ro AS (SELECT zone, gt AS label, sum(n) AS support, sum(CASE WHEN gt = pred THEN n ELSE 0 END) AS tp FROM cm GROUP BY 1, 2), co AS (SELECT zone, pred AS label, sum(n) AS predicted FROM cm GROUP BY 1, 2), per AS (SELECT zone, label, tp, support, tp / (support + 1e-7) AS accuracy, tp / (support + predicted - tp + 1e-7) AS iou FROM ro JOIN co USING (zone, label))"


def cm(spark, sf):
    return metrics.confusion(views.labelled(spark, sf), ("zone",))


@query("AGG01_quantiles", with_views("prob", "SELECT cls, round(quantile_cont(v, 0.01), 4) AS q_lo, round(quantile_cont(v, 0.99), 4) AS q_hi FROM prob GROUP BY 1"))
def agg01(spark, sf):
    return classify.class_quantiles(views.prob(spark, sf)).select("cls", F.round("q_lo", 4).alias("q_lo"), F.round("q_hi", 4).alias("q_hi"))


@query("AGG02_max_probability", with_views("prob", "SELECT scene, r, c, round(max(v), 4) AS v FROM prob GROUP BY 1, 2, 3"))
def agg02(spark, sf):
    return classify.classify(views.prob(spark, sf)).select("scene", "r", "c", F.round("v", 4).alias("v"))


@query("AGG03_argmax_class", with_views("prob", "SELECT scene, r, c, arg_max(cls, row(v, -cls)) AS cls FROM prob GROUP BY 1, 2, 3"))
def agg03(spark, sf):
    return classify.classify(views.prob(spark, sf)).drop("v")


@query("AGG04_black_white_share", with_views("rgb", "SELECT tile, round(sum(CASE WHEN (r + g + b) / 3 < 50 THEN 1 ELSE 0 END) * 100.0 / count(*), 4) AS dark, round(sum(CASE WHEN (r + g + b) / 3 > 200 THEN 1 ELSE 0 END) * 100.0 / count(*), 4) AS bright FROM rgb GROUP BY 1"))
def agg04(spark, sf):
    g = imagery.grey()
    pct = lambda cond: F.round(F.sum(cond.cast("int")) * 100.0 / F.count("*"), 4)
    return views.rgb(spark, sf).groupBy("tile").agg(pct(g < 50).alias("dark"), pct(g > 200).alias("bright"))


@query("AGG05_vote_counts", with_views("votes", "SELECT scene, r, c, cls, count(*) AS n FROM votes GROUP BY 1, 2, 3, 4"))
def agg05(spark, sf):
    return vote.vote_counts(views.votes(spark, sf))


@query("AGG06_plurality", with_views("votes", ",,n AS (SELECT scene, r, c, cls, count(*) AS n FROM votes GROUP BY 1, 2, 3, 4) SELECT scene, r, c, arg_max(cls, row(n, -cls)) AS cls, max(n) AS n FROM n GROUP BY 1, 2, 3"))
def agg06(spark, sf):
    return vote.plurality(vote.vote_counts(views.votes(spark, sf)))


@query("AGG07_confusion", with_views("labelled", f",,{KNOWN} SELECT zone, gt, pred, CAST(n AS BIGINT) AS n FROM cm"))
def agg07(spark, sf):
    return cm(spark, sf)


@query("AGG08_normalised_confusion", with_views("labelled", f",,{KNOWN} SELECT zone, gt, pred, round(n / (sum(n) OVER (PARTITION BY zone, gt) + 1e-7) * 100, 6) AS pct FROM cm"))
def agg08(spark, sf):
    return metrics.normalise(cm(spark, sf), ("zone",)).select("zone", "gt", "pred", F.round("pct", 6).alias("pct"))


@query("AGG09_class_accuracy", with_views("labelled", f",,{KNOWN}, {PER} SELECT zone, label, CAST(tp AS BIGINT) AS tp, round(accuracy, 6) AS accuracy FROM per"))
def agg09(spark, sf):
    return metrics.class_metrics(cm(spark, sf), ("zone",)).select("zone", "label", "tp", F.round("accuracy", 6).alias("accuracy"))


@query("AGG10_class_iou", with_views("labelled", f",,{KNOWN}, {PER} SELECT zone, label, round(iou, 6) AS iou FROM per"))
def agg10(spark, sf):
    return metrics.class_metrics(cm(spark, sf), ("zone",)).select("zone", "label", F.round("iou", 6).alias("iou"))


@query("AGG11_mean_metrics", with_views("labelled", f",,{KNOWN}, {PER} SELECT zone, round(avg(accuracy) FILTER (WHERE accuracy > 0), 6) AS mean_acc_positive, round(avg(iou) FILTER (WHERE iou > 0), 6) AS mean_iou_positive FROM per GROUP BY 1"))
def agg11(spark, sf):
    m = metrics.metrics(cm(spark, sf), ("zone",))
    return m.select("zone", F.round("mean_acc", 6).alias("mean_acc_positive"), F.round("mean_iou", 6).alias("mean_iou_positive"))


@query("AGG12_pixel_accuracy", with_views("labelled", f",,{KNOWN} SELECT CAST(zone AS VARCHAR) AS zone, round(CAST(sum(CASE WHEN gt = pred THEN n ELSE 0 END) AS DOUBLE) / sum(n), 6) AS pixel_acc FROM cm GROUP BY GROUPING SETS ((zone), ())"))
def agg12(spark, sf):
    c = cm(spark, sf)
    return c.groupingSets([["zone"], []], "zone").agg(F.round(F.sum(F.when(F.col("gt") == F.col("pred"), F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("pixel_acc")).withColumn("zone", F.col("zone").cast("string"))


@query("AGG13_channel_means", with_views("rgb", f",,{STATS_SQL} SELECT tile, round(avg_r, 6) AS avg_r, round(avg_g, 6) AS avg_g, round(avg_b, 6) AS avg_b, pixels FROM s"))
def agg13(spark, sf):
    return imagery.channel_stats(views.rgb(spark, sf)).select("tile", *[F.round(f"avg_{c}", 6).alias(f"avg_{c}") for c in imagery.CHANNELS], "pixels")


@query("AGG14_histogram", with_views("rgb", ",,l AS (SELECT tile, 'r' AS channel, r AS bin FROM rgb UNION ALL SELECT tile, 'g', g FROM rgb UNION ALL SELECT tile, 'b', b FROM rgb), n AS (SELECT tile, channel, bin, count(*) AS n FROM l GROUP BY 1, 2, 3), e AS (SELECT t.tile, c.channel, CAST(b.b AS INT) AS bin FROM (SELECT DISTINCT tile FROM rgb) t, (SELECT unnest(['r', 'g', 'b']) AS channel) c, (SELECT unnest(generate_series(0, 255)) AS b) b) SELECT e.tile, e.channel, e.bin, coalesce(n.n, 0) AS n FROM e LEFT JOIN n USING (tile, channel, bin)"))
def agg14(spark, sf):
    return imagery.histogram(views.rgb(spark, sf))


@query("AGG15_label_universe", with_views("labelled", "SELECT DISTINCT label FROM (SELECT gt AS label FROM labelled UNION ALL SELECT pred FROM labelled) WHERE label <> 0"))
def agg15(spark, sf):
    return metrics.label_universe(views.labelled(spark, sf))


@query("AGG16_crs_count", with_views("orthos", "SELECT place, count(DISTINCT crs) AS n FROM orthos GROUP BY 1"))
def agg16(spark, sf):
    return views.orthos(spark, sf).groupBy("place").agg(F.count_distinct("crs").alias("n"))


@query("AGG17_group_lists", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1")
def agg17(spark, sf):
    return table(spark, sf, "nation").groupBy("n_regionkey").agg(F.concat_ws(",", F.sort_array(F.collect_list("n_name"))).alias("names"))


@query("AGG18_class_distribution", with_views("labelled", ",,n AS (SELECT pred AS cls, count(*) AS n FROM labelled WHERE pred <> 0 GROUP BY 1) SELECT cls, n, round(n * 100.0 / sum(n) OVER (), 6) AS pct FROM n"))
def agg18(spark, sf):
    return metrics.class_distribution(views.labelled(spark, sf).select(F.col("pred").alias("cls"))).withColumn("pct", F.round("pct", 6)).orderBy(F.desc("n"))


@query("AGG19_mask_boxes", with_views("masks", "SELECT mask_id, coalesce(min(c) FILTER (WHERE on_ = 1), 0) AS x0, coalesce(min(r) FILTER (WHERE on_ = 1), 0) AS y0, coalesce(max(c) FILTER (WHERE on_ = 1), 0) AS x1, coalesce(max(r) FILTER (WHERE on_ = 1), 0) AS y1, CAST(sum(on_) AS BIGINT) AS area FROM masks GROUP BY 1"))
def agg19(spark, sf):
    return masks.mask_boxes(views.masks(spark, sf))


HULL = """,,p AS MATERIALIZED (SELECT DISTINCT CAST(box_id % 5 AS VARCHAR) AS k, x0 AS x, y0 AS y FROM boxes),
  h AS (WITH RECURSIVE t AS (SELECT k, 0 AS seq, min(row(x, y)) AS spot, min(row(x, y)) AS first, -pi() / 2 AS a, false AS done FROM p GROUP BY 1
    UNION ALL SELECT k, seq + 1, arg_min(q, row(b, -far)), first, min(b), arg_min(q, row(b, -far)) = first FROM (
      SELECT t.k, t.seq, t.first, t.a, row(p.x, p.y) AS q, (p.x - t.spot[1]) ** 2 + (p.y - t.spot[2]) ** 2 AS far, CASE WHEN atan2(p.y - t.spot[2], p.x - t.spot[1]) < -pi() / 2 THEN atan2(p.y - t.spot[2], p.x - t.spot[1]) + 2 * pi() ELSE atan2(p.y - t.spot[2], p.x - t.spot[1]) END AS b
      FROM t JOIN p ON p.k = t.k AND row(p.x, p.y) <> t.spot WHERE NOT t.done) WHERE b >= a - 1e-12 GROUP BY k, seq, first)
    SELECT * FROM t)
  SELECT k, seq, spot[1] AS x, spot[2] AS y FROM h WHERE NOT done"""


@query("AGG20_convex_hull", with_views("boxes", HULL))
def agg20(spark, sf):
    b = views.boxes(spark, sf).select((F.col("box_id") % 5).cast("string").alias("k"), F.col("x0").alias("x"), F.col("y0").alias("y"))
    # only the ends of each row of points can be on the hull
    ends = b.groupBy("k", "y").agg(F.array(F.min("x"), F.max("x")).alias("xs")).select("k", F.explode("xs").alias("x"), "y")
    return pandas_ops.convex_hull(ends, "k")


@query("AGG21_union_predicate", with_views("boxes zones", "SELECT DISTINCT b.box_id FROM boxes b JOIN zones z ON z.layer IN (0, 2) AND z.x0 <= b.x1 AND z.x1 >= b.x0 AND z.y0 <= b.y1 AND z.y1 >= b.y0"))
def agg21(spark, sf):
    z = views.zones(spark, sf)
    return spatial.spatial_join(views.boxes(spark, sf), z.where("layer = 0").union(z.where("layer = 2")), "intersects").select("box_id")


@query("AGG22_footprint", with_views("boxes", "SELECT box_id AS feature_id, round((x1 - x0) * (y1 - y0), 4) AS area, round((x0 + x1) / 2, 4) AS cx, round((y0 + y1) / 2, 4) AS cy, (x1 - x0) * (y1 - y0) > 500 AS large FROM boxes"))
def agg22(spark, sf):
    corner = lambda i, x, y: F.struct(F.lit(i).alias("seq"), F.col(x).alias("x"), F.col(y).alias("y"))
    p = views.boxes(spark, sf).select(F.col("box_id").alias("feature_id"), F.explode(F.array(corner(0, "x0", "y0"), corner(1, "x1", "y0"), corner(2, "x1", "y1"), corner(3, "x0", "y1"))).alias("p")).select("feature_id", "p.*")
    return spatial.footprint(p).select("feature_id", *[F.round(c, 4).alias(c) for c in ("area", "cx", "cy")], (F.col("area") > 500).alias("large"))


@query("AGG23_class_range", with_views("votes", "SELECT scene, min(cls) AS lo, max(cls) AS hi, count(*) AS n FROM votes GROUP BY 1"))
def agg23(spark, sf):
    return views.votes(spark, sf).groupBy("scene").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi"), F.count("*").alias("n"))


@query("AGG24_merge_first", with_views("prob", "SELECT r, c, arg_min(cls, scene) AS cls FROM (SELECT scene, r, c, min(cls) AS cls FROM prob GROUP BY 1, 2, 3) GROUP BY 1, 2"))
def agg24(spark, sf):
    px = views.prob(spark, sf).groupBy("scene", "r", "c").agg(F.min("cls").alias("cls"))
    return vote.merge_first(px, "scene")


@query("AGG25_mask_area", with_views("masks", "SELECT mask_id, CAST(sum(on_) AS BIGINT) AS area FROM masks GROUP BY 1"))
def agg25(spark, sf):
    return masks.rle_encode(views.masks(spark, sf), 32, 64).select("mask_id", masks.rle_area(F.col("counts")).alias("area"))


@query("AGG26_stability", with_views("prob", "SELECT scene || '-' || CAST(cls AS VARCHAR) AS mask_id, round(CAST(sum(CASE WHEN v > 50000 THEN 1 ELSE 0 END) AS DOUBLE) / nullif(sum(CASE WHEN v > 30000 THEN 1 ELSE 0 END), 0), 6) AS stability FROM prob GROUP BY 1"))
def agg26(spark, sf):
    p = views.prob(spark, sf).withColumn("mask_id", F.concat_ws("-", "scene", F.col("cls").cast("string")))
    return masks.stability(p, 40000, 10000).withColumn("stability", F.round("stability", 6))


@query("AGG27_dice_loss", "SELECT round(1 - avg((2 * i + 1e-5) / (u + 1e-5)), 6) AS loss FROM (SELECT l_returnflag, l_linestatus, sum(l_discount * (CASE WHEN l_tax > 0.04 THEN 1 ELSE 0 END)) AS i, sum(l_discount + (CASE WHEN l_tax > 0.04 THEN 1 ELSE 0 END)) AS u FROM lineitem GROUP BY 1, 2)")
def agg27(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("image"), F.col("l_linestatus").alias("cls"), F.col("l_discount").alias("p"), (F.col("l_tax") > 0.04).cast("int").alias("t"))
    return metrics.dice_loss(rows).select(F.round("loss", 6).alias("loss"))


@query("AGG28_latest_checkpoint", "SELECT event_type, arg_max(event_id, row(ts, event_id)) AS event_id FROM events GROUP BY 1")
def agg28(spark, sf):
    return catalog.latest(table(spark, sf, "events"), "event_type", "event_id", "ts").select("event_type", "event_id")


@query("AGG29_counters", "SELECT o_orderpriority, count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS failed FROM orders GROUP BY 1")
def agg29(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("failed"))


@query("AGG30_masked_mean", "SELECT label, CAST(i.i - 1 AS INT) AS i, round(avg(CAST(embedding[i.i] AS DOUBLE)), 6) AS mean FROM embeddings, (SELECT unnest(generate_series(1, 64)) AS i) i GROUP BY 1, 2")
def agg30(spark, sf):
    return catalog.masked_mean(table(spark, sf, "embeddings"), "label").withColumn("mean", F.round("mean", 6))


@query("AGG30_cosine", "SELECT a.vec_id, round(list_sum(list_transform(generate_series(1, 64), lambda i: CAST(a.embedding[i] AS DOUBLE) * b.embedding[i])) / (sqrt(list_sum(list_transform(generate_series(1, 64), lambda i: CAST(a.embedding[i] AS DOUBLE) * a.embedding[i]))) * sqrt(list_sum(list_transform(generate_series(1, 64), lambda i: CAST(b.embedding[i] AS DOUBLE) * b.embedding[i])))), 5) AS cos FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def agg30b(spark, sf):
    a = table(spark, sf, "embeddings").select("vec_id", "embedding")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").select("vec_id", F.round(catalog.cosine(F.col("embedding"), F.col("other")), 5).alias("cos"))


@query("AGG31_components", region_sql("on_ = 1", "SELECT mask_id, CAST(dense_rank() OVER (PARTITION BY mask_id ORDER BY l) AS INT) AS component, area, min(r) AS top FROM lab JOIN area USING (mask_id, l) GROUP BY mask_id, l, area"))
def agg31(spark, sf):
    """The regions of each mask, numbered in reading order of their first pixels."""
    found = regions.Regions(views.masks(spark, sf).where("on_ <> 0")).areas
    number = F.row_number().over(Window.partitionBy("mask_id").orderBy("region")).alias("component")
    return found.select("mask_id", number, "area", regions.first_row(F.col("region")).alias("top"))


@query("AGG31_remove_small", region_sql("on_ = 1", islands_sql(3)))
def agg31b(spark, sf):
    return regions.remove_small(views.masks(spark, sf), 3)


@query("AGG32_best_mask", "SELECT l_orderkey, arg_max(l_linenumber, row(l_discount, -l_linenumber)) AS l_linenumber, max(l_discount) AS l_discount FROM lineitem GROUP BY 1")
def agg32(spark, sf):
    return masks.best_mask(table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber", "l_discount")


@query("AGG33_distance_peak", with_views("masks", ",,g AS (SELECT mask_id, r, c, on_ FROM masks), d AS (SELECT a.mask_id, a.r, a.c, min((a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c)) AS d2 FROM g a JOIN (SELECT mask_id, i.i AS r, j.j AS c FROM (SELECT DISTINCT mask_id FROM g), (SELECT unnest(generate_series(0, 31)) AS i) i, (SELECT unnest(generate_series(0, 63)) AS j) j EXCEPT SELECT mask_id, r, c FROM g WHERE on_ = 1) b ON b.mask_id = a.mask_id WHERE a.on_ = 1 GROUP BY 1, 2, 3) SELECT mask_id, CAST(arg_min(r, row(-d2, r, c)) AS INT) AS r, CAST(arg_min(c, row(-d2, r, c)) AS INT) AS c FROM d GROUP BY 1"))
def agg33(spark, sf):
    # all cells of the grid, so that distances reach the unset ones too
    m = views.masks(spark, sf)
    full = m.select("mask_id").distinct().withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(31)))).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(63))))
    full = full.join(m, ["mask_id", "r", "c"], "left").select("mask_id", "r", "c", F.coalesce("on_", F.lit(0)).alias("on_"))
    d = pandas_ops.edt(full).where("d IS NOT NULL")  # a mask that is set all over has no peak
    return d.groupBy("mask_id").agg(F.min_by(F.struct("r", "c"), F.struct(-F.col("d"), "r", "c")).alias("p")).select("mask_id", "p.r", "p.c")


@query("Q0_mosaic_accuracy", with_views("votes truth_votes", MOSAIC + ", k AS (SELECT tm.scene AS zone, tm.cls AS gt, coalesce(pm.cls, 0) AS pred FROM tm LEFT JOIN pm USING (scene, r, c)), lab AS (SELECT DISTINCT zone, label FROM (SELECT zone, gt AS label FROM k UNION ALL SELECT zone, pred FROM k) WHERE label <> 0), n AS (SELECT zone, gt, pred, count(*) AS n FROM k GROUP BY 1, 2, 3), cm AS (SELECT a.zone, a.label AS gt, b.label AS pred, coalesce(n.n, 0) AS n FROM lab a JOIN lab b ON a.zone = b.zone LEFT JOIN n ON n.zone = a.zone AND n.gt = a.label AND n.pred = b.label), " + PER + " SELECT zone, round(CAST(sum(tp) AS DOUBLE) / sum(support), 6) AS pixel_acc, round(avg(accuracy) FILTER (WHERE accuracy > 0), 6) AS mean_acc, round(avg(iou) FILTER (WHERE iou > 0), 6) AS mean_iou FROM per GROUP BY 1"))
def q0(spark, sf):
    """The flagship: vote mosaics against truth, per scene."""
    m = metrics.metrics(metrics.confusion(aligned(spark, sf).withColumnRenamed("scene", "zone"), ("zone",)), ("zone",))
    return m.select("zone", *[F.round(c, 6).alias(c) for c in ("pixel_acc", "mean_acc", "mean_iou")])
