"""Queries of the inventory's windows, sorts, set operations, scalar families, streams and user functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pixelweave.operators import catalog, classify, grid, imagery, masks, numbering, pandas_ops, spatial, suppress, views, vote
from pixelweave.operators.views import table, with_views
from pixelweave.plans.projections import hue_weight_sql
from pixelweave.plans.registry import query

HIST = "l AS (SELECT tile, 'r' AS channel, r AS bin FROM rgb UNION ALL SELECT tile, 'g', g FROM rgb UNION ALL SELECT tile, 'b', b FROM rgb), n AS (SELECT tile, channel, bin, count(*) AS n FROM l GROUP BY 1, 2, 3), e AS (SELECT t.tile, c.channel, CAST(b.b AS INT) AS bin FROM (SELECT DISTINCT tile FROM rgb) t, (SELECT unnest(['r', 'g', 'b']) AS channel) c, (SELECT unnest(generate_series(0, 255)) AS b) b), h AS (SELECT e.tile, e.channel, e.bin, coalesce(n.n, 0) AS n FROM e LEFT JOIN n USING (tile, channel, bin))"


@query("WIN01_widest_gap", with_views("rgb", f",,{HIST}, b AS (SELECT DISTINCT tile, channel, bin FROM h WHERE n < 5 OR bin IN (0, 255)), g AS (SELECT tile, channel, bin, lead(bin) OVER (PARTITION BY tile, channel ORDER BY bin) AS nxt FROM b) SELECT tile, channel, arg_max(bin, row(nxt - bin, -bin)) AS low, arg_max(nxt, row(nxt - bin, -bin)) AS high FROM g WHERE nxt IS NOT NULL GROUP BY 1, 2"))
def win01(spark, sf):
    return imagery.widest_gap(imagery.histogram(views.rgb(spark, sf)), F.lit(5))


@query("WIN02_rle_encode", with_views("masks", ",,p AS (SELECT DISTINCT mask_id, c * 32 + r AS p FROM masks WHERE on_ = 1), i AS (SELECT mask_id, p, p - row_number() OVER (PARTITION BY mask_id ORDER BY p) AS g FROM p) SELECT mask_id, CAST(count(DISTINCT g) AS BIGINT) AS runs, CAST(count(*) AS BIGINT) AS area, CAST(min(p) AS BIGINT) AS first FROM i GROUP BY 1"))
def win02(spark, sf):
    rle = masks.rle_encode(views.masks(spark, sf), 32, 64)
    return rle.select("mask_id", F.floor(F.size("counts") / 2).alias("runs"), masks.rle_area(F.col("counts")).alias("area"), F.col("counts")[0].alias("first"))


@query("WIN03_rle_decode", with_views("masks", "SELECT mask_id, r, c FROM masks WHERE on_ = 1"))
def win03(spark, sf):
    return masks.rle_decode(masks.rle_encode(views.masks(spark, sf), 32, 64))


LOG = "SELECT event_type AS run, day(ts) AS epoch, event_id, value AS loss FROM events"


@query("WIN04_first_log_row", f"WITH l AS ({LOG}), w AS (SELECT *, row_number() OVER (PARTITION BY run, epoch ORDER BY event_id) AS rn FROM l WHERE loss IS NOT NULL) SELECT run, CAST(epoch AS BIGINT) AS epoch_no, event_id FROM w WHERE rn = 1")
def win04(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("run"), F.day("ts").alias("epoch"), "event_id", F.col("value").alias("loss"))
    return catalog.epoch_log(e, "run", "epoch", "event_id", "loss").select("run", "epoch_no", "event_id")


def nms_sql(group: str, x: str, y: str, limit: float) -> str:
    """The boxes that the greedy order keeps, one step of the recursion a box of each group."""
    meet = "greatest(0, least(a.x1, z.x1) - greatest(a.x0, z.x0)) * greatest(0, least(a.y1, z.y1) - greatest(a.y0, z.y0))"
    area = "({0}.x1 - {0}.x0) * ({0}.y1 - {0}.y0)"
    return with_views("boxes", f""",,b AS (SELECT {group} AS image, box_id, {x} AS x0, {y} AS y0, {x} + x1 - x0 AS x1, {y} + y1 - y0 AS y1, row_number() OVER (PARTITION BY {group} ORDER BY box_id * 13 % 101 / 101 DESC, box_id) AS n FROM boxes),
      c AS MATERIALIZED (SELECT z.image, z.n, z.box_id, coalesce(list(a.box_id) FILTER (WHERE {meet} > {limit} * ({area.format('a')} + {area.format('z')} - {meet})), []) AS better FROM b z LEFT JOIN b a ON a.image = z.image AND a.n < z.n GROUP BY 1, 2, 3),
      g AS (WITH RECURSIVE t AS (SELECT image, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS kept FROM b GROUP BY 1
        UNION ALL SELECT t.image, c.n, CASE WHEN list_has_any(t.kept, c.better) THEN t.kept ELSE list_append(t.kept, c.box_id) END FROM t JOIN c ON c.image = t.image AND c.n = t.n + 1) SELECT image, arg_max(kept, n) AS kept FROM t GROUP BY 1)
      SELECT image, unnest(kept) AS box_id FROM g""")


@query("WIN05_nms", nms_sql("'all'", "x0", "y0", 0.3))
def win05(spark, sf):
    b = views.boxes(spark, sf).select(F.lit("all").alias("image"), "box_id", "x0", "y0", "x1", "y1", (F.col("box_id") * 13 % 101 / 101).alias("score"))
    return suppress.suppress(b, "image", 0.3).select("image", "box_id")


@query("WIN05_iou_pairs", with_views("boxes", ",,b AS (SELECT box_id, x0, y0, x1, y1, greatest(0.0, 0.0) AS z FROM boxes), p AS (SELECT a.box_id AS a, b.box_id AS b, (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS i, (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) AS s FROM b a JOIN b b ON a.box_id < b.box_id AND a.x0 < b.x1 AND a.x1 > b.x0 AND a.y0 < b.y1 AND a.y1 > b.y0) SELECT a, b, round(i / (s - i), 6) AS iou FROM p"))
def win05b(spark, sf):
    b = views.boxes(spark, sf).withColumn("image", F.lit("all"))
    return masks.pairwise_iou(b, "image", digits=6).select("a", "b", "iou")


DAILY = "SELECT event_type AS run, CAST(day(ts) AS INT) AS epoch, round(avg(value), 6) AS loss FROM events GROUP BY 1, 2"


@query("WIN06_early_stop", f"WITH l AS ({DAILY}), b AS (SELECT *, min(loss) OVER (PARTITION BY run ORDER BY epoch) AS best FROM l), p AS (SELECT *, lag(best) OVER (PARTITION BY run ORDER BY epoch) AS prev FROM b), n AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY epoch) AS n FROM p), q AS (SELECT *, max(CASE WHEN prev IS NULL OR loss < prev THEN n END) OVER (PARTITION BY run ORDER BY epoch) AS last FROM n) SELECT run, epoch, loss, best, CAST(n - last AS INT) AS waited, n - last >= 10 AS stop FROM q")
def win06(spark, sf):
    e = table(spark, sf, "events").groupBy(F.col("event_type").alias("run"), F.day("ts").alias("epoch")).agg(F.round(F.avg("value"), 6).alias("loss"))
    return catalog.early_stop(e, 10)


@query("WIN07_class_ids", "SELECT c_mktsegment AS label, CAST(row_number() OVER (ORDER BY c_mktsegment) AS INT) AS cls FROM (SELECT DISTINCT c_mktsegment FROM customer)")
def win07(spark, sf):
    return classify.class_ids(table(spark, sf, "customer").select(F.col("c_mktsegment").alias("label")))


@query("WIN08_totals", "SELECT o_orderstatus, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct FROM orders GROUP BY 1")
def win08(spark, sf):
    n = table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    return n.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 6))


@query("WIN09_batches", "SELECT p_partkey, CAST(floor((row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) / 64) AS BIGINT) AS batch FROM part")
def win09(spark, sf):
    return catalog.batches(table(spark, sf, "part"), 64, ["p_partkey"], ["p_brand"]).select("p_partkey", "batch")


@query("WIN10_window_partition", with_views("prob", "SELECT scene, r // 14 AS wr, c // 14 AS wc, r % 14 AS ir, c % 14 AS ic, count(*) AS n FROM prob GROUP BY 1, 2, 3, 4, 5"))
def win10(spark, sf):
    w = lambda c: F.floor(F.col(c) / 14).cast("int")
    return views.prob(spark, sf).groupBy("scene", w("r").alias("wr"), w("c").alias("wc"), (F.col("r") % 14).alias("ir"), (F.col("c") % 14).alias("ic")).agg(F.count("*").alias("n"))


@query("WIN11_nearest_upsample", with_views("prob", ",,l AS (SELECT r, c, min(cls) AS cls FROM prob GROUP BY 1, 2), o AS (SELECT unnest(generate_series(0, 1)) AS o) SELECT CAST(l.r * 2 + a.o AS INT) AS r, CAST(l.c * 2 + b.o AS INT) AS c, cls FROM l, o a, o b"))
def win11(spark, sf):
    """Labels of all scenes on top of each other, at twice the size."""
    lab = views.prob(spark, sf).groupBy("r", "c").agg(F.min("cls").alias("cls"))
    axis = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) * 2 + 1)).alias(c)
    px = lab.agg(F.max("r").alias("r"), F.max("c").alias("c")).select(F.lit("t").alias("k"), axis("r"), "c").select("k", "r", axis("c"))
    return grid.upsample_labels(px, lab, 2, ("k",), False).select("r", "c", "cls")


@query("WIN11_nearest_upsample_scenes", with_views("prob", ",,l AS (SELECT scene, r, c, min(cls) AS cls FROM prob GROUP BY 1, 2, 3), o AS (SELECT unnest(generate_series(0, 3)) AS o) SELECT scene, CAST(r * 4 + i.o AS INT) AS r, CAST(c * 4 + j.o AS INT) AS c, cls FROM l, o i, o j"))
def win11_scenes(spark, sf):
    lab = views.prob(spark, sf).groupBy("scene", "r", "c").agg(F.min("cls").alias("cls"))
    axis = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) * 4 + 3)).alias(c)
    px = lab.groupBy("scene").agg(F.max("r").alias("r"), F.max("c").alias("c")).select("scene", axis("r"), "c").select("scene", "r", axis("c"))
    return grid.upsample_labels(px, lab, 4, ("scene",), False, ("scene",)).select("scene", "r", "c", "cls")


@query("SRT01_sorted_listing", "SELECT s_suppkey, s_name, CAST(row_number() OVER (ORDER BY s_name) AS INT) AS place FROM supplier")
def srt01(spark, sf):
    return numbering.number_rows(table(spark, sf, "supplier").select("s_suppkey", "s_name"), ["s_name"]).withColumn("place", F.col("place").cast("int"))


@query("SRT02_resume", "SELECT o_orderkey FROM orders ORDER BY o_orderkey OFFSET 100")
def srt02(spark, sf):
    return catalog.resume_from(table(spark, sf, "orders").select("o_orderkey"), "100", "o_orderkey")


@query("SRT03_sort_counts", with_views("labelled", "SELECT pred, count(*) AS n FROM labelled GROUP BY 1"))
def srt03(spark, sf):
    return views.labelled(spark, sf).groupBy("pred").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "pred")


@query("SRT04_first_patches", "SELECT p_partkey, p_name FROM part WHERE p_name NOT LIKE '%\\_pred' ORDER BY p_name, p_partkey LIMIT 10")
def srt04(spark, sf):
    return table(spark, sf, "part").select("p_partkey", "p_name").where(~F.col("p_name").endswith("_pred")).orderBy("p_name", "p_partkey").limit(10)


@query("SRT05_panels", "SELECT r_regionkey FROM region ORDER BY r_regionkey LIMIT 3")
def srt05(spark, sf):
    return table(spark, sf, "region").select("r_regionkey").orderBy("r_regionkey").limit(3)


@query("SRT06_reverse_legend", "SELECT r_name FROM region")
def srt06(spark, sf):
    return table(spark, sf, "region").select("r_name").orderBy(F.desc("r_name"))


@query("SRT07_top1", "SELECT o_custkey, arg_max(o_orderkey, row(o_totalprice, -o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def srt07(spark, sf):
    return masks.best_mask(table(spark, sf, "orders"), "o_custkey", "o_orderkey", "o_totalprice").select("o_custkey", "o_orderkey")


@query("SRT08_paired_sort", "SELECT n_regionkey, string_agg(n_name || ':' || CAST(n_nationkey AS VARCHAR), ',' ORDER BY n_name, n_nationkey) AS pairs FROM nation GROUP BY 1")
def srt08(spark, sf):
    s = F.sort_array(F.collect_list(F.struct("n_name", "n_nationkey")))
    n = table(spark, sf, "nation").groupBy("n_regionkey").agg(s.alias("s"))
    return n.select("n_regionkey", F.array_join(F.transform("s", lambda x: F.concat(x["n_name"], F.lit(":"), x["n_nationkey"].cast("string"))), ",").alias("pairs"))


@query("SRT09_hash_split", "SELECT doc_id, CAST('0x' || left(md5(CAST(doc_id AS VARCHAR)), 4) AS INT) < 19660 AS held FROM documents")
def srt09(spark, sf):
    return catalog.split(table(spark, sf, "documents"), "doc_id").select("doc_id", "held")


@query("SET01_stack_layers", with_views("zones", "SELECT zone_id, layer FROM zones WHERE layer = 0 UNION ALL SELECT zone_id, layer FROM zones WHERE layer = 3"))
def set01(spark, sf):
    z = views.zones(spark, sf).select("zone_id", "layer")
    return catalog.stack_layers(z.where("layer = 0"), z.where("layer = 3"))


@query("SET02_label_union", with_views("labelled", "SELECT gt AS label FROM labelled UNION SELECT pred FROM labelled"))
def set02(spark, sf):
    d = views.labelled(spark, sf)
    return d.select(F.col("gt").alias("label")).union(d.select("pred")).distinct()


@query("SET03_difference", with_views("labelled", "SELECT zone, gt AS label FROM labelled EXCEPT SELECT zone, 0 FROM labelled"))
def set03(spark, sf):
    d = views.labelled(spark, sf)
    return d.select("zone", F.col("gt").alias("label")).subtract(d.select("zone", F.lit(0)))


@query("SET04_concat_zones", with_views("labelled", "SELECT gt, pred, CAST(NULL AS INT) AS extra, count(*) AS n FROM labelled WHERE zone < 2 GROUP BY 1, 2"))
def set04(spark, sf):
    d = views.labelled(spark, sf)
    both = catalog.stack_layers(d.where("zone = 0").select("gt", "pred"), d.where("zone = 1").select("pred", "gt").withColumn("extra", F.lit(None).cast("int")))
    return both.groupBy("gt", "pred").agg(F.max("extra").alias("extra"), F.count("*").alias("n"))


@query("SET05_distinct_sets", with_views("orthos", "SELECT DISTINCT crs FROM orthos"))
def set05(spark, sf):
    return views.orthos(spark, sf).select("crs").distinct()


@query("FNS01_strings", "SELECT c_custkey, upper(split_part(c_name, '#', 1)) AS a, split_part(c_name, '_', 2) AS b, replace(c_mktsegment, 'A', 'x') AS c, lower(c_mktsegment) AS d, starts_with(c_name, 'Cust') AS e, substr(c_name, 1, 5) AS f, contains(c_name, '1') AS g, upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) AS h FROM customer")
def fns01(spark, sf):
    c, n, m = table(spark, sf, "customer"), F.col("c_name"), F.col("c_mktsegment")
    return c.select(
        "c_custkey", F.upper(F.split_part(n, F.lit("#"), F.lit(1))).alias("a"), F.split_part(n, F.lit("_"), F.lit(2)).alias("b"), F.replace(m, F.lit("A"), F.lit("x")).alias("c"),
        F.lower(m).alias("d"), F.startswith(n, F.lit("Cust")).alias("e"), F.substring(n, 1, 5).alias("f"), F.contains(n, F.lit("1")).alias("g"), F.initcap(m).alias("h"),
    )


@query("FNS02_dates", "SELECT event_id, strftime(ts, '%Y_%m_%d') AS day, CAST(hour(ts) * 3600 + minute(ts) * 60 + floor(second(ts)) AS INT) AS secs FROM events")
def fns02(spark, sf):
    return table(spark, sf, "events").select("event_id", F.date_format("ts", "yyyy_MM_dd").alias("day"), (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")).cast("int").alias("secs"))


@query("FNS03_math", "SELECT l_orderkey, l_linenumber, round(greatest(0.0, least(1.0, l_discount * 20)), 6) AS clip, round(cos(l_quantity) + sin(l_quantity), 6) AS trig, CAST(ceil(l_extendedprice / 7) AS BIGINT) AS up, l_partkey // 7 AS q, l_partkey % 7 AS m, round(exp(-l_tax), 6) AS e, round(sqrt(l_quantity), 6) AS s, CAST(sign(l_discount - 0.05) AS INT) AS sg FROM lineitem")
def fns03(spark, sf):
    c = F.col
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c("l_discount") * 20)), 6).alias("clip"), F.round(F.cos("l_quantity") + F.sin("l_quantity"), 6).alias("trig"),
        F.ceil(c("l_extendedprice") / 7).alias("up"), F.expr("l_partkey div 7").alias("q"), (c("l_partkey") % 7).alias("m"), F.round(F.exp(-c("l_tax")), 6).alias("e"), F.round(F.sqrt("l_quantity"), 6).alias("s"), F.signum(c("l_discount") - 0.05).cast("int").alias("sg"),
    )


@query("FNS04_arrays", "SELECT vec_id, round(CAST(list_max(embedding) AS DOUBLE), 5) AS top, CAST(list_position(embedding, list_min(embedding)) AS INT) AS at, CAST(len(list_filter(embedding, lambda x: x > 0)) AS INT) AS pos, round(CAST(embedding[3] AS DOUBLE), 5) AS third FROM embeddings")
def fns04(spark, sf):
    e = F.col("embedding")
    return table(spark, sf, "embeddings").select("vec_id", F.round(F.array_max(e).cast("double"), 5).alias("top"), F.array_position(e, F.array_min(e)).cast("int").alias("at"), F.size(F.filter(e, lambda x: x > 0)).alias("pos"), F.round(e[2].cast("double"), 5).alias("third"))


@query("FNS05_maps", "SELECT n_nationkey, CAST(n_nationkey AS VARCHAR) AS back, n_name AS got, 'none' AS other FROM nation")
def fns05(spark, sf):
    m = F.create_map(F.col("n_nationkey").cast("string"), F.col("n_name"))
    turned = F.map_from_arrays(F.map_values(m), F.map_keys(m))
    n = table(spark, sf, "nation")
    return n.select("n_nationkey", F.try_element_at(turned, F.col("n_name")).alias("back"), F.try_element_at(m, F.col("n_nationkey").cast("string")).alias("got"), F.coalesce(F.try_element_at(m, F.lit("x")), F.lit("none")).alias("other"))


@query("FNS06_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def fns06(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("FNS07_hashes", "SELECT doc_id, md5(source || ':' || lang) AS h, replace('md5:' || md5(lang), 'md5:', '') AS bare FROM documents")
def fns07(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.md5(F.concat("source", F.lit(":"), "lang").cast("binary")).alias("h"), F.replace(F.concat(F.lit("md5:"), F.md5(F.col("lang").cast("binary"))), F.lit("md5:"), F.lit("")).alias("bare"))


@query("FNS08_conversions", "SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice) AS BIGINT) AS whole, CAST(l_linenumber AS VARCHAR) AS s, TRY_CAST(l_returnflag AS INT) AS none, l_discount <> 0 AS b FROM lineitem")
def fns08(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.floor("l_extendedprice").alias("whole"), F.col("l_linenumber").cast("string").alias("s"), F.col("l_returnflag").try_cast("int").alias("none"), F.col("l_discount").cast("boolean").alias("b"))


@query("FNS09_conditionals", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band FROM orders")
def fns09(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_totalprice") > 200000, "high").when(F.col("o_totalprice") > 100000, "mid").otherwise("low").alias("band"))


@query("FNS10_geometry", with_views("boxes zones", "SELECT b.box_id, max(CASE WHEN z.x0 <= b.x0 AND z.x1 >= b.x1 AND z.y0 <= b.y0 AND z.y1 >= b.y1 THEN 1 ELSE 0 END) AS inside, round(max((b.x1 - b.x0) * (b.y1 - b.y0)), 4) AS area FROM boxes b JOIN zones z ON z.x0 <= b.x1 AND z.x1 >= b.x0 AND z.y0 <= b.y1 AND z.y1 >= b.y0 GROUP BY 1"))
def fns10(spark, sf):
    j = spatial.spatial_join(views.boxes(spark, sf), views.zones(spark, sf), "intersects", "inner")
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return j.groupBy("box_id").agg(F.max(spatial.box_contains().cast("int")).alias("inside"), F.round(F.max(area), 4).alias("area"))


@query("UDF01_tile_scorer", with_views("votes", "SELECT scene, r, c, CAST((r * 7 + c * 3) % 5 + 1 AS INT) AS cls FROM (SELECT DISTINCT scene, r, c FROM votes)"))
def udf01(spark, sf):
    tiles = views.votes(spark, sf).select("scene", "r", "c").distinct()
    return pandas_ops.score_tiles(tiles, lambda df: ((df["r"] * 7 + df["c"] * 3) % 5 + 1).astype("int32"), "scene string, r int, c int, cls int")


@query("UDF03_refine_flow", with_views("labelled", "SELECT zone, gt, CASE WHEN gt = 5 AND pred > 4 THEN NULL WHEN gt = 5 THEN 5 WHEN pred = 5 THEN 5 ELSE coalesce(gt, 0) END AS refined, count(*) AS n FROM labelled GROUP BY 1, 2, 3"))
def udf03(spark, sf):
    d = views.labelled(spark, sf)
    refined = F.when((F.col("gt") == 5) & (F.col("pred") > 4), F.lit(None)).when(F.col("gt") == 5, 5).when(F.col("pred") == 5, 5).otherwise(F.coalesce("gt", F.lit(0)))
    return d.withColumn("refined", refined).groupBy("zone", "gt", "refined").agg(F.count("*").alias("n"))


def distance_sql(on: str, far: str) -> str:
    """Distance of each cell where `on` to the nearest of the mask's box where not."""
    return with_views("masks", f""",,g AS (SELECT mask_id, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1 FROM masks GROUP BY 1),
      cells AS (SELECT mask_id, i.i AS r, j.j AS c FROM g, (SELECT unnest(generate_series(0, 31)) AS i) i, (SELECT unnest(generate_series(0, 63)) AS j) j WHERE i.i BETWEEN r0 AND r1 AND j.j BETWEEN c0 AND c1),
      z AS (SELECT mask_id, r, c FROM cells EXCEPT SELECT mask_id, r, c FROM masks WHERE {on})
      SELECT a.mask_id, a.r, a.c, round(sqrt(min((a.r - z.r) * (a.r - z.r) + (a.c - z.c) * (a.c - z.c))), 6) AS d FROM masks a LEFT JOIN z ON z.mask_id = a.mask_id WHERE {far} GROUP BY 1, 2, 3""")


@query("UDF04_distance_transform", distance_sql("on_ = 1", "a.on_ = 1"))
def udf04(spark, sf):
    return pandas_ops.edt(views.masks(spark, sf)).withColumn("d", F.round("d", 6))


def correction_sql(red: str) -> str:
    """Averages of corrected tiles, each step of the correction as a table of its own."""
    r, g, b = hue_weight_sql("h")
    sr, sg, sb = hue_weight_sql("shift")
    return with_views("rgb", f""",,px AS (SELECT tile, {red} AS r, g, b FROM rgb),
      s AS (SELECT tile, avg(r) AS avg_r, avg(g) AS avg_g, avg(b) AS avg_b, count(*) AS pixels FROM px GROUP BY 1),
      h AS (SELECT unnest(generate_series(0, 120)) AS h),
      sh AS (SELECT tile, pixels, CAST(CASE WHEN avg_r >= 60 THEN 0 ELSE coalesce(min(h) FILTER (WHERE avg_r * {r} + avg_g * {g} + avg_b * {b} >= 60) + 1, 121) END AS INT) AS shift FROM s, h GROUP BY tile, pixels, avg_r),
      t AS (SELECT tile, shift, r, g, b, CAST(floor(greatest(0.0, least(255.0, r * {sr} + g * {sg} + b * {sb}))) AS INT) AS tr FROM px JOIN sh USING (tile)),
      long AS (SELECT tile, 'r' AS ch, tr AS v FROM t UNION ALL SELECT tile, 'g', g FROM t UNION ALL SELECT tile, 'b', b FROM t),
      cnt AS (SELECT tile, ch, v, count(*) AS n FROM long GROUP BY 1, 2, 3),
      kinds AS (SELECT DISTINCT tile, ch FROM long),
      bins AS (SELECT tile, ch, CAST(unnest(generate_series(0, 255)) AS INT) AS v FROM kinds),
      ends AS (SELECT tile, ch, v FROM bins LEFT JOIN cnt USING (tile, ch, v) JOIN sh USING (tile) WHERE coalesce(n, 0) < pixels / 2000 + 2 UNION SELECT tile, ch, 0 FROM kinds UNION SELECT tile, ch, 255 FROM kinds),
      step AS (SELECT tile, ch, v AS low, lead(v) OVER (PARTITION BY tile, ch ORDER BY v) AS high FROM ends),
      gap AS (SELECT tile, ch, arg_max(row(low, high), row(high - low, -low)) AS g FROM step WHERE high IS NOT NULL GROUP BY 1, 2),
      k AS (SELECT tile, ch, 256e0 / (g[2] - g[1]) AS gain, (-g[1] / 256e0) * (256e0 / (g[2] - g[1])) AS offs FROM gap),
      m AS (SELECT tile, max(gain) FILTER (WHERE ch = 'r') AS rg, max(offs) FILTER (WHERE ch = 'r') AS ro, max(gain) FILTER (WHERE ch = 'g') AS gg, max(offs) FILTER (WHERE ch = 'g') AS go, max(gain) FILTER (WHERE ch = 'b') AS bg, max(offs) FILTER (WHERE ch = 'b') AS bo FROM k GROUP BY 1)
      SELECT tile, round(avg(floor(greatest(0.0, least(255.0, r * ({sr} * rg) + g * ({sg} * rg) + ro * 255)))), 4) AS r,
        round(avg(floor(greatest(0.0, least(255.0, g * gg + go * 255)))), 4) AS g, round(avg(floor(greatest(0.0, least(255.0, b * bg + bo * 255)))), 4) AS b
      FROM t JOIN m USING (tile) GROUP BY 1""")


def _corrected(rgb):
    return imagery.colour_correct(rgb).groupBy("tile").agg(*[F.round(F.avg(c), 4).alias(c) for c in imagery.CHANNELS])


@query("UDF05_colour_correction", correction_sql("r"))
def udf05(spark, sf):
    return _corrected(views.rgb(spark, sf))


@query("UDF05_colour_correction_dim", correction_sql("r // 4"))
def udf05_dim(spark, sf):
    """Images with too little red, whose hue is turned."""
    return _corrected(views.rgb(spark, sf).withColumn("r", F.floor(F.col("r") / 4).cast("int")))


@query("UDF06_geodesic_distance", distance_sql("on_ = 0", "a.on_ = 0"))
def udf06(spark, sf):
    # with no weight on intensities the geodesic distance is the Euclidean one
    return pandas_ops.edt(views.masks(spark, sf).withColumn("on_", 1 - F.col("on_"))).withColumn("d", F.round("d", 6))


@query("UDF07_tile_split", with_views("orthos", "SELECT ortho_id, count(*) AS tiles FROM orthos, LATERAL (SELECT unnest(generate_series(0, width - 32, 32)) AS x) x, LATERAL (SELECT unnest(generate_series(0, height - 32, 32)) AS y) y GROUP BY 1"))
def udf07(spark, sf):
    return grid.tile_grid(views.orthos(spark, sf), 32).groupBy("ortho_id").agg(F.count("*").alias("tiles"))


@query("UDF08_vote_aggregate", with_views("votes", ",,n AS (SELECT scene, r, c, cls, count(*) AS n FROM votes GROUP BY 1, 2, 3, 4), w AS (SELECT scene, r, c, arg_max(cls, row(n, -cls)) AS cls FROM n GROUP BY 1, 2, 3) SELECT scene, cls, count(*) AS pixels FROM w GROUP BY 1, 2"))
def udf08(spark, sf):
    return vote.plurality(vote.vote_counts(views.votes(spark, sf))).groupBy("scene", "cls").agg(F.count("*").alias("pixels"))


def _stream(spark, sf, build, name: str, mode: str):
    """Drive a stream over the line items to its end, into files of the shared folder, and return what it wrote."""
    from pixelweave.scratch import scratch_path
    from pixelweave.streaming.tiles import latest_batch, read_stream, result_stream

    path = scratch_path(spark, name)
    src = read_stream(spark, f"{sf}/lineitem.parque[t]", table(spark, sf, "lineitem").schema)  # a pattern, since a file is no folder
    result_stream(build(src), f"{path}/rows", f"{path}/checkpoint", mode).awaitTermination()
    return spark.read.parquet(f"{path}/rows") if mode == "append" else latest_batch(spark, f"{path}/rows")


@query("STR01_tile_stream", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_partkey % 256 + l_suppkey % 256 + least(255, floor(l_quantity * 5))) / 3 > 100")
def str01(spark, sf):
    g = (F.col("l_partkey") % 256 + F.col("l_suppkey") % 256 + F.least(F.lit(255), F.floor(F.col("l_quantity") * 5))) / 3
    return _stream(spark, sf, lambda s: s.where(g > 100).select("l_orderkey", "l_linenumber"), "str01", "append")


@query("STR02_running_votes", with_views("votes", "SELECT scene, r, c, cls, count(*) AS n FROM votes GROUP BY 1, 2, 3, 4"))
def str02(spark, sf):
    from pixelweave.streaming.tiles import running_votes

    return _stream(spark, sf, lambda s: running_votes(views._pixel(s).where("status = 'O' AND cls <= 5")), "str02", "complete")


