"""Queries of the inventory's sources and sinks."""

from __future__ import annotations


from pyspark.sql import functions as F

from pixelweave.operators import classify, imagery, views
from pixelweave.operators.views import table, with_views
from pixelweave.plans.registry import query
from pixelweave.scratch import scratch_path

WANTED = ["class_1", "class_2", "class_3"]


@query("SRC01_scan_probabilities", with_views("raw_prob", "SELECT scene, label, count(*) AS n, round(min(v), 4) AS lo, round(max(v), 4) AS hi FROM raw_prob WHERE v IS NOT NULL AND label IN ('class_1', 'class_2', 'class_3') GROUP BY 1, 2"))
def src01(spark, sf):
    rows = classify.valid_probabilities(views.raw_prob(spark, sf), WANTED)
    return rows.groupBy("scene", "label").agg(F.count("*").alias("n"), F.round(F.min("v"), 4).alias("lo"), F.round(F.max("v"), 4).alias("hi"))


@query("SRC02_ortho_catalogue", with_views("orthos", "SELECT place, count(*) AS n, string_agg(CAST(ortho_id AS VARCHAR), ',' ORDER BY ortho_id) AS ids, max(width) AS width FROM orthos GROUP BY 1"))
def src02(spark, sf):
    from pixelweave.operators.catalog import orthos_by_place

    t = orthos_by_place(views.orthos(spark, sf))
    return t.select("place", F.size("orthos").cast("long").alias("n"), F.concat_ws(",", F.transform("orthos", lambda o: o["ortho_id"].cast("string"))).alias("ids"), F.array_max(F.transform("orthos", lambda o: o["width"])).alias("width"))


@query("SRC03_windowed_read", with_views("prob", "SELECT scene, r, c, cls, round(v, 2) AS v FROM prob WHERE r >= 8 AND r < 16 AND c >= 16 AND c < 32"))
def src03(spark, sf):
    return views.prob(spark, sf).where("r >= 8 AND r < 16 AND c >= 16 AND c < 32").withColumn("v", F.round("v", 2))


@query("SRC04_masked_read", "SELECT l_orderkey, l_linenumber, nullif(l_discount, 0.0) AS discount FROM lineitem")
def src04(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.nullif("l_discount", F.lit(0.0)).alias("discount"))


@query("SRC07_config_header", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, json_extract_string(props, '$.k') IS NOT NULL AS ok, coalesce(json_extract_string(props, '$.missing'), 'none') AS other FROM events")
def src07(spark, sf):
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k")
    return e.select("event_id", k.cast("int").alias("k"), k.isNotNull().alias("ok"), F.coalesce(F.get_json_object("props", "$.missing"), F.lit("none")).alias("other"))


@query("SRC10_class_tiles", with_views("votes", "SELECT scene, cls, CAST(floor(c / 16) AS BIGINT) * 16 AS tile_x, CAST(floor(r / 16) AS BIGINT) * 16 AS tile_y, count(*) AS n FROM votes GROUP BY 1, 2, 3, 4"))
def src10(spark, sf):
    v = views.votes(spark, sf)
    return v.groupBy("scene", "cls", (F.floor(F.col("c") / 16) * 16).alias("tile_x"), (F.floor(F.col("r") / 16) * 16).alias("tile_y")).agg(F.count("*").alias("n"))


@query("SRC11_raster_tags", "SELECT n_nationkey, CAST(n_nationkey AS VARCHAR) || '=' || n_name AS tags FROM nation")
def src11(spark, sf):
    m = F.create_map(F.col("n_nationkey").cast("string"), F.col("n_name"), F.lit("AREA_OR_POINT"), F.lit("Area"))
    kept = F.map_filter(m, lambda k, v: k.rlike("^[0-9]+$"))
    return table(spark, sf, "nation").select("n_nationkey", F.array_join(F.transform(F.map_entries(kept), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("tags"))


@query("SRC14_download_routing", "SELECT doc_id, md5(text) AS checksum, CASE WHEN source IN ('src0', 'src1') THEN 'raster' WHEN source LIKE 'src1%' THEN 'metadata' ELSE 'other' END AS route FROM documents WHERE md5(text) <> 'x'")
def src14(spark, sf):
    route = F.when(F.col("source").isin("src0", "src1"), "raster").when(F.col("source").startswith("src1"), "metadata").otherwise("other")
    return table(spark, sf, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("checksum"), route.alias("route")).where("checksum <> 'x'")


@query("SRC15_md5", "SELECT page_id, md5(html) AS digest FROM pages")
def src15(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(F.col("html").cast("binary")).alias("digest"))


@query("SRC16_input_mode", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'csv' WHEN c_custkey % 2 = 0 THEN 'folder' ELSE 'session' END AS mode, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_name END, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END, 'session') AS src FROM customer")
def src16(spark, sf):
    csv, folder = F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment"))
    return table(spark, sf, "customer").select("c_custkey", F.when(csv.isNotNull(), "csv").when(folder.isNotNull(), "folder").otherwise("session").alias("mode"), F.coalesce(csv, folder, F.lit("session")).alias("src"))


@query("SRC19_decimated_read", with_views("prob", "SELECT scene, cls, CAST(floor(r / 4) AS INT) AS r, CAST(floor(c / 4) AS INT) AS c, round(avg(v) + 0.000001, 4) AS v FROM prob GROUP BY 1, 2, 3, 4"))
def src19(spark, sf):
    return imagery.thumbnails(views.prob(spark, sf), 4, ("scene", "cls"), "v").withColumn("v", F.round(F.col("v") + 0.000001, 4))


@query("SRC21_optional_artefacts", "SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), '{}') AS artefact FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def src21(spark, sf):
    d, l = table(spark, sf, "documents"), table(spark, sf, "labels")
    return d.select("doc_id").join(l, "doc_id", "left").select("doc_id", F.coalesce(F.col("quality").cast("string"), F.lit("{}")).alias("artefact"))


@query("SNK03_prediction_remap", with_views("labelled", "SELECT zone, gt, CASE WHEN pred = 0 THEN 255 ELSE pred END AS stored, count(*) AS n FROM labelled GROUP BY 1, 2, 3"))
def snk03(spark, sf):
    return views.labelled(spark, sf).withColumn("stored", F.when(F.col("pred") == 0, 255).otherwise(F.col("pred"))).groupBy("zone", "gt", "stored").agg(F.count("*").alias("n"))


@query("SNK05_class_masks", with_views("votes", "SELECT scene, r, c, " + ", ".join(f"CAST(max(CASE WHEN cls = {k} THEN 1 ELSE 0 END) AS INT) AS c{k}" for k in range(1, 6)) + " FROM votes GROUP BY 1, 2, 3"))
def snk05(spark, sf):
    v = views.votes(spark, sf).distinct()
    return v.groupBy("scene", "r", "c").agg(*[F.max((F.col("cls") == k).cast("int")).alias(f"c{k}") for k in range(1, 6)])


@query("SNK10_config_merge", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k, 'new' AS mode FROM events")
def snk10(spark, sf):
    old = F.map_filter(F.from_json("props", "map<string,string>"), lambda k, v: ~k.isin("mode"))
    both = F.map_concat(old, F.create_map(F.lit("mode"), F.lit("new")))
    return table(spark, sf, "events").select("event_id", both["k"].alias("k"), both["mode"].alias("mode"))


@query("SNK13_tile_pyramid", with_views("prob", ",,z AS (SELECT 0 AS z UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) SELECT scene, z.z AS z, CAST(floor(c * power(2, z.z) / 64) AS BIGINT) AS x, CAST(floor(r * power(2, z.z) / 64) AS BIGINT) AS y, count(*) AS n FROM prob, z GROUP BY 1, 2, 3, 4"))
def snk13(spark, sf):
    p = views.prob(spark, sf).withColumn("z", F.explode(F.array(*[F.lit(k) for k in range(4)])))
    at = lambda v: F.floor(F.col(v) * F.pow(F.lit(2), F.col("z")) / 64)
    return p.groupBy("scene", "z", at("c").alias("x"), at("r").alias("y")).agg(F.count("*").alias("n"))


@query("SNK01_tiles", with_views("votes", "SELECT scene AS ortho_id, r, c, cls, count(*) AS n FROM votes GROUP BY 1, 2, 3, 4"))
def snk01(spark, sf):
    from pixelweave.operators.vote import vote_counts
    from pixelweave.sources import sinks

    path = scratch_path(spark, "tiles")
    sinks.write_tiles(vote_counts(views.votes(spark, sf)).withColumnRenamed("scene", "ortho_id"), path)
    return spark.read.parquet(path).select("ortho_id", "r", "c", "cls", "n")


@query("SNK02_classified_raster", with_views("prob", "SELECT scene, r, c, arg_max(cls, row(v, -cls)) AS cls FROM prob GROUP BY 1, 2, 3"))
def snk02(spark, sf):
    from pixelweave.sources import sinks

    path = scratch_path(spark, "classified")
    sinks.write_classified(classify.classify(views.prob(spark, sf)).drop("v"), path, {k: f"class_{k}" for k in range(1, 6)})
    return spark.read.parquet(path)


@query("SNK04_mosaic", with_views("votes", ",,n AS (SELECT scene, r, c, cls, count(*) AS n FROM votes GROUP BY 1, 2, 3, 4) SELECT scene, r, c, arg_max(cls, row(n, -cls)) AS cls, 40 * arg_max(cls, row(n, -cls)) AS red FROM n GROUP BY 1, 2, 3"))
def snk04(spark, sf):
    from pixelweave.operators.catalog import with_class_info
    from pixelweave.operators.vote import plurality, vote_counts

    colours = spark.createDataFrame([(k, 40 * k) for k in range(1, 6)], "cls int, red int")
    path = scratch_path(spark, "mosaic")
    with_class_info(plurality(vote_counts(views.votes(spark, sf))).drop("n"), colours).write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path).select("scene", "r", "c", "cls", "red")


@query("SNK06_ortho_csv", with_views("orthos", "SELECT path AS root_folder, 'ortho_' || CAST(ortho_id AS VARCHAR) AS ortho_name FROM orthos"))
def snk06(spark, sf):
    from pixelweave.sources import files, sinks

    path = scratch_path(spark, "csv")
    sinks.write_csv(views.orthos(spark, sf).select(F.col("path").alias("root_folder"), F.concat(F.lit("ortho_"), F.col("ortho_id").cast("string")).alias("ortho_name")), path)
    return files.ortho_csv(spark, path)


@query("SRC05_csv_scan", with_views("sessions", "SELECT 'root' AS root_folder, session AS session_name FROM sessions"))
def src05(spark, sf):
    from pixelweave.sources import files, sinks

    path = scratch_path(spark, "sessions")
    sinks.write_csv(views.sessions(spark, sf).select(F.lit("root").alias("root_folder"), F.col("session").alias("session_name")), path)
    return files.session_csv(spark, path)


@query("SRC06_geojson", with_views("zones", "SELECT zone_id, 5 AS points, min(x0) AS x0, max(y1) AS y1 FROM zones GROUP BY 1"))
def src06(spark, sf):
    from pixelweave.sources import files

    z = views.zones(spark, sf)
    pt = lambda x, y: F.array(F.col(x), F.col(y))
    ring = F.array(pt("x0", "y0"), pt("x1", "y0"), pt("x1", "y1"), pt("x0", "y1"), pt("x0", "y0"))
    geo = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    layer = F.sort_array(F.collect_list(F.struct("zone_id", F.struct(geo.alias("geometry")).alias("f"))))
    doc = z.agg(F.to_json(F.struct(F.struct(F.struct(F.lit("EPSG:32740").alias("name")).alias("properties")).alias("crs"), F.transform(layer, lambda s: s["f"]).alias("features"))).alias("value"))
    path = scratch_path(spark, "geojson")
    doc.write.text(path)
    rows = files.geojson(spark, path, "zones")
    return rows.groupBy(F.col("feature_id").alias("zone_id")).agg(F.count("*").cast("int").alias("points"), F.min("x").alias("x0"), F.max("y").alias("y1"))


@query("SRC08_env_file", "SELECT 'TOKEN_' || CAST(r_regionkey AS VARCHAR) AS key, r_name AS value FROM region")
def src08(spark, sf):
    from pixelweave.sources import files

    path = scratch_path(spark, "env")
    table(spark, sf, "region").select(F.concat(F.lit("TOKEN_"), F.col("r_regionkey").cast("string"), F.lit("="), F.col("r_name")).alias("value")).write.text(path)
    return files.env_file(spark, path)


@query("SRC20_colour_table", "SELECT CAST(n_nationkey AS INT) AS cls, CAST(n_nationkey * 7 % 256 AS INT) AS r, 0 AS g, 128 AS b, 127 AS a FROM nation WHERE n_nationkey <> 0")
def src20(spark, sf):
    from pixelweave.sources import files

    path = scratch_path(spark, "colours")
    line = F.concat_ws(" ", F.col("n_nationkey").cast("string"), (F.col("n_nationkey") * 7 % 256).cast("string"), F.lit("0"), F.lit("128"), F.lit("127"))
    table(spark, sf, "nation").select(line.alias("value")).write.text(path)
    return files.colour_table(spark, path)


@query("SRC17_list_rasters", "SELECT CAST(0 AS BIGINT) AS n")
def src17(spark, sf):
    from pixelweave.sources import files

    return files.list_rasters(spark, sf).agg(F.count("*").alias("n"))


@query("SRC18_list_sessions", with_views("sessions", "SELECT DISTINCT split_part(session, '_', 2) AS place FROM sessions"))
def src18(spark, sf):
    from pixelweave.operators.catalog import place_of

    return views.sessions(spark, sf).select(place_of(F.col("session")).alias("place")).distinct().orderBy("place")


@query("SNK15_idempotent_stage", "SELECT r_regionkey, r_name FROM region")
def snk15(spark, sf):
    from pixelweave.sources import sinks

    path, t = scratch_path(spark, "once"), table(spark, sf, "region")
    sinks.write_once(t, path)
    sinks.write_once(t.where("false"), path)  # leaves what is there
    return spark.read.parquet(path)


