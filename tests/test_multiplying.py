"""Steps whose rows multiply: what is broadcast, how the rows of one key are dealt out, and that results stay whole."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from pixelweave.operators import catalog, fanout, imagery, masks, polygons, suppress


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_strips_are_not_broadcast(spark):
    """The pixels of context strips are many more than the planner takes them for; equal boxes are looked up once."""
    box = spark.createDataFrame([("i", k, 10, 10, 30, 30) for k in range(50)], "image string, box_id int, x0 long, y0 long, x1 long, y1 long")
    like = spark.createDataFrame([("i", r, c) for r in range(64) for c in (8, 9)], "image string, r int, c int")
    out = masks.expand_boxes(box, like, 64, 64, 0.5)
    assert "ShuffledHashJoin" in plan(out)
    assert {b.box_id: (b.x0, b.x1) for b in out.collect()} == dict.fromkeys(range(50), (8, 30))


def test_masks_set_all_over_have_no_peak(spark, tmp_path):
    """As in the SQL, where no unset pixel is there to measure from."""
    from pixelweave.plans.all import QUERIES

    at = ["id % 32 AS l_suppkey", "id div 32 AS l_partkey", "1 AS l_linenumber", "'O' AS l_linestatus", "50000.0D AS l_extendedprice"]
    rows = spark.range(2048).selectExpr("'A' AS l_returnflag", *at).union(spark.range(2047).selectExpr("'N' AS l_returnflag", *at))
    rows.write.parquet(str(tmp_path / "lineitem.parquet"))
    assert [(r.mask_id, r.r, r.c) for r in QUERIES["AGG33_distance_peak"](spark, str(tmp_path)).collect()] == [("N-1", 0, 0)]


def test_rows_of_one_key_are_dealt_out(spark):
    """An image's pixels reach their correction in parts, and a place's rows are joined by many tasks."""
    many = spark.range(4000).selectExpr("CASE WHEN id >= 0 THEN 't' END AS k", "id AS a")
    out = fanout.spread_join(many, spark.createDataFrame([("t", 1), ("t", 2), ("u", 3)], "k string, b int"), ["k"])
    assert out.columns == ["k", "a", "b"] and out.count() == 8000 and out.distinct().count() == 8000
    assert out.select(F.spark_partition_id()).distinct().count() > 2
    px = many.selectExpr("k AS tile", "a AS y", "CAST(a % 200 AS INT) AS r", "CAST(a % 90 AS INT) AS g", "CAST(a % 70 AS INT) AS b")
    fixed = imagery.colour_correct(px)
    assert fixed.count() == 4000 and fixed.select(F.spark_partition_id()).distinct().count() > 2


def test_many_to_many_joins_are_dealt_out(spark):
    """One place of many sessions and orthos, one stem in all names: rows come from several tasks, each pair once."""
    a = spark.range(300).selectExpr("id AS s", "CASE WHEN id >= 0 THEN 1 END AS place", "concat('n', id) AS name")
    b = spark.range(40).selectExpr("id AS o", "CASE WHEN id >= 0 THEN 1 END AS place", "CASE WHEN id >= 0 THEN 'n' END AS stem")
    for out in (catalog.match_orthos(a.drop("name"), b.drop("stem")), catalog.contains_join(a.drop("place"), "name", b.drop("place"), "stem")):
        assert out.count() == out.select("s", "o").distinct().count() == 12000
        assert out.select(F.spark_partition_id()).distinct().count() > 2


def test_pairs_take_few_bytes(spark, tmp_path):
    """Sessions and orthos of one place: in runs their pairs compress; in another order each takes bytes of its own."""
    a = spark.range(4000).selectExpr("id AS session_id", "CASE WHEN id >= 0 THEN 1 END AS place", "CAST(id AS STRING) AS session")
    b = spark.range(1500).selectExpr("id * 7 AS ortho_id", "CASE WHEN id >= 0 THEN 1 END AS place", "'x' AS crs")
    catalog.match_orthos(a.drop("session"), b).select("session_id", "ortho_id", "crs").write.parquet(str(tmp_path / "out"))
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == out.distinct().count() == 6_000_000
    assert sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")) < 1_500_000


def test_runs_keep_rows_whole(spark, monkeypatch):
    """Runs of two rows, blocks of three: nulls, equal rows, two keys, columns of one name and sides without columns, as by a plain join."""
    monkeypatch.setattr(fanout, "RUN", 2)
    monkeypatch.setattr(fanout, "BLOCK", 3)
    nan = float("nan")
    a = spark.createDataFrame([(1.0, "p", 1), (1.0, "p", None), (1.0, "p", None), (nan, "p", 2), (None, "p", 3), (2.0, "q", 4), (2.0, None, 5)], "k double, l string, v int")
    b = spark.createDataFrame([(1.0, "p", i, "w") for i in (1, 2, 3, 3, None, None, 4)] + [(nan, "p", 5, None), (None, "p", 6, "w"), (3.0, "q", 7, "w")], "k double, l string, v int, w string")
    told = lambda df: sorted(map(str, df.toDF(*[f"c{i}" for i in range(len(df.columns))]).collect()))
    got = fanout.run_join(a, b, ["k", "l"])
    assert got.columns == ["k", "l", "v", "v", "w"] and told(got) == told(a.join(b, ["k", "l"])) and got.count() == 22
    for x, y in ((a.drop("v"), b), (a, b.drop("v", "w"))):
        assert told(fanout.run_join(x, y, ["k", "l"])) == told(x.join(y, ["k", "l"]))
    assert told(fanout.run_join(a, b.drop("v"), ["k", "l"], ["w", "v"])) == told(a.join(b.drop("v"), ["k", "l"]).select("w", "v"))
    assert fanout.run_join(a, b.where("false"), ["k", "l"]).count() == 0


def test_pieces_that_are_no_stems_do_not_travel(spark, monkeypatch):
    """Of a name's pieces those that equal a stem go to the join; the same pairs come out where all pieces go."""
    names = spark.range(60).selectExpr("id AS n", "format_string('name%04d', id) AS name")
    stems = spark.range(30).selectExpr("id AS s", "right(format_string('%04d', id * 5), 2) AS stem")
    seen = []
    whole = catalog.run_join
    monkeypatch.setattr(catalog, "run_join", lambda many, *rest: seen.append(many.count()) or whole(many, *rest))
    some = catalog.contains_join(names, "name", stems, "stem", ["n", "s"])
    monkeypatch.setattr(catalog, "STEMS", 0)
    every = catalog.contains_join(names, "name", stems, "stem", ["n", "s"])
    want = sorted((n, s) for n in range(60) for s in range(30) if f"{s * 5:04d}"[-2:] in f"name{n:04d}")
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, every.collect())) == want
    assert seen[0] < seen[1] / 2


def test_equal_boxes_are_swept_together(spark, monkeypatch):
    """Many copies of few boxes: each of them gets its area, and the sweep sees a box once."""
    edges = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 0.0), (1, 10.0, 0.0, 10.0, 10.0), (1, 10.0, 10.0, 0.0, 10.0), (1, 0.0, 10.0, 0.0, 0.0)], "feature_id int, ax double, ay double, bx double, by double")
    boxes = spark.range(500).selectExpr("id AS box_id", "CAST(id % 5 AS DOUBLE) + 7 AS x0", "2.0D AS y0", "CAST(id % 5 AS DOUBLE) + 9 AS x1", "4.0D AS y1")
    seen = []
    whole = polygons.place_coverage
    monkeypatch.setattr(polygons, "place_coverage", lambda b, *rest: seen.append(b.count()) or whole(b, *rest))
    got = {r.box_id: (r.area, r.covered) for r in polygons.coverage(boxes, polygons.cover_cells(edges, ("feature_id",)), keys=("feature_id",)).where("area > 0").collect()}
    assert seen == [5]
    assert got == {k: ((4.0, 4.0, 2.0)[k % 5], k % 5 < 2) for k in range(500) if k % 5 < 3}


def test_pairs_of_equal_boxes(spark):
    """Copies are compared with others once, and each pair comes once, whatever the sizes."""
    kinds = [(0.0, 0.0, 4.0, 4.0), (2.0, 2.0, 300.0, 300.0), (3.0, 3.0, 5.0, 5.5), (299.0, 299.0, 299.5, 299.25), (9.0, 9.0, 9.0, 12.0)]
    rows = [(g, k, *kinds[(k * 7 + g) % 5]) for g in range(2) for k in range(30)]
    df = spark.createDataFrame(rows, "image int, box_id int, x0 double, y0 double, x1 double, y1 double")
    want = {}
    for g, k, *a in rows:
        for h, m, *b in rows:
            w, t = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
            if g == h and k < m and w > 0 and t > 0:
                want[g, k, m] = round(w * t / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * t), 6)
    out = masks.pairwise_iou(df, "image", digits=6)
    got = out.collect()
    assert len(got) == len(want) and {(r.image, r.a, r.b): r.iou for r in got} == want
    assert "BroadcastExchange" not in plan(out)


def test_suppression_in_batches(spark, monkeypatch):
    """Equal boxes make no conflicts, and batches keep what one graph of all conflicts keeps."""
    from tests.test_rasters import greedy

    rng = np.random.default_rng(5)
    kinds = [(float(x), float(y), float(x + s), float(y + s)) for x, y, s in zip(rng.integers(0, 30, 60), rng.integers(0, 30, 60), rng.integers(0, 12, 60), strict=True)]
    rows = [(k % 2, k, float(rng.integers(0, 9)), *kinds[int(rng.integers(0, 60))]) for k in range(300)]
    df = spark.createDataFrame(rows, "image int, box_id int, score double, x0 double, y0 double, x1 double, y1 double")
    sizes = []
    whole = suppress.rounds
    monkeypatch.setattr(suppress, "rounds", lambda b, *rest: sizes.append(b.count()) or whole(b, *rest))
    got = sorted((r.image, r.box_id) for r in suppress.suppress(df, "image", 0.3, first=16).collect())
    assert got == greedy(rows, 0.3)
    assert sizes[0] == 16 and len(sizes) == 3 and sum(sizes) < 120
