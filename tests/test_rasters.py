"""Resizing, suppression in rounds, global numbers, summed areas and pyramids against plain brute force."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelweave.operators import grid, numbering, summed, suppress
from pixelweave.sources import pyramid


@pytest.mark.parametrize("size", [(7, 9), (20, 30), (5, 5), (3, 4), (1, 1), (13, 2)])
def test_bilinear(spark, size):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3, 5, 5)).round(3)
    rows = [("s", r, c, k + 1, float(x[k, r, c])) for k in range(3) for r in range(5) for c in range(5) if (k, r, c) != (2, 1, 1)]
    x[2, 1, 1] = 0
    got = {(r.r, r.c): (r["values"], r.cls) for r in grid.resize_bilinear(spark.createDataFrame(rows, "scene string, r int, c int, cls int, v double"), 3, 5, 5, *size).withColumn("cls", grid.label_of(F.col("values"))).collect()}
    assert len(got) == size[0] * size[1]
    for (r, c), (values, cls) in got.items():
        py, px = (max(0.0, (t + 0.5) * 5 / n - 0.5) for t, n in zip((r, c), size, strict=True))
        a, b = int(py), int(px)
        fy, fx = py - a, px - b
        a1, b1 = min(a + 1, 4), min(b + 1, 4)
        want = x[:, a, b] * (1 - fy) * (1 - fx) + x[:, a, b1] * (1 - fy) * fx + x[:, a1, b] * fy * (1 - fx) + x[:, a1, b1] * fy * fx
        assert np.allclose(values, want) and cls == int(np.argmax(values)) + 1


def greedy(rows, limit):
    kept = []
    for g, k, s, *b in sorted(rows, key=lambda r: (r[0], -r[2], r[1])):
        def over(o):
            w, h = min(b[2], o[2]) - max(b[0], o[0]), min(b[3], o[3]) - max(b[1], o[1])
            i = max(0, w) * max(0, h)
            return i > limit * ((b[2] - b[0]) * (b[3] - b[1]) + (o[2] - o[0]) * (o[3] - o[1]) - i)

        if not any(g == q[0] and over(q[2:]) for q in kept):
            kept.append((g, k, *b))
    return sorted((g, k) for g, k, *_ in kept)


@pytest.mark.parametrize("limit,small", [(0.7, 0), (0.3, 0), (0.3, 200_000), (0.05, 0)])
def test_suppression(spark, limit, small):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(260):
        x, y = rng.uniform(0, 60, 2)
        s = 2 ** rng.uniform(-1, 5)
        rows.append((int(k % 2), k, float(rng.integers(0, 12)), float(x), float(y), float(x + s), float(y + s * rng.uniform(0.8, 1.2))))
    # a chain, in which each conflicts with the next alone
    rows += [(7, 1000 + i, float(-i), 10.0 * i, 0.0, 10.0 * i + 18, 10.0) for i in range(9)]
    rows += [(7, 2000, 1.0, 3.0, 3.0, 3.0, 3.0)]
    df = spark.createDataFrame(rows, "image int, box_id int, score double, x0 double, y0 double, x1 double, y1 double").repartition(4)
    got = sorted((r.image, r.box_id) for r in suppress.suppress(df, "image", limit, small=small).collect())
    assert got == greedy(rows, limit)


def test_long_chains_are_settled_in_one_task():
    import pandas as pd

    chain = pd.DataFrame({"g": 0, "better": range(5000), "worse": range(1, 5001)})
    (out,) = suppress.settle([chain.sample(frac=1, random_state=1)])
    assert sorted(out.worse) == list(range(1, 5001, 2))


def test_numbers_are_global(spark):
    rows = [(i % 7 if i % 3 else 5, i) for i in range(500)] + [(None, 1000)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(6)
    got = {r.b: r.place for r in numbering.number_rows(df, [F.desc("a"), "b"]).collect()}
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert [got[b] for _, b in want] == list(range(1, 502))
    assert sorted(r.b for r in numbering.resume_after(df, ["b"], 498).collect()) == [498, 499, 1000]
    assert {r.b: r.batch for r in numbering.batches(df, ["b"], 100).collect()}[250] == 2


def test_equal_rows_are_dealt_to_several_ranges(spark):
    df = spark.createDataFrame([(1,)] * 4000, "a int").repartition(4)
    out = numbering.number_rows(df, ["a"])
    assert sorted(r.place for r in out.collect()) == list(range(1, 4001))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan
    assert numbering.number_rows(df.where("false"), ["a"]).collect() == []


def test_rectangles_by_look_ups(spark):
    rng = np.random.default_rng(6)
    g = rng.integers(-9, 10, (37, 53)) * (rng.random((37, 53)) < 0.7)
    g[8:16, 16:24] = 0  # a block without pixels
    px = [("s", int(r), int(c), int(g[r, c])) for r, c in zip(*np.nonzero(g), strict=True)] + [("t", 0, 0, 5)]
    areas = summed.summed_areas(spark.createDataFrame(px, "scene string, r int, c int, v int").repartition(4), block=8)
    boxes = [("s", i, *(int(v) for v in (*rng.integers(-4, 40, 2), *rng.integers(-4, 60, 2)))) for i in range(120)] + [("s", 900, 0, 37, 0, 53), ("s", 901, 8, 16, 16, 24), ("s", 902, 5, 5, 0, 9), ("t", 903, -5, 100, -5, 100)]
    df = spark.createDataFrame(boxes, "scene string, box_id int, r0 int, r1 int, c0 int, c1 int")
    got = {r.box_id: r.total for r in summed.box_sums(df, areas, block=8).collect()}
    for s, i, r0, r1, c0, c1 in boxes:
        want = 5 if s == "t" else int(g[max(r0, 0) : max(r1, 0), max(c0, 0) : max(c1, 0)].sum()) if r0 < r1 and c0 < c1 else 0
        assert got[i] == want


def test_pyramid_levels_and_window(spark, tmp_path):
    rng = np.random.default_rng(8)
    px = {(r, c): int(rng.integers(1, 4)) for r in range(23) for c in range(30) if rng.random() < 0.8}
    df = spark.createDataFrame([("s", r, c, v) for (r, c), v in px.items()], "scene string, r int, c int, cls int")
    pyramid.write_pyramid(df, f"{tmp_path}/p", 3)
    level = px
    for z in range(4):
        got = {(r.r, r.c): r.cls for r in spark.read.parquet(f"{tmp_path}/p/z={z}").collect()}
        assert got == level
        above = {}
        for (r, c), v in level.items():
            above.setdefault((r // 2, c // 2), []).append(v)
        level = {k: min(v, key=lambda x: (-v.count(x), x)) for k, v in above.items()}
    seen = pyramid.read_window(spark, f"{tmp_path}/p", 0, 3, 9, 8, 21)
    assert {(r.r, r.c) for r in seen.collect()} == {k for k in px if 3 <= k[0] < 8 and 9 <= k[1] < 21}
    assert "GreaterThanOrEqual(morton," in seen._jdf.queryExecution().executedPlan().toString()


def test_morton_keys(spark):
    rows = spark.createDataFrame([(5, 9), (0, 0), (2**23, 2**24 - 1)], "r int, c int")
    assert [r.m for r in rows.select(pyramid.morton(F.col("r"), F.col("c")).alias("m")).collect()] == [pyramid.spread_int(r) << 1 | pyramid.spread_int(c) for r, c in ((5, 9), (0, 0), (2**23, 2**24 - 1))]
    assert math.log2(pyramid.spread_int(1 << 10)) == 20
