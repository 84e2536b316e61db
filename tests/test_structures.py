"""Regions, nearest labels and polygons that cross tiles, against plain brute force."""

from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pixelweave.operators import nearest, polygons, regions


def flood(on: set) -> dict:
    """First pixel of the region of each pixel."""
    out = {}
    for p in sorted(on):
        if p not in out:
            todo = [p]
            while todo:
                q = todo.pop()
                if q in on and q not in out:
                    out[q] = p
                    todo += [(q[0] + i, q[1] + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    return out


@settings(max_examples=80, deadline=None)
@given(st.sets(st.tuples(st.integers(-4, 9), st.integers(-5, 12)), min_size=1))
def test_runs_of_a_tile(px):
    r, c = (np.array(x) for x in zip(*px, strict=True))
    row, lo, hi, root = regions.tile_runs(r, c)
    want = flood(px)
    got = {(a, b): (row[k], lo[k]) for a, first, last, k in zip(row, lo, hi, root, strict=True) for b in range(first, last + 1)}
    assert got == want


def snake(n: int) -> list:
    """A path one pixel wide through every second row of n x n."""
    out = [(r, c) for r in range(0, n, 2) for c in range(n)]
    return out + [(r, n - 1 if r % 4 == 1 else 0) for r in range(1, n - 1, 2)]


@pytest.mark.parametrize("small", [0, 200_000])
def test_a_snake_is_one_region(spark, small):
    px = [("s", r, c) for r, c in snake(33)] + [("t", 40, 40), ("t", 41, 41), ("t", 43, 43)]
    found = regions.components(spark.createDataFrame([(k, r, c, 1) for k, r, c in px], "mask_id string, r int, c int, on_ int"), tile=4, small=small).collect()
    assert len(found) == len(px)
    first = {(r.mask_id, r.r, r.c): (r.region >> 32, (r.region & 0xFFFFFFFF) - (1 << 31), r.area) for r in found}
    assert {v for k, v in first.items() if k[0] == "s"} == {(0, 0, len(snake(33)))}
    assert first["t", 41, 41] == (40, 40, 2) and first["t", 43, 43] == (43, 43, 1)


@pytest.mark.parametrize("small", [0, 200_000])
def test_regions_across_tiles(spark, small):
    rng = np.random.default_rng(4)
    px = {k: {(int(r), int(c)) for r, c in zip(*np.nonzero(rng.random((40, 50)) < p), strict=True)} for k, p in (("a", 0.4), ("b", 0.25), ("c", 0.6))}
    rows = [(k, r - 7, c - 9, int((r, c) in px[k])) for k in px for r in range(40) for c in range(50)]
    m = spark.createDataFrame(rows, "mask_id string, r int, c int, on_ int").repartition(4)
    want = {(k, r - 7, c - 9): (a - 7, b - 9) for k in px for (r, c), (a, b) in flood(px[k]).items()}
    got = {(r.mask_id, r.r, r.c): (r.top, r.left) for r in regions.components(m, tile=8, small=small).withColumns({"top": regions.first_row(regions.F.col("region")), "left": regions.first_column(regions.F.col("region"))}).collect()}
    assert got == want
    size = {}
    for k, v in want.items():
        size[k[0], v] = size.get((k[0], v), 0) + 1
    kept = {k for k, v in want.items() if size[k[0], v] >= 9}
    assert {(r.mask_id, r.r, r.c) for r in regions.remove_small(m, 9, tile=8, small=small).collect() if r.on_} == kept


def test_largest_island_stays_and_empty_masks(spark):
    m = spark.createDataFrame([("a", 0, 0, 1), ("a", 5, 5, 1), ("a", 5, 6, 1), ("a", 9, 9, None), ("b", 0, 0, 0)], "mask_id string, r int, c int, on_ int")
    assert {(r.mask_id, r.r, r.c): r.on_ for r in regions.remove_small(m, 50, tile=4).collect()} == {("a", 0, 0): 0, ("a", 5, 5): 1, ("a", 5, 6): 1, ("a", 9, 9): 0, ("b", 0, 0): 0}
    assert regions.components(m.where("false")).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.data())
def test_nearest_index(h, w, data):
    on = np.array(data.draw(st.lists(st.booleans(), min_size=h * w, max_size=h * w))).reshape(h, w)
    d2, at = nearest.nearest_index(on)
    for r in range(h):
        for c in range(w):
            best = min(((r - a) ** 2 + (c - b) ** 2, a, b) for a, b in zip(*np.nonzero(on), strict=True)) if on.any() else (np.inf, 0, -1)
            assert (d2[r, c], at[r, c]) == (best[0], best[1] * w + best[2])


def test_labels_travel_as_far_as_they_must(spark):
    rng = np.random.default_rng(9)
    px = [("a", int(r), int(c), int(rng.integers(1, 6)) if rng.random() < 0.01 else None) for r in range(-70, 150) for c in range(40) if rng.random() < 0.8]
    px += [("b", 0, 0, None), ("b", 3, 3, None), ("d", 5, 5, 2)]
    df = spark.createDataFrame(px, "tile string, r int, c int, cls int").repartition(5)
    got = {(r.tile, r.r, r.c): r.cls for r in nearest.fill_nearest(df).collect()}
    known = [(r, c, cls) for k, r, c, cls in px if k == "a" and cls is not None]
    assert len(got) == len(px) and got["b", 0, 0] is None and got["d", 5, 5] == 2
    for k, r, c, _ in px:
        if k == "a":
            assert got[k, r, c] == min(((r - a) ** 2 + (c - b) ** 2, a, b, cls) for a, b, cls in known)[3]


def star(rng, n: int, x: float, y: float, lo: float, hi: float) -> list:
    angles = np.sort(rng.random(n)) * 2 * math.pi
    size = rng.uniform(lo, hi, n)
    return [(x + float(s * math.cos(a)), y + float(s * math.sin(a))) for s, a in zip(size, angles, strict=True)]


def edges_of(*rings) -> np.ndarray:
    return np.array([(*p, *q) for ring in rings for p, q in zip(ring, ring[1:] + ring[:1], strict=True)])


def inside(e: np.ndarray, x: float, y: float) -> bool:
    t = e[(e[:, 1] > y) != (e[:, 3] > y)]
    return int((x < (t[:, 2] - t[:, 0]) * (y - t[:, 1]) / (t[:, 3] - t[:, 1]) + t[:, 0]).sum()) % 2 == 1


def test_cover_of_stars_and_grids():
    """The cells tell inside from outside wherever they are asked, on polygons whose vertices lie on cell sides too."""
    rng = np.random.default_rng(2)
    shapes = [edges_of(star(rng, 60, 3, -8, 20, 50), star(rng, 9, 3, -8, 2, 8)) for _ in range(6)]
    shapes += [edges_of([(0, 0), (64, 0), (64, 64), (32, 32), (0, 64)], [(8, 8), (24, 8), (24, 24), (8, 24)]), edges_of([(0.0, 0.0), (1e-3, 0.0), (0.0, 1e-3)])]
    for e in shapes:
        cells = polygons.cover(e, max_edges=3, depth=8)
        lo, hi = e.min(), e.max()
        for x, y in rng.uniform(lo, hi, (400, 2)):
            held = [(*c[:7], np.array(c[7]).reshape(-1, 4)) for c in cells]
            assert polygons.part_has(held, x, y) == inside(e, x, y)


def test_cover_grows_with_the_outline():
    """A polygon of 10^6 unit squares doesn't make a cell for each."""
    e = edges_of([(0.3, 0.3), (1000.7, 0.3), (1000.7, 1000.7), (0.3, 1000.7)])
    assert len(polygons.cover(e, max_edges=1, depth=10)) < 30_000
    assert len(polygons.cover(e)) < 100


def layer(spark, shapes: dict):
    rows = [(i, *map(float, e)) for i, es in shapes.items() for e in es]
    return polygons.cover_cells(spark.createDataFrame(rows, "feature_id int, ax double, ay double, bx double, by double"), ("feature_id",))


def test_boxes_against_stars(spark):
    rng = np.random.default_rng(7)
    shapes = {i: edges_of(star(rng, int(rng.integers(5, 40)), *rng.uniform(0, 200, 2), 15, 40), *([star(rng, 5, 100, 100, 1, 3)] if i == 0 else [])) for i in range(8)}
    boxes = [(k, x, y, x + s, y + s * 0.7) for k, (x, y, s) in enumerate(zip(*rng.uniform(-20, 220, (2, 150)), 2 ** rng.uniform(-3, 6, 150), strict=True))]
    df = spark.createDataFrame([(k, *map(float, b)) for k, *b in boxes], "box_id int, x0 double, y0 double, x1 double, y1 double")
    got = {(r.box_id, r.feature_id): r.contains for r in polygons.relate(df, layer(spark, shapes), keys=("feature_id",)).collect()}
    want = {}
    for k, x0, y0, x1, y1 in boxes:
        for i, e in shapes.items():
            # clip each edge to the box: does any of it lie within?
            t0, t1 = np.zeros(len(e)), np.ones(len(e))
            for p, d, lo, hi in ((e[:, 0], e[:, 2] - e[:, 0], x0, x1), (e[:, 1], e[:, 3] - e[:, 1], y0, y1)):
                a, b = (lo - p) / d, (hi - p) / d
                t0, t1 = np.maximum(t0, np.minimum(a, b)), np.minimum(t1, np.maximum(a, b))
            cut = bool((t0 < t1).any())
            if cut or inside(e, x0, y0):
                want[k, i] = not cut
    assert got == want and 10 < sum(want.values()) < len(want)


def test_union_against_sampling(spark):
    rng = np.random.default_rng(11)
    shapes = {i: edges_of(star(rng, 12, *rng.uniform(20, 60, 2), 10, 25)) for i in range(6)}
    boxes = [(k, float(x), float(y), float(x + 9), float(y + 6)) for k, (x, y) in enumerate(rng.uniform(0, 80, (40, 2)))]
    df = spark.createDataFrame(boxes, "box_id int, x0 double, y0 double, x1 double, y1 double")
    got = {r.box_id: (r.area, r.covered) for r in polygons.coverage(df, layer(spark, shapes), keys=("feature_id",)).collect()}
    some = 0
    for k, x0, y0, x1, y1 in boxes:
        gx, gy = np.meshgrid(np.linspace(x0, x1, 62)[:-1] + 9 / 122, np.linspace(y0, y1, 62)[:-1] + 6 / 122)
        share = np.mean([any(inside(e, x, y) for e in shapes.values()) for x, y in zip(gx.ravel(), gy.ravel(), strict=True)])
        area, covered = got.get(k, (0.0, False))
        assert abs(area - 54 * share) < 54 * 0.02
        assert covered == (share == 1) or share > 0.999
        some += 0 < share < 1
    assert some > 8


def test_area_of_crossing_squares(spark):
    shapes = {0: edges_of([(0, 0), (10, 0), (10, 10), (0, 10)]), 1: edges_of([(5, 5), (15, 5), (15, 15), (5, 15)]), 2: edges_of([(5, -5), (10, 0), (5, 5), (0, 0)])}
    df = spark.createDataFrame([(0, -20.0, -20.0, 40.0, 40.0)], "box_id int, x0 double, y0 double, x1 double, y1 double")
    (r,) = polygons.coverage(df, layer(spark, shapes), keys=("feature_id",)).collect()
    assert abs(r.area - (175 + 25)) < 1e-9 and not r.covered


def test_no_polygons(spark):
    df = spark.createDataFrame([(0, 0.0, 0.0, 1.0, 1.0)], "box_id int, x0 double, y0 double, x1 double, y1 double")
    none = polygons.cover_cells(spark.createDataFrame([], "feature_id int, ax double, ay double, bx double, by double"), ("feature_id",))
    assert polygons.relate(df, none, keys=("feature_id",)).collect() == []
    assert polygons.in_polygons(df, none, "intersects", "left_anti", keys=("feature_id",)).count() == 1


def test_buffer_of_an_edge(spark):
    """A segment grown by 2: a capsule, but for the sides of its round ends."""
    e = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 0.0), (1, 10.0, 0.0, 0.0, 0.0)], "feature_id int, ax double, ay double, bx double, by double")
    cells = polygons.cover_cells(polygons.buffered(e, 2.0, ("feature_id",)), ("feature_id", "part"))
    df = spark.createDataFrame([(0, -16.0, -16.0, 16.0, 16.0)], "box_id int, x0 double, y0 double, x1 double, y1 double")
    (r,) = polygons.coverage(df, cells, keys=("feature_id", "part"), over=("feature_id",)).collect()
    sides = 64
    assert abs(r.area - (40 + sides / 2 * 4 * math.sin(2 * math.pi / sides))) < 1e-6
