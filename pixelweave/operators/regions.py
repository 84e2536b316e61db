"""Connected regions of masks of any size.

A tile of pixels becomes runs along its rows; a union-find over the runs, row by row, joins those that touch, corners
included. A region of a tile is named after its first pixel. Regions of different tiles touch through border pixels,
which meet in an equi-join on their places; that graph of regions, far smaller than the pixels, is contracted in
rounds. No task holds more than a tile.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelweave.scratch import drop, stage

TILE = 512
#: Edges below which the rest of the graph is contracted at once, in one task: some 10 MB.
SMALL = 200_000


def name_of(r: Column, c: Column) -> Column:
    """A region's name: its first pixel in reading order, as a long that sorts in reading order."""
    return F.shiftleft(r.cast("long"), 32) + c.cast("long") + F.lit(1 << 31)


def find(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def union_find(n: int, a: list[int], b: list[int]) -> np.ndarray:
    """The smallest member of the set of each of 0..n-1 after joining a[k] with b[k]."""
    parent = list(range(n))
    for x, y in zip(a, b, strict=True):
        x, y = find(parent, x), find(parent, y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return np.array([find(parent, i) for i in range(n)], np.int64)


def tile_runs(r: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs (row, first column, last column) of set pixels in reading order, and for each the first run of its region."""
    order = np.lexsort((c, r))
    r, c = r[order].astype(np.int64), c[order].astype(np.int64)
    new = np.concatenate(([True], (r[1:] != r[:-1]) | (c[1:] > c[:-1] + 1)))
    first = np.flatnonzero(new)
    row, lo, hi = r[first], c[first], c[np.append(first[1:], len(r)) - 1]
    base, width = c.min() - 1, c.max() - c.min() + 3
    place = lambda rr, cc: (rr - r[0]) * width + cc - base
    # runs of the row above that end behind the last pixel's left neighbour and begin before its right one
    i = np.searchsorted(place(row, hi), place(row - 1, lo - 1))
    j = np.searchsorted(place(row, lo), place(row - 1, hi + 1), "right")
    n = np.maximum(j - i, 0)
    below = np.repeat(np.arange(len(row)), n)
    above = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + i[below]
    return row, lo, hi, union_find(len(row), below.tolist(), above.tolist())


def runs(px: DataFrame, key: str, tile: int) -> DataFrame:
    """(key, r, c0, c1, node) of px(key, r, c), all set, distinct or not: runs within tiles, and the region of the tile."""

    def run(df: pd.DataFrame) -> pd.DataFrame:
        row, lo, hi, root = tile_runs(df["r"].to_numpy(), df["c"].to_numpy())
        return pd.DataFrame({key: df[key].iloc[0], "r": row, "c0": lo, "c1": hi, "node": (row[root] << 32) + lo[root] + (1 << 31)})

    kind = px.schema[key].dataType.simpleString()
    at = lambda v: F.floor(F.col(v) / tile)
    return px.select(key, "r", "c", at("r").alias("tr"), at("c").alias("tc")).groupBy(key, "tr", "tc").applyInPandas(run, f"`{key}` {kind}, r long, c0 long, c1 long, node long")


def border_links(found: DataFrame, key: str, tile: int) -> DataFrame:
    """(key, u, v): regions of different tiles that touch, u < v, each pair once."""
    line = F.pmod(F.col("r"), F.lit(tile))
    whole = F.sequence("c0", "c1")
    ends = F.array_distinct(F.filter(F.array("c0", "c1"), lambda c: F.pmod(c, F.lit(tile)).isin(0, tile - 1)))
    px = found.select(key, "r", F.explode(F.when(line.isin(0, tile - 1), whole).otherwise(ends)).alias("c"), "node")
    beside = F.array(*[F.struct((F.col("r") + dr).alias("r"), (F.col("c") + dc).alias("c")) for dr, dc in ((0, 1), (1, -1), (1, 0), (1, 1))])
    cell = lambda r, c: F.struct(F.floor(r / tile), F.floor(c / tile))
    out = px.withColumn("to", F.explode(F.filter(beside, lambda p: cell(p["r"], p["c"]) != cell(F.col("r"), F.col("c"))))).select(key, "to.r", "to.c", F.col("node").alias("a"))
    met = out.join(px.withColumnRenamed("node", "b"), [key, "r", "c"])
    return met.select(key, F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u <> v").distinct()


def contract(edges: DataFrame, key: str, small: int = SMALL) -> DataFrame:
    """(key, node, root): for every end of edges(key, u, v) the smallest node it is connected with.

    In each round every node goes to its neighbour, or itself, of the least hash, which differs from round to round; edges
    follow their ends, loops and repeats go. At least half of the nodes that still have edges, roughly, are gone after each round,
    whatever the shape, and an edge to a hub goes with its other end. Each round is written, so that a lost task
    repeats no more than its own round. What fits in one task is done there.
    """
    left = stage(edges.select(key, "u", "v"), "edges")
    moves = []
    while (n := left.count()) > small:
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(len(moves))), c)  # noqa: E731, B023
        both = left.union(left.select(key, F.col("v").alias("u"), F.col("u").alias("v")))
        best = both.groupBy(key, "u").agg(F.min(rank(F.col("v"))).alias("best"))
        move = stage(best.where(F.col("best") < rank(F.col("u"))).select(key, F.col("u").alias("node"), F.col("best")["v"].alias("to")), "moves")
        to = lambda c: move.select(key, F.col("node").alias(c), F.col("to").alias(f"{c}_to"))  # noqa: E731, B023
        now = left.join(to("u"), [key, "u"], "left").join(to("v"), [key, "v"], "left").select(key, F.coalesce("u_to", "u").alias("u"), F.coalesce("v_to", "v").alias("v"))
        nxt = stage(now.where("u <> v").select(key, F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
        drop(left)
        left = nxt
        moves.append(move)

    if not n and not moves:  # nothing touches across tiles
        return left.select(key, F.col("u").alias("node"), F.col("v").alias("root"))

    def finish(frames):
        some = pd.concat([*frames, pd.DataFrame({key: [], "u": [], "v": []})])
        if len(some):
            ends = pd.MultiIndex.from_frame(pd.concat([some[[key, "u"]].rename(columns={"u": "n"}), some[[key, "v"]].rename(columns={"v": "n"})])).drop_duplicates().sort_values()
            a, b = (ends.get_indexer(pd.MultiIndex.from_frame(some[[key, c]].rename(columns={c: "n"}))) for c in "uv")
            root = union_find(len(ends), a.tolist(), b.tolist())
            yield pd.DataFrame({key: ends.get_level_values(0), "node": ends.get_level_values(1), "root": ends.get_level_values(1)[root]})

    kind = edges.schema[key].dataType.simpleString()
    known = left.repartition(1).mapInPandas(finish, f"`{key}` {kind}, node long, root long") if n else left.select(key, F.col("u").alias("node"), F.col("v").alias("root"))
    for move in reversed(moves):  # a node's root is that of where it went, or where it went
        at = known.select(key, F.col("node").alias("to"), "root")
        known = known.union(move.join(at, [key, "to"], "left").select(key, "node", F.coalesce("root", "to").alias("root")))
    out = known.union(known.select(key, F.col("root").alias("node"), "root")).distinct()
    least = out.groupBy(key, "root").agg(F.min("node").alias("least"))
    named = stage(out.join(least, [key, "root"]).select(key, "node", F.col("least").alias("root")), "regions")
    drop(left, *moves)
    return named


class Regions:
    """The regions of px(key, r, c), all set: runs, and what is known of each region of a tile."""

    def __init__(self, px: DataFrame, key: str = "mask_id", tile: int = TILE, small: int = SMALL):
        self.key = key
        self.runs = stage(runs(px, key, tile), "runs")
        self.roots = contract(border_links(self.runs, key, tile), key, small)
        nodes = self.runs.groupBy(key, "node").agg(F.sum(F.col("c1") - F.col("c0") + 1).alias("n"))
        linked = nodes.join(self.roots, [key, "node"], "left").select(key, "node", F.coalesce("root", "node").alias("region"), "n")
        #: (key, region, area); a region's name tells its first pixel
        self.areas = linked.groupBy(key, "region").agg(F.sum("n").alias("area"))
        #: (key, node, region, area)
        self.nodes = linked.drop("n").join(self.areas, [key, "region"])

    def pixels(self, some: DataFrame | None = None) -> DataFrame:
        """(key, r, c, region, area) of all pixels, or of the regions of some(key, region)."""
        nodes = self.nodes if some is None else self.nodes.join(some, [self.key, "region"], "left_semi")
        met = self.runs.join(nodes, [self.key, "node"])
        return met.select(self.key, F.col("r").cast("int").alias("r"), F.explode(F.sequence(F.col("c0").cast("int"), F.col("c1").cast("int"))).alias("c"), "region", "area")


def first_row(region: Column) -> Column:
    return F.shiftright(region, 32).cast("int")


def first_column(region: Column) -> Column:
    return (region.bitwiseAND(F.lit(0xFFFFFFFF)) - F.lit(1 << 31)).cast("int")


def components(m: DataFrame, key: str = "mask_id", on: str = "on_", tile: int = TILE, small: int = SMALL) -> DataFrame:
    """(key, r, c, region, area) of the set pixels of m(key, r, c, on), 8-connected across tiles."""
    return Regions(m.where(F.col(on) != 0), key, tile, small).pixels()


def remove_small(m: DataFrame, min_area: int, mode: str = "islands", key: str = "mask_id", on: str = "on_", tile: int = TILE, small: int = SMALL) -> DataFrame:
    """m without islands (or holes) below min_area pixels, across tiles; where all islands are small the largest stays, of equals the first in reading order."""
    holes = mode == "holes"
    found = Regions(m.where(F.coalesce(F.col(on), F.lit(0)) == 0 if holes else F.col(on) != 0), key, tile, small)
    gone = found.areas.where(F.col("area") < min_area)
    if not holes:
        top = found.areas.groupBy(key).agg(F.max(F.struct("area", (-F.col("region")).alias("last"))).alias("t")).where(F.col("t.area") < min_area)
        largest = top.select(key, (-F.col("t.last")).alias("region"))
        gone = gone.join(largest, [key, "region"], "left_anti")
    flip = found.pixels(gone.select(key, "region")).select(key, "r", "c", F.lit(1).alias("flip"))
    return m.join(flip, [key, "r", "c"], "left").select(key, "r", "c", F.when(F.col("flip").isNotNull(), int(holes)).otherwise((F.coalesce(F.col(on), F.lit(0)) != 0).cast("int")).alias(on))
