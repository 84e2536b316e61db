"""Operator 2: exact near-duplicate embeddings by dual traversal of cover trees.

Unit vectors whose cosine is at least t lie within r = sqrt(2 - 2t). Equal vectors are one class with a
count. The classes of a label are cut into cells around pivots, cells that are too large again, LEVELS times, and
what cannot be cut further is dealt by hash; each chunk is a ball, and pairs of balls further apart than r are dropped. What is left goes to tasks of two chunks
each: each builds a cover tree (nested levels, radii halving, every node with its true covering radius) for
its chunks and walks the two trees together. Node pairs too far apart are pruned, node pairs that lie within
r as a whole are linked as a whole, and the rest is opened. A task returns numbers of links by class and a
spanning forest of the links it found, never the pairs of a group.

Defined results: vectors that are null, zero, of a null label or id, or with null or non-finite components
link with nothing and are components of their own; vectors of different lengths never link; a repeated row
is another vector; an empty table gives no rows. The limit is checked on cosines of double precision.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.llm.common import components, read_table, stage

THRESHOLD = 0.93
CHUNK = 1024
PIVOTS = 64
SLACK = 1e-7
#: Points no further apart are not told apart by levels; the points of such leaves are compared one by one.
LEAF = 1e-7
#: Times that cells are cut around pivots.
LEVELS = 4


class CoverTree:
    """Nested centres: node k covers members[k] within radius[k] of its centre. A leaf holds points that are nearly equal, or one."""

    def __init__(self, points: np.ndarray):
        self.x = points
        self.centre: list[int] = []
        self.members: list[np.ndarray] = []
        self.radius: list[float] = []
        below: list[list[int]] = []
        todo = [(np.arange(len(points)), 2.0, -1)] if len(points) else []
        while todo:
            idx, reach, parent = todo.pop()
            me = len(self.centre)
            if parent >= 0:
                below[parent].append(me)
            far = float(self.distances(idx[:1], idx).max())
            self.centre.append(int(idx[0]))
            self.members.append(idx)
            self.radius.append(far)
            below.append([])
            reach, groups = self.split(idx, reach, far)
            todo += [(g, reach, me) for g in groups]
        self.children = [np.array(c) if c else None for c in below]

    def split(self, idx: np.ndarray, reach: float, far: float) -> tuple[float, list[np.ndarray]]:
        """The next level that tells points apart, and its groups; none for a leaf."""
        while far > LEAF and reach > LEAF:
            reach /= 2
            if reach < far and len(groups := self.cover(idx, reach)) > 1:
                return reach, groups
        return reach, []

    def cover(self, idx: np.ndarray, radius: float) -> list[np.ndarray]:
        """Points split among centres: from the front each point that no centre covers yet becomes one. Candidates are compared by blocks."""
        groups = []
        while len(idx):
            near = self.distances(idx[:64], idx) <= radius
            free = np.ones(len(idx), bool)
            for j in range(len(near)):
                if free[j]:
                    inside = near[j] & free
                    inside[j] = True
                    groups.append(idx[inside])
                    free &= ~inside
            idx = idx[free]
        return groups

    def distances(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Right to about 2e-8, since the difference of unit vectors is taken from their cosine."""
        return np.sqrt(np.maximum(0, 2 - 2 * (self.x[a] @ self.x[b].T)))


class Links:
    """Numbers of links by point and a spanning forest of them, for points of one or two chunks."""

    def __init__(self, mult: np.ndarray):
        self.mult, self.n = mult, np.zeros(len(mult), np.int64)
        self.up = np.arange(len(mult))
        self.forest: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.forest.append((i, j))

    def block(self, a: np.ndarray, b: np.ndarray) -> None:
        """Every point of a links to every point of b; the two have nothing in common."""
        self.n[a] += self.mult[b].sum()
        self.n[b] += self.mult[a].sum()
        for j in b.tolist():
            self.join(int(a[0]), j)
        for i in a.tolist():
            self.join(i, int(b[0]))


def dual(s: CoverTree, t: CoverTree, links: Links, shift_s: int, shift_t: int, cosine: float) -> None:
    """Link all pairs of cosine at least `cosine` between two trees, or within one if they are the same.

    A step takes two lists of nodes and settles all pairs between them at once. Pairs left open are grouped
    by the node whose children come next, so the steps are as many as the nodes opened, not as the pairs.
    """
    if not s.centre or not t.centre:
        return
    r, same, root = np.sqrt(2 - 2 * cosine), s is t, np.array([0])
    cs, ct, rs, rt = np.array(s.centre), np.array(t.centre), np.array(s.radius), np.array(t.radius)
    fine_s, fine_t = (np.array([c is None for c in x.children]) for x in (s, t))
    def one_by_one(m: np.ndarray, n: np.ndarray, within: bool) -> None:
        hit = s.x[m] @ t.x[n].T >= cosine
        for k in np.flatnonzero((np.triu(hit, 1) if within else hit).any(axis=1)):
            others = n[np.flatnonzero(hit[k]) if not within else k + 1 + np.flatnonzero(hit[k, k + 1 :])]
            links.block(m[k : k + 1] + shift_s, others + shift_t)

    todo = [(root, root, same)]
    while todo:
        all_a, b, diagonal = todo.pop()
        for lo in range(0, len(all_a), 512):
            a = all_a[lo : lo + 512]
            cos = s.x[cs[a]] @ t.x[ct[b]].T
            apart = np.sqrt(np.maximum(0, 2 - 2 * cos))
            both = rs[a][:, None] + rt[b][None]
            leaf = fine_s[a][:, None] & fine_t[b][None]
            once = np.arange(lo, lo + len(a))[:, None] < np.arange(len(b))[None] if diagonal else np.ones((1, 1), bool)
            whole = once & (apart + both <= r - SLACK)
            meet = once & ~whole & (apart - both <= r + SLACK)
            for i, j in zip(*np.nonzero(whole), strict=True):
                links.block(s.members[a[i]] + shift_s, t.members[b[j]] + shift_t)
            for i, j in zip(*np.nonzero(meet & leaf), strict=True):
                one_by_one(s.members[a[i]], t.members[b[j]], False)
            opened = meet & ~leaf
            for i in np.flatnonzero(opened.any(axis=1) & ~fine_s[a]):
                todo.append((s.children[a[i]], b[opened[i]], False))
            opened &= fine_s[a][:, None]
            for j in np.flatnonzero(opened.any(axis=0)):
                todo.append((a[opened[:, j]], t.children[b[j]], False))
            for i in a.tolist() if diagonal else ():
                if len(s.members[i]) > 1 and 2 * rs[i] <= r - SLACK:
                    m = s.members[i] + shift_s
                    links.n[m] += links.mult[m].sum() - links.mult[m]
                    for j in m.tolist():
                        links.join(int(m[0]), j)
                elif fine_s[i]:
                    one_by_one(s.members[i], s.members[i], True)
                else:
                    todo.append((s.children[i], s.children[i], True))


def link_chunks(vectors: np.ndarray, mult: np.ndarray, side: np.ndarray, within: bool, cosine: float) -> Links:
    """Links between the points of side 0 and those of side 1, or among all if within."""
    links = Links(mult)
    if within:
        tree = CoverTree(vectors)
        dual(tree, tree, links, 0, 0, cosine)
        return links
    n = int((side == 0).sum())  # side 0 comes first
    dual(CoverTree(vectors[:n]), CoverTree(vectors[n:]), links, 0, n, cosine)
    return links


def near_duplicates(rows: DataFrame, cosine: float = THRESHOLD, chunk: int = CHUNK, pivots: int = PIVOTS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for rows(vec_id, embedding, label)."""
    spark = rows.sparkSession
    x = F.transform("embedding", lambda v: v.cast("double"))
    size = F.sqrt(F.aggregate(F.col("x"), F.lit(0.0), lambda a, v: a + v * v))
    good = (
        F.col("vec_id").isNotNull()
        & F.col("label").isNotNull()
        & F.col("x").isNotNull()
        & ~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
        & (F.coalesce(F.col("size"), F.lit(0.0)) > 0)
    )
    # scaled by the largest component first, so tiny and huge vectors keep their direction
    top = F.array_max(F.transform("x", lambda v: F.abs(v)))
    base = rows.select("vec_id", "label", x.alias("x")).withColumn("top", top)
    base = base.withColumn("x", F.when(F.col("top") > 0, F.transform("x", lambda v: v / F.col("top"))).otherwise(F.col("x"))).withColumn("size", size)
    base = base.withColumn("ok", F.coalesce(good, F.lit(False)))
    base = base.withColumn("node", F.when(F.col("ok"), F.xxhash64("label", "x")))
    base = stage(base.select("vec_id", "label", "ok", "node", F.when(F.col("ok"), F.transform("x", lambda v: v / F.col("size"))).alias("x")), "vectors")

    first = F.struct("x", "label")
    classes = base.where("ok").groupBy("node").agg(F.count("*").alias("mult"), F.min("vec_id").alias("rep"), F.any_value(first).alias("f"))
    classes = classes.select("node", "mult", "rep", F.col("f.label").alias("label"), F.col("f.x").alias("x"), F.size("f.x").alias("dim"))
    classes = stage(classes, "classes")

    # cells with more classes than a chunk are cut around pivots, again and again: those of a cell are the classes with the smallest hashes
    key = ["label", "dim", "cell"]
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    celled = classes.select("label", "dim", F.lit("").alias("cell"), "node", "mult", "x", F.lit(None).cast("array<double>").alias("centre"), F.lit(2.0).alias("away"))
    for depth in range(LEVELS):
        sizes = celled.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > chunk)
        if not sizes.limit(1).count():
            break
        # a list of a cell has `pivots` vectors at most
        spread = celled.join(sizes, key).withColumn("part", F.pmod(F.xxhash64("node", F.lit(depth)), F.lit(pivots)))
        few = spread.groupBy(*key, "part", "n").agg(F.min(F.struct(F.xxhash64("node", F.lit(7 + depth)).alias("h"), "x")).alias("p"))
        picked = few.groupBy(*key, "n").agg(F.array_sort(F.collect_list("p")).alias("p"))
        picked = picked.select(*key, F.transform(F.slice("p", F.lit(1), F.least(F.lit(pivots), F.ceil(F.col("n") / chunk).cast("int"))), lambda v: v["x"]).alias("pivot"))
        nearest = F.array_max(F.transform("pivot", lambda p, i: F.struct(dot(p, F.col("x")).alias("cos"), (-i).alias("i"))))
        near = celled.join(picked, key, "left").withColumn("near", nearest)
        cut = F.col("near").isNotNull()
        celled = near.select(
            "label", "dim", F.when(cut, F.concat_ws(".", "cell", -F.col("near.i"))).otherwise(F.col("cell")).alias("cell"), "node", "mult", "x",
            F.when(cut, F.element_at("pivot", 1 - F.col("near.i"))).otherwise(F.col("centre")).alias("centre"),
            F.when(cut, F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("near.cos")))).otherwise(F.col("away")).alias("away"),
        )
        celled = stage(celled, "cells")
    sizes = celled.groupBy(*key).agg(F.count("*").alias("n"))
    dealt = celled.join(sizes, key).withColumn("chunk", F.concat_ws("/", "cell", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / chunk)).cast("string")))
    chunked = stage(dealt.select("label", "dim", "chunk", "node", "mult", "x", "centre", "away"), "chunks")

    # balls of chunks; two meet if their centres are no further apart than both radii and r
    balls = chunked.groupBy("label", "dim", "chunk").agg(F.max("away").alias("radius"), F.any_value("centre").alias("centre"))
    other = balls.select("label", "dim", F.col("chunk").alias("chunk2"), F.col("radius").alias("radius2"), F.col("centre").alias("centre2"))
    apart = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.coalesce(dot(F.col("centre"), F.col("centre2")), F.lit(1.0))))
    reach = float(np.sqrt(2 - 2 * cosine)) + SLACK
    pairs = balls.join(other, ["label", "dim"]).where((F.col("chunk") <= F.col("chunk2")) & (apart - F.col("radius") - F.col("radius2") <= reach))
    ends = pairs.select("label", "dim", F.explode(F.expr("IF(chunk = chunk2, array(struct(chunk, 0 AS side)), array(struct(chunk, 0 AS side), struct(chunk2 AS chunk, 1 AS side)))")).alias("e"), F.concat_ws("|", "chunk", "chunk2").alias("pair"), (F.col("chunk") == F.col("chunk2")).alias("within"))
    tasks = chunked.drop("centre", "away").join(ends.select("label", "dim", "e.chunk", "e.side", "pair", "within"), ["label", "dim", "chunk"])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["side", "node"])
        node = group["node"].to_numpy()
        links = link_chunks(np.stack(group["x"].to_numpy()).astype(np.float64), group["mult"].to_numpy(), group["side"].to_numpy(), bool(group["within"].iloc[0]), cosine)
        some = np.flatnonzero(links.n)
        edges = np.array(links.forest, np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": np.concatenate([node[some], node[edges[:, 0]]]), "b": pd.array([*[None] * len(some), *node[edges[:, 1]].tolist()], "Int64"), "n": np.concatenate([links.n[some], np.zeros(len(edges), np.int64)])})

    found = tasks.groupBy("label", "dim", "pair").applyInPandas(run, "a long, b long, n long")
    found = stage(found, "links")
    counts = found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    comp = components(None, found.where("b is not null").select("a", "b"), "a", "b")
    known = classes.select("node", "rep", "mult").join(comp, "node", "left").join(counts, "node", "left").select("node", "rep", "mult", F.coalesce("component", "node").alias("component"), F.coalesce("n", F.lit(0)).alias("n"))
    known = stage(known, "known")
    least = known.groupBy("component").agg(F.min("rep").alias("component_id"))
    by_class = known.join(least, "component").select("node", (F.col("n") + F.col("mult") - 1).alias("n_links"), "component_id")
    out = base.select("vec_id", "node").join(by_class, "node", "left")
    comp_id = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp_id.alias("component_id"), (F.col("vec_id") == comp_id).alias("kept"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings."""
    return near_duplicates(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


