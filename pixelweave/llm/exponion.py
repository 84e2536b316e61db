"""Operator 12: k-means clusters of whole-number vectors by exponion search.

A vector carries an upper bound of the distance to its centroid and a lower bound of that to every other. After each
round the bounds follow the centroids' moves; a vector whose upper bound stays below both the lower bound and half
the way from its centroid to the nearest other one keeps its cluster without a look at any centroid. Otherwise only
the centroids inside a ball around its own are looked at, found in the sorted list of distances between centroids: the
radius is twice the distance to its own plus the way to the nearest other, so that the two nearest are inside. The
radius is inclusive and bounds are rounded outwards, so that ties come to an exact comparison.

Centroids, their moves and their lists go with each task: k vectors and k * k distances, so k should be some thousands
at most. The vectors with their bounds are written after each round to the shared folder, the round before is deleted,
and a lost task is repeated from those files. New centroids come from the sums of those vectors alone that changed their cluster,
added up by task before the shuffle.

Defined results: equal distances go to the smaller number; a centroid without vectors stays; equal centroids
leave all their vectors to the smallest; repeated rows count as often as they occur; other columns, whatever their names, and null
ids are kept; no vectors or no starts give an empty result. Components must lie within 2^27 either side, so that
squared distances fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelweave.llm.common import read_table, stage, unstage

#: Largest component either side.
LIMIT = 1 << 27
#: Relative and absolute widening of bounds, far above the rounding of a double.
WIDE = 1e-9
#: Vectors looked at together.
BLOCK = 8192


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows x (n, d) to centroids c (m, d)."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * x.shape[1] * top * top < 1 << 53:  # every intermediate value is exact in a double
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    out = np.empty((len(x), len(c)), np.int64)
    for j, row in enumerate(c):
        out[:, j] = ((x - row) ** 2).sum(1)
    return out


def paired_squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distance of each row of x to the same row of c."""
    return ((x - c) ** 2).sum(1)


@dataclass
class Centroids:
    """Centroids with, for each, the others by distance; moves is how far each came since the round before."""

    at: np.ndarray
    moves: np.ndarray

    def __post_init__(self):
        k = len(self.at)
        apart = np.sqrt(squares(self.at, self.at).astype(np.float64))
        order = np.lexsort((np.broadcast_to(np.arange(k), (k, k)), np.where(np.eye(k, dtype=bool), -1.0, apart)), axis=1)
        #: itself first, then the nearest
        self.order = order
        self.sorted = np.take_along_axis(apart, order, 1)
        self.nearest = self.sorted[:, 1] if k > 1 else np.full(k, np.inf)
        most = np.argmax(self.moves)
        self.other_move = np.full(k, self.moves[most])
        self.other_move[most] = np.delete(self.moves, most).max(initial=0.0)


def assign(x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, cents: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Cluster, upper and lower bound of each row after the centroids' moves, and the number of distances computed."""
    own, looked = own.copy(), 0
    upper = upper + cents.moves[own] * (1 + WIDE)
    lower = lower - cents.other_move[own] * (1 + WIDE)
    half = cents.nearest[own] / 2 * (1 - WIDE)
    open_ = np.flatnonzero(upper * (1 + WIDE) + WIDE >= np.maximum(lower, half))
    if len(open_):
        upper[open_] = np.sqrt(paired_squares(x[open_], cents.at[own[open_]]).astype(np.float64))
        looked += len(open_)
        open_ = open_[upper[open_] * (1 + WIDE) + WIDE >= np.maximum(lower[open_], half[open_])]
    if len(cents.at) == 1 or not len(open_):
        return own, upper, lower, looked
    before = own[open_]
    for a in np.unique(before):
        rows = open_[before == a]
        radius = (2 * upper[rows] + cents.nearest[a]) * (1 + WIDE) + WIDE
        count = np.searchsorted(cents.sorted[a], radius, "right")
        rings = np.ceil(np.log2(np.maximum(count, 2))).astype(int)  # lists are cut at powers of two
        for ring in np.unique(rings):
            some = rows[rings == ring]
            inside = np.sort(cents.order[a][: min(1 << int(ring), len(cents.at))])
            for lo in range(0, len(some), BLOCK):
                part = some[lo : lo + BLOCK]
                d = squares(x[part], cents.at[inside])
                looked += d.size
                best = np.argmin(d, 1)  # the first of equals: the smallest number
                two = np.sqrt(np.partition(d, 1, 1)[:, :2].astype(np.float64))
                own[part], upper[part], lower[part] = inside[best], two[:, 0], two[:, 1]
    return own, upper, lower, looked


def matrix(vectors: pa.Array) -> np.ndarray:
    """Rows of a list array of longs of one length."""
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(vectors), -1)


class Clusters:
    """The state of a run: vectors with cluster and bounds as a staged table, centroids on the driver."""

    def __init__(self, rows: DataFrame, vector: str, starts: np.ndarray):
        self.columns, self.vector, self.spark = rows.columns, vector, rows.sparkSession
        self.names = ["_".join([n, *rows.columns]) for n in ("cluster", "before", "upper", "lower")]
        self.k, self.dim = starts.shape
        self.sums, self.counts = np.zeros((self.k, self.dim), object), np.zeros(self.k, object)
        self.cents = Centroids(starts, np.zeros(self.k))
        marks = zip(self.names, (F.lit(0), F.lit(-1), F.lit(float("inf")), F.lit(-float("inf"))), strict=True)
        self.table = rows.select("*", *[m.alias(n) for n, m in marks])

    def search(self, schema: T.StructType, made) -> DataFrame:
        """The table after an assignment; made(batch, x, own, before, upper, lower) gives the columns of schema."""
        cents, at, first = self.cents, self.columns.index(self.vector), len(self.columns)

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    x = matrix(batch.column(at))
                    before, upper, lower = (batch.column(first + i).to_numpy(zero_copy_only=False) for i in (0, 2, 3))
                    new_row = np.isinf(upper)
                    own, upper, lower, _ = assign(x, before, upper, lower, cents)
                    yield pa.RecordBatch.from_arrays(made(batch, x, own, np.where(new_row, -1, before), upper, lower), schema.names)

        return self.table.mapInArrow(task, schema)

    def round(self) -> None:
        """Assign all vectors, then move the centroids."""
        n = len(self.columns)
        kinds = [T.StructField(c, t) for c, t in zip(self.names, (T.IntegerType(), T.IntegerType(), T.DoubleType(), T.DoubleType()), strict=True)]
        schema = T.StructType([*self.table.schema.fields[:n], *kinds])
        told = self.search(schema, lambda batch, x, own, before, upper, lower: [*batch.columns[:n], pa.array(own.astype(np.int32)), pa.array(before.astype(np.int32)), pa.array(upper), pa.array(lower)])
        new = stage(told, "exponion")
        unstage(self.table)
        self.table = new
        self.shift()

    def shift(self) -> None:
        """Centroids become the floors of their vectors' means; sums change by the vectors that moved."""
        cluster, before = self.names[:2]
        k, dim = self.k, self.dim

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, counts = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
            for batch in batches:
                if len(batch):
                    x = matrix(batch.column(0))
                    for column, sign in ((1, 1), (2, -1)):
                        c = batch.column(column).to_numpy()
                        order = np.argsort(c, kind="stable")
                        order = order[c[order] >= 0]
                        if len(order):
                            some, begin = np.unique(c[order], return_index=True)
                            sums[some] += sign * np.add.reduceat(x[order], begin, axis=0)
                            counts[some] += sign * np.diff(np.append(begin, len(order)))
            some = np.flatnonzero(sums.any(1) | (counts != 0))
            if len(some):
                flat = pa.array(np.column_stack([counts[some], sums[some]]).ravel())
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * (dim + 1)), flat)], ["cluster", "v"])

        moved = self.table.where(F.col(cluster) != F.col(before)).select(self.vector, cluster, before)
        parts = moved.mapInArrow(task, "cluster int, v array<long>").select("cluster", F.posexplode("v").alias("i", "v"))
        # one row for each cluster and component
        for r in parts.groupBy("cluster", "i").agg(F.sum("v").alias("v")).collect():
            if r.i:
                self.sums[r.cluster, r.i - 1] += r.v
            else:
                self.counts[r.cluster] += r.v
        at = self.cents.at.copy()
        for j in range(self.k):
            if self.counts[j]:
                at[j] = [s // self.counts[j] for s in self.sums[j]]
        self.cents = Centroids(at, np.sqrt(paired_squares(at, self.cents.at).astype(np.float64)))

    def last(self, cluster: str, distance: str) -> DataFrame:
        """All rows with their cluster and exact squared distance, written to the shared folder."""
        n, cents = len(self.columns), self.cents
        schema = T.StructType([*self.table.schema.fields[:n], T.StructField(cluster, T.IntegerType()), T.StructField(distance, T.LongType())])
        told = self.search(schema, lambda batch, x, own, before, upper, lower: [*batch.columns[:n], pa.array(own.astype(np.int32)), pa.array(paired_squares(x, cents.at[own]))])
        out = stage(told, "clusters")
        unstage(self.table)
        return out


def cluster_vectors(rows: DataFrame, vector: str, starts: list[list[int]], rounds: int, names: tuple[str, str] = ("cluster", "distance")) -> tuple[DataFrame, np.ndarray]:
    """rows with cluster int and squared distance long after `rounds` of assigning and moving and a last assigning; and the centroids.

    rows[vector] is array<long>, all of the starts' length, without nulls.
    """
    if not starts:
        return rows.limit(0).select("*", F.lit(0).alias(names[0]), F.lit(0).cast("long").alias(names[1])), np.empty((0, 0), np.int64)
    run = Clusters(rows, vector, np.array(starts, np.int64))
    for _ in range(rounds):
        run.round()
    return run.last(*names), run.cents.at


SIZE, SEED, K, ROUNDS = 64, 2, 40, 5


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings of 64 finite components in steps of 1/256, in 40 clusters after five rounds.

    Components beyond 2^27 steps count as 2^27. Starts are the vectors of the smallest hashes; of equal hashes (repeated
    ids) the smaller vectors. A null id hashes as empty text. A sum of distances that no long holds is null.
    """
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    step = lambda v: F.floor(F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), F.lit(256.0) * v.cast("double")))).cast("long")
    kept = read_table(spark, sf_dir, "embeddings").where((F.size("embedding") == SIZE) & F.forall("embedding", fine)).select("vec_id", F.transform("embedding", step).alias("x"))
    rank = F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    starts = [r.x for r in kept.select("x", rank.alias("h")).orderBy("h", "x").limit(K).collect()]
    told, cents = cluster_vectors(kept, "x", starts, ROUNDS)
    told = told.select("vec_id", "cluster", "distance")
    # a row for each cluster, K at most
    sums = {r.cluster: int(r.s) for r in told.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    held = lambda s: s if s < 1 << 63 else None
    known = [(j, held(sums[j]), held(sum(sums.values())), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for j, c in enumerate(cents) if j in sums]
    facts = spark.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return told.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
