"""Operator 11: whitening of embeddings by Chan's merging of counts, means and centred scatters.

Each task makes one state of its rows: for each vector length the count, the sums, the local mean and the scatter
around that mean, batch by batch. States are merged pairwise by Chan's formula in treeReduce, so that the driver
receives a few square matrices, whatever the number of tasks; it finds the eigenvectors. A second pass over all rows
sums up the whitened vectors in the same way, and its covariance is held against the identity. Nothing is shuffled but
states; every pass can be repeated from the table.

Defined results: vectors that are null or hold null or non-finite components, and empty ones, go; vectors of different
lengths are whitened apart, each length by a model of its own. Sums of whole-number vectors are exact. A component
whose eigenvalue is below the rounding error of the covariance (fewer vectors than components, copies of one vector)
can't be scaled to one: its whitened value is null, and the identity is checked without it. Repeated rows count as often as they occur; null ids and
all other columns are kept as they are; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelweave.llm.common import read_table

COMPONENTS = 32
#: Rows summed up at once: bounds the memory of a batch of long vectors.
BLOCK = 4096
#: Whole numbers up to here are exact in a double, and 2^10 of them in a sum of longs.
EXACT = 1 << 53


@dataclass
class State:
    """n vectors: their sums (exact for whole numbers), their mean, and the scatter around it."""

    n: int
    total: list
    mean: np.ndarray
    scatter: np.ndarray


@dataclass
class Model:
    """What whitens vectors of one length: axes are the unit eigenvectors in rows, by falling eigenvalue."""

    n: int
    total: list
    mean: np.ndarray
    values: np.ndarray
    axes: np.ndarray
    trace: float
    identity_error: float = float("nan")

    def explained(self) -> np.ndarray:
        return self.values / self.trace if self.trace > 0 else np.zeros(len(self.values))

    def scales(self, k: int) -> np.ndarray:
        """Standard deviations of the first k components; nan where there is none to speak of."""
        floor = self.values[0] * len(self.mean) * np.finfo(float).eps * 16 if len(self.values) else 0
        return np.sqrt(np.where(self.values[:k] > max(floor, 0), self.values[:k], np.nan))

    def centre(self, x: np.ndarray) -> np.ndarray:
        """x - mean; for whole numbers from the exact n * x - sums."""
        if x.dtype.kind == "i" and all(isinstance(t, int) for t in self.total):
            top = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
            if self.n * top < 1 << 61 and max(map(abs, self.total)) < 1 << 61:
                return (self.n * x - np.array(self.total, np.int64)) / self.n
        return x - self.mean

    def project(self, x: np.ndarray, k: int) -> np.ndarray:
        """Whitened values of rows x on the first k components."""
        return self.centre(x) @ self.axes[:k].T / self.scales(k)


def state_of(x: np.ndarray) -> State:
    """The state of rows x (longs or doubles)."""
    n = len(x)
    if x.dtype.kind == "i":
        top = max(abs(int(x.max())), abs(int(x.min())))
        total = x.sum(axis=0).tolist() if top * n < 1 << 62 else x.astype(object).sum(axis=0).tolist()
        if top * n < EXACT:
            centred = (n * x - np.array(total, np.int64)) / n
            return State(n, total, np.array([t / n for t in total]), centred.T @ centred)
    else:
        total = x.sum(axis=0).tolist()
    mean = np.array([t / n for t in total])
    centred = x - mean
    return State(n, total, mean, centred.T @ centred)


def merge(a: State, b: State) -> State:
    """Chan's pairwise formula; the distance of two means of whole numbers comes from exact sums."""
    n = a.n + b.n
    apart = np.array([(y * a.n - x * b.n) / (a.n * b.n) if isinstance(x, int) and isinstance(y, int) else q - p for x, y, p, q in zip(a.total, b.total, a.mean, b.mean, strict=True)])
    total = [x + y for x, y in zip(a.total, b.total, strict=True)]
    mean = np.array([t / n if isinstance(t, int) else p + d * b.n / n for t, p, d in zip(total, a.mean, apart, strict=True)])
    return State(n, total, mean, a.scatter + b.scatter + np.outer(apart, apart) * (a.n * b.n / n))


def merge_all(a: dict[int, State], b: dict[int, State]) -> dict[int, State]:
    """States by vector length."""
    out = dict(a)
    for size, s in b.items():
        out[size] = merge(out[size], s) if size in out else s
    return out


def usable(vector: Column) -> Column:
    """Not null, not empty, every component finite."""
    fine = lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) != float("inf"))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, fine), F.lit(False))


def by_length(vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, rows) of a list array without nulls, at most BLOCK rows at a time."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(vectors.offsets.to_numpy())
    begin = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    for size in np.unique(sizes):
        places = np.flatnonzero(sizes == size)
        for lo in range(0, len(places), BLOCK):
            some = places[lo : lo + BLOCK]
            yield int(size), some, flat[begin[some][:, None] + np.arange(size)]


def gather(vectors: DataFrame, change=None) -> dict[int, State]:
    """The states of a one-column table of usable vectors, merged; change(length, rows) may map rows before."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, State] = {}
        for batch in batches:
            for size, _, x in by_length(batch.column(0)):
                if change:
                    x = change(size, x)
                if x.shape[1]:
                    held = merge_all(held, {size: state_of(x)})
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(held)], pa.binary())], ["state"])

    states = vectors.mapInArrow(task, "state binary").rdd.map(lambda r: pickle.loads(r[0]))
    return states.treeReduce(merge_all) if states.getNumPartitions() else {}


def wide(vector: Column, kind: str) -> Column:
    """Whole numbers as longs, others as doubles."""
    return F.transform(vector, lambda v: v.cast("long" if kind in ("tinyint", "smallint", "int", "bigint") else "double"))


def fit(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> dict[int, Model]:
    """A model for each length of usable vectors, its identity checked by a second pass over them."""
    kind = rows.schema[vector].dataType.elementType.simpleString()
    vectors = rows.where(usable(F.col(vector))).select(wide(F.col(vector), kind).alias("v"))
    models = {}
    for size, s in gather(vectors).items():
        values, axes = np.linalg.eigh(s.scatter / s.n)
        models[size] = Model(s.n, s.total, s.mean, np.maximum(values[::-1], 0.0), np.ascontiguousarray(axes[:, ::-1].T), float(np.trace(s.scatter) / s.n))

    def whitened(size: int, x: np.ndarray) -> np.ndarray:
        out = models[size].project(x, components)
        return out[:, ~np.isnan(models[size].scales(components))]

    for size, s in gather(vectors, whitened).items():
        models[size].identity_error = float(np.abs(s.scatter / s.n - np.eye(len(s.mean))).max())
    return models


def transform(rows: DataFrame, models: dict[int, Model], vector: str = "embedding", components: int = COMPONENTS, name: str = "whitened") -> DataFrame:
    """The usable rows with a column array<double> of the first components, whitened; null entries where a component has no scale."""
    kept = rows.where(usable(F.col(vector)))
    kind = rows.schema[vector].dataType.elementType.simpleString()
    held = kept.select("*", wide(F.col(vector), kind).alias("_".join(["v", *kept.columns])))  # a name that no column has
    schema = T.StructType([*kept.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.zeros(len(batch), np.int64)
            made = []
            for size, places, x in by_length(batch.column(batch.num_columns - 1)):
                values = models[size].project(x, components)
                sizes[places] = values.shape[1]
                made.append((places, values))
            ends = np.concatenate(([0], np.cumsum(sizes)))
            flat = np.empty(ends[-1])
            for places, values in made:
                flat[ends[places][:, None] + np.arange(values.shape[1])] = values
            column = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat, from_pandas=True))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], column], [*batch.schema.names[:-1], name])

    return held.mapInArrow(task, schema)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings in steps of 1/64, whitened: a row for each vector and component.

    Components beyond 2^50 steps count as 2^50; a deviation that no long holds is null.
    """
    step = lambda c: F.floor(F.greatest(F.lit(-(2.0**50)), F.least(F.lit(2.0**50), F.lit(64.0) * c.cast("double")))).cast("long") + F.lit(1_000_000)
    rows = read_table(spark, sf_dir, "embeddings").where(usable(F.col("embedding"))).select("vec_id", F.transform("embedding", step).alias("x"))
    models = fit(rows, "x")
    told = transform(rows, models, "x")
    size = F.size("x")
    pick = lambda value, kind: F.element_at(F.create_map(*[c for s, m in models.items() for c in (F.lit(s), value(m))]), size) if models else F.lit(None).cast(kind)
    far = F.zip_with("x", "s", lambda x, s: F.try_subtract(F.try_multiply(F.col("n"), x), s))
    total = F.aggregate(far, F.lit(0).cast("long"), lambda a, d: F.try_add(a, F.try_multiply(d, d)))
    longs = lambda m: F.array(*[F.lit(t if abs(t) < 1 << 63 else None).cast("long") for t in m.total])
    doubles = lambda m: F.array(*[F.lit(float(v)) for v in m.explained()])
    known = told.withColumns({
        "n": pick(lambda m: F.lit(m.n).cast("long"), "long"), "s": pick(longs, "array<long>"),
        "e": pick(doubles, "array<double>"), "identity_error": pick(lambda m: F.lit(float(m.identity_error)), "double"),
    })
    known = known.withColumn("deviation", total)
    out = known.select("vec_id", "n", "deviation", "e", "identity_error", F.posexplode("whitened").alias("i", "whitened"))
    return out.select("vec_id", (F.col("i") + 1).cast("int").alias("component"), "n", "deviation", "whitened", F.element_at("e", F.col("i") + 1).alias("explained"), "identity_error")
