"""Operator 12 against plain rounds of k-means on the whole table, and its defined results."""

from __future__ import annotations

import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pixelweave.llm import exponion
from pixelweave.llm.exponion import Centroids, assign, cluster_vectors, op12_clusters, squares


def brute(x: np.ndarray, starts: np.ndarray, rounds: int):
    c = starts.copy()
    for r in range(rounds + 1):
        d = ((x[:, None, :] - c[None]) ** 2).sum(2)
        own = d.argmin(1)
        if r < rounds:
            for j in np.unique(own):
                c[j] = x[own == j].sum(0) // (own == j).sum()
    return own, d.min(1), c


def test_query_against_plain_rounds(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    x = np.floor(256 * np.array(rows.embedding.tolist()).astype(float)).astype(np.int64)
    first = sorted(range(len(rows)), key=lambda i: hashlib.sha256(f"2:{rows.vec_id[i]}".encode()).hexdigest())[:40]
    own, distance, cents = brute(x, x[first], 5)
    got = op12_clusters(spark, sf).toPandas().set_index("vec_id").loc[rows.vec_id]
    assert (got.cluster.to_numpy() == own).all() and (got.distance.to_numpy() == distance).all()
    assert set(got.inertia) == {distance.sum()}
    for j, part in got.groupby("cluster"):
        assert set(part.cluster_inertia) == {distance[own == j].sum()}
        assert set(part.centroid_sha256) == {hashlib.sha256(",".join(map(str, cents[j])).encode()).hexdigest()}


small = st.integers(-3, 3)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(small, small), min_size=1, max_size=60), st.lists(st.tuples(small, small), min_size=1, max_size=9), st.integers(1, 4))
def test_ties_and_equal_centroids(points, starts, rounds):
    """Bounds carried over rounds give what comparing everything gives, on grids full of ties."""
    x, c = np.array(points, np.int64), np.array(starts, np.int64)
    own, distance, cents = brute(x, c, rounds)
    a, up, low, at, moves = np.zeros(len(x), np.int64), np.full(len(x), np.inf), np.full(len(x), -np.inf), c, np.zeros(len(c))
    for r in range(rounds + 1):
        a, up, low, _ = assign(x, a, up, low, Centroids(at, moves))
        if r < rounds:
            new = at.copy()
            for j in np.unique(a):
                new[j] = x[a == j].sum(0) // (a == j).sum()
            moves, at = np.sqrt(((new - at) ** 2).sum(1).astype(float)), new
    assert (a == own).all() and (at == cents).all()
    assert (np.diagonal(squares(x, at[a])) == distance).all()


def test_most_centroids_are_not_looked_at():
    rng = np.random.default_rng(1)
    c = rng.integers(-1000, 1000, (200, 2))
    x = c[rng.integers(0, 200, 5000)] + rng.integers(-9, 10, (5000, 2))
    first = Centroids(c, np.zeros(200))
    own, up, low, _ = assign(x, np.zeros(5000, np.int64), np.full(5000, np.inf), np.full(5000, -np.inf), first)
    moved = c + 1
    again, _, _, looked = assign(x, own, up, low, Centroids(moved, np.full(200, 2**0.5)))
    assert (again == squares(x, moved).argmin(1)).all() and looked < 0.05 * 5000 * 200


def test_large_components_are_exact():
    x = np.array([[1 << 27, -(1 << 27)], [(1 << 27) - 1, 3]], np.int64)
    assert squares(x, x).tolist() == [[0, 1 + ((1 << 27) + 3) ** 2], [1 + ((1 << 27) + 3) ** 2, 0]]


def test_odd_rows(spark, tmp_path):
    v = [float(i % 5) for i in range(64)]
    rows = [(1, v), (1, v), (2, [0.0] * 64), (None, v), (4, None), (5, [1.0]), (6, [*v[:63], None]), (7, [float("nan"), *v[1:]]), (8, [3e38, *v[1:]])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/a/embeddings.parquet")
    got = op12_clusters(spark, f"{tmp_path}/a").collect()
    assert sorted((r.vec_id is None, r.vec_id or 0) for r in got) == [(False, 1), (False, 1), (False, 2), (False, 8), (True, 0)]
    assert len({r.cluster for r in got if r.vec_id in (None, 1)}) == 1 and all(r.distance == 0 for r in got)
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/b/embeddings.parquet")
    assert op12_clusters(spark, f"{tmp_path}/b").collect() == []


def test_columns_stay_and_staged_rounds_go(spark, tmp_path, monkeypatch):
    """A column may have any name; of the rounds nothing but the last table stays."""
    monkeypatch.setattr("pixelweave.llm.common.shared_dir", lambda s: f"file://{tmp_path}")
    rows = spark.createDataFrame([(i, [i, i * i % 7], "x", i) for i in range(30)], "cluster long, v array<long>, upper string, before long").repartition(3)
    out, cents = cluster_vectors(rows, "v", [[0, 0], [9, 9], [20, 0]], 3, ("k", "d"))
    own, distance, want = brute(np.array([[i, i * i % 7] for i in range(30)]), np.array([[0, 0], [9, 9], [20, 0]]), 3)
    got = sorted(out.collect())
    assert out.columns == ["cluster", "v", "upper", "before", "k", "d"]
    assert [r.k for r in got] == own.tolist() and [r.d for r in got] == distance.tolist() and cents.tolist() == want.tolist()
    assert len(list((tmp_path / "pixelweave").iterdir())) == 1


def test_no_starts(spark):
    out, _ = cluster_vectors(spark.createDataFrame([(1, [1])], "id long, v array<long>"), "v", [], 2)
    assert out.collect() == [] and out.columns == ["id", "v", "cluster", "distance"]
    assert exponion.K == 40
