from __future__ import annotations

import numpy as np

from pixelweave.llm import cover_tree as ct


def brute(rows, limit):
    n = len(rows)
    link = np.zeros((n, n), bool)
    unit = []
    for _, v, label in rows:
        a = None if v is None or any(x is None for x in v) else np.array(v, float)
        unit.append(a / np.linalg.norm(a) if a is not None and label is not None and np.isfinite(a).all() and np.linalg.norm(a) > 0 else None)
    for i in range(n):
        for j in range(n):
            if i != j and unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]):
                link[i, j] = unit[i] @ unit[j] >= limit
    ids = np.array([r[0] for r in rows])
    comp = ids.copy()
    while True:
        new = np.array([min([comp[i], *comp[link[i]]]) for i in range(n)])
        if (new == comp).all():
            return {(int(a), int(k), int(c), bool(a == c)) for a, k, c in zip(ids, link.sum(1), comp, strict=True)}
        comp = new


def make(seed, n, dim, groups):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(groups, dim))
    rows = []
    for i in range(n):
        v = base[i % groups] + rng.normal(size=dim) * rng.choice([0, 0.05, 0.25, 0.6])
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 3 if i % 7 else 0)))
    return rows


SCHEMA = "vec_id long, embedding array<float>, label int"


def test_dual_traversal_is_exact():
    for seed in range(8):
        rows = make(seed, 120, 6, 9)
        x = np.array([r[1] for r in rows])
        x /= np.linalg.norm(x, axis=1)[:, None]
        x = np.unique(x, axis=0)
        want = (x @ x.T >= 0.93).sum(1) - 1
        assert (ct.link_chunks(x, np.ones(len(x), np.int64), np.zeros(len(x)), True, 0.93).n == want).all()
        side = (np.arange(len(x)) >= 50).astype(int)
        got = ct.link_chunks(x, np.ones(len(x), np.int64), side, False, 0.93)
        cross = x[:50] @ x[50:].T >= 0.93
        assert (got.n == np.concatenate([cross.sum(1), cross.sum(0)])).all()


def test_against_brute_force(spark):
    rows = make(1, 90, 8, 7)
    rows += [(200, None, 1), (201, [0.0] * 8, 1), (202, [float("nan")] * 8, 1), (203, rows[3][1], rows[3][2]), (204, rows[3][1], None), (205, [None] * 8, 1), (206, [float("inf")] * 8, 1), (207, [1.0, 0.0], 1), (208, [2.0, 0.0], 1)]
    rows += [(300 + i, rows[0][1], rows[0][2]) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS mult", "'x' AS node")
    want = brute(rows, 0.93)
    for chunk, pivots in ((1024, 64), (8, 4)):
        assert {tuple(r) for r in ct.near_duplicates(df, chunk=chunk, pivots=pivots).collect()} == want


def test_empty(spark):
    assert ct.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def close_copies(seed, dim, n=60):
    """Vectors that differ by single steps of float32, multiples of each other in float32, and others."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=dim).astype(np.float32)
    rows = [base]
    for k in range(8):
        v = base.copy()
        v[k % dim] = np.nextafter(v[k % dim], np.float32(9))
        rows.append(v)
    rows += [base * np.float32(1 + k / 7) for k in range(8)]
    rows += [(base + rng.normal(size=dim) * rng.choice([1e-9, 1e-7, 1e-5, 0.2])).astype(np.float32) for _ in range(20)]
    return rows + list(rng.normal(size=(n, dim)).astype(np.float32))


def test_nearly_equal_vectors():
    for seed in range(40):
        for dim in (8, 64):
            x = np.array(close_copies(seed, dim), float)
            x /= np.linalg.norm(x, axis=1)[:, None]
            x = np.unique(x, axis=0)
            cos = x @ x.T
            if (abs(cos - 0.93) < 1e-12).any():
                continue
            for limit in (0.93, 1 - 1e-9):
                if (abs(cos - limit) < 1e-13).any():
                    continue
                got = ct.link_chunks(x, np.ones(len(x), np.int64), np.zeros(len(x)), True, limit)
                assert (got.n == (cos >= limit).sum(1) - 1).all()
            side = np.arange(len(x)) % 2
            order = np.argsort(side, kind="stable")
            got = ct.link_chunks(x[order], np.ones(len(x), np.int64), side[order], False, 0.93)
            cross = (cos[order][:, order] >= 0.93) & (side[order][:, None] != side[order])
            assert (got.n == cross.sum(1)).all()


def test_cells_cut_again(spark):
    rows = [(i, [float(y) for y in v], 1) for i, v in enumerate(close_copies(3, 8, 200))]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {tuple(r) for r in ct.near_duplicates(df, chunk=6, pivots=4).collect()} == brute(rows, 0.93)


def test_query_over_small_tables(spark, sf):
    t = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()
    assert {tuple(r) for r in ct.op2_embedding_dedup(spark, sf).collect()} == brute([tuple(r) for r in t], 0.93)
