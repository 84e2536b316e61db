"""Operator 11 against numpy on the whole table, and its defined results."""

from __future__ import annotations

import math

import numpy as np
import pytest

from pixelweave.llm import whitening
from pixelweave.llm.whitening import fit, merge, op11_whitening, state_of, transform


def brute(x: np.ndarray, k: int = 32):
    """Whitened values (up to sign), shares and squared deviations of whole-number rows."""
    n, s = len(x), x.sum(0)
    centred = (n * x - s) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    return centred @ axes[:, :k] / np.sqrt(values[:k]), values / values.sum(), ((n * x - s) ** 2).sum(1)


def test_query_against_numpy(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    x = np.floor(64 * np.array(rows.embedding.tolist()).astype(float)).astype(np.int64) + 1_000_000
    white, share, deviation = brute(x)
    got = op11_whitening(spark, sf).toPandas()
    assert len(got) == 32 * len(rows) and set(got.n) == {len(rows)} and not got.isna().any().any()
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[rows.vec_id].to_numpy()
    assert np.abs(np.abs(wide) - np.abs(white)).max() < 1e-8
    signs = np.sign(wide[np.abs(wide).argmax(0), range(32)] * white[np.abs(wide).argmax(0), range(32)])
    assert np.abs(wide * signs - white).max() < 1e-8  # one sign a component, the same for all rows
    assert np.allclose(got.groupby("component").explained.first(), share[:32], rtol=1e-9)
    assert (got.groupby("vec_id").deviation.first().loc[rows.vec_id].to_numpy() == deviation).all()
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9


@pytest.mark.parametrize("whole", [True, False])
def test_merged_states_are_that_of_all_rows(whole):
    rng = np.random.default_rng(5)
    x = rng.normal(1e6, 3, (700, 7))
    x = np.floor(x).astype(np.int64) if whole else x
    cuts = [0, 1, 2, 300, 699, 700]
    state = None
    for lo, hi in zip(cuts, cuts[1:]):
        part = state_of(x[lo:hi])
        state = part if state is None else merge(state, part)
    assert state.n == 700
    assert np.allclose(state.scatter / 700, np.cov(x.T.astype(float), bias=True), rtol=1e-8, atol=1e-8)
    if whole:
        assert state.total == x.sum(0).tolist()


def test_sums_beyond_a_long_stay_exact():
    x = np.full((5, 2), (1 << 62) - 1, np.int64)
    assert merge(state_of(x), state_of(x)).total == [10 * ((1 << 62) - 1)] * 2


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    good = [(i, rng.normal(size=3).tolist(), "a") for i in range(50)]
    odd = [(100, None, "n"), (101, [1.0, None, 2.0], "n"), (102, [float("nan"), 0.0, 0.0], "n"), (103, [float("inf"), 0.0, 0.0], "n"), (104, [], "n"), (None, [0.5, 0.5, 0.5], None)]
    rows = spark.createDataFrame(good + odd + [good[0]], "id long, whitened array<double>, n string").repartition(5)
    models = fit(rows, "whitened", 3)
    assert set(models) == {3} and models[3].n == 52 and models[3].identity_error < 1e-9
    out = transform(rows, models, "whitened", 3, name="w").collect()
    assert len(out) == 52 and {r.id for r in out} == {*range(50), None}
    white = np.array([r.w for r in out])
    assert np.allclose(white.T @ white / 52, np.eye(3), atol=1e-9)


def test_lengths_are_fitted_apart_and_missing_rank_is_null(spark):
    rows = spark.createDataFrame([(i, [i % 4, i % 3, 7]) for i in range(24)] + [(99, [1, 2])] * 3, "id long, v array<int>")
    models = fit(rows, "v", 5)
    assert set(models) == {2, 3} and models[3].n == 24 and models[2].n == 3
    out = transform(rows, models, "v", 5).collect()
    assert all(len(r.whitened) == len(r.v) for r in out)
    assert all(r.whitened[2] is None and r.whitened[0] is not None for r in out if len(r.v) == 3)
    assert all(r.whitened == [None, None] for r in out if len(r.v) == 2)
    assert models[3].identity_error < 1e-9 and math.isnan(models[2].identity_error)


def test_empty_table_and_few_rows(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/a/embeddings.parquet")
    assert op11_whitening(spark, f"{tmp_path}/a").collect() == []
    spark.createDataFrame([(1, [1e30, 0.0]), (2, [0.0, -1e30]), (2, [0.0, -1e30])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/b/embeddings.parquet")
    got = op11_whitening(spark, f"{tmp_path}/b").collect()
    assert len(got) == 6 and all(r.deviation is None for r in got)  # beyond a long


def test_blocks_do_not_matter(spark, sf, monkeypatch):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    one = fit(rows)[64]
    monkeypatch.setattr(whitening, "BLOCK", 7)
    many = fit(rows.repartition(9))[64]
    assert np.allclose(one.values, many.values, rtol=1e-9)
