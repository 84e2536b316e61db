"""Streams that keep state of their own: mosaics in strips and training logs."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pytest

from pixelweave.plans.streams import read_log
from pixelweave.scratch import commit_text
from pixelweave.streaming.epochs import GAIN, Progress
from pixelweave.streaming.mosaic import MosaicStore

VOTES = "scene string, r int, c int, cls int"


def sizes(path: Path) -> dict:
    return {str(p): p.stat().st_size for p in path.rglob("*.parquet")}


def test_a_batch_writes_its_strips_alone(spark, tmp_path):
    rng = np.random.default_rng(1)
    store = MosaicStore(spark, f"file://{tmp_path}/m", 16, retain=2)
    every = [("a/b=1", int(r), int(c), int(k)) for r, c, k in zip(*rng.integers(0, (160, 60, 5), (9000, 3)).T, strict=True)]
    assert store.merge(spark.createDataFrame(every, VOTES), 0)
    before = sizes(tmp_path)
    few = [("a/b=1", 3, 4, 2), ("a/b=1", 3, 4, 2), ("new", 700, 1, 1)]
    assert store.merge(spark.createDataFrame(few, VOTES), 1)
    fresh = {p: n for p, n in sizes(tmp_path).items() if p not in before}
    assert sum(fresh.values()) < 0.25 * sum(before.values())
    assert not store.merge(spark.createDataFrame(few, VOTES), 1)  # the same batch again
    want = {}
    for v in every + few:
        want[v] = want.get(v, 0) + 1
    assert {(r.scene, r.r, r.c, r.cls): r.n for r in store.counts().collect()} == want
    assert {(r.scene, r.r, r.c, r.cls): r.n for r in store.counts(1).collect()} == {k: n for k, n in ((v, every.count(v)) for v in set(every))}
    assert not store.merge(spark.createDataFrame([], VOTES), 0)
    assert store.merge(spark.createDataFrame([], VOTES), 2) and store.versions() == [2, 3]
    assert store.mosaic().where("scene = 'new'").first().cls == 1


def test_old_strips_go_with_their_snapshots(spark, tmp_path):
    store = MosaicStore(spark, f"file://{tmp_path}/m", 16, retain=1)
    for i in range(3):
        store.merge(spark.createDataFrame([("a", 1, 1, 1)], VOTES), i)
    assert len(store.versions()) == 1 and len(sizes(tmp_path)) == 1
    assert store.counts().first().n == 3
    assert MosaicStore(spark, f"file://{tmp_path}/none").counts().collect() == []


def test_one_writer_commits(spark, tmp_path):
    commit_text(spark, f"file://{tmp_path}/x/v1.json", "a")
    with pytest.raises(FileExistsError):
        commit_text(spark, f"file://{tmp_path}/x/v1.json", "b")
    assert Path(f"{tmp_path}/x/v1.json").read_text() == "a"


def recurrence(rows, rate, patience, stop_after):
    """(run, epoch) -> (best, waited, bad, rate, stop), evaluation by evaluation."""
    out = {}
    for run in {r[0] for r in rows}:
        best = plateau = None
        waited = bad = 0
        lr, stop = rate, False
        for _, epoch, loss in sorted(r for r in rows if r[0] == run):
            if stop:
                break
            waited = 0 if best is None or loss < best else waited + 1
            best = loss if best is None else min(best, loss)
            if plateau is None or loss < plateau * (1 - GAIN):
                plateau, bad = loss, 0
            else:
                bad += 1
            if bad > patience:
                lr, bad = lr * 0.1, 0
            stop = waited >= stop_after
            out[run, epoch] = (best, waited, bad, round(lr, 15), stop)
    return out


def test_logs_out_of_order_across_a_restart(spark, tmp_path):
    """Epochs with gaps, shuffled within the lateness, a run that stops and one whose end never comes."""
    rng = np.random.default_rng(5)
    rows = [("a", e, float(x)) for e, x in zip(range(0, 90, 3), np.round(np.abs(rng.normal(1, 0.2, 30)), 3), strict=True)]
    rows += [("b", e, float(x)) for e, x in zip(range(1, 31), np.round(2 - np.arange(30) * 0.05, 3), strict=True)]
    rows += [("c", e, float(x)) for e, x in zip(range(1, 12), np.round(np.abs(rng.normal(1, 0.2, 11)), 3), strict=True)]
    order = {"a": list(range(30)), "b": list(range(30)), "c": list(range(11))}
    sent = [r for k in order for r in (rows[i] for i in range(len(rows)) if rows[i][0] == k)]
    key = {id(r): i for i, r in enumerate(sorted(sent, key=lambda r: (r[1], r[0])))}
    stream = sorted(sent, key=lambda r: key[id(r)] + rng.uniform(0, 3))  # neighbours change places
    stamp = lambda e: f"2024-01-01 00:{e // 60:02d}:{e % 60:02d}"
    files = [stream[:25], stream[25:50], stream[50:]]
    for i, part in enumerate(files):
        data = [(run, e, stamp(e), x) for run, e, x in part]
        if i == 2:
            data += [("a", 99, stamp(99), None), ("b", 99, stamp(99), None)]
        spark.createDataFrame(data, "run string, epoch int, ts string, loss double").selectExpr("run", "epoch", "cast(ts AS timestamp) AS ts", "loss").coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
        if i:
            read_log(spark, f"file://{tmp_path}/log", f"file://{tmp_path}/rows", f"file://{tmp_path}/checkpoint")
    got = {(r.run, r.epoch): (r.best, r.waited, r.bad, round(r.rate, 15), r.stop) for r in spark.read.parquet(f"{tmp_path}/rows").collect()}
    want = recurrence(rows, 1e-3, 2, 9)
    assert {k: v for k, v in got.items() if k[0] != "c"} == {k: v for k, v in want.items() if k[0] != "c"}
    assert all(want[k] == v for k, v in got.items())
    assert spark.read.parquet(f"{tmp_path}/rows").count() == len(got)


def test_a_rate_has_a_floor():
    step = Progress(1e-7, 0.1, 0, 99).step
    now = (-1, None, None, 0, 0, 1e-7, False)
    for e in range(9):
        now = step(now, e, 1.0)
    assert 1e-9 < now[5] < 2e-8
