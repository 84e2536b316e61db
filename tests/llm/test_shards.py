from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pixelweave.llm import shards
from tests.compare import connect, rows_of


def test_append_compact_read(spark, tmp_path):
    store = shards.ShardStore(spark, f"file://{tmp_path}/s", target_bytes=1 << 16, fan_in=3, base_bytes=256)
    rows = spark.range(900).select("id", F.md5(F.col("id").cast("string").cast("binary")).alias("run"), F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id")).alias("maybe"))
    for k in range(9):
        store.append(rows.where(F.col("id") % 9 == k).coalesce(1))
    before = store.manifest()
    assert len(before["runs"]) == 9 and before["version"] == 9
    assert store.compact() >= 1
    now = store.manifest()
    assert len(now["runs"]) < 9 and not store.merges(now["runs"])
    assert sorted(map(tuple, store.read().collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    store.append(rows.limit(5))
    assert store.read().count() == 905 and store.read(now["version"]).count() == 900


def test_second_writer_loses(spark, tmp_path):
    a, b = (shards.ShardStore(spark, f"file://{tmp_path}/s") for _ in range(2))
    old = a.manifest()
    a.commit(old, [], "{}")
    with pytest.raises(shards.Conflict):
        b.commit(old, [{"path": "x", "files": 1, "bytes": 1}], "{}")
    assert b.manifest()["runs"] == []


def test_empty_store(spark, tmp_path):
    store = shards.ShardStore(spark, f"file://{tmp_path}/s")
    store.append(spark.range(0).withColumn("x", F.lit("a")))
    assert store.read().columns == ["id", "x"] and store.read().count() == 0 and store.compact() == 0


def test_query_matches_sql(spark, sf):
    df = shards.op7_sharding(spark, sf)
    ref = connect(sf).execute(shards.OP7_SQL)
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in ref.description], ref.fetchall())


def test_older_versions_and_expiry(spark, tmp_path):
    store = shards.ShardStore(spark, f"file://{tmp_path}/s", retain=3)
    rows = spark.createDataFrame([(i % 5, "x" * (i % 3 * 1000), None) for i in range(40)], "run int, text string, arrival_ string")
    for _ in range(2):
        store.append(rows.withColumn("part", rows.run % 4), "part")
    before = store.manifest()["version"]
    early = store.read()
    assert store.compact() >= 1
    assert store.read().count() == store.read(before).count() == early.count() == 80
    assert sorted(map(tuple, store.read().collect())) == sorted(map(tuple, rows.union(rows).collect()))
    for _ in range(3):
        store.append(rows.limit(1))
    with pytest.raises(Exception):
        store.manifest(before)
    assert store.read().count() == 83


def test_append_tries_again(spark, tmp_path):
    store, other = (shards.ShardStore(spark, f"file://{tmp_path}/s") for _ in range(2))
    rows = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    commit, raced = store.commit, []

    def late(old, runs, schema):
        if not raced:
            raced.append(True)
            other.append(rows)
        return commit(old, runs, schema)

    store.commit = late
    store.append(rows)
    assert raced and store.read().count() == 2


def test_columns_and_types_evolve(spark, tmp_path):
    """A new column, a missing one, a wider type, repeated rows and a very long text, before and after compaction."""
    store = shards.ShardStore(spark, f"file://{tmp_path}/evolving", fan_in=2)
    long_text = "é" * 3_000_000
    store.append(spark.createDataFrame([(1, 1, 0.5), (1, 1, 0.5), (None, None, None)], "id int, n smallint, x float"))
    store.append(spark.createDataFrame([(2**40, "new", long_text)], "id long, extra string, text string"))
    store.append(spark.createDataFrame([(3, 7, 0.25)], "id int, n int, x double"))
    for _ in range(2):
        got = store.read()
        assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [("id", "bigint"), ("n", "int"), ("x", "double"), ("extra", "string"), ("text", "string")]
        rows = sorted((tuple(r) for r in got.collect()), key=str)
        assert rows == sorted([(1, 1, 0.5, None, None), (1, 1, 0.5, None, None), (None, None, None, None, None), (2**40, None, None, "new", long_text), (3, 7, 0.25, None, None)], key=str)
        store.compact()
    assert len(store.manifest()["runs"]) == 1
    assert [f.name for f in store.read(1).schema] == ["id", "n", "x"]


def test_clashing_types_are_refused_before_writing(spark, tmp_path):
    store = shards.ShardStore(spark, f"file://{tmp_path}/clash")
    store.append(spark.createDataFrame([(1, "a")], "id long, t string"))
    before = sorted((tmp_path / "clash" / "data").iterdir())
    for rows in (spark.createDataFrame([("x",)], "id string"), spark.createDataFrame([(1,)], "T int"), spark.createDataFrame([([1],)], "t array<int>")):
        with pytest.raises(TypeError):
            store.append(rows)
    assert sorted((tmp_path / "clash" / "data").iterdir()) == before and store.manifest()["version"] == 1


def test_folders_of_lost_jobs_are_swept(spark, tmp_path):
    store = shards.ShardStore(spark, f"file://{tmp_path}/swept")
    store.append(spark.createDataFrame([(1,)], "id long"))
    spark.createDataFrame([(2,)], "id long").write.parquet(f"{tmp_path}/swept/data/lost/run=0")
    assert store.sweep() == 0 and store.sweep(0) == 1
    assert [r.id for r in store.read().collect()] == [1] and len(list((tmp_path / "swept" / "data").iterdir())) == 1
