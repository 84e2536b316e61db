from __future__ import annotations

from pyspark.sql import functions as F

from pixelweave.llm import mixing as mx


def by_quotients(votes, seats, most):
    got = [0] * len(votes)
    for _ in range(seats):
        free = [i for i in range(len(votes)) if got[i] < most[i] and votes[i] > 0]
        if not free:
            break
        best = max(free, key=lambda i: (votes[i] / (2 * got[i] + 1), -i))
        got[best] += 1
    return got


def test_apportionment_matches_highest_quotients():
    import random

    r = random.Random(3)
    for _ in range(200):
        n = r.randint(1, 8)
        votes, seats = [r.choice([0, r.random() * 100]) for _ in range(n)], r.randint(0, 60)
        most = [r.choice([2, 10, 100]) for _ in range(n)]
        assert mx.sainte_lague(votes, seats, most) == by_quotients(votes, seats, most)


def test_targets_stop_and_reshare():
    got = mx.targets([10, 100, 100], [5, 2, 1])
    assert got[0] == 30 and abs(got[1] - 120) < 1e-9 and abs(got[2] - 60) < 1e-9
    assert mx.targets([], []) == [] and mx.targets([0, 4], [5, 2]) == [0.0, 4.0]


def test_mix(spark):
    rows = [(i, "w " * (i % 50), "b" if i % 3 == 0 else "a") for i in range(3000)] + [(9000, None, None), (9001, "one two", None), (9001, "one two", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    got = mx.mix_sources(df, shard_words=5000).collect()
    assert len(got) == len(rows)
    again = mx.mix_sources(df.repartition(7), shard_words=5000).collect()
    assert sorted((r.doc_id, r.taken, r.copies) for r in got) == sorted((r.doc_id, r.taken, r.copies) for r in again)
    size = {}
    for d, t, s in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    total = sum(size.values())
    assert abs(sum({(r.source_size, r.target) for r in got} and {r.source_size: r.target for r in got}.values()) - total) < 1e-6
    for s in ("a", "b"):
        taken = sum(r.taken for r in got if r.source_size == size[s])
        target = next(r.target for r in got if r.source_size == size[s])
        assert abs(taken - target) <= 0.01 * target
    assert all(0 <= r.taken <= 3 * r.size and 0 <= r.copies <= 3 for r in got)


def test_hot_source_is_many_shards(spark):
    df = spark.createDataFrame([(i, "w w w w") for i in range(4000)], "doc_id long, text string").withColumn("source", F.lit("s"))
    assert mx.mix_sources(df, shard_words=1000).select("shard").distinct().count() == 16


def test_empty(spark):
    assert mx.mix_sources(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_shards_receive_what_their_source_is_due(spark):
    rows = [(i, "w " * (1 + i % 37), "abcd"[i % 4] if i % 11 else "e") for i in range(4000)] + [(9000, "one two three", "f"), (9001, "one", "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    size = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in "abcdefg"}
    taken = {r.source: r.taken for r in mx.mix_sources(df, shard_words=100).join(df, "doc_id").groupBy("source").agg(F.sum("taken").alias("taken")).collect()}
    goal = mx.targets(list(size.values()), [(5, 2, 1)[i % 3] for i in range(7)])
    assert taken == dict(zip(size, mx.sainte_lague(goal, sum(size.values())), strict=True))
    assert taken["f"] == 9 and taken["g"] == 3


def test_query_against_brute_force(spark, sf):
    """Sizes, targets by plain resharing, and words taken, of every document of the table."""
    import re

    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()
    size = {r.doc_id: len(re.findall("[^\x20\x09-\x0d]+", r.text or "")) for r in rows}
    names = sorted({r.source for r in rows}, key=lambda s: (s is None, s or ""))
    of = {s: sum(size[r.doc_id] for r in rows if r.source == s) for s in names}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    goal, full = {}, set()
    while True:
        left = sum(of.values()) - sum(3 * of[s] for s in full)
        goal = {s: 3 * of[s] if s in full else left * weight[s] / sum(weight[x] for x in names if x not in full) for s in names}
        over = {s for s in names if s not in full and goal[s] > 3 * of[s]}
        if not over:
            break
        full |= over
    got = {r.doc_id: r for r in mx.op6_mixing(spark, sf).collect()}
    assert set(got) == set(size) and all(got[d].size == n for d, n in size.items())
    for s in names:
        mine = [got[r.doc_id] for r in rows if r.source == s]
        assert all(r.source_size == of[s] and abs(r.target - goal[s]) < 1e-6 * max(1, goal[s]) and 0 <= r.taken <= 3 * r.size for r in mine)
        assert abs(sum(r.taken for r in mine) - goal[s]) <= 1
        # whole rounds of the source, and one more of some: no document is favoured
        times = goal[s] // of[s] if of[s] else 0
        assert all(r.taken >= (times - 1) * r.size for r in mine)
