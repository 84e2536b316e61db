from __future__ import annotations

import hashlib

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from pixelweave.llm import fingerprints as fp


def by_hand(spark, texts):
    """Fingerprints from Spark's own hashes, but binned and densified in Python."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r.i: r.h for r in df.select("i", fp.shingles(F.col("text")).alias("h")).collect()}
    orders = [sorted(range(fp.BINS), key=lambda j: (j != i, fp.order_key(i, j), j)) for i in range(fp.BINS)]
    picks = []
    for i in range(len(texts)):
        least = {}
        for x in got[i]:
            b = (x >> 56) + 128
            least[b] = min(least.get(b, x), x)
        picks.append([next(least[j] for j in orders[k] if j in least) for k in range(fp.BINS)] if least else [])
    flat = spark.createDataFrame([(i, k, x) for i, p in enumerate(picks) for k, x in enumerate(p)], "i int, k int, x long")
    digit = flat.select("i", "k", F.xxhash64("x", "k").alias("h")).collect()
    out = [[""] * fp.BINS if p else [] for p in picks]
    for r in digit:
        out[r.i][r.k] = f"{r.h & 15:x}"
    return ["".join(o) for o in out]


def test_fingerprint_by_hand(spark):
    texts = ["", "  \t ", "one", "a b c d", "a b c d e", "a b c d e f g", " ".join(f"w{i}" for i in range(80)), " ".join(f"w{i % 31}" for i in range(3000)), "long " * 20000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = [r.f for r in df.orderBy("i").select(fp.fingerprint(F.col("text")).alias("f")).collect()]
    assert got == by_hand(spark, texts)


def test_query(spark, sf):
    t = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pandas().sort_values("doc_id")
    texts = t.text.tolist()
    nxt = texts[1:] + texts[:1]
    edited = [a[: len(a) - len(a) // 4] + b[: len(a) // 4] for a, b in zip(texts, nxt, strict=True)]
    got = fp.op10_fingerprints(spark, sf).toPandas().sort_values("doc_id")
    assert got.edited_sha256.tolist() == [hashlib.sha256(e.encode()).hexdigest() for e in edited]
    assert got.n_chars.tolist() == [len(x) for x in texts]

    def sets(x):
        w = x.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}

    true = np.array([len(sets(a) & sets(b)) / len(sets(a) | sets(b)) for a, b in zip(texts, edited, strict=True)])
    assert np.abs(got.near_edited.to_numpy() - true).mean() < 0.04
    assert got.near_next.mean() < 0.1


def test_next_over_many_runs(spark):
    ids = [None, -5, 0, 1, 2, 10**15, 10**15 + 1, 7, 8]
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string").withColumn("run", F.lit(1))
    got = {r.doc_id: r.next_text for r in fp.with_next(df, ["text"], run_rows=1).collect()}
    order = sorted(ids, key=lambda i: (i is not None, i or 0))
    assert got == {a: f"t{b}" for a, b in zip(order, order[1:] + order[:1], strict=True)}
    one = fp.with_next(df.where("doc_id = 7"), ["text"]).collect()
    assert [r.next_text for r in one] == ["t7"]
    twice = fp.with_next(df.where("doc_id = 7").union(df.where("doc_id = 7")), ["text"]).collect()
    assert len(twice) == 2
    assert fp.with_next(df.limit(0), ["text"]).count() == 0


def test_likeness(spark):
    row = spark.range(1).select(fp.likeness(F.lit(""), F.lit("")).alias("a"), fp.likeness(F.lit(""), F.lit("0" * 256)).alias("b"), fp.likeness(F.lit("1" * 256), F.lit("1" * 256)).alias("c")).first()
    assert tuple(row) == (1.0, 0.0, 1.0)


def test_next_with_ids_far_off(spark):
    ids = [*range(300), 1 << 62, -(1 << 61)]
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    got = {r.doc_id: r.next_text for r in fp.with_next(df, ["text"], run_rows=10).collect()}
    order = sorted(ids)
    assert got == {a: f"t{b}" for a, b in zip(order, [*order[1:], order[0]])}
    plan = fp.with_next(df, ["text"], run_rows=10).select("doc_id")
    assert plan.count() == len(ids)
