from __future__ import annotations

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from tests.llm.test_near_dup import brute

cp = pytest.importorskip("corpus_pipeline")


def test_stages_in_turn(spark, sf):
    from pixelweave.llm.byte_bpe import load_ranks
    from pixelweave.llm.common import stage

    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("row_key", F.lit("clash"))
    told = stage(cp.STAGES[0][1](spark, docs, sf), "t")
    assert told.columns == docs.columns and told.count() >= 0.97 * docs.count()
    one = stage(cp.STAGES[1][1](spark, told, sf), "t")
    assert one.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in told.collect()]
    assert sorted(r.doc_id for r in one.collect()) == sorted(d for d, _, c, kept in brute(rows, 5, 80, 100) if kept)
    mix = stage(cp.STAGES[2][1](spark, one, sf), "t")
    assert mix.columns == docs.columns and {r.doc_id for r in mix.collect()} <= {r.doc_id for r in one.collect()}
    out = cp.STAGES[3][1](spark, mix, sf).collect()
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    text = dict(rows)
    assert len(out) == mix.count()
    for r in out[:50]:
        assert np.frombuffer(bytes(r.token_ids), "<u4").tolist() == enc.encode_ordinary(text[r.doc_id])


def test_odd_documents(spark, sf):
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "123", None, None, 3), (None, "the cat and the dog sat on the mat", "en", "s", 34), (5, "the cat and the dog sat on the mat", "en", "s", 34), (5, "the cat and the dog sat on the mat", "en", "s", 34)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    told = cp.language_stage(spark, docs, sf)
    assert told.count() == 3
    one = cp.near_dup_stage(spark, told, sf)
    assert [r.doc_id for r in one.collect()] == [5]
    for _, step in cp.STAGES:
        assert step(spark, docs.limit(0), sf).count() == 0
    clash = docs.withColumn("decoded", F.lit(1)).withColumn("token_ids", F.lit(2)).withColumn("copies", F.lit(3)).withColumn("mix_key", F.lit(4))
    assert cp.mixing_stage(spark, clash, sf).columns == clash.columns
    out = cp.bpe_stage(spark, clash, sf).collect()
    assert sorted(r.n_tokens for r in out)[:1] == [0] and [r.doc_id for r in out].count(5) == 2 and len(out) == 6


def test_near_dup_stage_on_odd_rows(spark, sf):
    """What has no words stays; rows equal in id and text are one; names may clash; a very long text is compared whole."""
    long_text = " ".join(f"w{i % 9000}" for i in range(60_000))
    rows = [(1, None), (2, None), (3, ""), (4, " \t"), (4, " \t"), (5, long_text), (6, long_text + " end"), (7, "one two three four five six"), (7, "other words that stand for themselves alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row_key", F.lit(1)).withColumn("group", F.lit("g")).withColumn("component_id", F.lit(0))
    one = cp.near_dup_stage(spark, docs, sf)
    assert one.columns == docs.columns
    got = sorted((r.doc_id, r.text or "") for r in one.collect())
    assert got == sorted([(1, ""), (2, ""), (3, ""), (4, " \t"), (5, long_text), (7, rows[7][1]), (7, rows[8][1])])
