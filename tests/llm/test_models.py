from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from pixelweave.llm import language_id as li
from pixelweave.llm import lm_score as lm
from pixelweave.llm.common import word_hash


def docs_of(sf):
    t = pq.read_table(f"{sf}/documents.parquet")
    return t.to_pylist()


def test_scores_against_brute_force(spark, sf, monkeypatch):
    docs = docs_of(sf)
    out = [zlib.crc32(str(d["doc_id"]).encode()) % 7 == 2 for d in docs]
    toks = [(d["text"] or "").encode().lower().split() + [b""] for d in docs]
    c = Counter(w for t, o in zip(toks, out, strict=True) if not o for w in t)
    n, v = sum(c.values()), len(c)
    monkeypatch.setattr(lm, "HEAD", 50)  # so that most tokens take the way of the join
    got = {r.doc_id: r for r in lm.op4_lm_score(spark, sf).collect()}
    assert len(got) == len(docs)
    for d, o, t in zip(docs, out, toks, strict=True):
        r = got[d["doc_id"]]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (o, len(t), sum(w in c for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
        assert math.isfinite(r.score) and r.score <= 0
    held = [got[d["doc_id"]] for d, o in zip(docs, out, strict=True) if o]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) * 1.05


def test_filter_counts(spark):
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**63, 5000, dtype=np.uint64)
    q = rng.integers(1, 12, 5000)
    bits, data = lm.make_filter(h, np.full(len(h), lm.PAIRS), q)
    bloom = lm.LogBloom(bits, np.frombuffer(data, np.uint8), 14)
    got = bloom.levels(h, lm.PAIRS)
    assert (got >= q).all() and (got == q).mean() > 0.95
    assert (bloom.levels(rng.integers(0, 2**63, 5000, dtype=np.uint64), lm.PAIRS) == 0).mean() > 0.95


def test_lm_edge_cases(spark):
    rows = [(1, None), (1, None), (None, ""), (2, "A a\x0bb"), (3, "word " * 50000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("held_out", F.lit(False))
    model, counts = lm.train(df.select("text"))
    got = lm.score(df, model, counts).collect()
    assert sorted(r.n_tokens for r in got) == [1, 1, 1, 4, 50001]
    none, counts = lm.train(df.limit(0).select("text"))
    assert {r.base_score for r in lm.score(df, none, counts).collect()} == {0.0}
    assert lm.score(df.limit(0), model, counts).count() == 0


def test_language_accuracy(spark, sf):
    docs = {d["doc_id"]: d for d in docs_of(sf)}
    got = li.op5_language_id(spark, sf).collect()
    assert len(got) == len(docs)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert np.mean([docs[r.doc_id]["lang"] == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edge_cases(spark):
    rows = [("the cat and the dog", "en"), ("le chat et le chien", "fr"), ("x", None), (None, "en")] * 5
    df = spark.createDataFrame(rows, "text string, lang string")
    model = li.train(df)
    assert model.languages == ["en", "fr"]
    asked = spark.createDataFrame([(None, "a"), ("", "b"), ("123 _ ²", "c"), ("the the dog", "d"), ("le chien", "e"), ("the " * 50000, "f")], "text string, score string")
    assert [r.lang_pred for r in li.predict(asked, model).collect()] == ["und", "und", "und", "en", "fr", "en"]
    assert li.predict(asked.limit(0), model).count() == 0
    one = li.train(df.where("lang = 'en'"))
    assert one.predict(["abc"])[0] == ["en"]
    assert li.train(df.where("false")).predict(["abc"])[0] == ["und"]


def test_codewords_are_apart():
    for k in (2, 3, 4, 9, 40):
        m = li.code_matrix(k)
        assert len({r.tobytes() for r in m}) == k


def test_scores_are_the_same_in_many_parts(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", F.lit(False).alias("held_out"))
    found = []
    for size in (1 << 30, 1 << 14):
        monkeypatch.setattr(lm, "PART_BYTES", size)
        model, counts = lm.train(docs.select("text"))
        found.append((model.parts, {r.doc_id: r.score for r in lm.score(docs, model, counts).collect()}))
    assert found[0][0] == 1 < found[1][0]
    got = [np.array([f[1][k] for k in found[0][1]]) for f in found]
    assert abs(got[0].sum() / got[1].sum() - 1) < 0.03
    # every pair that occurs twice is kept, in whichever part
    toks = [[b"<s>", *(r.text or "").encode().lower().split(), b""] for r in docs.collect()]
    c = Counter(p for t in toks for p in zip(t[:-1], t[1:], strict=True))
    often = [p for p, k in c.items() if k >= 2]
    one = lambda w: lm.START if w == b"<s>" else lm.END if w == b"" else word_hash(w)
    h = lm.pair(np.array([one(a) for a, _ in often]), np.array([one(b) for _, b in often]))
    part = (h >> np.uint64(8)) & np.uint64(model.parts - 1)
    for r in model.filters.where("pairs").collect():
        assert (lm.LogBloom(r.bits, np.frombuffer(r.data, np.uint8), lm.TOP).levels(h[part == np.uint64(r.part)], lm.PAIRS) > 0).all()


def test_what_occurs_once_counts(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "blue hen")], "doc_id long, text string").withColumn("held_out", F.lit(False))
    model, counts = lm.train(docs.select("text"))
    asked = spark.createDataFrame([(1, "red fox"), (2, "red hen"), (3, "red cow")], "doc_id long, text string").withColumn("held_out", F.lit(True))
    got = {r.doc_id: r.score for r in lm.score(asked, model, counts).collect()}
    assert got[1] > got[2] > got[3]
    assert (lm.count_of(lm.levels_of(np.array([1, 2, 3]))) == [1, 2, 3]).all()


def test_languages_beside_many_copies(spark):
    # the hash draws the group of copies
    texts = spark.range(20_000).select(F.concat(F.lit("the dog and cat "), F.col("id")).alias("text"))
    drawn = texts.where(F.pmod(F.xxhash64(F.lit(11), F.col("text")), F.lit(1 << 30)) < (1 << 30) * 0.001).first().text
    rows = [(drawn, "en")] * 6000 + [(f"le chat et le chien {i}", "fr") for i in range(40)] + [(f"der hund und die katze {i}", "de") for i in range(40)]
    df = spark.createDataFrame(rows, "text string, lang string").coalesce(1)
    model = li.train(df, sample_rows=30)
    assert model.languages == ["de", "en", "fr"]
    assert model.predict(["le chat et le chien", "der hund und die katze", drawn])[0] == ["fr", "de", "en"]


def exact_bigrams(train, asked):
    """log10 probabilities by absolute discounting with exact counts."""
    words, pairs, ctx, kinds = Counter(), Counter(), Counter(), Counter()
    for t in train:
        words.update(t)
        pairs.update(zip([None, *t], t))
        ctx.update([None, *t[:-1]])
    kinds.update(a for a, _ in pairs)
    n, v = sum(words.values()), len(words)
    out = []
    for t in asked:
        total = 0.0
        for a, b in zip([None, *t], t):
            p = (words[b] + 1) / (n + v + 1)
            if ctx[a]:
                p = max(pairs[a, b] - lm.DISCOUNT, 0) / ctx[a] + max(1, lm.DISCOUNT * kinds[a]) / ctx[a] * p
            total += math.log10(min(1, p))
        out.append(total)
    return out


def test_score_against_exact_bigrams(spark, sf):
    """Levels a factor BASE apart and false hits of the filter cost less than 0.12 of log10 a token, by 0.05 on average."""
    docs = docs_of(sf)
    toks = [(d["text"] or "").encode().lower().split() + [b""] for d in docs]
    want = exact_bigrams([t for d, t in zip(docs, toks) if zlib.crc32(str(d["doc_id"]).encode()) % 7 != 2], toks)
    got = {r.doc_id: r.score for r in lm.op4_lm_score(spark, sf).collect()}
    off = np.array([abs(got[d["doc_id"]] - w) / len(t) for d, w, t in zip(docs, want, toks, strict=True)])
    assert off.max() < 0.12 and off.mean() < 0.05


def test_filters_that_stay_in_parts_give_the_same_scores(spark, sf, monkeypatch):
    monkeypatch.setattr(lm, "PART_BYTES", 1 << 15)
    monkeypatch.setattr(lm, "FLUSH", 5000)
    found = []
    for size in (lm.BROADCAST_BYTES, 0):
        monkeypatch.setattr(lm, "BROADCAST_BYTES", size)
        found.append({r.doc_id: (r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in lm.op4_lm_score(spark, sf).collect()})
    assert found[0] == found[1] and len(found[0]) == len(docs_of(sf))


def test_lm_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", "x", "y"), (1, "a b", "x", "y")], "doc_id long, text string, token string, uid string").withColumn("held_out", F.lit(False)).withColumn("h", F.lit(1))
    model, counts = lm.train(docs)
    assert len({r.score for r in lm.score(docs, model, counts).collect()}) == 1
