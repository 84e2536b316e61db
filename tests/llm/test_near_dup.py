from __future__ import annotations

import random
import re

import numpy as np
import pyarrow.parquet as pq

from pixelweave.llm import near_dup as nd

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, n, num, den):
    sets = [shingles(t, n) for _, t in rows]
    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    order = sorted(range(len(rows)), key=lambda i: rows[i][0])
    rank = {i: k for k, i in enumerate(order)}
    for i, s in enumerate(sets):
        near = {}
        for x in s:
            for j in where[x]:
                if j < i:
                    near[j] = near.get(j, 0) + 1
        for j, k in near.items():
            if den * k >= num * (len(s) + len(sets[j]) - k):
                a, b = sorted((root(i), root(j)), key=rank.get)
                up[b] = a
    return {(d, len(s), rows[root(i)][0], rows[root(i)][0] == d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))}


def made_up(seed, groups=12, size=9):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows = [(0, None), (1, ""), (2, " \t"), (3, "One two"), (4, "one TWO"), (5, "x")]
    for _ in range(groups):
        base = [r.choice(vocab) for _ in range(r.choice([4, 8, 20, 60, 200, 900]))]
        for _ in range(size):
            w = list(base)
            for _ in range(int(len(w) * r.choice([0, 0.01, 0.03, 0.06]))):
                w[r.randrange(len(w))] = r.choice(vocab)
            rows.append((len(rows), " ".join(w)))
    # a hub: copies that are each near the hub and not near each other
    hub = [r.choice(vocab) for _ in range(300)]
    for k in range(25):
        w = list(hub)
        for j in range(7):
            w[(k * 11 + j * 3) % 300] = f"own{k}-{j}"
        rows.append((len(rows), " ".join(w)))
    rows.append((len(rows), " ".join(hub)))
    return rows


def answer(df):
    return {tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()}


def test_against_brute_force(spark):
    for seed, (n, num, den) in enumerate([(3, 85, 100), (5, 80, 100)]):
        rows = made_up(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS node", "'k' AS key")
        assert answer(nd.near_duplicates(df, n, num, den)) == brute(rows, n, num, den)


def test_whole_small_table(spark, sf):
    t = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"])
    rows = list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True))
    got = nd.op8_near_dup(spark, sf)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert answer(got) == brute(rows, 3, 85, 100)


def test_null_ids_repeats_and_empty(spark):
    rows = [(7, "a b c d e"), (7, "a b c d e"), (None, "a b c d e"), (None, "q r s t u")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(nd.near_duplicates(df).select("doc_id", "component_id", "kept").collect(), key=str)
    assert [tuple(r) for r in got] == [(7, 7, True), (7, 7, True), (None, 7, None), (None, None, None)]
    assert nd.near_duplicates(df.limit(0)).count() == 0


def test_signature_estimates(spark):
    rng = np.random.default_rng(0)
    for n in (8, 40, 300, 5000):
        err = []
        for _ in range(30):
            both = rng.integers(0, 2**63, int(n * 0.8), dtype=np.uint64)
            a = np.unique(np.concatenate([both, rng.integers(0, 2**63, n // 10 + 1, dtype=np.uint64)]) * np.uint64(2) + np.uint64(1))
            b = np.unique(np.concatenate([both, rng.integers(0, 2**63, n // 10 + 1, dtype=np.uint64)]) * np.uint64(2) + np.uint64(1))
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            err.append(nd.agreement(nd.sketches(a, 80, 100)[1], nd.sketches(b, 80, 100)[1]) - true)
        assert abs(np.mean(err)) < 0.05


def test_near_links_without_ids(spark):
    base = [f"w{i}" for i in range(200)]
    near = lambda k: " ".join([*base[:k], "other", *base[k + 1 :]])
    alone = [f"v{i}" for i in range(200)]
    rows = [(5, near(20)), (None, near(100)), (None, " ".join(alone)), (None, " ".join([*alone[:50], "x", *alone[51:]])), (None, "q r s t u")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.text_key: r for r in nd.near_duplicates(df, 3, 85, 100).collect()}
    keys = [r.k for r in df.select(nd.text_key("doc_id", "text").alias("k")).collect()]
    assert [got[k].component_id for k in keys] == [5, 5, None, None, None]
    assert got[keys[2]].group == got[keys[3]].group != got[keys[4]].group

    import corpus_pipeline

    kept = {r.text for r in corpus_pipeline.near_dup_stage(spark, df, "").collect()}
    assert len(kept) == 3 and rows[0][1] in kept and rows[4][1] in kept


def test_signatures_that_fall_short_are_still_checked(spark):
    # halves of bytes: 512 values, of which 120 differ (0.77 agree), or all
    a, b, c = (bytes([9]) + x for x in (bytes(256), bytes([17] * 60) + bytes(196), bytes([34] * 256)))
    assert 0.7 < nd.agreement(a, b) < 0.8 and nd.agreement(a, c) < 0
    classes = spark.createDataFrame([(1, bytearray(a)), (2, bytearray(b)), (3, bytearray(c))], "node long, low binary")
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "a long, b long")
    assert [tuple(r) for r in nd.plausible(pairs, classes, 85, 100).collect()] == [(1, 2)]


def test_large_groups_in_blocks(spark, monkeypatch):
    """One large group of near copies of which only some link, and one passage that many texts share, in blocks of four."""
    r = random.Random(5)
    base, passage = [f"b{i}" for i in range(160)], [f"p{i}" for i in range(60)]
    rows = []
    for k in range(70):
        w = list(base)
        for j in r.sample(range(160), r.choice([1, 3, 6, 12])):
            w[j] = f"o{r.randrange(60)}"
        rows.append((k, " ".join(w)))
    rows += [(100 + k, " ".join([*passage, *(f"q{k}-{j}" for j in range(r.choice([3, 6, 40])))])) for k in range(70)]
    monkeypatch.setattr(nd, "BLOCK", 4)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for n, num, den in ((3, 85, 100), (5, 80, 100)):
        assert answer(nd.near_duplicates(df, n, num, den)) == brute(rows, n, num, den)


def test_word_hashes_by_batch():
    """Hashes depend on the word alone: not on its place, its neighbours, the cut of the texts or the case of A-Z."""
    import pyarrow as pa

    from pixelweave.llm import common as c

    texts = ["One two\tTHREE", None, "", " \x0b ", "two", "é É one", "x" * 3000 + " two"]
    array = pa.array([None if t is None else t.encode() for t in texts], pa.binary())
    words = [WORD.findall((t or "").translate(LOWER)) for t in texts]
    for part, some in ((array, words), (array.slice(4), words[4:])):
        data, at = c.raw_texts(part)
        a, b, first = c.word_spans(data, at)
        flat = [w for t in some for w in t]
        assert first.tolist() == np.cumsum([0] + [len(w) for w in some]).tolist()
        hashes = c.span_hashes(data, a, b).tolist()
        assert len(set(zip(flat, hashes))) == len(set(flat)) == len(set(hashes))
    span, c.SPAN = c.SPAN, 64
    try:
        again = c.span_hashes(data, a, b).tolist()
    finally:
        c.SPAN = span
    assert again == hashes


def rows_written(monkeypatch):
    """How many rows each staged table of link_classes has, by label."""
    seen: dict[str, int] = {}
    real = nd.stage

    def counting(df, label):
        out = real(df, label)
        seen[label] = max(seen.get(label, 0), out.count())
        return out

    monkeypatch.setattr(nd, "stage", counting)
    return seen


def test_templates_below_the_limit_make_no_pairs(spark, monkeypatch):
    """400 texts of which each two are alike by about 0.75: no links, and nothing that grows with their pairs is written."""
    r = random.Random(2)
    base = [f"b{i}" for i in range(400)]
    rows = [(k, " ".join([*base, *(f"o{k}-{j}" for j in range(65))])) for k in range(400)]
    # and texts that share most of it with them, but less with each other
    rows += [(1000 + k, " ".join([*base[: 400 - r.randrange(60, 160)], *(f"s{k}-{j}" for j in range(40))])) for k in range(60)]
    seen = rows_written(monkeypatch)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert answer(nd.near_duplicates(df, 3, 85, 100)) == brute(rows, 3, 85, 100)
    assert max(seen.get(label, 0) for label in ("found", "far", "star", "likely")) < 30_000 and seen["found"] < 1000


def test_members_outside_the_star_link(spark, monkeypatch):
    """Pairs similar to each other and far from the text that most resemble are found, in blocks of any size."""
    r = random.Random(8)
    base = [f"b{i}" for i in range(300)]
    rows = [(k, " ".join([*base, *(f"o{k}-{j}" for j in range(20))])) for k in range(20)]
    for k in range(30):
        own = [*base[: r.randrange(170, 215)], *(f"p{k}-{j}" for j in range(30))]
        rows.append((100 + k, " ".join(own)))
        own[5] = f"x{k}"
        rows.append((200 + k, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 3, 85, 100)
    assert answer(nd.near_duplicates(df, 3, 85, 100)) == want
    monkeypatch.setattr(nd, "BLOCK", 3)
    monkeypatch.setattr(nd, "BLOCK_BYTES", 5000)
    assert answer(nd.near_duplicates(df, 3, 85, 100)) == want


def test_one_very_long_text(spark):
    long_text = " ".join(f"w{i % 70_000}" for i in range(300_000))
    rows = [(1, long_text), (2, long_text + " more"), (3, "a b c d")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert answer(nd.near_duplicates(df, 3, 85, 100)) == brute(rows, 3, 85, 100)
