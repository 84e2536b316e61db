"""Operator 4: language-model scores from a log-frequency Bloom filter.

Training counts every token and every pair of neighbours. Counts are quantised on a log scale; an entry of
level q is put into the filter q times, once for each level up to its own, and a reader probes level 1, 2, ...
until one is missing: overestimates die off geometrically. The filter also holds, for each context, its count
and the mass that its pairs leave to the words alone. The model interpolates by absolute discounting:
P(w | v) = max(c(vw) - D, 0) / c(v) + left(v) / c(v) * (c(w) + 1) / (N + V + 1), all counts from probes.

Every n-gram is counted and kept, those that occur once at level 1, whatever the size of the corpus: the filter
has BITS_PER_ENTRY for each entry. N-grams are dealt by hash to parts, one for each PART_BYTES of text, and each
part has a filter of its own in the shared folder, so building it needs no large task. A filter of up to
BROADCAST_BYTES in all is broadcast, and workers probe the distinct n-grams of many texts at once. A larger one
stays where it is: chunks of texts ask the parts for the levels of their distinct n-grams, packed in one row for each part
that has any of them, and the answer is one byte for each, in order. Scores are the same either way.

The base score needs exact counts. The most frequent tokens (at most HEAD of them) are broadcast; any other
token of a text is looked up by a join on the token, where by construction no token is frequent.

Defined results: a null text counts as empty and is one end token; without training rows N = V = 0 and each
token has probability 1; repeated rows are scored each; a null doc_id hashes like empty text; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.llm.common import mix64, raw_texts, read_table, span_bytes, span_hashes, stage, training_rows, unstage, word_spans


#: Bytes of training text to one part of the filter.
PART_BYTES = 16 << 20
#: Bytes of filters that are broadcast at most.
BROADCAST_BYTES = 192 << 20
BITS_PER_ENTRY = 10
PROBES = 4
SEGMENTS = 256
BASE = 1.5
DISCOUNT = 0.75
HEAD = 150_000
#: Tokens gathered before a task sums them up and passes them on.
FLUSH = 1_000_000
#: More levels than any count has.
TOP = 120

START = np.uint64(0x243F6A8885A308D3)
END = np.uint64(0x13198A2E03707344)
WORDS, PAIRS, CONTEXTS, LEFT = (np.uint64(x) for x in (0x9E37, 0x79B9, 0x7F4A, 0x7C15))



class Tokens:
    """The tokens of some binary texts: their hashes, those before them, where each text's tokens start, and their bytes."""

    def __init__(self, texts: pa.Array):
        self.data, at = raw_texts(texts)
        a, b, first = word_spans(self.data, at)
        n = len(at) - 1
        ends = first[1:] + np.arange(n)
        self.h = np.empty(len(a) + n, np.uint64)
        is_word = np.ones(len(self.h), bool)
        is_word[ends] = False
        self.h[is_word] = span_hashes(self.data, a, b)
        self.h[ends] = END
        self.sizes = np.diff(first) + 1
        self.first = first[:-1] + np.arange(n)
        self.before = np.concatenate(([START], self.h[:-1]))[: len(self.h)]
        self.before[self.first] = START
        self.a, self.b = np.zeros(len(self.h), np.int64), np.zeros(len(self.h), np.int64)
        self.a[is_word], self.b[is_word] = a, b

    def bytes_of(self, i: np.ndarray) -> pa.Array:
        """The tokens at places i; an end is empty."""
        return span_bytes(self.data, self.a[i], self.b[i])


#: Low bits of a pair's hash, which tell the pairs of one context apart; the others are its context's.
PAIR_BITS = np.uint64(30)


def context(h: np.ndarray) -> np.ndarray:
    """The 34 bits by which a word is known as context: of 10^8 distinct words one in 170 shares them with another, of 10^9 one in 17."""
    return mix64(h) >> PAIR_BITS


def pair(before: np.ndarray, h: np.ndarray) -> np.ndarray:
    return (context(before) << PAIR_BITS) | (mix64(before * np.uint64(0x9E3779B97F4A7C15) + h) >> (np.uint64(64) - PAIR_BITS))


COUNTS = "h long, token binary, c long"


def pack(u: np.ndarray) -> bytes:
    """Sorted hashes as differences, byte by byte, so that the compression of shuffles and files finds the zeros."""
    return np.diff(u, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(b: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(b, np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel(), dtype=np.uint64)


def deal(u: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts sorted hashes by part, and where each part starts in it."""
    part = ((u >> np.uint64(8)) & np.uint64(parts - 1)).astype(np.int32)
    return np.argsort(part, kind="stable"), np.concatenate(([0], np.cumsum(np.bincount(part, minlength=parts))))


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, token, c) of docs(text): all tokens with their text (empty: end). The starts have no token and the hash START."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, starts = [], 0, 0

        def flush() -> pa.RecordBatch:
            u, first, at = np.unique(np.concatenate([x[0] for x in held]), return_index=True, return_inverse=True)
            c = np.bincount(at, np.concatenate([x[1] for x in held])).astype(np.int64)
            words = pa.concat_arrays([x[2] for x in held]).take(pa.array(first)).cast(pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(np.append(u, START).view(np.int64)), pa.concat_arrays([words, pa.nulls(1, pa.binary())]), pa.array(np.append(c, starts))], ["h", "token", "c"])

        for batch in batches:
            for lo in range(0, len(batch), 512):
                t = Tokens(batch.column(0).slice(lo, 512))
                u, first, c = np.unique(t.h, return_index=True, return_counts=True)
                held.append((u, c, t.bytes_of(first)))
                size, starts = size + len(u), starts + len(t.first)
                if size >= FLUSH:
                    yield flush()
                    held, size, starts = [], 0, 0
        if size:
            yield flush()

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a task has summed up already, so rows are dealt by hash and summed once, after the shuffle
    found = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, COUNTS).repartition(n, "h")
    return found.groupBy("h", "token").agg(F.sum("c").alias("c"))


def pair_parts(docs: DataFrame, parts: int) -> DataFrame:
    """(part, h, c) of docs(text): for each chunk and part the packed pairs and how often each occurs in the chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            u, c = np.unique(np.concatenate(held), return_counts=True)
            order, at = deal(u, parts)
            u, c = u[order], c[order].astype(np.uint32)
            some = [i for i in range(parts) if at[i] < at[i + 1]]
            rows = [(pack(u[at[i] : at[i + 1]]), c[at[i] : at[i + 1]].tobytes()) for i in some]
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([x for x, _ in rows], pa.binary()), pa.array([x for _, x in rows], pa.binary())], ["part", "h", "c"])

        for batch in batches:
            for lo in range(0, len(batch), 512):
                t = Tokens(batch.column(0).slice(lo, 512))
                held.append(pair(t.before, t.h))
                size += len(t.h)
                if size >= FLUSH:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "part int, h binary, c binary")


def level(c) -> F.Column:
    """1 for a count of 1, one more for each factor BASE."""
    return (F.floor(F.log(c * F.lit(1 + 1e-12)) / float(np.log(BASE))) + 1).cast("int")


def levels_of(c: np.ndarray) -> np.ndarray:
    return (np.log(c * (1 + 1e-12)) / np.log(BASE)).astype(np.int64) + 1


def count_of(q: np.ndarray) -> np.ndarray:
    """The count that a level stands for: the one of its range, up to 3, or the middle on the log scale."""
    return np.where(q > 3, BASE ** (q - 0.5), q)


def positions(h: np.ndarray, q: int, kind: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Places of an entry's level within its segment, of fewer than 2^32 bits; all from one hash."""
    key = mix64(h ^ (kind * np.uint64(0x1000193)) ^ (np.uint64(q) << np.uint64(56)))
    step, half = key >> np.uint64(32) | np.uint64(1), np.uint64((1 << 32) - 1)
    for i in range(PROBES):
        yield ((key + np.uint64(i) * step) & half) * np.uint64(bits) >> np.uint64(32)


class LogBloom:
    """Reader of the filter: one array of bits by segment; an entry's low 8 bits name its segment."""

    def __init__(self, bits: int, data: np.ndarray, top: int):
        self.bits, self.data, self.top = bits, data, top

    def levels(self, h: np.ndarray, kind: np.uint64) -> np.ndarray:
        """For each hash how many levels in a row are there."""
        out, alive = np.zeros(len(h), np.uint8), np.arange(len(h))
        for q in range(1, self.top + 1):
            x = h[alive]
            base, there = (x & np.uint64(SEGMENTS - 1)) * np.uint64(self.bits), np.arange(len(x))
            for p in positions(x, q, kind, self.bits):
                at = (base + p)[there]  # where a bit is missing the others are not looked up
                there = there[(self.data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1]
            alive = alive[there]
            if not len(alive):
                break
            out[alive] = q
        return out


def make_filter(h: np.ndarray, kind: np.ndarray, q: np.ndarray) -> tuple[int, bytes]:
    """Bits by segment, and the filter of one part."""
    # segments of few entries are filled unevenly, so none is small
    bits = -(-max(1024, int(q.sum()) * BITS_PER_ENTRY // SEGMENTS) // 64) * 64
    data = np.zeros(SEGMENTS * bits, np.uint8)
    for j in range(1, int(q.max(initial=0)) + 1):
        some = q >= j
        base = (h[some] & np.uint64(SEGMENTS - 1)) * np.uint64(bits)
        for p in positions(h[some], j, kind[some], bits):
            data[base + p] = 1
    return bits, np.packbits(data, bitorder="little").tobytes()


class Model:
    """The staged filters of all parts, their size, totals, and the most frequent tokens (HEAD at most)."""

    def __init__(self, filters: DataFrame, size: int, parts: int, n: int, v: int, head: np.ndarray, head_counts: np.ndarray):
        self.filters, self.size, self.parts, self.n, self.v, self.head, self.head_counts = filters, size, parts, n, v, head, head_counts


def train(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model of docs(text) and the staged counts of all its tokens (token, c)."""
    counts = stage(word_counts(docs), "counts")
    words = counts.where("token is not null")
    n, v = (x or 0 for x in words.agg(F.sum("c"), F.count("*")).first())
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 1 << max(0, -(-size // PART_BYTES) - 1).bit_length()

    def pair_filters(key, group: pd.DataFrame) -> pd.DataFrame:
        h, at = np.unique(np.concatenate([unpack(b) for b in group["h"]]), return_inverse=True)
        c = np.bincount(at, np.concatenate([np.frombuffer(b, np.uint32) for b in group["c"]]))
        bits, data = make_filter(h, np.full(len(h), PAIRS), levels_of(c))
        # what each context's pairs take, for the parts of the contexts
        ctx, at = np.unique(h >> PAIR_BITS, return_inverse=True)
        mass = np.bincount(at, c - DISCOUNT, len(ctx)) if len(ctx) else np.empty(0)
        order, cut = deal(ctx, parts)
        ctx, mass = ctx[order], mass[order]
        rows = [(int(key[0]), bits, data, None, None)]
        rows += [(i, None, None, pack(ctx[cut[i] : cut[i + 1]]), mass[cut[i] : cut[i + 1]].tobytes()) for i in range(parts) if cut[i] < cut[i + 1]]
        return pd.DataFrame(rows, columns=["part", "bits", "data", "ctx", "mass"]).astype({"bits": "Int32"})

    made = stage(pair_parts(docs, parts).groupBy("part").applyInPandas(pair_filters, "part int, bits int, data binary, ctx binary, mass binary"), "pairs")

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(context(h).astype(np.int64)), batch.column(1)], ["h", "c"])

    def word_filters(key, group: pd.DataFrame, masses: pd.DataFrame) -> pd.DataFrame:
        h, c, kind = group["h"].to_numpy().view(np.uint64), group["c"].to_numpy(), group["kind"].to_numpy().astype(np.uint64)
        is_word = kind == WORDS
        order = np.argsort(h[~is_word])
        ctx, total = h[~is_word][order], c[~is_word][order]
        taken = np.zeros(len(ctx))
        for x, m in zip(masses["ctx"], masses["mass"], strict=True):
            taken[np.searchsorted(ctx, unpack(x))] += np.frombuffer(m)
        left = np.maximum(1, total - taken)
        h, c = h[is_word], c[is_word]
        kinds = np.repeat(np.array([WORDS, CONTEXTS, LEFT]), [len(h), len(ctx), len(ctx)])
        bits, data = make_filter(np.concatenate([h, ctx, ctx]), kinds, levels_of(np.concatenate([c, total, left])))
        return pd.DataFrame({"part": [key[0]], "bits": [bits], "data": [data]})

    as_context = counts.where(F.col("token").isNull() | (F.col("h") != int(END.view(np.int64)))).select("h", "c")
    ctx = as_context.mapInArrow(contexts, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    kind = lambda k: F.lit(int(k)).alias("kind")
    entries = words.select(kind(WORDS), "h", "c").union(ctx.select(kind(CONTEXTS), "h", "c"))
    entries = entries.withColumn("part", F.shiftrightunsigned("h", 8).bitwiseAND(F.lit(parts - 1)).cast("int"))
    masses = made.where("ctx is not null").select("part", "ctx", "mass")
    other = entries.groupBy("part").cogroup(masses.groupBy("part")).applyInPandas(word_filters, "part int, bits int, data binary")
    pair_rows = made.where("data is not null").select("part", F.lit(True).alias("pairs"), "bits", "data")
    filters = stage(pair_rows.union(other.select("part", F.lit(False).alias("pairs"), "bits", "data")), "filters")
    unstage(made)
    filter_bytes = filters.agg(F.sum(F.octet_length("data"))).first()[0] or 0

    # the most frequent tokens, whole levels of them, HEAD at most
    often = words.withColumn("q", level(F.col("c")))
    word_levels = {r["q"]: r["n"] for r in often.groupBy("q").agg(F.count("*").alias("n")).collect()}
    low_head = next(q for q in range(1, 400) if sum(k for p, k in word_levels.items() if p >= q) <= HEAD)
    head = often.where(F.col("q") >= low_head).select("h", "c").collect()
    h = np.array([r["h"] for r in head], np.int64).view(np.uint64)
    order = np.argsort(h)
    return Model(filters, filter_bytes, parts, n, v, h[order], np.array([r["c"] for r in head], np.int64)[order]), counts


class Chunk:
    """Some texts as the distinct words, contexts and pairs, and for each token which ones."""

    def __init__(self, h: np.ndarray, sizes: np.ndarray):
        self.sizes = sizes
        first = np.cumsum(sizes) - sizes
        self.words, self.word = np.unique(h, return_inverse=True)
        self.contexts, at = np.unique(context(np.append(self.words, START)), return_inverse=True)
        self.before = at[np.concatenate(([-1], self.word[:-1]))]
        self.before[first] = at[-1]
        before = np.concatenate(([START], h[:-1]))
        before[first] = START
        self.pairs, self.pair = np.unique(pair(before, h), return_inverse=True)

    def scores(self, levels, space: float) -> np.ndarray:
        """For each text the sum of log10 P(token | token before it), all counts from levels(distinct n-grams, kind)."""
        counts = lambda u, kind: count_of(levels(u, kind).astype(np.int64))
        p = ((counts(self.words, WORDS) + 1) / space)[self.word]
        total = counts(self.contexts, CONTEXTS)
        left = np.minimum(counts(self.contexts, LEFT), total)
        n = np.maximum(counts(self.pairs, PAIRS) - DISCOUNT, 0)
        total, left, n = total[self.before], left[self.before], n[self.pair]
        known = (total > 0) & (left > 0)
        total = np.where(known, total, 1.0)
        p = np.where(known, np.minimum(1.0, np.minimum(n, total) / total + left / total * p), p)
        text = np.repeat(np.arange(len(self.sizes)), self.sizes)
        return np.bincount(text, np.log10(np.minimum(1.0, p)), len(self.sizes))


def unpacked_chunk(words: bytes, places: bytes, sizes: bytes) -> Chunk:
    at = np.frombuffer(places, np.uint8).reshape(4, -1).T.copy().view(np.int32).ravel()
    return Chunk(unpack(words)[at], np.frombuffer(sizes, np.int32))


def packed_chunk(h: np.ndarray, sizes: np.ndarray) -> tuple[bytes, bytes, bytes]:
    u, at = np.unique(h, return_inverse=True)
    return pack(u), at.astype(np.int32).view(np.uint8).reshape(-1, 4).T.tobytes(), sizes.astype(np.int32).tobytes()


def chunk_scores(chunks: DataFrame, model: Model) -> DataFrame:
    """(uid, score) for chunks(uid, words, places, sizes): log10 of P(token | token before it), summed up by text."""
    parts, space = model.parts, model.n + model.v + 1.0
    names = {int(k): x for k, x in ((PAIRS, "pairs"), (WORDS, "words"), (CONTEXTS, "totals"), (LEFT, "lefts"))}

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uid, *packed in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                c = unpacked_chunk(*packed)
                dealt = [(u, *deal(u, parts)) for u in (c.pairs, c.words, c.contexts)]
                # only parts that are asked for something: no more rows than n-grams, however many parts
                some = np.flatnonzero(sum(np.diff(at) for _, _, at in dealt)).tolist()
                asked = [[pack(u[order[at[i] : at[i + 1]]]) for i in some] for u, order, at in dealt]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([uid] * len(some), pa.int64()), *(pa.array(x, pa.binary()) for x in asked)], ["part", "uid", "pairs", "words", "contexts"])

    def answer(key, group: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
        held = {bool(p): LogBloom(int(b), np.frombuffer(d, np.uint8), TOP) for p, b, d in zip(filters["pairs"], filters["bits"], filters["data"], strict=True)}

        def levels(column: str, kind: np.uint64) -> list[bytes]:
            bloom = held.get(kind == PAIRS)
            asked = (unpack(b) for b in group[column])
            return [(bloom.levels(h, kind) if bloom else np.zeros(len(h), np.uint8)).tobytes() for h in asked]

        return pd.DataFrame({"uid": group["uid"], "part": group["part"], "pairs": levels("pairs", PAIRS), "words": levels("words", WORDS), "totals": levels("contexts", CONTEXTS), "lefts": levels("contexts", LEFT)})

    def told(key, chunk: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        c, answers = unpacked_chunk(*chunk[["words", "places", "sizes"]].iloc[0]), answers.sort_values("part")

        def levels(u: np.ndarray, kind: np.uint64) -> np.ndarray:
            q = np.empty(len(u), np.uint8)
            q[deal(u, parts)[0]] = np.frombuffer(b"".join(answers[names[int(kind)]]), np.uint8)
            return q

        return pd.DataFrame({"uid": key[0] + np.arange(len(c.sizes)), "score": c.scores(levels, space)})

    asked = chunks.mapInArrow(ask, "part int, uid long, pairs binary, words binary, contexts binary")
    answers = asked.groupBy("part").cogroup(model.filters.groupBy("part")).applyInPandas(answer, "uid long, part int, pairs binary, words binary, totals binary, lefts binary")
    return chunks.groupBy("uid").cogroup(answers.groupBy("uid")).applyInPandas(told, "uid long, score double")


class WholeFilter:
    """All parts of a filter, read by one worker."""

    def __init__(self, parts: int, rows: list[tuple]):
        self.parts = parts
        self.held = {(part, pairs): LogBloom(bits, np.frombuffer(data, np.uint8), TOP) for part, pairs, bits, data in rows}

    def levels(self, u: np.ndarray, kind: np.uint64) -> np.ndarray:
        order, at = deal(u, self.parts)
        out = np.zeros(len(u), np.uint8)
        for i in range(self.parts):
            bloom = self.held.get((i, bool(kind == PAIRS)))
            if bloom and at[i] < at[i + 1]:
                some = order[at[i] : at[i + 1]]
                out[some] = bloom.levels(u[some], kind)
        return out


SCORED = "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, sum double, score double, tail array<struct<token:binary,tf:int>>, words binary, places binary, sizes binary"


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for docs(doc_id, held_out, text)."""
    sc = docs.sparkSession.sparkContext
    held = sc.broadcast((model.head, model.head_counts))
    whole = None
    if model.size <= BROADCAST_BYTES:
        # some partitions at a time, so that the driver holds the filter once
        whole = sc.broadcast((model.parts, [(r.part, r.pairs, r.bits, r.data) for r in model.filters.toLocalIterator()]))
    space = model.n + model.v + 1.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (head, head_counts), uid = held.value, TaskContext.get().partitionId() << 40
        names = ["uid", "doc_id", "held_out", "n_tokens", "n_known", "sum", "score", "tail", "words", "places", "sizes"]
        tail_type = pa.list_(pa.struct([("token", pa.binary()), ("tf", pa.int32())]))
        found = WholeFilter(*whole.value) if whole else None
        kept, rows, size = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal uid
            h, sizes = (np.concatenate([x[k] for x in kept]) for k in (0, 1))
            scores = pa.array(Chunk(h, sizes).scores(found.levels, space)) if found else pa.nulls(len(sizes), pa.float64())
            n = len(sizes)
            columns = [pa.concat_arrays([r[k] for r in rows]) for k in range(6)]
            yield pa.RecordBatch.from_arrays([pa.array(uid + np.arange(n)), *columns[:5], scores, columns[5], *(pa.nulls(n, pa.binary()) for _ in range(3))], names)
            if not found:
                nothing = [pa.nulls(1, t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), tail_type)]
                yield pa.RecordBatch.from_arrays([pa.array([uid]), *nothing, *(pa.array([x], pa.binary()) for x in packed_chunk(h, sizes))], names)
            uid += n

        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                t = Tokens(part.column(2))
                h, n = t.h, len(t.sizes)
                doc = np.repeat(np.arange(n), t.sizes)
                at = np.minimum(np.searchsorted(head, h), max(0, len(head) - 1))
                in_head = head[at] == h if len(head) else np.zeros(len(h), bool)
                c = np.where(in_head, head_counts[at] if len(head) else 0, 0)
                out = np.flatnonzero(~in_head)
                # tokens outside the head, once for each text
                order = out[np.lexsort((h[out], doc[out]))]
                new = np.ones(len(order), bool)
                new[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
                begin = np.flatnonzero(new)
                tf = np.diff(np.append(begin, len(order)))
                rare = order[begin]
                ends = np.concatenate(([0], np.cumsum(np.bincount(doc[rare], minlength=n)))).astype(np.int32)
                items = pa.StructArray.from_arrays([t.bytes_of(rare).cast(pa.binary()), pa.array(tf.astype(np.int32))], ["token", "tf"])
                sums = lambda x: np.bincount(doc, x, minlength=n)
                rows.append([part.column(0), part.column(1), pa.array(t.sizes.astype(np.int64)), pa.array(sums(in_head).astype(np.int64)), pa.array(sums(np.log10(c + 1.0))), pa.ListArray.from_arrays(pa.array(ends), items).cast(tail_type)])
                kept.append((h, t.sizes))
                size += len(h)
                if size >= FLUSH:
                    yield from flush()
                    kept, rows, size = [], [], 0
        if kept:
            yield from flush()

    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", F.col("text").cast("binary").alias("text"))
    both = stage(asked.mapInArrow(run, SCORED), "scored")
    done = both.where("words is null").drop("words", "places", "sizes")
    rare = done.select("uid", F.explode("tail").alias("t")).select("uid", "t.token", "t.tf")
    more = rare.join(counts.where("token is not null").select("token", "c"), "token").groupBy("uid").agg(F.sum(F.col("tf") * F.log10(F.col("c") + 1)).alias("more"), F.sum("tf").alias("known"))
    out = done.drop("tail").join(more, "uid", "left")
    if not whole:
        out = out.drop("score").join(chunk_scores(both.where("words is not null").select("uid", "words", "places", "sizes"), model), "uid")
    log_space = float(np.log10(space))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(int(model.n)).cast("long").alias("train_tokens"),
        (F.col("sum") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * log_space).alias("base_score"), "score",
    )


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of those whose id's crc32 mod 7 is not 2."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", (~training_rows(F.col("doc_id"), 7, 2)).alias("held_out"))
    model, counts = train(docs.where("not held_out").select("text"))
    return score(docs, model, counts)


