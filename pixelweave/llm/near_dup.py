"""Operator 8: near-duplicate texts by one-permutation MinHash, banded buckets and stars.

Texts with equal shingle sets are one class. Each class has a signature of 512 values: its shingle hashes are
split into bins once, each bin keeps its least hash, and empty bins copy a full one by optimal densification.
Sets too small for 512 bins use fewer bins and more passes, each a permutation of its own, so that about four
hashes fall into a bin; sets of sizes that could be similar always share a layout. Bands of eight values are
buckets: a pair at similarity 0.85 shares none of the 64 once in 7 * 10^8 times, at 0.8 once in 10^5.

A bucket links nothing by itself. Its heaviest member (the one in the fullest buckets) is the centre of a
star, and only star edges become candidates, so candidates grow with bucket entries and not with their square.
What the signatures allow is measured on full sets: a member near its centre links with it or is kept with its
difference from the centre's set. As Jaccard distance is a metric, all partners of a member near the centre are
near it too, so stars settle them: members of a star that are in different components are compared in blocks,
exactly, by their differences. What is in no star of its bucket meets the rest of the bucket in blocks, but for what is close
to the centre: signatures tell which members may have a link there at all, and these are compared on full sets, block by
block. Blocks give forests of links, so that what is written grows with members and not with pairs. Signatures speak against a pair if
they fall short by eight standard errors (against a star's member by five), once in 10^14 (10^6) pairs.
The work is linear in bucket entries but for blocks of one star or bucket, whose pairs grow with the square
of the number of blocks of mutually distant texts; no pair of a bucket is left out.

Defined results: null texts and texts without words have an empty set and link with nothing; with fewer words
than a shingle the whole sequence is the one shingle; repeated rows are documents each, so rows of one doc_id
with equal text share their component and each says kept; documents without doc_id are linked like others; their
component is null where all of it are without; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.llm.common import ODD, components, mix64, read_table, shingle_sets, stage, unstage, worker_state

BINS = 512
ROWS = 8
#: Hashes wanted in a bin.
FILL = 4
#: Standard errors by which signatures may fall short of a limit, of links and of a star's members.
ERRORS, STAR_ERRORS = 8.0, 5.0
#: How far below the limit the similarity of a star's members to its centre may be. Members no further than this from it are settled by the star.
REACH = 0.2
#: Members in a block, and blocks by distance from the centre.
BLOCK = 128
BLOCK_BYTES = 64 << 20
RING = 0.05
#: A bucket's members that are in the star of its centre, and those that aren't.
INNER, OUTER = 0, 1
#: Rows of (hash, hash) that are broadcast at most: 24 MB. Above it they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
NONE = np.uint64((1 << 64) - 1)
#: Equal halves of two bytes by their exclusive or.
EQUAL_HALVES = np.array([(x < 16) + (x % 16 == 0) for x in range(256)], np.uint8)


def probe_table(bins: int, seed: int = 3) -> np.ndarray:
    """For each bin a seeded order in which an empty one tries the others."""
    rng = np.random.default_rng(seed)
    return np.array([rng.permutation(bins) for _ in range(bins)])


PROBES = [probe_table(1 << p) for p in range(BINS.bit_length())]


def layouts(n: int, num: int, den: int) -> list[int]:
    """Bins in a pass, as powers of two, for all sizes of sets that can be similar to a set of n."""
    top = BINS.bit_length() - 1
    power = lambda size: min(top, max(0, int(max(1, size) // FILL).bit_length() - 1))
    return list(range(power(-(-n * num // den)), power(n * den // num) + 1))


def signatures(sets: list[np.ndarray], power: int) -> np.ndarray:
    """One-permutation MinHash of sets of 64-bit hashes, a row of BINS values each, empty bins filled by optimal densification."""
    bins, n = 1 << power, len(sets)
    h, row = np.concatenate(sets), np.repeat(np.arange(n) * bins, [len(s) for s in sets])
    out = np.empty((n, BINS), np.uint64)
    for p in range(BINS // bins):
        own = h if bins == BINS else mix64(h ^ np.uint64(0xA5A5 + 977 * p))
        sig = np.full(n * bins, NONE)
        np.minimum.at(sig, row + (own >> np.uint64(64 - power)).astype(np.intp) if power else row, own)
        sig = sig.reshape(n, bins)
        full = sig != NONE
        at, empty = np.nonzero(~full)
        if len(at):
            tries = PROBES[power][empty]
            sig[at, empty] = sig[at, tries[np.arange(len(at)), full[at[:, None], tries].argmax(axis=1)]]
        out[:, p * bins : (p + 1) * bins] = sig
    return out


def sketches(hashes: np.ndarray, num: int, den: int) -> tuple[np.ndarray, bytes]:
    """Bucket keys and low halves of bytes of the signatures of one shingle set."""
    keys, low = sketch_sets([hashes], num, den)
    return keys[0], low[0]


def sketch_sets(sets: list[np.ndarray], num: int, den: int) -> tuple[list[np.ndarray], list[bytes]]:
    """For each set its bucket keys, and the low halves of bytes of its signatures: a layout, then BINS / 2 bytes, for each layout."""
    keys: list[list] = [[] for _ in sets]
    low = [b""] * len(sets)
    by_layout: dict[int, list[int]] = {}
    for i, s in enumerate(sets):
        for power in layouts(len(s), num, den) if len(s) else ():
            by_layout.setdefault(power, []).append(i)
    for power, some in sorted(by_layout.items()):
        sig = signatures([sets[i] for i in some], power)
        bands = sig.reshape(len(some), -1, ROWS)
        h = np.broadcast_to(np.arange(BINS // ROWS, dtype=np.uint64) + np.uint64(1 + (power << 16)), bands.shape[:2])
        for j in range(ROWS):
            h = mix64(h * np.uint64(ODD) + bands[:, :, j])
        halves = (sig & np.uint64(15)).astype(np.uint8)
        packed = halves[:, ::2] << 4 | halves[:, 1::2]
        for k, i in enumerate(some):
            keys[i].append(h[k])
            low[i] += bytes([power]) + packed[k].tobytes()
    return [np.unique(np.concatenate(k)) if k else np.empty(0, np.uint64) for k in keys], low


def layout_of(low: bytes) -> dict[int, np.ndarray]:
    """The packed signatures by layout."""
    step = BINS // 2 + 1
    return {low[i]: np.frombuffer(low, np.uint8, step - 1, i + 1) for i in range(0, len(low), step)}


def estimated(same: np.ndarray) -> np.ndarray:
    """Similarity by the number of equal values, without those that are equal by chance."""
    return (same / BINS - 1 / 16) / (1 - 1 / 16)


def agreement(a: bytes, b: bytes) -> float:
    """Estimated similarity of two sets by the first layout that both have; 1 if they have none in common."""
    mine, other = layout_of(a), layout_of(b)
    for power in mine:
        if power in other:
            return float(estimated(EQUAL_HALVES[mine[power] ^ other[power]].sum()))
    return 1.0


def least_agreement(limit: float, errors: float) -> float:
    return limit - errors * (limit * (1 - limit) / BINS) ** 0.5 / (1 - 1 / 16)


def set_id(hashes: np.ndarray) -> int:
    """A hash of the whole set; of 10^9 different sets two share it once in 40 tables."""
    h = mix64(hashes)
    total = mix64(h.sum(dtype=np.uint64, keepdims=True) + np.uint64(len(h)))
    return int((total ^ np.bitwise_xor.reduce(h, keepdims=True)).view(np.int64)[0])


def text_key(doc_id: str, text: str) -> Column:
    """A hash of a document's id and text, by which results find their rows again."""
    return F.xxhash64(F.lit(8), F.col(doc_id).cast("long"), F.col(text).cast("binary"))


def text_sketches(docs: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    """(doc_id, text_key, n, node, keys, low) for docs(doc_id, text): node is a hash of the shingle set, null where it is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state(("near_dup",))
        for batch in batches:
            for lo in range(0, len(batch), 512):
                part = batch.slice(lo, 512)
                sets = shingle_sets(part.column(1), shingle)
                keys, low = sketch_sets(sets, num, den)
                ends = np.cumsum([0] + [len(k) for k in keys]).astype(np.int32)
                columns = [pa.array([len(s) for s in sets], pa.int64()), pa.array([set_id(s) if len(s) else None for s in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys).view(np.int64))), pa.array(low, pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *columns], ["doc_id", "text_key", "n", "node", "keys", "low"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), text_key("doc_id", "text").alias("text_key"))
    return rows.mapInArrow(run, "doc_id long, text_key long, n long, node long, keys array<long>, low binary")


def full_sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(node, hashes) for staged wanted(node, rep_key): the texts with these keys are read again. wanted is broadcast if it has few rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state(("near_dup",))
        for batch in batches:
            for lo in range(0, len(batch), 512):
                part = batch.slice(lo, 512)
                sets = shingle_sets(part.column(1), shingle)
                keep = [len(s) > 0 and set_id(s) == n for s, n in zip(sets, part.column(0).to_pylist(), strict=True)]  # keys may collide
                kept = [s.tobytes() for s, k in zip(sets, keep, strict=True) if k]
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(keep)), pa.array(kept, pa.binary())], ["node", "hashes"])

    rows = docs.select(text_key("doc_id", "text").alias("rep_key"), F.col("text").cast("binary").alias("text"))
    rows = rows.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted, "rep_key")
    # a row that is given several times has one key
    return rows.select("node", "text").mapInArrow(run, "node long, hashes binary").dropDuplicates(["node"])


def with_both(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """pairs(a, b) with the column of table(node, ...) for both ends, named like the end. Joins are by node; AQE splits those of hot nodes."""
    for end in ("b", "a"):
        pairs = pairs.join(table.select(F.col("node").alias(end), F.col(column).alias(f"{column}_{end}")), end)
    return pairs.select("a", "b", f"{column}_a", f"{column}_b")


def plausible(pairs: DataFrame, classes: DataFrame, num: float, den: float, errors: float = ERRORS) -> DataFrame:
    """Those of pairs(a, b) whose signatures don't speak against a similarity of num / den."""
    least = least_agreement(num / den, errors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [agreement(x, y) >= least for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    return with_both(pairs, classes, "low").mapInArrow(run, "a long, b long")


def common_size(a: np.ndarray, b: np.ndarray) -> int:
    """How many of the sorted distinct a are in b, likewise."""
    return len(np.intersect1d(a, b, assume_unique=True))


def similar(both, size_a, size_b, num: int, den: int):
    return den * both >= num * (size_a + size_b - both)


def measured(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b, n, distance, link, apart) for those of pairs(a, b) that are in a star of centre a: b's size and distance, and what is in one of the sets only."""
    least = num / den - REACH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, columns = [], ([], [], [], [])
            for i in range(len(batch)):
                a, b = (np.frombuffer(batch.column(k)[i].as_py(), np.uint64) for k in (2, 3))
                both = common_size(a, b)
                share = both / (len(a) + len(b) - both)
                keep.append(share >= least)
                if share >= least:
                    for column, x in zip(columns, (len(b), 1 - share, similar(both, len(a), len(b), num, den), np.setxor1d(a, b, assume_unique=True).tobytes()), strict=True):
                        column.append(x)
            ends = [c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]]
            yield pa.RecordBatch.from_arrays([*ends, *(pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.float64(), pa.bool_(), pa.binary()), strict=True))], ["a", "b", "n", "distance", "link", "apart"])

    return with_both(pairs, sets, "hashes").mapInArrow(run, "a long, b long, n long, distance double, link boolean, apart binary")


def forest(found: np.ndarray, comp: list[int]) -> Iterator[tuple[int, int]]:
    """Of found pairs of places those that join components not joined yet."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.get(x, x)) != x:
            x = y
        return x

    for i, j in found.tolist():
        a, b = root(comp[i]), root(comp[j])
        if a != b:
            up[max(a, b)] = min(a, b)
            yield i, j


def common_sizes(sets: list[np.ndarray]) -> np.ndarray:
    """For each two of the sets how many values they share; values are taken some at a time."""
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.cumsum(n > 1) - 1  # a value of one set is shared by none
    rows, at = rows[n[at] > 1], place[at[n[at] > 1]]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for lo in range(0, int(at.max(initial=-1)) + 1, 4096):
        some = (at >= lo) & (at < lo + 4096)
        has = np.zeros((len(sets), 4096), np.float32)
        has[rows[some], at[some] - lo] = 1
        out += has @ has.T
    return out.astype(np.int64)


def compare_stars(blocks: list[list[dict]], num: int, den: int) -> list[tuple[int, int]]:
    """Links (as a forest) between members(node, comp, n, apart) of one star that are in different components: within a block, or between two."""
    rows = [r for b in blocks for r in b]
    apart = [np.frombuffer(r["apart"], np.uint64) for r in rows]
    n, away = np.array([r["n"] for r in rows]), np.array([len(x) for x in apart])
    both = (n[:, None] + n - (away[:, None] + away - 2 * common_sizes(apart))) // 2
    comp = [r["comp"] for r in rows]
    _, kind = np.unique(comp, return_inverse=True)
    found = similar(both, n[:, None], n, num, den) & (kind[:, None] != kind)
    return [(rows[i]["node"], rows[j]["node"]) for i, j in forest(np.argwhere(np.triu(found, 1)), comp)]


def compare_signatures(blocks: list[list[dict]], num: int, den: int) -> list[tuple[int, int]]:
    """Members(node, comp, n, low) that signatures and sizes allow a link with one of another component, as (node, node): within a block, or between two."""
    least = least_agreement(num / den, ERRORS)
    first = blocks[0]
    rows = [r for b in blocks for r in b]
    n = np.array([r["n"] for r in rows])
    _, kind = np.unique([r["comp"] for r in rows], return_inverse=True)
    open_ = (kind[:, None] != kind) & (np.minimum(n[:, None], n) * den >= np.maximum(n[:, None], n) * num)
    if len(blocks) == 2:  # within a block it is done by itself
        open_[len(first) :, len(first) :] = False
        open_[: len(first), : len(first)] = False
    open_ = np.triu(open_, 1)
    found: set[int] = set()
    parsed = [layout_of(r["low"]) for r in rows]
    for power in sorted({p for x in parsed for p in x}):
        some = np.array([i for i, x in enumerate(parsed) if power in x])
        low = np.stack([parsed[i][power] for i in some])
        for k, i in enumerate(some):
            others = np.flatnonzero(open_[i, some])
            if len(others):
                open_[i, some[others]] = False  # one layout is enough
                good = others[estimated(EQUAL_HALVES[low[others] ^ low[k]].sum(axis=1, dtype=np.int64)) >= least]
                if len(good):
                    found.update((int(i), *some[good].tolist()))
    return [(rows[i]["node"], rows[i]["node"]) for i in found]


def compare_sets(blocks: list[list[dict]], num: int, den: int) -> list[tuple[int, int]]:
    """Links (as a forest) between members(node, comp, n, hashes) in different components: within a block, or between two."""
    rows = [r for b in blocks for r in b]
    n = np.array([r["n"] for r in rows])
    both = common_sizes([np.frombuffer(r["hashes"], np.uint64) for r in rows])
    comp = [r["comp"] for r in rows]
    _, kind = np.unique(comp, return_inverse=True)
    found = similar(both, n[:, None], n, num, den) & (kind[:, None] != kind)
    return [(rows[i]["node"], rows[j]["node"]) for i, j in forest(np.argwhere(np.triu(found, 1)), comp)]


def block_pairs(members: DataFrame, group: str, ring: Column, farthest: int, compare, num: int, den: int, settled: int | None = None) -> DataFrame:
    """compare() over the blocks of members(group, node, comp, n, data) of which some are in different components: (a, b).

    The members of a group are dealt by ring and hash to blocks of about BLOCK and BLOCK_BYTES, whatever the size of the
    group. Each block is compared with itself, and with others of its group no more than `farthest` rings off, but for
    two of the ring `settled`. The result is staged.
    """
    data = [c for c in members.columns if c not in (group, "node", "comp", "n", "distance", "ring")][0]
    open_ = members.groupBy(group).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select(group)
    rows = members.withColumn("ring", ring).join(open_, group, "left_semi")
    sizes = rows.groupBy(group, "ring").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.length(data)) / BLOCK_BYTES)).alias("parts"))
    dealt = rows.join(sizes, [group, "ring"]).withColumn("part", F.pmod(F.xxhash64("node"), "parts"))
    blocks = dealt.groupBy(group, "ring", "part").agg(F.collect_list(F.struct("node", "comp", "n", data)).alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    blocks = stage(blocks, "blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i in range(len(batch)):
                found += compare([c[i].as_py() for c in batch.columns], num, den)
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    here = F.lit(True) if settled is None else F.col("ring") != settled
    alone = blocks.where("lo <> hi").where(here).select("m").mapInArrow(run, "a long, b long")
    light = blocks.select(group, "ring", "part", "lo", "hi")
    other = light.select(group, *[F.col(c).alias(f"{c}2") for c in ("ring", "part", "lo", "hi")])
    later = (F.struct("ring", "part") < F.struct(F.col("ring2").alias("ring"), F.col("part2").alias("part"))) & (F.col("ring2") - F.col("ring") <= farthest)
    if settled is not None:
        later &= (F.col("ring") != settled) | (F.col("ring2") != settled)
    pairs = light.join(other, group).where(later & (F.least("lo", "lo2") < F.greatest("hi", "hi2"))).select(group, "ring", "part", "ring2", "part2")
    both = pairs.join(blocks.select(group, "ring", "part", "m"), [group, "ring", "part"])
    both = both.join(blocks.select(group, F.col("ring").alias("ring2"), F.col("part").alias("part2"), F.col("m").alias("m2")), [group, "ring2", "part2"])
    out = stage(alone.union(both.select("m", "m2").mapInArrow(run, "a long, b long")).distinct(), "found")
    unstage(blocks)
    return out


def with_component(rows: DataFrame, comp: DataFrame | None) -> DataFrame:
    """rows(node, ...) with comp, the node itself where it has none."""
    if comp is None:
        return rows.withColumn("comp", F.col("node"))
    return rows.join(comp.select("node", F.col("component").alias("comp")), "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def some(df: DataFrame) -> bool:
    return bool(df.limit(1).count())


def link_classes(docs: DataFrame, classes: DataFrame, shingle: int, num: int, den: int) -> DataFrame | None:
    """(node, component) of all classes that link with another; None if none does."""
    limit = num / den
    entries = classes.select("node", "n", F.explode("keys").alias("key"))
    shared = entries.join(entries.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"), "key")
    shared = stage(shared.select("key", "node", "n", "members"), "shared")
    weighed = shared.join(shared.groupBy("node").agg(F.sum("members").alias("weight")), "node")
    centres = weighed.groupBy("key").agg(F.max(F.struct("weight", (-F.col("node")).alias("minus"), F.col("node").alias("centre"), F.col("n").alias("size"))).alias("c"))
    asks = shared.join(centres.select("key", "c.centre", "c.size"), "key").where("node <> centre")
    asks = stage(asks.select("key", "node", "n", "centre", "size"), "asks")
    unstage(shared)

    # stars: who is near the centre of a bucket
    fits = F.least("n", "size") >= F.greatest("n", "size") * (limit - REACH)
    pairs = asks.where(fits).select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    likely = stage(plausible(pairs, classes, limit - REACH, 1, STAR_ERRORS), "likely")
    wanted = likely.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = stage(classes.join(wanted, "node").select("node", "rep_key"), "wanted")
    sets = stage(full_sets(docs, wanted, shingle), "sets")
    star = stage(measured(likely, sets, num, den), "star")
    links = star.where("link").select("a", "b")
    comp = stage(components(None, links, "a", "b"), "components") if some(links) else None

    # within stars
    members = with_component(star.select(F.col("a").alias("centre"), F.col("b").alias("node"), "n", "distance", "apart"), comp)
    more = block_pairs(members, "centre", F.floor(F.col("distance") / RING), int((1 - limit) / RING) + 2, compare_stars, num, den)
    if some(more):
        links = links.union(more)
        before, comp = comp, stage(components(None, links, "a", "b"), "components")
        unstage(*[c for c in (before,) if c])

    # with others than a star's members: those settle all links among them, and the nearer ones all links
    near = star.select(F.col("a").alias("centre"), F.col("b").alias("node"), (F.col("distance") <= REACH).alias("settled"), F.lit(INNER).alias("inside"))
    far = asks.join(near, ["centre", "node"], "left").where("settled IS NULL OR NOT settled")
    far = with_component(far.select("key", "node", "n", F.coalesce("inside", F.lit(OUTER)).alias("ring")), comp)
    open_ = far.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("ring").alias("most")).where(f"lo <> hi AND most = {OUTER}").select("key")
    far = stage(far.join(open_, "key", "left_semi"), "far")
    ring = F.col("ring")
    drawn = far.join(classes.select("node", "low"), "node").select("key", "node", "comp", "n", "ring", "low")
    likely_far = block_pairs(drawn, "key", ring, OUTER - INNER, compare_signatures, num, den, INNER)
    staged = [asks, likely, wanted, sets, star, more, far, likely_far]
    if some(likely_far):
        named = likely_far.select(F.col("a").alias("node")).distinct()
        new = stage(classes.join(named.join(wanted.select("node"), "node", "left_anti"), "node").select("node", "rep_key"), "wanted")
        fresh = stage(full_sets(docs, new, shingle), "sets")
        whole = far.join(named, "node").join(sets.union(fresh), "node").select("key", "node", "comp", "n", "ring", "hashes")
        found = block_pairs(whole, "key", ring, OUTER - INNER, compare_sets, num, den, INNER)
        if some(found):
            before, comp = comp, stage(components(None, links.union(found), "a", "b"), "components")
            staged += [c for c in (before,) if c]
        staged += [new, fresh, found]
    unstage(*staged)
    return comp


def near_duplicates(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_key, group) for docs(doc_id, text), linked at similarity num/den of shingle sets. group names a component even where it has no id."""
    made = stage(text_sketches(docs, shingle, num, den), "sketches")
    first = [F.first(c).alias(c) for c in ("n", "low", "keys")]
    classes = stage(made.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.min("text_key").alias("rep_key"), *first), "classes")
    rows = stage(made.select("doc_id", "n", "node", "text_key"), "rows")
    unstage(made)
    comp = link_classes(docs, classes, shingle, num, den)
    named = with_component(classes.select("node", "rep"), comp)
    least = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    out = rows.join(named.join(least, "comp").select("node", "component_id", F.col("comp").alias("group")), "node", "left")
    comp_id = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), comp_id.alias("component_id"), (F.col("doc_id") == comp_id).alias("kept"), "text_key", F.coalesce("group", "text_key").alias("group"))


def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents: three-word shingles, similarity at least 0.85."""
    return near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"), 3, 85, 100).drop("text_key", "group")
