"""Operator 6: mixing sources to target weights by Sainte-Laguë apportionment.

All words of all documents are the amount to hand out. Each source gets a target from its weight; words go to
the sources by highest quotient (target over 1, 3, 5, ...), then each source's words to its shards in the same
way by their sizes, so every shard has an integer quota and those of a source add up to the source's. A shard's
documents stand in a seeded order: the quota takes all words as often as it goes and the first ones once more.
Only sizes by source and shard reach the driver; documents are never gathered, and a source of any share of the
rows is many shards.

Defined results: a null text has size 0 and is taken 0 times; the null source is a source of its own, last in
order; repeated rows stand at places of their own; an empty table gives no rows; a source of no words has
target 0; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelweave.llm.common import WORD, read_table, stage

#: Weights stand for a list of sources, which the driver holds; more than this is an error, not a cut.
MAX_SOURCES = 1_000_000


def targets(sizes: list[int], weights: list[float], limit: float = 3.0) -> list[float]:
    """Shares of sum(sizes) by weight; what lies above limit * size is shared again among the others."""
    out, left = [0.0] * len(sizes), float(sum(sizes))
    free = [i for i, s in enumerate(sizes) if s > 0]
    while free:
        each = left / sum(weights[i] for i in free)
        full = [i for i in free if each * weights[i] > limit * sizes[i]]
        if not full:
            for i in free:
                out[i] = each * weights[i]
            break
        for i in full:
            out[i] = float(limit * sizes[i])
            left -= out[i]
        free = [i for i in free if i not in set(full)]
    return out


def sainte_lague(votes: list[float], seats: int, most: list[int] | None = None) -> list[int]:
    """Seats by highest quotients votes/(2k+1), the first of equals first; none above `most`.

    Starts at the rounded shares, which balance the quotients, and moves single seats from there.
    """
    n = len(votes)
    most = most or [seats] * n
    seats = min(seats, sum(m for v, m in zip(votes, most, strict=True) if v > 0))
    total = float(sum(votes))
    if not n or total <= 0 or seats <= 0:
        return [0] * n
    share = total / seats
    got = [min(m, math.floor(v / share + 0.5)) for v, m in zip(votes, most, strict=True)]
    more = seats - sum(got)
    if more > 0:
        heap = [(-v / (2 * g + 1), i) for i, (v, g, m) in enumerate(zip(votes, got, most, strict=True)) if v > 0 and g < m]
        heapq.heapify(heap)
        for _ in range(more):
            _, i = heapq.heappop(heap)
            got[i] += 1
            if got[i] < most[i]:
                heapq.heappush(heap, (-votes[i] / (2 * got[i] + 1), i))
    elif more < 0:
        heap = [(votes[i] / (2 * got[i] - 1), -i) for i in range(n) if got[i]]
        heapq.heapify(heap)
        for _ in range(-more):
            _, i = heapq.heappop(heap)
            got[-i] -= 1
            if got[-i]:
                heapq.heappush(heap, (votes[-i] / (2 * got[-i] - 1), i))
    return got


def row_key(doc_id: str, text: str, seed: int = 17) -> F.Column:
    """The seeded hash that orders documents within a shard."""
    return F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text))


def mix_sources(
    docs: DataFrame, weights: tuple = (5, 2, 1), seed: int = 17, limit: int = 3, shard_words: int = 500_000, max_shards: int = 16_384, source: str = "source"
) -> DataFrame:
    """(doc_id, key, size, source_size, target, taken, copies): how much of each document the mix takes.

    taken counts words, and cuts the one document of a shard that the quota ends in; copies takes whole
    documents, the one that the quota ends in among them. key is a hash of the document's id and text.
    Sources in code-point order, null last, have the weights in turn.
    """
    spark = docs.sparkSession
    name = F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("null"))
    rows = docs.select(
        "doc_id",
        name.alias("name"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        row_key("doc_id", "text", seed).alias("key"),
    )
    rows = stage(rows, "mix")
    sums = rows.groupBy("name").agg(F.sum("size").alias("size")).limit(MAX_SOURCES + 1).collect()
    if len(sums) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sums = sorted(sums, key=lambda r: (r.name == "null", r.name))
    sizes = [r["size"] for r in sums]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(sums))], limit)
    plan = [(r.name, i, r["size"], goal[i], max(1, min(max_shards, math.ceil(r["size"] / shard_words)))) for i, r in enumerate(sums)]
    table = spark.createDataFrame(plan, "name string, source_no int, source_size long, target double, shards long")
    placed = rows.join(table, "name").withColumn("shard", F.pmod(F.xxhash64("key"), "shards"))

    # at most max_shards rows a source, and one for each shard_words words
    counts = sorted(tuple(r) for r in placed.groupBy("source_no", "shard").agg(F.sum("size").alias("size")).collect())
    quotas = sainte_lague(goal, sum(sizes), [limit * n for n in sizes])
    out, at = [], 0
    for i in range(len(plan)):
        mine = []
        while at < len(counts) and counts[at][0] == i:
            mine.append(counts[at])
            at += 1
        shares = [c[2] for c in mine]
        for (_, shard, size), q in zip(mine, sainte_lague(shares, quotas[i], [limit * n for n in shares]), strict=True):
            times, edge = divmod(q, size) if size else (0, 0)
            out.append((i, shard, q, times, edge))
    quota = spark.createDataFrame(out, "source_no int, shard long, quota long, times long, edge long")

    order = Window.partitionBy("source_no", "shard").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("end", F.sum("size").over(order)).join(quota, ["source_no", "shard"])
    start = F.col("end") - F.col("size")
    once_more = F.greatest(F.lit(0), F.least(F.col("size"), F.col("edge") - start))
    return placed.select(
        "doc_id",
        "key",
        "size",
        "source_size",
        "target",
        (F.col("times") * F.col("size") + once_more).cast("long").alias("taken"),
        (F.col("times") + (start < F.col("edge")).cast("long")).alias("copies"),
        "shard",
    )


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents."""
    return mix_sources(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


