"""Equi-joins of few bytes and many rows: keys that have many rows on both sides, or few keys in all.

The planner sizes a join by its inputs' bytes. Where rows multiply, that gives one task a whole key, or broadcasts what is large by then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts that the rows of a key are dealt to.
SPREAD = 32
#: For a join in runs: rows of the larger side that are put together, rows of the smaller one in a run, and rows of a key, about, in a list to be cut into runs.
LIST, RUN, BLOCK = 64, 256, 65536
#: It has a task for so many rows of the smaller side if that is more tasks than set, up to so many.
ROWS_A_TASK, TASKS = 1000, 1000


def spread_join(many: DataFrame, few: DataFrame, on: list[str], spread: int = SPREAD) -> DataFrame:
    """many joined to few: a key's rows of `many` are dealt to `spread` parts by a hash of the row, those of `few` go to each.

    A task holds the rows of `few` that it was dealt; nothing is broadcast, and there are as many tasks as
    spark.sql.shuffle.partitions says, however few bytes there are.
    """
    part = "_".join(["part", *many.columns, *few.columns])
    parts = int(many.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = many.withColumn(part, F.pmod(F.xxhash64(*many.columns), F.lit(spread)).cast("int")).repartition(parts, *on, part)
    copied = few.withColumn(part, F.explode(F.sequence(F.lit(0), F.lit(spread - 1)))).repartition(parts, *on, part)
    return dealt.join(copied.hint("shuffle_hash"), [*on, part]).drop(part)


def run_join(many: DataFrame, few: DataFrame, on: list[str], keep: list[str] | None = None, spread: int = SPREAD) -> DataFrame:
    """many joined to few, for results of many more rows than both: lists of LIST rows of a key meet runs of RUN rows.

    Lists are dealt to `spread` parts by a hash of the rows, runs go to each. Rows come out key by key, and a run whole
    for one row of a list after the other. So the columns of one side stay for a run and the others' repeat with it, of
    which dictionaries and compression in files leave next to nothing; in another order each row takes its bytes.
    keep: the columns to return, all if none; others don't travel. Equal rows of one key are put together in one task.
    """
    part, run, some = ("_".join([x, *many.columns, *few.columns]) for x in ("part", "run", "some"))
    rows = few.count()
    parts = max(int(many.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(rows // ROWS_A_TASK, TASKS))
    own = lambda df: [c for c in df.columns if c not in on and (keep is None or c in keep)]

    def lists(df: DataFrame, name: str, size: int, groups: int) -> DataFrame:
        for c in on:
            df = df.where(F.col(c).isNotNull())
        each = df.select(*on, F.pmod(F.xxhash64(*df.columns), F.lit(groups)).cast("int").alias(part), F.struct(*own(df) or on[:1]).alias(name))
        cut = F.transform(F.sequence(F.lit(1), F.size(name), F.lit(size)), lambda i: F.slice(name, i, F.lit(size)))
        return each.groupBy(*on, part).agg(F.collect_list(name).alias(name)).select(*on, part, F.explode(cut).alias(name))

    dealt = lists(many, some, LIST, 8 * spread).withColumn(part, F.col(part) % spread).repartition(parts, *on, part)
    copied = lists(few, run, RUN, max(1, -(-rows // BLOCK))).withColumn(part, F.explode(F.sequence(F.lit(0), F.lit(spread - 1)))).repartition(parts, *on, part)
    # coalesce leaves the partitions as they are, but ends the compiled step: else it would hold all rows that a list meets in its key
    met = dealt.join(copied.hint("merge"), [*on, part]).coalesce(parts)
    one = met.select(*on, run, F.inline(some).alias(*own(many) or [part]))
    out = one.select(*on, *own(many), F.inline(run).alias(*own(few) or [part])).drop(part)
    return out if keep is None else out.select(*keep)
