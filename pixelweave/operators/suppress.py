"""Greedy box suppression without a task that holds a group.

Two boxes of one group conflict if they overlap by more than the limit. A box without a better one in conflict is kept; what it
conflicts with goes; so on with the rest, in rounds over the graph of conflicts, until no conflict is left. That is
what the greedy order gives, as a box's fate hangs on better ones alone.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelweave.operators.masks import iou, meeting_boxes, with_level
from pixelweave.operators.numbering import number_rows
from pixelweave.scratch import drop, stage

#: Conflicts below which the rest is settled at once, in one task: some 10 MB.
SMALL = 200_000
#: Boxes of the first batch, and how many times as many boxes are done after the next.
FIRST, FACTOR = 4096, 4


def _up(limit: float):
    """Levels on which a box looks for others: overlap bounds the ratio of sizes."""
    above = max(1, math.ceil(math.log2(1 / limit)))
    return lambda k: F.sequence(k, k + above)


def conflicts(boxes: DataFrame, group: str, limit: float, key: str = "box_id", score: str = "score") -> DataFrame:
    """(group, better, worse): pairs of boxes(group, key, score, x0, y0, x1, y1) whose overlap exceeds limit > 0.

    The better one has the higher score, of equals the smaller key. A box looks for others in cells of its own size and of a
    few sizes above.
    """
    b = with_level(boxes.select(group, key, score, "x0", "y0", "x1", "y1"))
    met = meeting_boxes(b, b, group, _up(limit)).where((F.col("b_k") < F.col("a_k")) | (F.col(f"a_{key}") < F.col(f"b_{key}"))).where(iou() > limit)
    first = (F.col(f"a_{score}") > F.col(f"b_{score}")) | ((F.col(f"a_{score}") == F.col(f"b_{score}")) & (F.col(f"a_{key}") < F.col(f"b_{key}")))
    a, z = F.col(f"a_{key}"), F.col(f"b_{key}")
    return met.select(group, F.when(first, a).otherwise(z).alias("better"), F.when(first, z).otherwise(a).alias("worse"))


def beaten(boxes: DataFrame, kept: DataFrame, group: str, limit: float, key: str = "box_id") -> DataFrame:
    """(group, key) of boxes that overlap by more than limit with one of kept; there are few such for any box, as kept ones don't overlap so."""
    b, k = (with_level(d.select(group, key, "x0", "y0", "x1", "y1")) for d in (boxes, kept))
    larger = meeting_boxes(k, b, group, _up(limit)).where(iou() > limit).select(group, F.col(f"b_{key}").alias(key))
    smaller = meeting_boxes(b, k, group, _up(limit)).where("b_k < a_k").where(iou() > limit).select(group, F.col(f"a_{key}").alias(key))
    return larger.union(smaller).distinct()


def settle(frames):
    """The keys that go, of all conflicts left of some groups."""
    df = pd.concat(list(frames), ignore_index=True)
    group = df.columns[0]
    pairs: dict = {}
    for g, a, z in df.itertuples(index=False):
        pairs.setdefault((g, z), []).append((g, a))
    fate: dict = {}
    for start in pairs:
        todo = [start]
        while todo:
            at = todo[-1]
            better = pairs.get(at, ())
            open_ = [p for p in better if p not in fate]
            if any(fate.get(p) for p in better):
                fate[at] = False
            elif not open_:
                fate[at] = True
            else:
                todo.append(open_[0])
                continue
            todo.pop()
    gone = [k for k, kept in fate.items() if not kept]
    yield pd.DataFrame({group: [g for g, _ in gone], "worse": [z for _, z in gone]})


def rounds(boxes: DataFrame, group: str, limit: float, key: str, score: str, small: int) -> list[DataFrame]:
    """Tables (group, key) of the boxes that go, by rounds over the graph of conflicts."""
    left = stage(conflicts(boxes, group, limit, key, score), "conflicts")
    gone = []
    while (n := left.count()) > small:
        best = left.select(group, F.col("better").alias("k")).distinct().join(left.select(group, F.col("worse").alias("k")).distinct(), [group, "k"], "left_anti")
        out = stage(left.join(best.withColumnRenamed("k", "better"), [group, "better"], "left_semi").select(group, "worse").distinct(), "gone")
        nxt = left.join(out, [group, "worse"], "left_anti").join(out.withColumnRenamed("worse", "better"), [group, "better"], "left_anti")
        nxt = stage(nxt.select(group, "better", "worse"), "conflicts")
        drop(left)
        left = nxt
        gone.append(out)
    if n:
        kind = lambda c: left.schema[c].dataType.simpleString()
        gone.append(left.repartition(1).mapInPandas(settle, f"`{group}` {kind(group)}, worse {kind('worse')}"))
    return [g.withColumnRenamed("worse", key) for g in gone]


def suppress(boxes: DataFrame, group: str = "image", limit: float = 0.7, key: str = "box_id", score: str = "score", small: int = SMALL, first: int = FIRST) -> DataFrame:
    """boxes that greedy suppression keeps: best score first, of equals the smaller key, each group by itself.

    A box may have any other columns; keys are unique within their group. Boxes without extent overlap with none and stay.
    Of equal boxes the best alone matters: what it meets, the others meet, and where it is kept they go. The rest is taken in
    batches, the best `first` boxes, then those up to FACTOR times as many, and so on; a batch loses what overlaps with
    boxes that are kept already, and is settled by itself. So dense places don't make all pairs of their boxes.
    """
    fields = [group, key, score, "x0", "y0", "x1", "y1"]
    solid = F.coalesce(F.expr("x1 > x0 AND y1 > y0") & F.col(group).isNotNull(), F.lit(False))
    some = boxes.where(solid).select(*fields)
    if limit < 1:
        place = [group, "x0", "y0", "x1", "y1"]
        some = some.groupBy(*place, score).agg(F.min(key).alias(key)).groupBy(*place).agg(F.max_by(F.struct(key, score), F.struct(score)).alias("b")).select(group, f"b.{key}", f"b.{score}", "x0", "y0", "x1", "y1")
    some = stage(some, "boxes")
    n = some.count()
    if n > first:
        numbered = number_rows(some, [F.desc(score), key], "at")
    done, size, kept = 0, first, None
    while done < n:
        batch = some if n <= first else numbered.where((F.col("at") > done) & (F.col("at") <= size)).drop("at")
        if kept is not None:
            batch = stage(batch.join(beaten(batch, kept, group, limit, key), [group, key], "left_anti"), "batch")
        gone = rounds(batch, group, limit, key, score, small)
        for g in gone[1:]:
            gone[0] = gone[0].union(g)
        stay = stage(batch.join(gone[0], [group, key], "left_anti") if gone else batch, "kept")
        kept = stay if kept is None else kept.union(stay)
        done, size = size, size * FACTOR
    if kept is None:
        return boxes.where(~solid)
    mark = "_".join(["kept", *boxes.columns])
    return boxes.join(kept.select(group, key, F.lit(True).alias(mark)), [group, key], "left").where(F.col(mark) | ~solid).select(*boxes.columns)
