"""Nearest labelled pixels of rasters of any size, exact, in two shuffles and linear time.

A labelled pixel is the nearest of its column for an interval of rows, which its neighbours in the column bound. It
goes to each strip of rows that the interval meets, so that a strip knows, for each of its rows and each column, the
nearest label above or below, from however far. Along a row these are parabolas of one width, whose lower envelope
gives the nearest label of every pixel. No task holds more than a strip; tile borders play no part.

Of labels at equal distances that of the smallest row, then column, is taken.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a strip.
STRIP = 64
NONE = -(1 << 62)


def lower_envelope(xs: np.ndarray, gap: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Envelopes of the parabolas (x - xs[j])^2 + gap[i, j]^2 for each row i; a negative gap is no parabola.

    Gives stack (numbers j, left to right), start (the first integer x where each is the lowest) and the last place
    used of each row, -1 for none. Of equal values the smaller row[i, j], then the smaller j, counts as lower; the
    difference of two parabolas is linear, so that their order changes once, at a place found in whole numbers.
    """
    n, m = gap.shape
    stack, start, top = np.zeros((n, max(m, 1)), np.int64), np.full((n, max(m, 1)), NONE), np.full(n, -1)
    for j in range(m):
        todo = np.flatnonzero(gap[:, j] >= 0)
        while len(todo):
            first = top[todo] < 0
            new, begin = todo[first], np.full(first.sum(), NONE)
            rest = todo[~first]
            p = stack[rest, top[rest]]
            num = xs[j] ** 2 + gap[rest, j] ** 2 - xs[p] ** 2 - gap[rest, p] ** 2
            den = 2 * (xs[j] - xs[p])
            s = num // den + 1 - ((num % den == 0) & (row[rest, j] < row[rest, p]))
            gone = s <= start[rest, top[rest]]
            put, at = np.concatenate([new, rest[~gone]]), np.concatenate([begin, s[~gone]])
            top[put] += 1
            stack[put, top[put]], start[put, top[put]] = j, at
            todo = rest[gone]
            top[todo] -= 1
    return stack, start, top


def nearest_columns(xs: np.ndarray, gap: np.ndarray, row: np.ndarray, at_row: np.ndarray, at_x: np.ndarray) -> np.ndarray:
    """For points (at_row, at_x) the number of the lowest parabola of their row; -1 for none."""
    stack, start, top = lower_envelope(xs, gap, row)
    out = np.full(len(at_row), -1, np.int64)
    order = np.argsort(at_row, kind="stable")
    cuts = np.searchsorted(at_row[order], np.arange(len(gap) + 1))
    for i in range(len(gap)):
        some = order[cuts[i] : cuts[i + 1]]
        if len(some) and top[i] >= 0:
            out[some] = stack[i, np.searchsorted(start[i, : top[i] + 1], at_x[some], "right") - 1]
    return out


def nearest_index(on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each cell of one grid the squared distance to the nearest set cell and that cell's flat index, (inf, -1) for none."""
    h, w = on.shape
    rows = np.arange(h)[:, None]
    up = np.maximum.accumulate(np.where(on, rows, -(10**9)), axis=0)
    down = np.minimum.accumulate(np.where(on, rows, 10**9)[::-1], axis=0)[::-1]
    pick = np.where(rows - up <= down - rows, up, down)
    gap = np.abs(pick - rows)
    gap[gap >= 10**8] = -1
    rr, cc = (x.ravel() for x in np.indices(on.shape))
    j = nearest_columns(np.arange(w), gap, pick, rr, cc)
    d2 = np.where(j >= 0, (cc - j) ** 2 + gap[rr, j] ** 2, np.inf).astype(float)
    return d2.reshape(h, w), np.where(j >= 0, pick[rr, j] * w + j, -1).reshape(h, w)


def nearest(targets: DataFrame, sources: DataFrame, key: str = "tile", values: tuple = ()) -> DataFrame:
    """(key, r, c, source_r, source_c, d2, values) of targets(key, r, c): the nearest of sources(key, r, c, values) with the same key.

    Sources are distinct pixels without nulls in r and c. Targets of a key without sources get nulls.
    """
    kind = {f.name: f.dataType.simpleString() for f in sources.schema.fields}
    ends = targets.groupBy(key).agg(F.floor(F.min("r") / STRIP).alias("s0"), F.floor(F.max("r") / STRIP).alias("s1"))
    w = Window.partitionBy(key, "c").orderBy("r")
    r = F.col("r").cast("long")
    span = sources.select(key, r.alias("r"), F.col("c").cast("long").alias("c"), *values).withColumn("before", F.lag("r").over(w)).withColumn("after", F.lead("r").over(w))
    # halfway between two of a column belongs to the upper
    span = span.withColumn("lo", F.floor((F.col("before") + F.col("r")) / 2) + 1).withColumn("hi", F.floor((F.col("r") + F.col("after")) / 2))
    strips = span.join(ends, key)
    first, last = F.greatest("s0", F.coalesce(F.floor(F.col("lo") / STRIP), "s0")), F.least("s1", F.coalesce(F.floor(F.col("hi") / STRIP), "s1"))
    dealt = strips.where(first <= last).withColumn("strip", F.explode(F.sequence(first, last))).select(key, "strip", "r", "c", "lo", "hi", *values)
    here = targets.select(key, F.floor(F.col("r") / STRIP).alias("strip"), "r", "c")

    def run(t: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        out = t[[key, "r", "c"]].assign(source_r=pd.NA, source_c=pd.NA, d2=pd.NA, **dict.fromkeys(values))
        if not len(t) or not len(s):
            return out
        xs, col = np.unique(s["c"].to_numpy(np.int64), return_inverse=True)
        rows, row_of = np.unique(t["r"].to_numpy(np.int64), return_inverse=True)
        lo = np.searchsorted(rows, s["lo"].fillna(NONE).to_numpy(np.int64))
        hi = np.searchsorted(rows, s["hi"].fillna(-NONE).to_numpy(np.int64), "right")
        size = np.maximum(hi - lo, 0)
        which = np.repeat(np.arange(len(s)), size)
        line = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + lo[which]
        own = np.full((len(rows), len(xs)), -1, np.int64)
        own[line, col[which]] = which
        source = s["r"].to_numpy(np.int64)[own]
        gap = np.where(own >= 0, np.abs(source - rows[:, None]), -1)
        x = t["c"].to_numpy(np.int64)
        j = nearest_columns(xs, gap, source, row_of, x)
        at = own[row_of, j]
        out["source_r"], out["source_c"] = source[row_of, j], xs[j]
        out["d2"] = (x - xs[j]) ** 2 + gap[row_of, j] ** 2
        for v in values:
            out[v] = s[v].to_numpy()[at]
        return out

    schema = ", ".join([f"`{key}` {targets.schema[key].dataType.simpleString()}", f"r {targets.schema['r'].dataType.simpleString()}", f"c {targets.schema['c'].dataType.simpleString()}", "source_r long, source_c long, d2 long", *[f"`{v}` {kind[v]}" for v in values]])
    dealt = dealt.toDF(*[f"source_{c}" if c in (key, "strip") else c for c in dealt.columns])  # the sides may come from one table
    return here.groupBy(key, "strip").cogroup(dealt.groupBy(f"source_{key}", "source_strip")).applyInPandas(run, schema)


def fill_nearest(px: DataFrame, key: str = "tile", cls: str = "cls") -> DataFrame:
    """(key, r, c, cls): unlabelled pixels (null) take the class of the nearest labelled one of their key, however far; null where there is none."""
    known = px.where(F.col(cls).isNotNull()).select(key, "r", "c", cls)
    open_ = px.where(F.col(cls).isNull()).select(key, "r", "c")
    return known.union(nearest(open_, known, key, (cls,)).select(key, "r", "c", cls))
