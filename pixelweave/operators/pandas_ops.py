"""What columns cannot express, one tile, mask or image at a time: distance transforms, components, hulls, box suppression, opaque scorers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from pixelweave.operators.nearest import fill_nearest, nearest_index  # noqa: F401
from pixelweave.operators.regions import tile_runs


def _grid(df: pd.DataFrame, value: str, fill) -> tuple[np.ndarray, int, int]:
    r0, c0 = int(df["r"].min()), int(df["c"].min())
    g = np.full((int(df["r"].max()) - r0 + 1, int(df["c"].max()) - c0 + 1), fill, dtype=np.int64)
    g[df["r"] - r0, df["c"] - c0] = df[value]
    return g, r0, c0


def edt(m: DataFrame, key: str = "mask_id", on: str = "on_") -> DataFrame:
    """(key, r, c, d): distance of each set pixel to the nearest unset one of its grid (null if there is none)."""

    def run(df: pd.DataFrame) -> pd.DataFrame:
        g, r0, c0 = _grid(df, on, 0)
        d2, _ = nearest_index(g == 0)
        rr, cc = np.nonzero(g)
        d = np.sqrt(d2[rr, cc])
        return pd.DataFrame({key: df[key].iloc[0], "r": rr + r0, "c": cc + c0, "d": np.where(np.isinf(d), np.nan, d)})

    return m.groupBy(key).applyInPandas(run, f"{key} string, r int, c int, d double")


def label_components(g: np.ndarray) -> np.ndarray:
    """8-neighbour components of a boolean grid: 0 outside, else numbers from 1 by first cell in reading order."""
    out = np.zeros(g.shape, np.int64)
    rr, cc = np.nonzero(g)
    if len(rr):
        _, lo, hi, root = tile_runs(rr, cc)
        out[rr, cc] = np.repeat(np.unique(root, return_inverse=True)[1] + 1, hi - lo + 1)
    return out


def components(m: DataFrame, key: str = "mask_id", on: str = "on_") -> DataFrame:
    """(key, r, c, component, area) of the set pixels."""

    def run(df: pd.DataFrame) -> pd.DataFrame:
        g, r0, c0 = _grid(df, on, 0)
        lab = label_components(g != 0)
        rr, cc = np.nonzero(lab)
        area = np.bincount(lab.ravel())
        return pd.DataFrame({key: df[key].iloc[0], "r": rr + r0, "c": cc + c0, "component": lab[rr, cc], "area": area[lab[rr, cc]]})

    return m.groupBy(key).applyInPandas(run, f"{key} string, r int, c int, component int, area long")


def remove_small(m: DataFrame, min_area: int, mode: str = "islands", key: str = "mask_id", on: str = "on_") -> DataFrame:
    """(key, r, c, on): mask without islands (or holes) below min_area; the largest island stays where all are small."""

    def run(df: pd.DataFrame) -> pd.DataFrame:
        g, r0, c0 = _grid(df, on, 0)
        work = (g != 0) ^ (mode == "holes")
        lab = label_components(work)
        area = np.bincount(lab.ravel(), minlength=1)
        small = [i for i in range(1, len(area)) if area[i] < min_area]
        if small:
            if mode == "holes":
                g = np.where(np.isin(lab, small), 1, g)
            else:
                keep = [i for i in range(1, len(area)) if i not in set(small)] or [int(np.argmax(area[1:])) + 1]
                g = np.isin(lab, keep).astype(int)
        return pd.DataFrame({key: df[key].iloc[0], "r": df["r"], "c": df["c"], on: (g != 0).astype(int)[df["r"] - r0, df["c"] - c0]})

    return m.groupBy(key).applyInPandas(run, f"{key} string, r int, c int, {on} int")


def convex_hull(points: DataFrame, key: str, x: str = "x", y: str = "y") -> DataFrame:
    """(key, seq, x, y): hull vertices anticlockwise from the lowest, leftmost; collinear points left out."""

    def run(df: pd.DataFrame) -> pd.DataFrame:
        pts = sorted(set(zip(df[x].tolist(), df[y].tolist(), strict=True)))

        def half(seq):
            out = []
            for p in seq:
                while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                    out.pop()
                out.append(p)
            return out[:-1]

        hull = pts if len(pts) < 3 else half(pts) + half(reversed(pts))
        return pd.DataFrame({key: df[key].iloc[0], "seq": range(len(hull)), "x": [p[0] for p in hull], "y": [p[1] for p in hull]})

    return points.groupBy(key).applyInPandas(run, f"{key} string, seq int, x double, y double")


def nms(boxes: DataFrame, group: str, iou: float = 0.7, key: str = "box_id") -> DataFrame:
    """(group, key) of boxes kept by greedy suppression: best score first, of equals the smaller key."""

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["score", key], ascending=[False, True])
        b = df[["x0", "y0", "x1", "y1"]].to_numpy(float)
        area, left, keep = (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1]), np.ones(len(b), bool), []
        for i in range(len(b)):
            if not left[i]:
                continue
            keep.append(i)
            w = np.maximum(0, np.minimum(b[i, 2], b[:, 2]) - np.maximum(b[i, 0], b[:, 0]))
            h = np.maximum(0, np.minimum(b[i, 3], b[:, 3]) - np.maximum(b[i, 1], b[:, 1]))
            inter = w * h
            left &= inter <= iou * (area[i] + area - inter)
            left[i] = False
        return pd.DataFrame({group: df[group].iloc[0], key: df[key].to_numpy()[keep]})

    return boxes.groupBy(group).applyInPandas(run, f"{group} string, {key} long")


def score_tiles(tiles: DataFrame, scorer: Callable[[pd.DataFrame], pd.Series], schema: str) -> DataFrame:
    """tiles with `cls` from an opaque scorer over batches of rows: the place where a model goes."""

    def run(frames):
        for df in frames:
            yield df.assign(cls=scorer(df))

    return tiles.mapInPandas(run, schema)
