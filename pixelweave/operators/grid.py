"""Affine grids, tiles and the fan-out of pixels to tiles. No range joins: covering tiles are generated from a pixel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def step_of(tile: int, overlap: float) -> int:
    return max(1, int(tile * (1 - overlap)))


def _origins(size: Column, tile: int, step: int) -> Column:
    n = size.cast("long")
    return F.when(n >= tile, F.sequence(F.lit(0).cast("long"), F.greatest(n - tile, F.lit(0)), F.lit(step).cast("long"))).otherwise(F.array().cast("array<bigint>"))


def tile_grid(ortho: DataFrame, tile: int, overlap_x: float = 0.0, overlap_y: float = 0.0) -> DataFrame:
    """One row for each whole tile of ortho(width, height, ...): tile_x, tile_y. What is left at the right and bottom is not tiled."""
    xs, ys = _origins(F.col("width"), tile, step_of(tile, overlap_x)), _origins(F.col("height"), tile, step_of(tile, overlap_y))
    return ortho.withColumn("tile_x", F.explode(xs)).withColumn("tile_y", F.explode(ys))


def covering_origins(x: Column, tile: int, step: int, size: Column | int) -> Column:
    """Origins of the tiles that cover position x on an axis of `size`."""
    size = F.lit(size).cast("long") if isinstance(size, int) else size.cast("long")
    x = x.cast("long")
    last = F.floor((size - tile) / step).cast("long") * step
    lo = F.greatest(F.lit(0).cast("long"), F.ceil((x - tile + 1) / step).cast("long") * step)
    hi = F.least(F.floor(x / step).cast("long") * step, last)
    return F.when((size >= tile) & (lo <= hi), F.sequence(lo, F.greatest(lo, hi), F.lit(step).cast("long"))).otherwise(F.array().cast("array<bigint>"))


def cover_tiles(px: DataFrame, tile: int, step: int, width: int, height: int) -> DataFrame:
    """px(r, c, ...) once for each covering tile: tile_x, tile_y."""
    return px.withColumn("tile_x", F.explode(covering_origins(F.col("c"), tile, step, width))).withColumn("tile_y", F.explode(covering_origins(F.col("r"), tile, step, height)))


def pixel_to_world(r: Column, c: Column, gt: dict) -> tuple[Column, Column]:
    """World position of a pixel's centre under the affine a..f."""
    return gt["c"] + gt["a"] * (c + 0.5) + gt["b"] * (r + 0.5), gt["f"] + gt["d"] * (c + 0.5) + gt["e"] * (r + 0.5)


def world_to_pixel(x: Column, y: Column, gt: dict) -> tuple[Column, Column]:
    """(row, col) of a world position for an affine without rotation."""
    return F.floor((y - gt["f"]) / gt["e"]).cast("long"), F.floor((x - gt["c"]) / gt["a"]).cast("long")


def tile_bounds(x: Column, y: Column, tile: int, gt: dict) -> dict[str, Column]:
    """Box of a tile in the world."""
    xs = [gt["c"] + gt["a"] * v for v in (x, x + tile)]
    ys = [gt["f"] + gt["e"] * v for v in (y, y + tile)]
    return {"x0": F.least(*xs), "y0": F.least(*ys), "x1": F.greatest(*xs), "y1": F.greatest(*ys)}


def snap(position: Column, src: int, dst: int) -> Column:
    """Source index nearest to a target index when `src` cells are shown as `dst`."""
    return F.floor((position + 0.5) * src / dst).cast("int")


def label_cell(r: Column, c: Column, px_gt: dict, label_gt: dict) -> tuple[Column, Column]:
    """(row, col) in the label grid under the centre of a pixel, each grid with an affine of its own."""
    return world_to_pixel(*pixel_to_world(r, c, px_gt), label_gt)


def snap_labels(px: DataFrame, labels: DataFrame, px_gt: dict, label_gt: dict, keys: tuple = ("scene",)) -> DataFrame:
    """px(keys, r, c, ...) with cls of labels(keys, r, c, cls) under each pixel's centre; null off the label grid."""
    row, col = label_cell(F.col("r"), F.col("c"), px_gt, label_gt)
    under = labels.select(*keys, F.col("r").cast("long").alias("label_r"), F.col("c").cast("long").alias("label_c"), "cls")
    return px.withColumn("label_r", row).withColumn("label_c", col).join(under, [*keys, "label_r", "label_c"], "left").drop("label_r", "label_c")


def whole_tiles(labelled: DataFrame, keys: tuple) -> DataFrame:
    """The tiles of labelled(keys, cls, ...) where no pixel lacks a label or has label 0."""
    whole = labelled.groupBy(*keys).agg(F.bool_and(F.coalesce(F.col("cls") != 0, F.lit(False))).alias("ok")).where("ok").select(*keys)
    return labelled.join(whole, list(keys), "left_semi")


def strips(height: Column, width: Column, bands: int, budget: int) -> tuple[Column, Column]:
    """Rows of a strip under a pixel budget, and the number of strips."""
    rows = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / (width * bands)).cast("long"))
    return rows, F.ceil(height / rows).cast("long")


def filter_blank_tiles(px: DataFrame, keys: tuple = ("tile",), max_black: float = 5.0, max_white: float = 10.0) -> DataFrame:
    """Tiles of px(r, g, b) that are not too black or white: (keys, pixels, black_pct, white_pct)."""
    grey = (F.col("r") + F.col("g") + F.col("b")) / 3
    pct = lambda cond: F.sum(cond.cast("int")) * 100.0 / F.count("*")
    stats = px.groupBy(*keys).agg(F.count("*").alias("pixels"), pct(grey == 0).alias("black_pct"), pct(grey == 255).alias("white_pct"))
    return stats.where((F.col("black_pct") <= max_black) & (F.col("white_pct") <= max_white))


def upsample_labels(tile_px: DataFrame, labels: DataFrame, scale: int, keys: tuple, require_full: bool = True, label_keys: tuple = ()) -> DataFrame:
    """tile_px(keys, r, c in the fine grid) with cls of labels(label_keys, r, c, cls) under it; whole tiles only, if asked."""
    snapped = tile_px.withColumn("ar", F.floor(F.col("r") / scale).cast("int")).withColumn("ac", F.floor(F.col("c") / scale).cast("int"))
    got = snapped.join(labels.select(*label_keys, F.col("r").alias("ar"), F.col("c").alias("ac"), "cls"), [*label_keys, "ar", "ac"], "left").drop("ar", "ac")
    if not require_full:
        return got.where("cls is not null")
    whole = got.groupBy(*keys).agg(F.bool_and(F.coalesce(F.col("cls") != 0, F.lit(False))).alias("ok")).where("ok").select(*keys)
    return got.join(whole, list(keys), "left_semi")


def drop_out_of_range_tiles(label_px: DataFrame, lo: int, hi: int, keys: tuple) -> DataFrame:
    """label_px without the tiles that hold a class outside lo..hi."""
    bad = label_px.where(~F.col("cls").between(lo, hi) | F.col("cls").isNull()).select(*keys).distinct()
    return label_px.join(bad, list(keys), "left_anti")


def resize_bilinear(logits: DataFrame, classes: int, h: int, w: int, height: int, width: int, keys: tuple = ("scene",), value: str = "v") -> DataFrame:
    """(keys, r, c, values): logits(keys, r, c, cls 1..classes, value) of h x w pixels as array<double> by class at height x width.

    The centre of a target pixel falls between four source pixels, clamped to the border, which are weighted by nearness. Each
    source pixel sends its weighted classes to the targets around it, so that sums are partial before the one shuffle of targets.
    Missing logits are zero.
    """
    one = lambda k: F.coalesce(F.max(F.when(F.col("cls") == k, F.col(value).cast("double"))), F.lit(0.0))
    px = logits.groupBy(*keys, "r", "c").agg(F.array(*[one(k) for k in range(1, classes + 1)]).alias("v"))

    def targets(at: Column, src: int, dst: int) -> Column:
        """Targets of a source position with their weights."""
        scale = src / dst
        lo, hi = F.floor((at - 0.5) / scale - 0.5), F.ceil((at + 1.5) / scale - 0.5)
        span = F.sequence(F.greatest(lo, F.lit(0)), F.least(hi, F.lit(dst - 1)))

        def weight(t: Column) -> Column:
            place = F.greatest((t + 0.5) * scale - 0.5, F.lit(0.0))
            first = F.floor(place)
            share = place - first
            second = F.least(first + 1, F.lit(src - 1))
            return F.when(first == at, 1 - share).otherwise(0.0) + F.when(second == at, share).otherwise(0.0)

        return F.filter(F.transform(span, lambda t: F.struct(t.cast("int").alias("t"), weight(t).alias("w"))), lambda p: p["w"] > 0)

    sent = px.withColumn("tr", F.explode(targets(F.col("r"), h, height))).withColumn("tc", F.explode(targets(F.col("c"), w, width)))
    weighted = sent.select(*keys, F.col("tr.t").alias("r"), F.col("tc.t").alias("c"), F.transform("v", lambda x: x * (F.col("tr.w") * F.col("tc.w"))).alias("v"))
    sums = weighted.groupBy(*keys, "r", "c").agg(*[F.sum(F.col("v")[k]).alias(f"v{k}") for k in range(classes)])
    return sums.select(*keys, "r", "c", F.array(*[f"v{k}" for k in range(classes)]).alias("values"))


def label_of(values: Column) -> Column:
    """The class, from 1, of the largest value, the first of equals."""
    return F.array_position(values, F.array_max(values)).cast("int")


def mosaic_window(x0: Column, y1: Column, height: Column, width: Column, mosaic: dict) -> dict[str, Column]:
    """Where a tile, its upper left corner at (x0, y1), falls into a mosaic (left, top, a, e, height, width): offsets rounded to whole pixels.

    row, col and row_end, col_end in the mosaic; row_skip, col_skip: what of the tile lies before the mosaic's first row
    and column and is cut off. Nothing of the tile is inside where an end isn't beyond its beginning.
    """
    row, col = (F.floor((v - F.lit(float(start))) / F.lit(float(step)) + 0.5).cast("long") for v, start, step in ((y1, mosaic["top"], mosaic["e"]), (x0, mosaic["left"], mosaic["a"])))
    zero = F.lit(0).cast("long")
    out = {}
    for name, at, size, most in (("row", row, height, mosaic["height"]), ("col", col, width, mosaic["width"])):
        skip = F.greatest(zero, -at)
        first = F.greatest(zero, at)
        out |= {name: first, f"{name}_skip": skip, f"{name}_end": F.least(first + size.cast("long") - skip, F.lit(most).cast("long"))}
    return out


def decimate(px: DataFrame, factor: int, height: int, width: int, gt: dict, keys: tuple = ("scene",), value: str = "v", lo: float = 0.0, hi: float = 255.0) -> DataFrame:
    """(keys, r, c, value, x, y): px(keys, r, c, value) in blocks of `factor`, averaged and clipped, with each block's upper left corner in the world.

    The reduced raster has height // factor rows and width // factor columns, one at least; its affine is that of gt scaled by the true ratios,
    so that a remainder at the far side stretches the pixels a little and is averaged into the last block.
    """
    h, w = max(1, height // factor), max(1, width // factor)
    at = lambda c, n, size: F.least(F.floor(F.col(c) * n / size), F.lit(n - 1)).cast("int")
    out = px.groupBy(*keys, at("r", h, height).alias("r"), at("c", w, width).alias("c")).agg(F.greatest(F.lit(lo), F.least(F.lit(hi), F.avg(value))).alias(value))
    x, y = gt["c"] + F.col("c") * (gt["a"] * width / w), gt["f"] + F.col("r") * (gt["e"] * height / h)
    return out.withColumn("x", x).withColumn("y", y)
