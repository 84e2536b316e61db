"""Colour statistics and colour correction of images as column arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelweave.operators.fanout import spread_join

CHANNELS = ("r", "g", "b")

# Fixed values of the colour correction: least average red, largest hue shift, pixels of an image to each pixel that a
# rare bin of its histogram may hold (and the number of them that any may), part of blue that feeds red, and for red,
# green and blue the constant, cosine and sine parts of their weights in red after a turn of hue.
MIN_AVG_RED = 60
MAX_HUE_SHIFT = 120
RARE_SHARE = 2000
RARE_MORE = 2
BLUE_MAGIC_VALUE = 0.0
HUE_WEIGHTS = ((0.299, 0.701, 0.168), (0.587, -0.587, 0.330), (0.114, -0.114, -0.497))


def clamp(v: Column) -> Column:
    """0..255, truncated to whole numbers."""
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), v))).cast("int")


def grey(bands: tuple = CHANNELS) -> Column:
    """Sum of the bands over three, however many bands there are."""
    total = F.col(bands[0])
    for b in bands[1:]:
        total = total + F.col(b)
    return total / 3


def channel_stats(rgb: DataFrame, keys: tuple = ("tile",)) -> DataFrame:
    """(keys, avg_r, avg_g, avg_b, pixels)."""
    return rgb.groupBy(*keys).agg(*[F.avg(c).alias(f"avg_{c}") for c in CHANNELS], F.count("*").alias("pixels"))


def histogram(rgb: DataFrame, keys: tuple = ("tile",), bins: int = 256) -> DataFrame:
    """(keys, channel, bin, n): all bins, empty ones too."""
    long = rgb.select(*keys, F.explode(F.create_map(*[x for c in CHANNELS for x in (F.lit(c), F.col(c))])).alias("channel", "v"))
    counted = long.groupBy(*keys, "channel", F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.col("v"))).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    every = counted.select(*keys, "channel").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return every.join(counted, [*keys, "channel", "bin"], "left").select(*keys, "channel", "bin", F.coalesce("n", F.lit(0)).alias("n"))


def widest_gap(hist: DataFrame, threshold: Column, keys: tuple = ("tile", "channel")) -> DataFrame:
    """(keys, low, high): the widest gap between neighbours among 0, the bins with less than threshold, and 255; the first of equals."""
    rare = hist.where(F.col("n") < threshold).select(*keys, "bin")
    ends = hist.select(*keys).distinct().withColumn("bin", F.explode(F.array(F.lit(0), F.lit(255))))
    steps = rare.union(ends).distinct().withColumn("next", F.lead("bin").over(Window.partitionBy(*keys).orderBy("bin"))).where("next is not null")
    best = F.max_by(F.struct("bin", "next"), F.struct(F.col("next") - F.col("bin"), -F.col("bin")))
    return steps.groupBy(*keys).agg(best.alias("g")).select(*keys, F.col("g.bin").alias("low"), F.col("g.next").alias("high"))


def gain_offset(low: Column, high: Column) -> tuple[Column, Column]:
    """Scale and shift that spread low..high over the whole range."""
    gain = F.lit(256.0) / (high - low)
    return gain, (-low / F.lit(256.0)) * gain


def hue_weights(h: Column) -> tuple[Column, Column, Column]:
    """Weights of red, green and blue in the red channel turned by h degrees."""
    u, w = F.cos(h * math.pi / 180), F.sin(h * math.pi / 180)
    return tuple(F.lit(k) + F.lit(c) * u + F.lit(d) * w for k, c, d in HUE_WEIGHTS)


def hue_shifted_red(r: Column, g: Column, b: Column, h: Column) -> Column:
    wr, wg, wb = hue_weights(h)
    return r * wr + g * wg + b * wb


def least_hue_shift(stats: DataFrame, keys: tuple = ("tile",)) -> DataFrame:
    """(keys, shift): the step after the first hue at which average red is enough; 0 if it is from the start, 121 if never."""
    turned = stats.withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(MAX_HUE_SHIFT))))
    enough = hue_shifted_red(F.col("avg_r"), F.col("avg_g"), F.col("avg_b"), F.col("h").cast("double")) >= MIN_AVG_RED
    first = turned.groupBy(*keys, "avg_r").agg(F.min(F.when(enough, F.col("h"))).alias("h"))
    return first.select(*keys, F.when(F.col("avg_r") >= MIN_AVG_RED, F.lit(0)).otherwise(F.coalesce(F.col("h") + 1, F.lit(MAX_HUE_SHIFT + 1))).cast("int").alias("shift"))


def apply_matrix(m: dict[str, Column]) -> dict[str, Column]:
    """Channels under a 3 x 5 colour matrix given by row letter and place, as rr, rg, rb, r0, ..."""
    c, out = F.col, {}
    for ch in CHANNELS:
        out[ch] = clamp(c("r") * m[f"{ch}r"] + c("g") * m[f"{ch}g"] + c("b") * m[f"{ch}b"] + m[f"{ch}0"] * 255)
    return out


def colour_matrix(rgb: DataFrame, keys: tuple = ("tile",)) -> DataFrame:
    """(keys, r_gain, r_offset, ..., shift): the correction of each image from its own statistics. Pixels meet it in parts, so that no task reads a whole image."""
    stats = channel_stats(rgb, keys)
    shift = least_hue_shift(stats, keys)
    turned = spread_join(rgb.select(*keys, *CHANNELS), shift, list(keys)).withColumn("r", clamp(hue_shifted_red(F.col("r"), F.col("g"), F.col("b"), F.col("shift").cast("double"))))
    hist = histogram(turned, keys).join(stats.select(*keys, "pixels"), list(keys))
    gaps = widest_gap(hist, F.col("pixels") / RARE_SHARE + RARE_MORE, (*keys, "channel"))
    gain, offset = gain_offset(F.col("low"), F.col("high"))
    wide = gaps.withColumn("gain", gain).withColumn("offset", offset).groupBy(*keys).pivot("channel", list(CHANNELS)).agg(F.first("gain").alias("gain"), F.first("offset").alias("offset"))
    return wide.join(shift, list(keys))


def colour_correct(rgb: DataFrame, keys: tuple = ("tile",)) -> DataFrame:
    """rgb with corrected channels."""
    m = colour_matrix(rgb, keys)
    wr, wg, wb = hue_weights(F.col("shift").cast("double"))
    zero = F.lit(0.0)
    mat = {
        "rr": wr * F.col("r_gain"), "rg": wg * F.col("r_gain"), "rb": wb * F.col("r_gain") * BLUE_MAGIC_VALUE, "r0": F.col("r_offset"),
        "gr": zero, "gg": F.col("g_gain"), "gb": zero, "g0": F.col("g_offset"),
        "br": zero, "bg": zero, "bb": F.col("b_gain"), "b0": F.col("b_offset"),
    }
    return spread_join(rgb, m, list(keys)).withColumns(apply_matrix(mat)).select(*rgb.columns)


def blend(bg: Column, fg: Column, alpha: float) -> Column:
    return bg * (1 - alpha) + fg * alpha


def thumbnails(px: DataFrame, k: int, keys: tuple, value: str) -> DataFrame:
    """Averages over k x k blocks."""
    return px.groupBy(*keys, F.floor(F.col("r") / k).cast("int").alias("r"), F.floor(F.col("c") / k).cast("int").alias("c")).agg(F.avg(value).alias(value))


def softmax(a: Column) -> Column:
    top = F.array_max(a)
    e = F.transform(a, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, v: s + v))


def pad_square(px: DataFrame, size: int, values: tuple, keys: tuple = ("tile",)) -> DataFrame:
    """px(keys, r, c, values) as whole size x size images, with 0 for pixels that are missing."""
    axis = F.sequence(F.lit(0), F.lit(size - 1))
    cells = px.select(*keys).distinct().withColumn("r", F.explode(axis)).withColumn("c", F.explode(axis))
    return cells.join(px, [*keys, "r", "c"], "left").fillna(0, list(values))
