"""Palettes: look-up, nearest entries, and building one from an image's colours.

Palettes have at most 256 entries, which bounds what is broadcast. Distances are taken once per distinct colour, not
once per pixel: colours are aggregated first, matched, and joined back.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])
MAX_COLORS = 256
RGBA = ["r", "g", "b", "a"]


def entries(palette: DataFrame) -> DataFrame:
    """The palette as one row with an array sorted by index: at most MAX_COLORS entries."""
    return palette.agg(F.array_sort(F.collect_list(F.struct("idx", *RGBA))).alias("pal"))


def lookup(indices: DataFrame, palette: DataFrame) -> DataFrame:
    """indices with r, g, b, a of their entry; an index without one is opaque black."""
    p = F.broadcast(palette.where(F.col("idx") < MAX_COLORS))
    joined = indices.join(p, "idx", "left")
    return joined.select(*indices.columns, *[F.coalesce(c, F.lit(0)).alias(c) for c in RGBA[:3]], F.coalesce("a", F.lit(255)).alias("a"))


def distance(entry: Column, channels: list[str]) -> Column:
    parts = [(entry[c] - F.col(c)) * (entry[c] - F.col(c)) for c in channels]
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def nearest(pixels: DataFrame, palette: DataFrame, channels: list[str] | None = None) -> DataFrame:
    """pixels with idx and dist of the nearest entry; of equals the first. The palette of at most 256 entries travels
    as one array, and distinct colours are matched once."""
    channels = channels or RGBA
    colors = pixels.select(*channels).distinct()
    best = F.array_min(F.transform("pal", lambda e: F.struct(distance(e, channels).alias("dist"), e["idx"].alias("idx"))))
    matched = colors.crossJoin(F.broadcast(entries(palette))).select(*channels, best.alias("m")).select(*channels, "m.idx", "m.dist")
    return pixels.join(matched, channels)


def first_colors(pixels: DataFrame, limit: int = MAX_COLORS) -> DataFrame:
    """img_id, idx, r, g, b, a: the first `limit` distinct colours of each image in scan order."""
    seen = pixels.groupBy("img_id", *RGBA).agg(F.min("i").alias("at"))
    rn = F.row_number().over(Window.partitionBy("img_id").orderBy("at", *RGBA))
    return seen.withColumn("idx", (rn - 1).cast("int")).where(F.col("idx") < limit).select("img_id", "idx", *RGBA)


def quantize_nearest(pixels: DataFrame, limit: int = MAX_COLORS) -> DataFrame:
    """img_id, i, idx: each pixel's entry in the palette of the first colours, its own or the nearest."""
    pal = first_colors(pixels, limit).groupBy("img_id").agg(F.array_sort(F.collect_list(F.struct("idx", *RGBA))).alias("pal"))
    colors = pixels.select("img_id", *RGBA).distinct().join(pal, "img_id")
    best = F.array_min(F.transform("pal", lambda e: F.struct(distance(e, RGBA).alias("dist"), e["idx"].alias("idx"))))
    return pixels.join(colors.select("img_id", *RGBA, best["idx"].alias("idx")), ["img_id", *RGBA]).select("img_id", "i", "idx")


def histogram(pixels: DataFrame) -> DataFrame:
    """img_id, r, g, b, count of the pixels that aren't transparent."""
    return pixels.where("a > 0").groupBy("img_id", "r", "g", "b").agg(F.count("*").alias("count"))


def variance(pixels: DataFrame) -> DataFrame:
    """img_id, variance: the mean squared distance of an image's distinct colours to their mean."""
    d = histogram(pixels)
    return d.groupBy("img_id").agg((F.var_pop("r") + F.var_pop("g") + F.var_pop("b")).alias("variance"))


def split(colors: DataFrame) -> DataFrame:
    """img_id, r, g, b, half: distinct colours halved at the median of the widest axis (ties R, G, B; order r, g, b)."""
    w = Window.partitionBy("img_id")
    width = [F.max(c).over(w) - F.min(c).over(w) for c in RGBA[:3]]
    axis = F.when((width[0] >= width[1]) & (width[0] >= width[2]), F.col("r")).when(width[1] >= width[2], F.col("g")).otherwise(F.col("b"))
    d = colors.withColumn("_axis", axis).withColumn("_n", F.count("*").over(w))
    rn = F.row_number().over(w.orderBy("_axis", "r", "g", "b"))
    return d.withColumn("half", (rn > F.floor(F.col("_n") / 2)).cast("int")).select("img_id", "r", "g", "b", "half")


def cut(colors: np.ndarray, limit: int) -> np.ndarray:
    """Median cut of distinct colours, sorted: the bucket of largest variance (the last of equals) is halved at the
    median of its widest axis until there are `limit`; entries are truncated means."""
    if len(colors) <= limit:
        return colors
    buckets = [colors]
    spread = lambda b: ((b - b.mean(axis=0)) ** 2).sum() / len(b)
    scores = [spread(colors)]
    while len(buckets) < limit and any(len(b) > 1 for b in buckets):
        k = max((k for k, b in enumerate(buckets) if len(b) > 1), key=lambda k: (scores[k], k))
        b = buckets.pop(k)
        scores.pop(k)
        axis = int(np.argmax(b.max(axis=0) - b.min(axis=0)))
        b = b[np.argsort(b[:, axis], kind="stable")]
        for half in (b[: len(b) // 2], b[len(b) // 2 :]):
            buckets.append(half)
            scores.append(spread(half))
    return np.array([b.sum(axis=0) // len(b) for b in buckets])


def median_cut(pixels: DataFrame, limit: int = MAX_COLORS) -> DataFrame:
    """img_id, idx, r, g, b, a=255: a palette per image by median cut over its distinct colours.

    An image's distinct colours are one group; with 8-bit channels there are at most 2^24 of them.
    """
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        colors = rows.sort_values(["r", "g", "b"])[["r", "g", "b"]].to_numpy(np.int64)
        out = pd.DataFrame(cut(colors, limit), columns=["r", "g", "b"])
        return out.assign(img_id=rows["img_id"].iloc[0], idx=range(len(out)), a=255)[["img_id", "idx", *RGBA]]

    if not 1 <= limit <= MAX_COLORS:
        raise ValueError(f"a palette has 1 to {MAX_COLORS} colours, not {limit}")
    return histogram(pixels).select("img_id", "r", "g", "b").groupBy("img_id").applyInPandas(run, "img_id bigint, idx int, r int, g int, b int, a int")


def median_cut_indices(pixels: DataFrame, limit: int = MAX_COLORS) -> DataFrame:
    """img_id, i, idx under the median cut palette, alpha taken as opaque; an image without any colour falls back to
    its first colours."""
    opaque = pixels.withColumn("a", F.lit(255))
    pal = median_cut(opaque, limit).groupBy("img_id").agg(F.array_sort(F.collect_list(F.struct("idx", *RGBA))).alias("pal"))
    colors = opaque.select("img_id", *RGBA[:3]).distinct().join(pal, "img_id")
    best = F.array_min(F.transform("pal", lambda e: F.struct(distance(e, RGBA[:3]).alias("dist"), e["idx"].alias("idx"))))
    return opaque.join(colors.select("img_id", *RGBA[:3], best["idx"].alias("idx")), ["img_id", *RGBA[:3]]).select("img_id", "i", "idx")


def quantize(pixels: DataFrame, algorithm: str = "nearest", limit: int = MAX_COLORS) -> DataFrame:
    """img_id, i, idx by the named algorithm: nearest or median_cut (any case, - and _ alike)."""
    name = algorithm.lower().replace("-", "").replace("_", "")
    if name in ("nearest", "nearestneighbor"):
        return quantize_nearest(pixels, limit)
    if name == "mediancut":
        return median_cut_indices(pixels, limit)
    raise ValueError(f"unknown palette algorithm {algorithm}")


def bit_depth(n: Column) -> Column:
    """The fewest bits for a palette of n entries."""
    return F.when(n <= 2, 1).when(n <= 4, 2).when(n <= 16, 4).otherwise(8)
