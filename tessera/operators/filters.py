"""Predictive filters over byte tiles: residuals, their scores, the choice of a filter, and the inverse.

Tiles are arrays (img_id, v), so neighbours are index arithmetic inside a row: no window, no shuffle before the
aggregation by tile. Single predictors are column expressions; scoring all 16 and the sequential operators (weighted
predictor, inverses) are array work on batches of tiles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.predictors import predict
from tessera.operators import codec
from tessera.operators.raster import STRIDE

CANDIDATES = codec.CANDIDATES
PRUNE_TO = 8


def neighbours(tiles: DataFrame, bpp: int = 1, stride: int = STRIDE) -> DataFrame:
    """img_id, i, y, x, v and the neighbours a, b, c, d, ll, uu of every byte: index arithmetic on the tile's array in
    compiled code, without a window."""
    t = tiles.select("img_id", F.col("v").alias("tile"), F.posexplode("v").alias("i", "v"))
    i = F.col("i")
    x = i % stride
    at = lambda k, ok: F.when(ok & (i >= k), F.get("tile", F.greatest(i - k, F.lit(0)))).otherwise(F.lit(0))
    yes = F.lit(True)
    return t.select(
        "img_id", "i", F.floor(i / stride).cast("int").alias("y"), x.alias("x"), "v", at(bpp, x >= bpp).alias("a"), at(stride, yes).alias("b"), at(stride + bpp, x >= bpp).alias("c"),
        at(stride - bpp, (x + bpp < stride) & (i >= stride)).alias("d"), at(2 * bpp, x >= 2 * bpp).alias("ll"), at(2 * stride, yes).alias("uu"),
    )


def residuals(cells: DataFrame, code: int) -> DataFrame:
    """img_id, i, y, x, r: what a stateless predictor leaves of every byte, from cells with neighbours."""
    p = predict(code, *[F.col(c) for c in ("a", "b", "c", "d", "ll", "uu")])
    return cells.select("img_id", "i", "y", "x", (F.col("v") - p).bitwiseAND(255).alias("r"))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda s, x: s + x)


def residual_tiles(tiles: DataFrame, bpp: int = 1, stride: int = STRIDE) -> DataFrame:
    """img_id, code, res: the residuals of every tile under all 16 filters, as one array per tile and code."""
    t = tiles.select("img_id", F.octet_length("data").alias("n"), codec.all_residuals(F.col("data"), bpp, stride).alias("r"))
    return t.select("img_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.slice("r", k * F.col("n") + 1, F.col("n")))).alias("code", "res"))


def rows_of(values: Column, stride: int = STRIDE) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(values) / stride).cast("int") - 1), lambda y: F.slice(values, y * stride + 1, F.lit(stride)))


def scores(tiles: DataFrame, bpp: int = 1, stride: int = STRIDE) -> DataFrame:
    """img_id, code, msad (sum of residual bytes), entropy (sum over rows, 9 decimals): 16 rows per tile.

    No shuffle: a batch of tiles is scored as arrays where it is, and only numbers leave.
    """
    t = tiles.select("img_id", codec.all_scores(F.col("data"), bpp, stride).alias("s"))
    triples = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.struct(k.alias("code"), F.get("s", k * 2).cast("bigint").alias("msad"), F.round(F.get("s", k * 2 + 1), 9).alias("entropy")))
    return t.select("img_id", F.inline(triples))


def best_filter(scored: DataFrame, by: str = "entropy") -> DataFrame:
    """img_id, code, score: the least score; of equals the lowest code."""
    return scored.groupBy("img_id").agg(F.min(F.struct(by, "code")).alias("m")).select("img_id", "m.code", F.col(f"m.{by}").alias("score"))


def quick_prune(scored: DataFrame, keep: int = PRUNE_TO) -> DataFrame:
    """img_id, code: the `keep` smallest sums of residuals, of these the least entropy; ties to the smaller sum.

    The 16 candidates of a tile are sorted inside one array: no window over the whole table.
    """
    ranked = scored.groupBy("img_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("msad", "code", "entropy"))), 1, keep).alias("top"))
    return ranked.select("img_id", F.array_min(F.transform("top", lambda c, i: F.struct(c["entropy"].alias("entropy"), i.alias("i"), c["code"].alias("code"))))["code"].alias("code"))


def block_stats(cells: DataFrame, stride: int = STRIDE) -> DataFrame:
    """img_id, avg_variance, high_regions, regions: population variance of the byte regions of a tile."""
    height = cells.groupBy("img_id").agg((F.max("y") + 1).alias("h"))
    rh = F.greatest(F.floor(F.col("h") / 4).cast("int"), F.lit(1))
    v = F.col("v").cast("double")
    region = cells.join(height, "img_id").groupBy("img_id", F.floor(F.col("y") / rh).alias("ry"), F.floor(F.col("x") / max(stride // 4, 1)).alias("rx")).agg((F.avg(v * v) - F.avg(v) * F.avg(v)).alias("variance"))
    return region.groupBy("img_id").agg(F.avg("variance").alias("avg_variance"), F.sum((F.round("variance", 9) > 100).cast("bigint")).alias("high_regions"), F.count("*").alias("regions"))


def block_type(stats: DataFrame) -> DataFrame:
    kind = F.when(F.round("avg_variance", 9) < 10, "Smooth").when(F.round("avg_variance", 9) < 50, "Natural").when(F.col("high_regions") > F.floor(F.col("regions") / 3), "HighFreq").otherwise("Mixed")
    return stats.select("img_id", "avg_variance", "high_regions", "regions", kind.alias("block_type"))


def adaptive(scored: DataFrame, types: DataFrame) -> DataFrame:
    """img_id, block_type, code: the least entropy among the block type's candidates; of equals the earlier one."""
    lists = F.create_map(*[x for k, codes in CANDIDATES.items() for x in (F.lit(k), F.array(*map(F.lit, codes)))])
    d = scored.join(types.select("img_id", "block_type"), "img_id").withColumn("ord", F.array_position(F.element_at(lists, F.col("block_type")), F.col("code")))
    best = d.where("ord > 0").groupBy("img_id", "block_type").agg(F.min(F.struct("entropy", "ord", "code")).alias("m"))
    return best.select("img_id", "block_type", "m.code")
