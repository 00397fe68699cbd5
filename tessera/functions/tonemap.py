"""HDR tone mapping as Spark columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Transfer functions and primaries by code.
LINEAR, PQ, HLG, SRGB = 0, 1, 2, 3
BT709, BT2020, P3 = 0, 1, 2
#: Curve constants.
PQ_M1, PQ_M2, PQ_C1, PQ_C2, PQ_C3 = 0.1593, 78.8438, 0.8359, 18.8516, 18.6875
HLG_A, HLG_B, HLG_C = 0.17883, 0.28466, 0.55991
#: RGB to XYZ and back, by primaries.
TO_XYZ = {
    BT709: ((0.412456, 0.357576, 0.180438), (0.212673, 0.715152, 0.072175), (0.019334, 0.119192, 0.950304)),
    BT2020: ((0.636958, 0.144617, 0.168881), (0.262700, 0.677998, 0.059302), (0.0, 0.028073, 1.060985)),
    P3: ((0.486571, 0.265668, 0.198217), (0.228975, 0.691739, 0.079287), (0.0, 0.045113, 1.043944)),
}
FROM_XYZ = {
    BT709: ((3.240454, -1.537139, -0.498531), (-0.969266, 1.876011, 0.041556), (0.055643, -0.204026, 1.057225)),
    BT2020: ((1.716651, -0.355671, -0.253366), (-0.666684, 1.616481, 0.015769), (0.017640, -0.042771, 0.942103)),
    P3: ((2.493497, -0.931384, -0.402711), (-0.829489, 1.762664, 0.023625), (0.035846, -0.076172, 0.956885)),
}


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def finite(x: Column) -> Column:
    """0 for NaN and infinities."""
    bad = F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, 0.0).otherwise(x)


def pq(x: Column, top: float = 1.0) -> Column:
    root = F.pow(x, F.lit(1 / PQ_M2))
    below = F.lit(PQ_C2) - root * PQ_C3
    curve = F.pow(F.greatest(root - PQ_C1, F.lit(0.0)) / below, F.lit(1 / PQ_M1)) * top
    return F.when(x <= 0, 0.0).when(x >= 1, top).when(F.abs(below) < 1e-10, top).otherwise(curve)


def hlg(x: Column) -> Column:
    return F.when(x <= 0.5, x * x / 3).otherwise((F.exp((x - HLG_B) * HLG_A) + HLG_C) / 12)


def srgb(x: Column) -> Column:
    return F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4)))


def companding(x: Column) -> Column:
    v = clamp(x)
    return F.when(v <= 0.0031308, v * 12.92).otherwise(F.pow(v, F.lit(1 / 2.4)) * 1.055 - 0.055)


def reinhard(x: Column) -> Column:
    return clamp(x / (x + 1))


def filmic(x: Column) -> Column:
    return clamp(x * (x * 2.51 + 0.03) / (x * (x * 2.43 + 0.59) + 0.14))


OPERATORS = {"reinhard": reinhard, "filmic": filmic}


def multiply(m, rgb: list[Column]) -> list[Column]:
    return [rgb[0] * row[0] + rgb[1] * row[1] + rgb[2] * row[2] for row in m]


def convert(rgb: list[Column], source: int, target: int) -> list[Column]:
    """Linear RGB between primaries, by way of XYZ; unknown codes count as P3."""
    if source == target:
        return list(rgb)
    return multiply(FROM_XYZ.get(target, FROM_XYZ[P3]), multiply(TO_XYZ.get(source, TO_XYZ[P3]), rgb))


def linear(rgb: list[Column], transfer: int, max_lum: float) -> list[Column]:
    """Relative linear light, 0 to 1, of samples under a transfer function."""
    held = [clamp(finite(x), 0.0, max_lum) for x in rgb]
    safe = max(max_lum, 1.0)
    if transfer == LINEAR:
        return [clamp(x / max_lum) for x in held]
    if transfer == PQ:
        return [pq(x / safe) for x in held]
    if transfer == HLG:
        return [hlg(clamp(x / max(safe / 100, 0.12))) for x in held]
    return [srgb(clamp(x)) for x in held]


def check(transfer: int, source: int, target: int) -> None:
    if transfer not in (LINEAR, PQ, HLG, SRGB) or source not in TO_XYZ or target not in TO_XYZ:
        raise ValueError(f"unknown transfer function or primaries: {transfer}, {source}, {target}")


def tonemap(df: DataFrame, transfer: int, source: int, target: int, max_lum: float, operator: str = "filmic", rgb: tuple = ("r", "g", "b"), out: tuple = ("r", "g", "b")) -> DataFrame:
    """df with the display light, 0 to 1, of a pixel in the columns `out`; codes outside the tables are errors.

    Each step is a column of its own: an expression that is used several times is computed once.
    """
    check(transfer, source, target)
    keep = df.columns
    lin, moved = [f"_lin_{c}" for c in "rgb"], [f"_moved_{c}" for c in "rgb"]
    d = df.withColumns(dict(zip(lin, linear([F.col(c) for c in rgb], transfer, max_lum), strict=True)))
    d = d.withColumns({n: F.greatest(finite(x), F.lit(0.0)) for n, x in zip(moved, convert([F.col(c) for c in lin], source, target), strict=True)})
    d = d.withColumns({n: OPERATORS[operator](F.col(c)) for n, c in zip(out, moved, strict=True)})
    return d.select(*dict.fromkeys([*keep, *out]))


def to_display(df: DataFrame, transfer: int, source: int, target: int, max_lum: float, operator: str = "filmic") -> DataFrame:
    """df with r, g, b, a as 8-bit samples, truncated."""
    names = ("_r", "_g", "_b")
    d = tonemap(df, transfer, source, target, max(max_lum, 1.0), operator, out=names)
    d = d.withColumns({n: companding(F.col(n)) for n in names}).withColumn("_a", clamp(F.col("a")))
    return d.withColumns({c: F.floor(F.col(f"_{c}") * 255).cast("int") for c in "rgba"}).select(*df.columns)
