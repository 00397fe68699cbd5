"""Geometry of tiles and passes as Spark columns: Morton codes, interlacing passes, tile grids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Masks and shifts that spread 32 bits to the even places of 64.
SPREAD = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))
#: Passes 1 to 6 as (x step, x offset, y step, y offset); the first that holds a pixel owns it, 7 the rest.
PASSES = ((8, 0, 8, 0), (8, 4, 8, 0), (4, 2, 8, 0), (4, 2, 4, 2), (2, 1, 4, 2), (2, 1, 2, 1))


def _spread(v: Column) -> Column:
    x = v.cast("bigint").bitwiseAND(0xFFFFFFFF)
    for shift, mask in SPREAD:
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask).cast("bigint"))
    return x


def _gather(v: Column) -> Column:
    x = v.bitwiseAND(F.lit(SPREAD[-1][1]).cast("bigint"))
    for k in range(len(SPREAD) - 1, -1, -1):
        wider = SPREAD[k - 1][1] if k else 0xFFFFFFFF
        x = x.bitwiseOR(F.shiftrightunsigned(x, SPREAD[k][0])).bitwiseAND(F.lit(wider).cast("bigint"))
    return x


def morton(x: Column, y: Column) -> Column:
    """Bits of x on even, of y on odd places."""
    return _spread(x).bitwiseOR(F.shiftleft(_spread(y), 1))


def morton_x(code: Column) -> Column:
    return _gather(code)


def morton_y(code: Column) -> Column:
    return _gather(F.shiftrightunsigned(code, 1))


def interlace_pass(x: Column, y: Column) -> Column:
    """The pass, 1 to 7, that owns a pixel."""
    out = None
    for k, (xs, xo, ys, yo) in enumerate(PASSES):
        here = (x % xs == xo) & (y % ys == yo)
        out = F.when(here, k + 1) if out is None else out.when(here, k + 1)
    return out.otherwise(7)


def pass_size(extent: Column, step: int, offset: int) -> Column:
    """How many places of an extent a pass grid has."""
    return F.greatest(F.floor((extent - offset + (step - 1)) / step), F.lit(0)).cast("int")
