"""Predictors over byte neighbours as Spark columns.

Neighbours of a byte inside its tile: a left, b up, c up-left, d up-right, ll two to the left, uu two up (0 outside).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The codes of the stateless predictors, in order; 15 is the weighted one.
NAMES = ("none", "sub", "up", "average", "paeth", "med", "gradient", "smedian", "2ndorder", "4way_h", "4way_v", "4way_d1", "4way_d2", "context", "tr")
WEIGHTED = 15
WEIGHT_START, WEIGHT_MAX = 8, 64


def _half(x: Column) -> Column:
    return F.shiftright(x, 1)


def _floor(x: Column, n: int) -> Column:
    """Whole quotient of a sum that is never negative."""
    return F.floor(x / n).cast("int")


def _paeth(a, b, c):
    pa, pb, pc = F.abs(b - c), F.abs(a - c), F.abs(a + b - c - c)
    return F.when((pa <= pb) & (pa <= pc), a).when(pb <= pc, b).otherwise(c)


def _med(a, b, c):
    low, high = F.least(a, b), F.greatest(a, b)
    return F.when(c >= high, low).when(c <= low, high).otherwise((a + b - c).bitwiseAND(255))


def _median(a, b, c):
    return F.greatest(F.least(a, b), F.least(F.greatest(a, b), c))


def _second_order(a, b, ll, uu):
    twice = a + a - ll + b + b - uu
    halved = F.when(twice < 0, -_half(-twice)).otherwise(_half(twice))
    return F.greatest(F.lit(0), F.least(F.lit(255), halved))


def _context(a, b, c):
    along, across = F.abs(a - c), F.abs(b - c)
    return F.when(along > across, a).when(along < across, b).otherwise(_half(a + b))


def predict(code: int, a: Column, b: Column, c: Column, d: Column, ll: Column, uu: Column) -> Column:
    """What the stateless predictor `code` says of a byte, 0 to 255."""
    rules: tuple[Callable[[], Column], ...] = (
        lambda: F.lit(0),
        lambda: a,
        lambda: b,
        lambda: _half(a + b),
        lambda: _paeth(a, b, c),
        lambda: _med(a, b, c),
        lambda: (a + b - c).bitwiseAND(255),
        lambda: _median(a, b, c),
        lambda: _second_order(a, b, ll, uu),
        lambda: F.shiftright(a * 3 + b, 2),
        lambda: F.shiftright(a + b * 3, 2),
        lambda: F.shiftright(a + b + c * 2, 2),
        lambda: _floor(a * 2 + b * 2 + c, 5),
        lambda: _context(a, b, c),
        lambda: _half(_half(a + c) + _half(b + d)),
    )
    return rules[code]()


def weighted(w: list[Column], n: list[Column]) -> Column:
    """The weighted mean of four neighbours (left, up, up-left, up-right), rounded; 0 without weight."""
    total = w[0] + w[1] + w[2] + w[3]
    acc = w[0] * n[0] + w[1] * n[1] + w[2] * n[2] + w[3] * n[3]
    return F.when(total == 0, 0).otherwise(F.least(F.lit(255), F.floor((acc + _half(total)) / F.greatest(total, F.lit(1))).cast("int")))


def reweighted(w: list[Column], n: list[Column], actual: Column) -> list[Column]:
    """Weights after a byte is known: neighbours at most as far off as the mean gain one, the others lose one."""
    off = [F.abs(actual - x) for x in n]
    mean = F.shiftright(off[0] + off[1] + off[2] + off[3], 2)
    return [F.when(o <= mean, F.least(x + 1, F.lit(WEIGHT_MAX))).otherwise(F.greatest(x - 1, F.lit(0))) for x, o in zip(w, off, strict=True)]
