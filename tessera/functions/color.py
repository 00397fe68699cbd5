"""Sample and colour conversion as Spark columns. Samples are whole numbers; floats are doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Colour types and their samples per pixel.
GRAY, RGB, INDEXED, GRAY_ALPHA, RGBA = 0, 2, 3, 4, 6
SAMPLES = {GRAY: 1, RGB: 3, INDEXED: 1, GRAY_ALPHA: 2, RGBA: 4}
PACKED, WHOLE = (1, 2, 4), {8: 1, 10: 2, 12: 2, 16: 2, 32: 4}
#: Bit depths each colour type may have.
DEPTHS = {GRAY: (1, 2, 4, 8, 10, 12, 16, 32), RGB: (8, 10, 12, 16, 32), INDEXED: (1, 2, 4, 8), GRAY_ALPHA: (1, 2, 4, 8, 10, 12, 16, 32), RGBA: (8, 10, 12, 16, 32)}


def bytes_per_pixel(color_type: int, depth: int) -> int | None:
    """None where the type has no such depth; packed depths count as one byte."""
    if depth not in DEPTHS.get(color_type, ()):
        return None
    return 1 if depth in PACKED else SAMPLES[color_type] * WHOLE[depth]


def bytes_per_row(width: Column, depth: Column) -> Column:
    """Bytes of a row of packed samples."""
    return F.floor((width * depth + 7) / 8).cast("bigint")


def gray(r: Column, g: Column, b: Column) -> Column:
    """Luma in thousandths, truncated."""
    return F.floor((r * 299 + g * 587 + b * 114) / 1000).cast("int")


def reduce(v: Column, depth: int) -> Column:
    """8 bits to 1, 2 or 4: the high bits."""
    return F.shiftright(v, 8 - depth)


def widen(v: Column, depth: int) -> Column:
    """1, 2 or 4 bits to 8, by replication."""
    return v * (255 // (2**depth - 1))


def expand(v: Column, depth: int) -> Column:
    """8 bits to 10, 12 or 16 (whole range) or 32 (the byte four times)."""
    top = {10: 1023, 12: 4095, 16: 65535, 32: 4294967295}[depth]
    return F.floor(v.cast("bigint") * top / 255).cast("bigint") if depth < 16 else v.cast("bigint") * (top // 255)


def narrow(v: Column, depth: int) -> Column:
    """10, 12, 16 or 32 bits to 8: the high byte."""
    return F.shiftright(v.cast("bigint"), depth - 8).cast("int")


def to_float(v: Column) -> Column:
    return v / F.lit(255.0)


def from_float(v: Column) -> Column:
    """Clamped, rounded half away from zero; NaN is 0."""
    return F.when(F.isnan(v), 0).otherwise(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)) * 255 + 0.5).cast("int"))


def channels(color_type: int, r: Column, g: Column, b: Column, a: Column) -> list[Column]:
    """The 8-bit samples of a pixel of a colour type."""
    return {GRAY: [gray(r, g, b)], RGB: [r, g, b], GRAY_ALPHA: [gray(r, g, b), a], RGBA: [r, g, b, a]}[color_type]


def encode(v: Column, depth: int) -> Column:
    return reduce(v, depth) if depth < 8 else v if depth == 8 else expand(v, depth)


def decode(v: Column, depth: int, raw: bool = False) -> Column:
    """Back to 8 bits. raw keeps packed samples as they are, for files whose reader did."""
    if depth < 8:
        return v if raw else widen(v, depth)
    return v if depth == 8 else narrow(v, depth)


def to_rgba(color_type: int, samples: list[Column]) -> list[Column]:
    """Four 8-bit samples; alpha 255 where the type has none."""
    full = F.lit(255)
    return {GRAY: lambda s: [s[0]] * 3 + [full], RGB: lambda s: [*s, full], GRAY_ALPHA: lambda s: [s[0]] * 3 + [s[1]], RGBA: lambda s: list(s)}[color_type](samples)


def pack(values: Column, depth: int) -> Column:
    """array<int> of bytes from samples of 1, 2 or 4 bits, high bits first, zeros after the last."""
    per = 8 // depth
    n = F.floor((F.size(values) + (per - 1)) / per).cast("int")
    at = lambda i, k: F.shiftleft(F.coalesce(F.get(values, i * per + k), F.lit(0)), 8 - depth * (k + 1))

    def byte(i: Column) -> Column:
        out = at(i, 0)
        for k in range(1, per):
            out = out.bitwiseOR(at(i, k))
        return out

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), byte)).otherwise(F.array().cast("array<int>"))


def fits(values: Column, depth: int) -> Column:
    """True if every sample has at most `depth` bits."""
    return F.forall(values, lambda v: v.between(0, 2**depth - 1))


def unpack(packed: Column, depth: int, width: Column) -> Column:
    """array<int> of `width` samples from bytes."""
    per = 8 // depth
    sample = lambda byte, k: F.shiftright(byte, 8 - depth * (k + 1)).bitwiseAND(2**depth - 1)
    return F.slice(F.flatten(F.transform(packed, lambda b: F.array(*[sample(b, k) for k in range(per)]))), F.lit(1), width)


def shuffle(values: Column, bpp: int) -> Column:
    """Byte k of all pixels together, for every k."""
    n = F.size(values)
    pixels = F.floor(n / bpp).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.get(values, (j % pixels) * bpp + F.floor(j / pixels).cast("int")))


def unshuffle(values: Column, bpp: int) -> Column:
    n = F.size(values)
    pixels = F.floor(n / bpp).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(values, (i % bpp) * pixels + F.floor(i / bpp).cast("int")))
