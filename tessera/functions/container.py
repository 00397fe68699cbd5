"""Chunk framing and metadata payloads: as Spark columns where built-ins can say it, else as plain functions on bytes.

A file is a signature and chunks: length (u32, big-endian), type (4 letters), flag, data, CRC-32 of type, flag and data.
"""

from __future__ import annotations

import struct
import sys
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])
#: Fixed values of the file format: the signature and the chunk types.
SIGNATURE = bytes.fromhex("89434146450D0A1A0A")
IHDR, IDIM, CHDR, EXIF, JSON, ICCP, XMPD, ZDIC, PLTE, IDAT, IEND = "IHDR", "iDIM", "cHDR", "eXIF", "jSON", "iCCP", "xMPd", "zDIC", "PLTE", "IDAT", "IEND"
CRITICAL = frozenset((IHDR, PLTE, IDAT, IEND))
HEADER, FOOTER = 9, 4
#: Sample formats, filter methods, interlace methods, scan orders.
UINT, FLOAT, HALF = 0, 1, 2
NO_FILTER, BYTE_SHUFFLE, PREDICTIVE = 0, 1, 2
#: The pixel sizes that can be shuffled.
SHUFFLE_BPP = (2, 4, 8, 16)
NO_INTERLACE, ADAM7, EVEN_ODD = 0, 1, 2
ROW_MAJOR, MORTON = 0, 1


# --- as columns


def be_bytes(value: Column, width: int) -> Column:
    """Big-endian bytes of a whole number."""
    return F.unhex(F.lpad(F.hex(value.cast("bigint")), 2 * width, "0"))


def be_number(data: Column, at: int | Column, width: int) -> Column:
    """The big-endian number at byte `at` (from 0); null where the bytes end before."""
    at = F.lit(at) if isinstance(at, int) else at
    part = F.substring(F.hex(data), at * 2 + 1, F.lit(2 * width))
    return F.when(F.length(part) == 2 * width, F.conv(part, 16, 10).cast("bigint"))


def crc(kind: Column, flag: Column, data: Column) -> Column:
    return F.crc32(F.concat(kind.cast("binary"), be_bytes(flag, 1), data))


def chunk(kind: Column, flag: Column, data: Column) -> Column:
    """The bytes of a chunk."""
    return F.concat(be_bytes(F.octet_length(data), 4), kind.cast("binary"), be_bytes(flag, 1), data, be_bytes(crc(kind, flag, data), 4))


def json_payload(namespace: Column, json: Column) -> Column:
    """Length, namespace and JSON text; null where the namespace has over 255 bytes."""
    return F.when(F.octet_length(namespace) <= 255, F.concat(be_bytes(F.octet_length(namespace), 1), namespace.cast("binary"), json.cast("binary")))


def valid_json(text: Column) -> Column:
    """True for one whole JSON value. The parser ignores what follows a value, so the text is also tried inside an
    array and inside an object, which anything that follows would break."""
    inside = lambda a, b: F.try_parse_json(F.concat(F.lit(a), text, F.lit(b))).isNotNull()
    return F.try_parse_json(text).isNotNull() & inside("[", "]") & inside('{"x":', "}")


def compression_bit(flag: Column) -> Column:
    """Over the chunks of a file: the header's compression byte, 1 if any chunk is compressed."""
    return F.coalesce(F.max(flag.cast("int")), F.lit(0))


def tiling(data: Column) -> Column:
    """struct<tile_width, tile_height, tiles_x, tiles_y, valid> of a tiling payload; valid says whether the order is known."""
    names = ("tile_width", "tile_height", "tiles_x", "tiles_y")
    return F.struct(*[be_number(data, 2 * k, 2).alias(n) for k, n in enumerate(names)], F.coalesce(be_number(data, 8, 1) <= MORTON, F.lit(False)).alias("valid"))


def palette_entries(data: Column) -> Column:
    """array<struct<idx, r, g, b, a>> of a palette payload; missing alpha is 255, a partial last entry is left out."""
    n = F.when(be_number(data, 0, 1) != 0, 4).otherwise(3)
    whole = F.floor((F.octet_length(data) - 1) / n).cast("int")
    at = lambda k, c: be_number(data, k * n + 1 + c, 1)
    entry = lambda k: F.struct(k.alias("idx"), at(k, 0).alias("r"), at(k, 1).alias("g"), at(k, 2).alias("b"), F.when(n == 4, at(k, 3)).otherwise(F.lit(255)).alias("a"))
    return F.when(whole > 0, F.transform(F.sequence(F.lit(0), whole - 1), entry))


def budget(interlace: Column, color_type: Column, width: Column, height: Column, row_bytes: Column) -> Column:
    """The most bytes that the image data of a file may unpack to."""
    px = width.cast("bigint") * height.cast("bigint")
    plain = F.when(color_type == 3, px + height).otherwise(row_bytes.cast("bigint") * height + height)
    return F.when(interlace == ADAM7, px * 4 + 7).when(interlace == EVEN_ODD, px * 4 + 2).otherwise(plain)


def header_fault(h: dict[str, Column]) -> Column:
    """Why a header can't be read, or null: one code for the first rule that it breaks."""
    t, d = h["color_type"], h["bit_depth"]
    deep = d.isin(8, 10, 12, 16, 32)
    depth_fits = F.when(t.isin(0, 4), deep | d.isin(1, 2, 4)).when(t.isin(2, 6), deep).when(t == 3, d.isin(1, 2, 4, 8)).otherwise(F.lit(True))
    rules = (
        ((h["width"] == 0) | (h["height"] == 0), "dimensions"), (~h["sample_format"].isin(UINT, FLOAT, HALF), "sample_format"),
        ((h["sample_format"] == FLOAT) & (d != 32), "float_depth"), ((h["sample_format"] == HALF) & (d != 16), "half_depth"),
        (~depth_fits, "bit_depth"), (~t.isin(0, 2, 3, 4, 6), "color_type"), (~h["filter_method"].isin(0, 1, 2), "filter_method"),
        (~h["interlace_method"].isin(0, 1, 2), "interlace_method"), (h["compression_method"].bitwiseAND(0xFE) != 0, "compression_method"),
        ((h["filter_method"] == BYTE_SHUFFLE) & (h["interlace_method"] != NO_INTERLACE), "shuffle_interlace"),
    )
    out = None
    for broken, name in rules:
        out = F.when(broken, name) if out is None else out.when(broken, name)
    return out


# --- on bytes


class ContainerError(ValueError):
    """code: signature, truncated, chunk_type, crc, header, feature, missing, limit or block."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code


@dataclass(frozen=True)
class Chunk:
    kind: str
    flag: int
    data: bytes


def write_chunk(kind: str, flag: int, data: bytes) -> bytes:
    body = kind.encode("ascii") + bytes([flag]) + data
    return struct.pack(">I", len(data)) + body + struct.pack(">I", zlib.crc32(body))


def read_chunks(content: bytes) -> Iterator[Chunk]:
    """The chunks up to the end chunk or the end of the file; a broken one is an error."""
    if content[: len(SIGNATURE)] != SIGNATURE:
        raise ContainerError("signature")
    at = len(SIGNATURE)
    while at < len(content):
        if at + HEADER > len(content):
            raise ContainerError("truncated", f"chunk header at {at}")
        size, kind, flag = struct.unpack_from(">I4sB", content, at)
        if not (kind.isalpha() and kind.isascii()):
            raise ContainerError("chunk_type", repr(kind))
        end = at + HEADER + size
        if end + FOOTER > len(content):
            raise ContainerError("truncated", f"{kind!r} says {size} bytes")
        data = content[at + HEADER : end]
        if zlib.crc32(content[at + 4 : end]) != struct.unpack_from(">I", content, end)[0]:
            raise ContainerError("crc", repr(kind))
        yield Chunk(kind.decode("ascii"), flag, data)
        if kind == b"IEND":
            return
        at = end + FOOTER


@dataclass(frozen=True)
class Header:
    width: int
    height: int
    bit_depth: int = 8
    sample_format: int = UINT
    color_type: int = 6
    compression_method: int = 0
    filter_method: int = PREDICTIVE
    interlace_method: int = NO_INTERLACE

    def pack(self) -> bytes:
        return struct.pack(">IIBBBBBB", self.width, self.height, self.bit_depth, self.sample_format, self.color_type, self.compression_method, self.filter_method, self.interlace_method)

    @classmethod
    def parse(cls, data: bytes) -> Header:
        if len(data) < 14:
            raise ContainerError("truncated", "header")
        h = cls(*struct.unpack_from(">IIBBBBBB", data))
        h.check()
        return h

    def check(self) -> None:
        depths = {0: (1, 2, 4, 8, 10, 12, 16, 32), 2: (8, 10, 12, 16, 32), 3: (1, 2, 4, 8), 4: (1, 2, 4, 8, 10, 12, 16, 32), 6: (8, 10, 12, 16, 32)}
        if not self.width or not self.height:
            raise ContainerError("feature", "dimensions")
        if self.sample_format > HALF or (self.sample_format == FLOAT and self.bit_depth != 32) or (self.sample_format == HALF and self.bit_depth != 16):
            raise ContainerError("feature", "sample format")
        if self.bit_depth not in depths.get(self.color_type, ()):
            raise ContainerError("feature", "colour type and depth")
        if self.filter_method > PREDICTIVE or self.interlace_method > EVEN_ODD or self.compression_method & 0xFE:
            raise ContainerError("feature", "method")
        if self.filter_method == BYTE_SHUFFLE and self.interlace_method:
            raise ContainerError("feature", "byte shuffle with passes")
        if self.interlace_method and self.bit_depth != 8:
            raise ContainerError("feature", "passes have 8-bit samples")

    @property
    def bpp(self) -> int:
        if self.bit_depth < 8:
            return 1
        per = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[self.color_type]
        return per * {8: 1, 10: 2, 12: 2, 16: 2, 32: 4}[self.bit_depth]

    @property
    def row_bytes(self) -> int:
        per = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[self.color_type]
        return (self.width * per * self.bit_depth + 7) // 8 if self.bit_depth < 8 else self.width * self.bpp

    @property
    def budget(self) -> int:
        px = self.width * self.height
        if self.interlace_method:
            return px * 4 + (7 if self.interlace_method == ADAM7 else 2)
        return px + self.height if self.color_type == 3 else self.row_bytes * self.height + self.height


@dataclass(frozen=True)
class Tiling:
    tile_width: int
    tile_height: int
    tiles_x: int
    tiles_y: int
    scan_order: int = ROW_MAJOR

    @classmethod
    def of(cls, width: int, height: int, tile_width: int, tile_height: int, scan_order: int = ROW_MAJOR) -> Tiling:
        return cls(tile_width, tile_height, -(-width // tile_width), -(-height // tile_height), scan_order)

    def pack(self) -> bytes:
        return struct.pack(">HHHHB", self.tile_width, self.tile_height, self.tiles_x, self.tiles_y, self.scan_order)

    @classmethod
    def parse(cls, data: bytes) -> Tiling:
        if len(data) < 9:
            raise ContainerError("truncated", "tiling")
        t = cls(*struct.unpack_from(">HHHHB", data))
        if t.scan_order > MORTON:
            raise ContainerError("feature", "scan order")
        return t

    def boxes(self, width: int, height: int) -> list[tuple[int, int, int, int]]:
        """x, y, width and height of the tiles in scan order; the grid must be the image's."""
        if not self.tile_width or not self.tile_height or (self.tiles_x, self.tiles_y) != (-(-width // self.tile_width), -(-height // self.tile_height)):
            raise ContainerError("feature", "tile grid")
        at = [(tx, ty) for ty in range(self.tiles_y) for tx in range(self.tiles_x)]
        if self.scan_order == MORTON:
            at.sort(key=lambda p: sum(((p[0] >> k & 1) << 2 * k) | ((p[1] >> k & 1) << 2 * k + 1) for k in range(16)))
        w, h = self.tile_width, self.tile_height
        return [(tx * w, ty * h, min(w, width - tx * w), min(h, height - ty * h)) for tx, ty in at]


@dataclass(frozen=True)
class Hdr:
    transfer: int = 0
    primaries: int = 0
    max_lum: float = 1.0
    min_lum: float = 0.0
    max_cll: int | None = None
    max_fall: int | None = None

    def pack(self) -> bytes:
        more = [v for v in (self.max_cll, self.max_fall) if v is not None]
        return struct.pack(f">BBff{len(more)}I", self.transfer, self.primaries, self.max_lum, self.min_lum, *more)

    @classmethod
    def parse(cls, data: bytes) -> Hdr:
        if len(data) not in (10, 14, 18):
            raise ContainerError("truncated", f"HDR of {len(data)} bytes")
        return cls(*struct.unpack(f">BBff{(len(data) - 10) // 4}I", data))


def pack_palette(entries: list[tuple[int, int, int, int]], has_alpha: bool) -> bytes:
    return bytes([has_alpha]) + b"".join(bytes(e[: 4 if has_alpha else 3]) for e in entries)


def parse_palette(data: bytes) -> list[tuple[int, int, int, int]]:
    """Entries; missing alpha is 255, a partial last entry is left out."""
    if not data:
        raise ContainerError("truncated", "palette")
    n = 4 if data[0] else 3
    return [(*data[k : k + 3], data[k + 3] if n == 4 else 255) for k in range(1, len(data) - n + 1, n)]
