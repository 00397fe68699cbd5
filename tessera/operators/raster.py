"""Rasters as relations: byte tiles from texts, pixels and palettes from integer columns, float rasters from vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRIDE, TILE_BYTES = 16, 256


def byte_values(data: Column) -> Column:
    """array<int> of the bytes of a binary column: each byte is one Latin-1 character."""
    text = F.decode(data, "ISO-8859-1")
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c))


def whole_tiles(docs: DataFrame, stride: int = STRIDE, size: int = TILE_BYTES) -> DataFrame:
    """img_id, tile_id, data: every whole text as tiles of `size` bytes in order, its last row filled up with zeros;
    empty texts have none. The pieces are cut before they are exploded, so that no tile carries its whole text."""
    d = docs.where(F.octet_length("text") > 0).select(F.col("doc_id").alias("img_id"), F.encode("text", "UTF-8").alias("d"))
    fill = F.substring(F.lit(bytes(stride)), F.lit(1), (stride - F.octet_length("d") % stride) % stride)
    d = d.select("img_id", F.concat("d", fill).alias("d"))
    last = F.ceil(F.octet_length("d") / size).cast("int") - 1
    tiles = F.transform(F.sequence(F.lit(0), last), lambda k: F.struct(k.alias("tile_id"), F.substring("d", k * size + 1, F.lit(size)).alias("data")))
    return d.select("img_id", F.inline(tiles))


def keyed_tiles(docs: DataFrame) -> DataFrame:
    """img_id (struct of img_id and tile_id), data, v: every tile of every whole text, as binary and as array<int>.
    Whoever reads only one of the two forms pays for that one."""
    t = whole_tiles(docs).select(F.struct("img_id", "tile_id").alias("img_id"), "data")
    return t.select("img_id", "data", byte_values(F.col("data")).alias("v"))


def whole_images(docs: DataFrame, width: int = 256) -> DataFrame:
    """img_id, width, height, pixels: every whole text as one RGBA image, its last row filled up with zeros."""
    t = whole_tiles(docs, 4 * width, 2**30)
    return t.select("img_id", F.lit(width).alias("width"), (F.octet_length("data") / (4 * width)).cast("int").alias("height"), F.col("data").alias("pixels"))


def tile_rows(tiles: DataFrame, stride: int = STRIDE) -> DataFrame:
    """img_id, y, cur, up, up2: every row of every tile with the two rows above it (empty where there is none)."""
    height = F.floor(F.size("v") / stride).cast("int")
    t = tiles.select("img_id", "v", F.explode(F.sequence(F.lit(0), height - 1)).alias("y"))
    row = lambda k: F.when(F.col("y") >= k, F.slice("v", (F.col("y") - k) * stride + 1, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    return t.select("img_id", "y", row(0).alias("cur"), row(1).alias("up"), row(2).alias("up2"))


def cells(tiles: DataFrame, stride: int = STRIDE) -> DataFrame:
    """img_id, i, y, x, v: one row per byte."""
    t = tiles.select("img_id", F.posexplode("v").alias("i", "v"))
    return t.select("img_id", "i", F.floor(F.col("i") / stride).cast("int").alias("y"), (F.col("i") % stride).alias("x"), "v")


def strips(c: DataFrame, rows: int) -> DataFrame:
    """Cells with the strip (`tile`) of so many rows that they are in; the last strip may have fewer."""
    return c.withColumn("tile", F.floor(F.col("y") / rows).cast("int"))


def grid(sizes: DataFrame, width: int, height: int) -> DataFrame:
    """img_id, tx, ty, tw, th: the tiles of images (img_id, w, h); those at the right and lower edge are smaller."""
    nx, ny = F.ceil(F.col("w") / width).cast("int"), F.ceil(F.col("h") / height).cast("int")
    t = sizes.select("img_id", "w", "h", F.explode(F.sequence(F.lit(0), ny - 1)).alias("ty"), nx.alias("nx")).select("*", F.explode(F.sequence(F.lit(0), F.col("nx") - 1)).alias("tx"))
    return t.select("img_id", "tx", "ty", F.least(F.lit(width), F.col("w") - F.col("tx") * width).alias("tw"), F.least(F.lit(height), F.col("h") - F.col("ty") * height).alias("th"))


def tiled(c: DataFrame, width: int, height: int) -> DataFrame:
    """img_id, tx, ty, k, v: every cell with its tile and its place in a whole tile, row by row."""
    x, y = F.col("x"), F.col("y")
    return c.select("img_id", F.floor(x / width).cast("int").alias("tx"), F.floor(y / height).cast("int").alias("ty"), ((y % height) * width + x % width).alias("k"), "v")


def untiled(t: DataFrame, width: int, height: int) -> DataFrame:
    """img_id, y, x, v: where the cells of tiles (img_id, tx, ty, k, v) belong in their image."""
    k = F.col("k")
    return t.select("img_id", (F.col("ty") * height + F.floor(k / width)).cast("int").alias("y"), (F.col("tx") * width + k % width).cast("int").alias("x"), "v")


def halves(c: DataFrame, stride: int = STRIDE) -> DataFrame:
    """img_id, pass, k, v: cells by the half (even or odd rows) that they are in, and their place in it."""
    return c.select("img_id", (F.col("y") % 2).alias("pass"), (F.floor(F.col("y") / 2) * stride + F.col("x")).alias("k"), "v")


def split_rows(v: Column, stride: int = STRIDE) -> Column:
    """struct<h, even, odd>: the number of rows of a raster (array<int>), and its even and odd rows as two rasters."""
    rows = F.floor(F.size(v) / stride).cast("int")
    of = lambda odd: F.flatten(F.transform(F.filter(F.sequence(F.lit(0), rows - 1), lambda y: y % 2 == odd), lambda y: F.slice(v, y * stride + 1, F.lit(stride))))
    return F.struct(rows.alias("h"), of(0).alias("even"), of(1).alias("odd"))


def joined_rows(h: Column, even: Column, odd: Column, stride: int = STRIDE) -> Column:
    """The raster of h rows whose halves split_rows() gave."""
    row = lambda y: F.slice(F.when(y % 2 == 0, even).otherwise(odd), F.shiftright(y, 1) * stride + 1, F.lit(stride))
    return F.flatten(F.transform(F.sequence(F.lit(0), h - 1), row))


def line_pixels(lineitem: DataFrame) -> DataFrame:
    """img_id, i, r, g, b, a: a pixel of many colours per line item."""
    k, o, n = F.col("l_partkey"), F.col("l_orderkey"), F.col("l_linenumber").cast("bigint")
    part = lambda c: c.bitwiseAND(255).cast("int")
    return lineitem.select((F.col("l_suppkey") % 64).alias("img_id"), (o * 8 + n).alias("i"), part(k).alias("r"), part(o).alias("g"), part(k * 3 + n * 17).alias("b"), (255 - n * 16).cast("int").alias("a"))


def coarse_pixels(lineitem: DataFrame) -> DataFrame:
    """img_id, i, r, g, b, a: pixels of few colours, as an indexed image has."""
    p = line_pixels(lineitem)
    return p.select("img_id", "i", F.col("r").bitwiseAND(0xE0).alias("r"), F.col("g").bitwiseAND(0xC0).alias("g"), F.col("b").bitwiseAND(0x80).alias("b"), F.lit(255).alias("a"))


def palette(parts: DataFrame, size: int = 64) -> DataFrame:
    """idx, r, g, b, a: a palette of `size` entries from the first parts; its size is the bound of its broadcasts."""
    k = F.col("p_partkey")
    part = lambda c: c.bitwiseAND(255).cast("int")
    return parts.where((k >= 1) & (k <= size)).select((k - 1).cast("int").alias("idx"), part(k * 37).alias("r"), part(k * 101).alias("g"), part(k * 53).alias("b"), F.lit(255).alias("a"))


def float_pixels(vectors: DataFrame, scale: float = 1.0) -> DataFrame:
    """img_id, p, r, g, b, a: a 4x4 RGBA float image per vector of 64 numbers, magnitudes times scale."""
    e = vectors.select(F.col("vec_id").alias("img_id"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("p"))
    at = lambda k: (F.abs(F.get("embedding", F.col("p") * 4 + k).cast("double")) * scale)
    return e.select("img_id", "p", at(0).alias("r"), at(1).alias("g"), at(2).alias("b"), at(3).alias("a"))


def geometry(orders: DataFrame) -> DataFrame:
    """img_id, w, h: image sizes from order keys."""
    k = F.col("o_orderkey")
    return orders.select(k.alias("img_id"), (k % 500 + 1).cast("int").alias("w"), (k * 7 % 300 + 1).cast("int").alias("h"))
