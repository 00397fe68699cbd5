"""Queries over geometry, reordering, packing, colour, tone mapping and palettes, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import color as C
from tessera.functions import geometry as G
from tessera.functions import tonemap as T
from tessera.operators import codec, raster
from tessera.operators import quantize as Q
from tessera.plans.filter_queries import cells_sql, checksum, flat, flat_sql, pairs, tiles
from tessera.plans.tables import table

TW, TH = 64, 48


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.line_pixels(table(spark, sf_dir, "lineitem"))


def coarse(spark, sf_dir):
    return raster.coarse_pixels(table(spark, sf_dir, "lineitem"))


def pal(spark, sf_dir):
    return raster.palette(table(spark, sf_dir, "part"))


def sizes(spark, sf_dir):
    return raster.geometry(table(spark, sf_dir, "orders"))


def floats(spark, sf_dir, scale=4.0):
    return raster.float_pixels(table(spark, sf_dir, "embeddings"), scale)


PIXELS = "px AS (SELECT l_suppkey % 64 AS img_id, l_orderkey * 8 + l_linenumber AS i, CAST(l_partkey & 255 AS INTEGER) AS r, CAST(l_orderkey & 255 AS INTEGER) AS g, CAST((l_partkey * 3 + l_linenumber * 17) & 255 AS INTEGER) AS b, CAST(255 - l_linenumber * 16 AS INTEGER) AS a FROM lineitem)"
COARSE = PIXELS + ", few AS (SELECT img_id, i, r & 224 AS r, g & 192 AS g, b & 128 AS b, 255 AS a FROM px)"
PAL = "pal AS (SELECT CAST(p_partkey - 1 AS INTEGER) AS idx, CAST((p_partkey * 37) & 255 AS INTEGER) AS r, CAST((p_partkey * 101) & 255 AS INTEGER) AS g, CAST((p_partkey * 53) & 255 AS INTEGER) AS b, 255 AS a FROM part WHERE p_partkey BETWEEN 1 AND 64)"
SIZES = "geo AS (SELECT o_orderkey AS img_id, CAST(o_orderkey % 500 + 1 AS INTEGER) AS w, CAST(o_orderkey * 7 % 300 + 1 AS INTEGER) AS h FROM orders)"
FLOATS = "fl AS (SELECT vec_id AS img_id, CAST(p.p AS INTEGER) AS p, abs(CAST(embedding[4*p.p+1] AS DOUBLE)) * 4.0 AS r, abs(CAST(embedding[4*p.p+2] AS DOUBLE)) * 4.0 AS g, abs(CAST(embedding[4*p.p+3] AS DOUBLE)) * 4.0 AS b, abs(CAST(embedding[4*p.p+4] AS DOUBLE)) * 4.0 AS a FROM embeddings, unnest(range(0, 16)) AS p(p))"


# --- geometry and reordering


def tile_rows(spark, sf_dir):
    c = raster.strips(raster.cells(tiles(spark, sf_dir)), 6)
    return c.groupBy("img_id", "tile").agg(F.countDistinct("y").alias("rows"), F.sum("v").alias("byte_sum"))


def tile_grid(spark, sf_dir):
    return raster.grid(sizes(spark, sf_dir), TW, TH)


GRID = SIZES + f", grid AS (SELECT img_id, CAST(x.tx AS INTEGER) AS tx, CAST(y.ty AS INTEGER) AS ty, CAST(least({TW}, w - x.tx * {TW}) AS INTEGER) AS tw, CAST(least({TH}, h - y.ty * {TH}) AS INTEGER) AS th FROM geo, unnest(range(0, (w + {TW - 1}) // {TW})) AS x(tx), unnest(range(0, (h + {TH - 1}) // {TH})) AS y(ty))"


def tile_extract(spark, sf_dir):
    t = raster.tiled(raster.cells(tiles(spark, sf_dir)), 5, 4)
    return t.groupBy("img_id", "tx", "ty").agg(F.count("*").alias("n"), F.sum((F.col("k") + 1) * F.col("v")).alias("tile_check"))


def tile_reassemble(spark, sf_dir):
    """Cut every raster into tiles, put them together again by place, and check it against the source."""
    cut = raster.tiled(raster.cells(tiles(spark, sf_dir)), 5, 4).groupBy("img_id", "tx", "ty").agg(F.collect_list(F.struct("k", "v")).alias("tile"))
    back = raster.untiled(cut.select("img_id", "tx", "ty", F.inline("tile")), 5, 4)
    return back.groupBy("img_id").agg(F.sum(((F.col("y") * raster.STRIDE + F.col("x") + 1) * F.col("v")).cast("bigint")).alias("byte_check"), F.sum("v").alias("byte_sum"))


def ordered(key: str):
    def run(spark, sf_dir):
        from pyspark.sql import Window

        g = tile_grid(spark, sf_dir)
        by = [F.col("ty"), F.col("tx")] if key == "row" else [G.morton(F.col("tx"), F.col("ty"))]
        # one image's tiles are one small group
        return g.select("img_id", "tx", "ty", (F.row_number().over(Window.partitionBy("img_id").orderBy(*by)) - 1).alias("place"))

    return run


MORTON = lambda x, y: "(" + " | ".join(f"((({x} >> {k}) & 1) << {2 * k}) | ((({y} >> {k}) & 1) << {2 * k + 1})" for k in range(24)) + ")"


def morton_code(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") * 7919 % 16777216).alias("x"), (F.col("o_orderkey") * 104729 % 16777216).alias("y"))
    return o.select("o_orderkey", G.morton(F.col("x"), F.col("y")).alias("code"))


def morton_decode(spark, sf_dir):
    c = morton_code(spark, sf_dir)
    return c.select("o_orderkey", G.morton_x(F.col("code")).alias("x"), G.morton_y(F.col("code")).alias("y"))


def adam7_extract(spark, sf_dir):
    """Bytes of each pass in (y, x) order, one byte per pixel: every tile gives its passes where it is, without a shuffle."""
    p = tiles(spark, sf_dir).select("img_id", codec.pass_sums(codec.passes(F.col("data"))).alias("s"))
    p = p.select("img_id", pairs(F.col("s"), "pass", "n", "pass_check")).where("n > 0")
    return p.select("img_id", (F.col("pass") + 1).alias("pass"), F.col("n").cast("int").alias("n"), "pass_check")


def adam7_reconstruct(spark, sf_dir):
    """The passes as byte arrays, placed again by their order: sums are those of the source raster."""
    put = tiles(spark, sf_dir).select("img_id", codec.byte_sums(codec.from_passes(codec.passes(F.col("data")))).alias("s"))
    return put.select("img_id", F.get("s", F.lit(0)).alias("byte_sum"), F.get("s", F.lit(1)).alias("byte_check"))


def adam7_dims(spark, sf_dir):
    g = sizes(spark, sf_dir)
    parts = [F.struct(F.lit(k + 1).alias("pass"), G.pass_size(F.col("w"), xs, xo).alias("pw"), G.pass_size(F.col("h"), ys, yo).alias("ph")) for k, (xs, xo, ys, yo) in enumerate(G.PASSES)]
    parts.append(F.struct(F.lit(7).alias("pass"), F.col("w").alias("pw"), F.col("h").alias("ph")))
    return g.select("img_id", F.inline(F.array(*parts)))


_dims = " UNION ALL ".join([f"SELECT img_id, {k + 1} AS pass, CAST(greatest((w - {xo} + {xs - 1}) // {xs}, 0) AS INTEGER) AS pw, CAST(greatest((h - {yo} + {ys - 1}) // {ys}, 0) AS INTEGER) AS ph FROM geo" for k, (xs, xo, ys, yo) in enumerate(G.PASSES)] + ["SELECT img_id, 7, w, h FROM geo"])
#: The passes in closed form.
PASS = "CASE WHEN x%8=0 AND y%8=0 THEN 1 WHEN x%8=4 AND y%8=0 THEN 2 WHEN x%4=2 AND y%8=0 THEN 3 WHEN x%4=2 AND y%4=2 THEN 4 WHEN x%2=1 AND y%4=2 THEN 5 WHEN x%2=1 AND y%2=1 THEN 6 ELSE 7 END"


def evenodd_extract(spark, sf_dir):
    half = raster.halves(raster.cells(tiles(spark, sf_dir)))
    return half.groupBy("img_id", "pass").agg(F.count("*").alias("n"), F.sum((F.col("k") + 1) * F.col("v")).alias("pass_check"))


def evenodd_reconstruct(spark, sf_dir):
    split = tiles(spark, sf_dir).select("img_id", raster.split_rows(F.col("v")).alias("s")).select("img_id", "s.*")
    back = raster.joined_rows(F.col("h"), F.col("even"), F.col("odd"))
    return split.select("img_id", back.alias("v")).select("img_id", F.aggregate("v", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("byte_sum"), checksum(F.col("v")).alias("byte_check"))


STRIDES = (2, 4, 8, 16)


def byte_shuffle(spark, sf_dir):
    t = tiles(spark, sf_dir)
    return t.select("img_id", *[F.get(codec.byte_sums(codec.shuffled_bytes(F.col("data"), k)), F.lit(1)).alias(f"check{k}") for k in STRIDES])


def byte_unshuffle(spark, sf_dir):
    t = tiles(spark, sf_dir).select("img_id", "data")
    for k in STRIDES:
        t = t.withColumn("data", codec.shuffled_bytes(codec.shuffled_bytes(F.col("data"), k), k, inverse=True))
    return t.select("img_id", F.get(codec.byte_sums(F.col("data")), F.lit(1)).alias("byte_check"))


# --- packing


def packed(spark, sf_dir):
    """Rows of samples of 1, 2 and 4 bits from the high bits of the bytes, 13 of a row so that the last byte is padded."""
    c = raster.tile_rows(tiles(spark, sf_dir)).select("img_id", "y", F.slice("cur", 1, 13).alias("v"))
    return c.select("img_id", "y", *[F.transform("v", _reducer(k)).alias(f"s{k}") for k in C.PACKED])


def _reducer(depth):
    return lambda v: C.reduce(v, depth)


def pack_samples(spark, sf_dir):
    p = packed(spark, sf_dir)
    return p.select("img_id", "y", *[checksum(C.pack(F.col(f"s{k}"), k)).alias(f"pack{k}") for k in C.PACKED])


def unpack_samples(spark, sf_dir):
    p = packed(spark, sf_dir)
    return p.select("img_id", "y", *[checksum(C.unpack(C.pack(F.col(f"s{k}"), k), k, F.lit(13))).alias(f"back{k}") for k in C.PACKED])


def pack_indices(spark, sf_dir):
    """Palette indices (0 to 15) of the bytes' low bits as 4-bit rows."""
    c = raster.tile_rows(tiles(spark, sf_dir)).select("img_id", "y", F.transform("cur", lambda v: v.bitwiseAND(15)).alias("v"))
    return c.select("img_id", "y", checksum(C.pack(F.col("v"), 4)).alias("packed"))


def unpack_indices(spark, sf_dir):
    c = raster.tile_rows(tiles(spark, sf_dir)).select("img_id", "y", F.transform("cur", lambda v: v.bitwiseAND(15)).alias("v"))
    return c.select("img_id", "y", checksum(C.unpack(C.pack(F.col("v"), 4), 4, F.lit(16))).alias("unpacked"))


def _pack_sql(depth: int) -> str:
    per = 8 // depth
    return f"(SELECT img_id, y, CAST(sum((x // {per} + 1) * ((v >> {8 - depth}) << (8 - {depth} * (x % {per} + 1)))) AS BIGINT) AS pack{depth} FROM cells WHERE x < 13 GROUP BY ALL) p{depth}"


# --- colour


def rgb_to_gray(spark, sf_dir):
    return pixels(spark, sf_dir).select("img_id", "i", C.gray(F.col("r"), F.col("g"), F.col("b")).alias("gray"))


def rgba_to_color_type(spark, sf_dir):
    """Sample sums of every colour type at every depth, by image."""
    p = pixels(spark, sf_dir)
    sums = []
    for kind in (C.GRAY, C.RGB, C.GRAY_ALPHA, C.RGBA):
        for depth in C.DEPTHS[kind]:
            total = None
            for k, v in enumerate(C.channels(kind, *map(F.col, "rgba"))):
                one = C.encode(v, depth).cast("bigint") * (k + 1)
                total = one if total is None else total + one
            sums.append(F.sum(total).alias(f"t{kind}_{depth}"))
    return p.groupBy("img_id").agg(*sums)


GRAY_SQL = "((299 * r + 587 * g + 114 * b) // 1000)"


def _enc(v: str, d: int) -> str:
    if d < 8:
        return f"({v} >> {8 - d})"
    return {8: v, 10: f"({v} * 1023 // 255)", 12: f"({v} * 4095 // 255)", 16: f"({v} * 257)", 32: f"(CAST({v} AS BIGINT) * 16843009)"}[d]


def _channels_sql(kind: int) -> list[str]:
    return {0: [GRAY_SQL], 2: ["r", "g", "b"], 4: [GRAY_SQL, "a"], 6: ["r", "g", "b", "a"]}[kind]


_types = ", ".join(f"CAST(sum({' + '.join(f'CAST({_enc(v, d)} AS BIGINT) * {k + 1}' for k, v in enumerate(_channels_sql(kind)))}) AS BIGINT) AS t{kind}_{d}" for kind in (0, 2, 4, 6) for d in C.DEPTHS[kind])


def color_type_to_rgba(spark, sf_dir):
    """Every colour type and depth, encoded and decoded again, as RGBA sums by image."""
    p = pixels(spark, sf_dir)
    sums = []
    for kind in (C.GRAY, C.RGB, C.GRAY_ALPHA, C.RGBA):
        for depth in C.DEPTHS[kind]:
            back = C.to_rgba(kind, [C.decode(C.encode(v, depth), depth) for v in C.channels(kind, *map(F.col, "rgba"))])
            sums.append(F.sum((back[0] + back[1] * 2 + back[2] * 3 + back[3] * 4).cast("bigint")).alias(f"t{kind}_{depth}"))
    return p.groupBy("img_id").agg(*sums)


def _dec(v: str, d: int) -> str:
    if d < 8:
        return f"(({v} >> {8 - d}) * {255 // (2**d - 1)})"
    return f"({_enc(v, d)} >> {d - 8})" if d > 8 else v


def _back_sql(kind: int, d: int) -> str:
    s = [_dec(v, d) for v in _channels_sql(kind)]
    full = {0: lambda: [s[0]] * 3 + ["255"], 2: lambda: [*s, "255"], 4: lambda: [s[0]] * 3 + [s[1]], 6: lambda: s}[kind]()
    return f"CAST(sum({' + '.join(f'{v} * {k + 1}' for k, v in enumerate(full))}) AS BIGINT) AS t{kind}_{d}"


def sample_format(spark, sf_dir):
    """Integer, float and half samples of gray: float32 and float16 hold every 8-bit value exactly enough to return."""
    p = pixels(spark, sf_dir).withColumn("gray", C.gray(F.col("r"), F.col("g"), F.col("b")))
    f32 = C.to_float(F.col("gray")).cast("float").cast("double")
    return p.select("img_id", "i", C.from_float(f32).alias("from_float"), F.round(f32, 6).alias("as_float"))


def conversion(name, of):
    def run(spark, sf_dir):
        p = pixels(spark, sf_dir)
        return p.select("img_id", "i", *[v.alias(n) for n, v in of(F.col("r")).items()])

    return run


CONVERSIONS = {
    "reduce_8_to_n": (lambda v: {f"d{k}": C.reduce(v, k) for k in C.PACKED}, ["r >> 7 AS d1", "r >> 6 AS d2", "r >> 4 AS d4"]),
    "expand_n_to_8": (lambda v: {f"d{k}": C.widen(C.reduce(v, k), k) for k in C.PACKED}, ["(r >> 7) * 255 AS d1", "(r >> 6) * 85 AS d2", "(r >> 4) * 17 AS d4"]),
    "expand_8_to_n": (lambda v: {f"d{k}": C.expand(v, k) for k in (10, 12, 16)}, ["CAST(r * 1023 // 255 AS BIGINT) AS d10", "CAST(r * 4095 // 255 AS BIGINT) AS d12", "CAST(r * 257 AS BIGINT) AS d16"]),
    "expand_8_to_32": (lambda v: {"d32": C.expand(v, 32)}, ["CAST(r AS BIGINT) * 16843009 AS d32"]),
    "compress_32_to_8": (lambda v: {"d8": C.narrow(C.expand(v, 32) + 77, 32)}, ["CAST((CAST(r AS BIGINT) * 16843009 + 77) >> 24 AS INTEGER) AS d8"]),
    "compress_n_to_8": (lambda v: {f"d{k}": C.narrow(C.expand(v, k), k) for k in (10, 12, 16)}, ["CAST((r * 1023 // 255) >> 2 AS INTEGER) AS d10", "CAST((r * 4095 // 255) >> 4 AS INTEGER) AS d12", "CAST((r * 257) >> 8 AS INTEGER) AS d16"]),
    "u8_float": (lambda v: {"f": F.round(C.to_float(v), 9)}, ["round(r / 255.0, 9) AS f"]),
    "float_u8": (lambda v: {"u": C.from_float(v * 1.7 / 255 - 0.2)}, ["CAST(floor(greatest(0.0, least(1.0, CAST(r AS DOUBLE) * 1.7 / 255 - 0.2)) * 255 + 0.5) AS INTEGER) AS u"]),
}


def _int_udf(fn):
    return F.pandas_udf(lambda s: fn(s), "int")


def half_bits(spark, sf_dir):
    """8-bit values as IEEE half bits, in Arrow batches: Spark has no such type."""
    import pandas as pd

    def run(s):
        return pd.Series((s.to_numpy("float32") / 255).astype("float16").view("uint16").astype("int32"))

    v = pixels(spark, sf_dir).select("r").distinct()
    return v.select("r", _int_udf(run)("r").alias("bits"))


def half_back(spark, sf_dir):
    import numpy as np
    import pandas as pd

    def run(s):
        h = s.to_numpy("uint16").view("float16").astype("float32")
        return pd.Series(np.floor(np.clip(np.nan_to_num(h, nan=0.0), 0, 1) * 255 + 0.5).astype("int32"))

    return half_bits(spark, sf_dir).select("r", _int_udf(run)("bits").alias("back"))


def pixel_sizes(spark, sf_dir):
    """The table of bytes and samples per pixel for every colour type and depth."""
    rows = [(kind, depth, C.bytes_per_pixel(kind, depth), C.SAMPLES[kind]) for kind in C.SAMPLES for depth in (1, 2, 4, 8, 10, 12, 16, 32) if C.bytes_per_pixel(kind, depth)]
    return spark.createDataFrame(rows, "color_type int, bit_depth int, bytes int, samples int")


# --- tone mapping


def curve(fn, sql, top=1.0):
    def run(spark, sf_dir):
        return floats(spark, sf_dir).select("img_id", "p", F.round(fn(F.col("r") / 2), 7).alias("y"))

    return run, f"WITH {FLOATS}, q AS (SELECT img_id, p, r / 2 AS x FROM fl) SELECT img_id, p, round({sql}, 7) AS y FROM q"


_pq = "CASE WHEN {x} <= 0 THEN 0.0 WHEN {x} >= 1 THEN 1.0 WHEN abs(18.8516 - 18.6875 * pow({x}, 1 / 78.8438)) < 1e-10 THEN 1.0 ELSE pow(greatest(pow({x}, 1 / 78.8438) - 0.8359, 0) / (18.8516 - 18.6875 * pow({x}, 1 / 78.8438)), 1 / 0.1593) END"
_hlg = "CASE WHEN {x} <= 0.5 THEN {x} * {x} / 3 ELSE (exp(0.17883 * ({x} - 0.28466)) + 0.55991) / 12 END"
_srgb = "CASE WHEN {x} <= 0.04045 THEN {x} / 12.92 ELSE pow(({x} + 0.055) / 1.055, 2.4) END"
_comp = "CASE WHEN greatest(0, least(1, {x})) <= 0.0031308 THEN greatest(0, least(1, {x})) * 12.92 ELSE 1.055 * pow(greatest(0, least(1, {x})), 1 / 2.4) - 0.055 END"
_reinhard = "greatest(0, least(1, {x} / (1 + {x})))"
_filmic = "greatest(0, least(1, {x} * (2.51 * {x} + 0.03) / ({x} * (2.43 * {x} + 0.59) + 0.14)))"
CURVES = {
    "eotf_pq": curve(T.pq, _pq.format(x="x")), "eotf_hlg": curve(T.hlg, _hlg.format(x="x")), "eotf_srgb": curve(T.srgb, _srgb.format(x="x")),
    "srgb_companding": curve(T.companding, _comp.format(x="x")), "op_reinhard": curve(T.reinhard, _reinhard.format(x="x")), "op_filmic": curve(T.filmic, _filmic.format(x="x")),
}


def _rgb(spark, sf_dir):
    return floats(spark, sf_dir), [F.col(c) for c in "rgb"]


def primaries(spark, sf_dir):
    """XYZ of every pixel under each of the three primaries."""
    f, rgb = _rgb(spark, sf_dir)
    return f.select("img_id", "p", *[F.round(v, 7).alias(f"{n}{k}") for k in T.TO_XYZ for n, v in zip("xyz", T.multiply(T.TO_XYZ[k], rgb), strict=True)])


def convert_primaries(spark, sf_dir):
    f, rgb = _rgb(spark, sf_dir)
    return f.select("img_id", "p", *[F.round(v, 6).alias(f"{n}{s}{t}") for s in T.TO_XYZ for t in T.TO_XYZ for n, v in zip("rgb", T.convert(rgb, s, t), strict=True)])


def _mul_sql(m, rgb) -> list[str]:
    return ["(" + " + ".join(f"({v}) * ({k})" for v, k in zip(rgb, row, strict=True)) + ")" for row in m]


def _convert_sql(rgb, s, t) -> list[str]:
    return rgb if s == t else _mul_sql(T.FROM_XYZ[t], _mul_sql(T.TO_XYZ[s], rgb))


CASES = ((0, 0, 0, 2.0), (1, 1, 0, 2.0), (2, 2, 0, 100.0), (3, 0, 2, 2.0))


def tonemap_pixel(spark, sf_dir):
    f, _ = _rgb(spark, sf_dir)
    names = []
    for k, (transfer, s, t, top) in enumerate(CASES):
        for op in T.OPERATORS:
            out = tuple(f"{n}_{op}_{k}" for n in "rgb")
            f = T.tonemap(f, transfer, s, t, top, op, out=out)
            names += out
    return f.select("img_id", "p", *[F.round(n, 6).alias(n) for n in names])


def _linear_sql(transfer: int, top: float) -> list[str]:
    held = [f"greatest(0, least({top}, {c}))" for c in "rgb"]
    if transfer == 0:
        return [f"greatest(0, least(1, {x} / {top}))" for x in held]
    if transfer == 1:
        return [_pq.format(x=f"({x} / {max(top, 1.0)})") for x in held]
    if transfer == 2:
        return [_hlg.format(x=f"greatest(0, least(1, {x} / {max(max(top, 1.0) / 100, 0.12)}))") for x in held]
    return [_srgb.format(x=f"greatest(0, least(1, {x}))") for x in held]


def _tonemap_steps(cases) -> str:
    """Steps in subqueries, so that the text stays short: lin{k}, conv{k}, then the operators."""
    lin = ", ".join(f"{x} AS l{k}{n}" for k, (transfer, _, _, top) in enumerate(cases) for n, x in zip("rgb", _linear_sql(transfer, top), strict=True))
    conv = ", ".join(f"greatest(0, {x}) AS c{k}{n}" for k, (_, s, t, _) in enumerate(cases) for n, x in zip("rgb", _convert_sql([f"l{k}{n}" for n in "rgb"], s, t), strict=True))
    return f"WITH {FLOATS}, lin AS (SELECT img_id, p, a, {lin} FROM fl), conv AS (SELECT img_id, p, a, {conv} FROM lin)"


_ops = {"reinhard": _reinhard, "filmic": _filmic}
_pixel_sql = _tonemap_steps(CASES) + " SELECT img_id, p, " + ", ".join(f"round({_ops[op].format(x=f'c{k}{n}')}, 6) AS {n}_{op}_{k}" for k in range(len(CASES)) for op in _ops for n in "rgb") + " FROM conv"


def tonemap_image(spark, sf_dir):
    return T.to_display(floats(spark, sf_dir), T.PQ, T.BT2020, T.BT709, 2.0)


_image_sql = _tonemap_steps(((1, 1, 0, 2.0),)) + ", op AS (SELECT img_id, p, a, " + ", ".join(f"{_filmic.format(x=f'c0{n}')} AS o_{n}" for n in "rgb") + " FROM conv) SELECT img_id, p, " + ", ".join(f"CAST(floor(({_comp.format(x=f'o_{n}')}) * 255) AS INTEGER) AS {n}" for n in "rgb") + ", CAST(floor(greatest(0, least(1, a)) * 255) AS INTEGER) AS a FROM op"


# --- palettes


def indices(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 64).alias("img_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber").cast("bigint")).alias("i"), (F.col("l_partkey") % 80).cast("int").alias("idx"))


INDICES = "ind AS (SELECT l_suppkey % 64 AS img_id, l_orderkey * 8 + l_linenumber AS i, CAST(l_partkey % 80 AS INTEGER) AS idx FROM lineitem)"


def palette_lookup(spark, sf_dir):
    return Q.lookup(indices(spark, sf_dir), pal(spark, sf_dir))


def index_to_rgba(spark, sf_dir):
    return indices(spark, sf_dir).join(F.broadcast(pal(spark, sf_dir)), "idx").select("img_id", "i", "idx", "r", "g", "b", "a")


def palette_nearest(spark, sf_dir):
    return Q.nearest(pixels(spark, sf_dir), pal(spark, sf_dir)).select("img_id", "i", "idx", "dist")


def palette_nearest_rgb(spark, sf_dir):
    return Q.nearest(pixels(spark, sf_dir), pal(spark, sf_dir), ["r", "g", "b"]).select("img_id", "i", "idx", "dist")


def _nearest_sql(channels: str, scope: str = "px") -> str:
    d = " + ".join(f"(c.{n} - p.{n}) * (c.{n} - p.{n})" for n in channels)
    cols = ", ".join(channels)
    return f"cols AS (SELECT DISTINCT {cols} FROM {scope}), near AS (SELECT {', '.join('c.' + n for n in channels)}, p.idx, {d} AS dist FROM cols c, pal p QUALIFY row_number() OVER (PARTITION BY {', '.join('c.' + n for n in channels)} ORDER BY {d}, p.idx) = 1)"


def quantize_nn(spark, sf_dir):
    return Q.quantize(pixels(spark, sf_dir), "NearestNeighbor", 16)


_nn = f"WITH {PIXELS}, seen AS (SELECT img_id, r, g, b, a, min(i) AS first_at FROM px GROUP BY ALL), pal AS (SELECT *, CAST(row_number() OVER (PARTITION BY img_id ORDER BY first_at, r, g, b, a) - 1 AS INTEGER) AS idx FROM seen QUALIFY idx < 16), near AS (SELECT c.img_id, c.r, c.g, c.b, c.a, p.idx FROM seen c JOIN pal p USING (img_id) QUALIFY row_number() OVER (PARTITION BY c.img_id, c.r, c.g, c.b, c.a ORDER BY (c.r-p.r)*(c.r-p.r) + (c.g-p.g)*(c.g-p.g) + (c.b-p.b)*(c.b-p.b) + (c.a-p.a)*(c.a-p.a), p.idx) = 1) SELECT img_id, i, idx FROM px JOIN near USING (img_id, r, g, b, a)"


def quantize_dispatch(spark, sf_dir):
    """Pixels per palette entry under both algorithms."""
    both = [Q.quantize(coarse(spark, sf_dir), name, 64).groupBy("img_id", "idx").agg(F.count("*").alias("n")).withColumn("algorithm", F.lit(name)) for name in ("nearest", "median_cut")]
    return both[0].unionByName(both[1])


_dispatch = f"WITH {COARSE}, nn AS (SELECT img_id, r, g, b, min(i) AS first_at, count(*) AS n FROM few GROUP BY ALL) SELECT img_id, CAST(row_number() OVER (PARTITION BY img_id ORDER BY first_at, r, g, b) - 1 AS INTEGER) AS idx, n, 'nearest' AS algorithm FROM nn UNION ALL SELECT img_id, CAST(row_number() OVER (PARTITION BY img_id ORDER BY r, g, b) - 1 AS INTEGER), n, 'median_cut' FROM nn"


def median_cut(spark, sf_dir):
    return Q.median_cut(pixels(spark, sf_dir), 32)


def median_cut_wrapper(spark, sf_dir):
    return Q.median_cut_indices(pixels(spark, sf_dir), 32)


def split_bucket(spark, sf_dir):
    return Q.split(Q.histogram(pixels(spark, sf_dir)).select("img_id", "r", "g", "b"))


def palette_bit_depth(spark, sf_dir):
    n = coarse(spark, sf_dir).groupBy("img_id").agg(F.countDistinct("r", "g", "b").alias("n"))
    more = table(spark, sf_dir, "part").select((F.col("p_partkey") + 1000).alias("img_id"), (F.col("p_partkey") % 256 + 1).alias("n"))
    return n.unionByName(more).select("img_id", "n", Q.bit_depth(F.col("n")).alias("depth"))


def bytes_per_row(spark, sf_dir):
    return sizes(spark, sf_dir).select("img_id", *[C.bytes_per_row(F.col("w"), F.lit(k)).alias(f"d{k}") for k in (1, 2, 4, 8)])


# --- detection


def detect_indexed(spark, sf_dir):
    """Every 10th pixel, at most 256 colours; counted exactly by a two-level aggregation."""
    p = coarse(spark, sf_dir).unionByName(pixels(spark, sf_dir).withColumn("img_id", F.col("img_id") + 100))
    return p.where(F.col("i") % 10 == 0).groupBy("img_id").agg(F.countDistinct("r", "g", "b", "a").alias("colors")).select("img_id", "colors", (F.col("colors") <= 256).alias("indexed"))


def _gray_images(spark, sf_dir):
    p = pixels(spark, sf_dir)
    even = F.col("img_id") % 2 == 0
    return p.select("img_id", "i", "r", F.when(even, F.col("r")).otherwise(F.col("g")).alias("g"), F.when(even, F.col("r")).otherwise(F.col("b")).alias("b"), F.when(F.col("img_id") % 3 == 0, 255).otherwise(F.col("a")).alias("a"))


GRAYS = PIXELS + ", gr AS (SELECT img_id, i, r, CASE WHEN img_id % 2 = 0 THEN r ELSE g END AS g, CASE WHEN img_id % 2 = 0 THEN r ELSE b END AS b, CASE WHEN img_id % 3 = 0 THEN 255 ELSE a END AS a FROM px)"


def detect_grayscale(spark, sf_dir):
    g = _gray_images(spark, sf_dir).where(F.col("i") % 100 == 0)
    return g.groupBy("img_id").agg(F.bool_and((F.col("r") == F.col("g")) & (F.col("g") == F.col("b"))).alias("gray"))


def detect_color_type(spark, sf_dir):
    g = _gray_images(spark, sf_dir).where(F.col("i") % 100 == 0)
    d = g.groupBy("img_id").agg(F.bool_and((F.col("r") == F.col("g")) & (F.col("g") == F.col("b"))).alias("gray"), F.bool_or(F.col("a") < 255).alias("alpha"))
    return d.select("img_id", F.when(F.col("gray") & F.col("alpha"), C.GRAY_ALPHA).when(F.col("gray"), C.GRAY).when(F.col("alpha"), C.RGBA).otherwise(C.RGB).alias("color_type"))


_sum = cells_sql() + " SELECT img_id, CAST(sum(v) AS BIGINT) AS byte_sum, CAST(sum((i + 1) * v) AS BIGINT) AS byte_check FROM cells GROUP BY 1"
_shuffles = ", ".join(f"CAST(sum(((i % {k}) * (n // {k}) + i // {k} + 1) * v) AS BIGINT) AS check{k}" for k in (2, 4, 8, 16))
_bpp = ", ".join(f"({k}, {d}, {C.bytes_per_pixel(k, d)}, {C.SAMPLES[k]})" for k, d in [(0, 1), (0, 2), (0, 4), (0, 8), (0, 10), (0, 12), (0, 16), (0, 32), (2, 8), (2, 10), (2, 12), (2, 16), (2, 32), (3, 1), (3, 2), (3, 4), (3, 8), (4, 1), (4, 2), (4, 4), (4, 8), (4, 10), (4, 12), (4, 16), (4, 32), (6, 8), (6, 10), (6, 12), (6, 16), (6, 32)])

QUERIES = {
    "tile_rows": tile_rows, "tile_grid": tile_grid, "tile_extract": tile_extract, "tile_reassemble": tile_reassemble, "tile_order_rowmajor": ordered("row"), "tile_order_morton": ordered("morton"),
    "morton_code": morton_code, "morton_decode": morton_decode, "adam7_extract": adam7_extract, "adam7_reconstruct": adam7_reconstruct, "adam7_dims": adam7_dims,
    "evenodd_extract": evenodd_extract, "evenodd_reconstruct": evenodd_reconstruct, "byte_shuffle": byte_shuffle, "byte_unshuffle": byte_unshuffle,
    "pack_samples": pack_samples, "unpack_samples": unpack_samples, "pack_indices": pack_indices, "unpack_indices": unpack_indices, "bytes_per_row": bytes_per_row,
    "rgb_to_gray": rgb_to_gray, "rgba_to_color_type": rgba_to_color_type, "color_type_to_rgba": color_type_to_rgba, "color_with_format": sample_format, "u8_half": half_bits, "half_u8": half_back, "bytes_per_pixel": pixel_sizes,
    "primaries_matrices": primaries, "convert_primaries": convert_primaries, "tonemap_pixel": tonemap_pixel, "tonemap_image": tonemap_image,
    "palette_lookup": palette_lookup, "index_to_rgba": index_to_rgba, "palette_nearest": palette_nearest, "palette_nearest_rgb": palette_nearest_rgb,
    "quantize_dispatch": quantize_dispatch, "quantize_nn": quantize_nn, "quantize_median_cut": median_cut, "median_cut_wrapper": median_cut_wrapper, "split_bucket": split_bucket, "palette_bit_depth": palette_bit_depth,
    "variance_bucket": lambda s, d: Q.variance(pixels(s, d)).select("img_id", F.round("variance", 6).alias("variance")), "color_histogram": lambda s, d: Q.histogram(coarse(s, d)),
    "detect_indexed": detect_indexed, "detect_grayscale": detect_grayscale, "detect_color_type": detect_color_type,
} | {name: conversion(name, of) for name, (of, _) in CONVERSIONS.items()} | {name: run for name, (run, _) in CURVES.items()}

ORACLES = {
    "tile_rows": cells_sql() + " SELECT img_id, CAST(y // 6 AS INTEGER) AS tile, count(DISTINCT y) AS rows, CAST(sum(v) AS BIGINT) AS byte_sum FROM cells GROUP BY ALL",
    "tile_grid": f"WITH {GRID} SELECT * FROM grid",
    "tile_extract": cells_sql() + " SELECT img_id, CAST(x // 5 AS INTEGER) AS tx, CAST(y // 4 AS INTEGER) AS ty, count(*) AS n, CAST(sum(((y % 4) * 5 + x % 5 + 1) * v) AS BIGINT) AS tile_check FROM cells GROUP BY ALL",
    "tile_reassemble": _sum,
    "tile_order_rowmajor": f"WITH {GRID} SELECT img_id, tx, ty, CAST(row_number() OVER (PARTITION BY img_id ORDER BY ty, tx) - 1 AS INTEGER) AS place FROM grid",
    "tile_order_morton": f"WITH {GRID} SELECT img_id, tx, ty, CAST(row_number() OVER (PARTITION BY img_id ORDER BY {MORTON('CAST(tx AS BIGINT)', 'CAST(ty AS BIGINT)')}) - 1 AS INTEGER) AS place FROM grid",
    "morton_code": f"SELECT o_orderkey, {MORTON('(o_orderkey * 7919 % 16777216)', '(o_orderkey * 104729 % 16777216)')} AS code FROM orders",
    "morton_decode": "SELECT o_orderkey, o_orderkey * 7919 % 16777216 AS x, o_orderkey * 104729 % 16777216 AS y FROM orders",
    "adam7_extract": cells_sql() + f", ps AS (SELECT img_id, {PASS} AS pass, i, v FROM cells), rk AS (SELECT img_id, pass, v, row_number() OVER (PARTITION BY img_id, pass ORDER BY i) AS k FROM ps) SELECT img_id, pass, CAST(count(*) AS INTEGER) AS n, CAST(sum(k * v) AS BIGINT) AS pass_check FROM rk GROUP BY ALL",
    "adam7_reconstruct": _sum,
    "adam7_dims": f"WITH {SIZES} {_dims}",
    "evenodd_extract": cells_sql() + " SELECT img_id, CAST(y % 2 AS INTEGER) AS pass, count(*) AS n, CAST(sum(((y // 2) * 16 + x + 1) * v) AS BIGINT) AS pass_check FROM cells GROUP BY ALL",
    "evenodd_reconstruct": _sum,
    "byte_shuffle": cells_sql() + f" SELECT img_id, {_shuffles} FROM cells GROUP BY 1",
    "byte_unshuffle": cells_sql() + " SELECT img_id, CAST(sum((i + 1) * v) AS BIGINT) AS byte_check FROM cells GROUP BY 1",
    "pack_samples": cells_sql() + f" SELECT p1.img_id, CAST(p1.y AS INTEGER) AS y, pack1, pack2, pack4 FROM {_pack_sql(1)} JOIN {_pack_sql(2)} USING (img_id, y) JOIN {_pack_sql(4)} USING (img_id, y)",
    "unpack_samples": cells_sql() + " SELECT img_id, CAST(y AS INTEGER) AS y, " + ", ".join(f"CAST(sum((x + 1) * (v >> {8 - k})) AS BIGINT) AS back{k}" for k in (1, 2, 4)) + " FROM cells WHERE x < 13 GROUP BY ALL",
    "pack_indices": cells_sql() + " SELECT img_id, CAST(y AS INTEGER) AS y, CAST(sum((x // 2 + 1) * ((v & 15) << (4 * (1 - x % 2)))) AS BIGINT) AS packed FROM cells GROUP BY ALL",
    "unpack_indices": cells_sql() + " SELECT img_id, CAST(y AS INTEGER) AS y, CAST(sum((x + 1) * (v & 15)) AS BIGINT) AS unpacked FROM cells GROUP BY ALL",
    "bytes_per_row": f"WITH {SIZES} SELECT img_id, " + ", ".join(f"CAST((w * {k} + 7) // 8 AS BIGINT) AS d{k}" for k in (1, 2, 4, 8)) + " FROM geo",
    "rgb_to_gray": f"WITH {PIXELS} SELECT img_id, i, CAST({GRAY_SQL} AS INTEGER) AS gray FROM px",
    "rgba_to_color_type": f"WITH {PIXELS} SELECT img_id, {_types} FROM px GROUP BY 1",
    "color_type_to_rgba": f"WITH {PIXELS} SELECT img_id, " + ", ".join(_back_sql(k, d) for k in (0, 2, 4, 6) for d in C.DEPTHS[k]) + " FROM px GROUP BY 1",
    "color_with_format": f"WITH {PIXELS}, g AS (SELECT img_id, i, {GRAY_SQL} AS gray FROM px) SELECT img_id, i, CAST(gray AS INTEGER) AS from_float, round(CAST(CAST(gray / 255.0 AS FLOAT) AS DOUBLE), 6) AS as_float FROM g",
    "half_u8": f"WITH {PIXELS} SELECT DISTINCT r, r AS back FROM px",
    "bytes_per_pixel": f"SELECT CAST(t AS INTEGER) AS color_type, CAST(d AS INTEGER) AS bit_depth, CAST(n AS INTEGER) AS bytes, CAST(s AS INTEGER) AS samples FROM (VALUES {_bpp}) v(t, d, n, s)",
    "primaries_matrices": f"WITH {FLOATS} SELECT img_id, p, " + ", ".join(f"round({x}, 7) AS {n}{k}" for k in T.TO_XYZ for n, x in zip("xyz", _mul_sql(T.TO_XYZ[k], ["r", "g", "b"]), strict=True)) + " FROM fl",
    "convert_primaries": f"WITH {FLOATS} SELECT img_id, p, " + ", ".join(f"round({x}, 6) AS {n}{s}{t}" for s in T.TO_XYZ for t in T.TO_XYZ for n, x in zip("rgb", _convert_sql(["r", "g", "b"], s, t), strict=True)) + " FROM fl",
    "tonemap_pixel": _pixel_sql,
    "tonemap_image": _image_sql,
    "palette_lookup": f"WITH {INDICES}, {PAL} SELECT img_id, i, idx, coalesce(r, 0) AS r, coalesce(g, 0) AS g, coalesce(b, 0) AS b, coalesce(a, 255) AS a FROM ind LEFT JOIN pal USING (idx)",
    "index_to_rgba": f"WITH {INDICES}, {PAL} SELECT img_id, i, idx, r, g, b, a FROM ind JOIN pal USING (idx)",
    "palette_nearest": f"WITH {PIXELS}, {PAL}, {_nearest_sql('rgba')} SELECT img_id, i, idx, dist FROM px JOIN near USING (r, g, b, a)",
    "palette_nearest_rgb": f"WITH {PIXELS}, {PAL}, {_nearest_sql('rgb')} SELECT img_id, i, idx, dist FROM px JOIN near USING (r, g, b)",
    "quantize_dispatch": _dispatch,
    "quantize_nn": _nn,
    "split_bucket": f"WITH {PIXELS}, c AS (SELECT DISTINCT img_id, r, g, b FROM px WHERE a > 0), m AS (SELECT img_id, max(r) - min(r) AS wr, max(g) - min(g) AS wg, max(b) - min(b) AS wb, count(*) AS n FROM c GROUP BY 1), k AS (SELECT img_id, r, g, b, n, row_number() OVER (PARTITION BY img_id ORDER BY CASE WHEN wr >= wg AND wr >= wb THEN r WHEN wg >= wb THEN g ELSE b END, r, g, b) AS rn FROM c JOIN m USING (img_id)) SELECT img_id, r, g, b, CAST(CASE WHEN rn > n // 2 THEN 1 ELSE 0 END AS INTEGER) AS half FROM k",
    "palette_bit_depth": f"WITH {COARSE}, n AS (SELECT img_id, count(DISTINCT (r, g, b)) AS n FROM few GROUP BY 1 UNION ALL SELECT p_partkey + 1000, p_partkey % 256 + 1 FROM part) SELECT img_id, n, CASE WHEN n <= 2 THEN 1 WHEN n <= 4 THEN 2 WHEN n <= 16 THEN 4 ELSE 8 END AS depth FROM n",
    "variance_bucket": f"WITH {PIXELS}, c AS (SELECT DISTINCT img_id, r, g, b FROM px WHERE a > 0) SELECT img_id, round(var_pop(r) + var_pop(g) + var_pop(b), 6) AS variance FROM c GROUP BY 1",
    "color_histogram": f"WITH {COARSE} SELECT img_id, r, g, b, count(*) AS count FROM few WHERE a > 0 GROUP BY ALL",
    "detect_indexed": f"WITH {COARSE}, u AS (SELECT * FROM few UNION ALL SELECT img_id + 100, i, r, g, b, a FROM px) SELECT img_id, count(DISTINCT (r, g, b, a)) AS colors, count(DISTINCT (r, g, b, a)) <= 256 AS indexed FROM u WHERE i % 10 = 0 GROUP BY 1",
    "detect_grayscale": f"WITH {GRAYS} SELECT img_id, bool_and(r = g AND g = b) AS gray FROM gr WHERE i % 100 = 0 GROUP BY 1",
    "detect_color_type": f"WITH {GRAYS}, d AS (SELECT img_id, bool_and(r = g AND g = b) AS gray, bool_or(a < 255) AS alpha FROM gr WHERE i % 100 = 0 GROUP BY 1) SELECT img_id, CASE WHEN gray AND alpha THEN 4 WHEN gray THEN 0 WHEN alpha THEN 6 ELSE 2 END AS color_type FROM d",
} | {name: f"WITH {PIXELS} SELECT img_id, i, {', '.join(sql)} FROM px" for name, (_, sql) in CONVERSIONS.items()} | {name: sql for name, (_, sql) in CURVES.items()}

#: Queries over the tiles of texts.
TILED = (
    "tile_rows", "tile_extract", "tile_reassemble", "adam7_extract", "adam7_reconstruct", "evenodd_extract", "evenodd_reconstruct", "byte_shuffle", "byte_unshuffle",
    "pack_samples", "unpack_samples", "pack_indices", "unpack_indices",
)
QUERIES |= {k: flat(QUERIES[k]) for k in TILED}
ORACLES |= {k: flat_sql(ORACLES[k]) for k in TILED}
