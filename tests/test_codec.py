"""Blocks, filters, containers and whole files: known answers, properties, and broken inputs."""

import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import color as C
from tessera.functions import container as K
from tessera.functions import geometry as G
from tessera.functions import predictors as P
from tessera.operators import codec, quantize
from tessera.plans import lifecycle as L
from tessera.plans.options import EncodeOptions

RNG = np.random.default_rng(5)


def image(w, h, kind="mixed"):
    y, x = np.mgrid[0:h, 0:w]
    v = {"mixed": (17 * x, 17 * y, x * y + 1, x + 7 * y), "flat": (0 * x + 9, 0 * x + 8, 0 * x + 7, 0 * x + 255), "ramp": (3 * x, 5 * y, x + 2 * y, 0 * x + 255)}[kind]
    return np.stack(v, -1).astype(np.uint8)


def one(spark, rgba, options=None, indexed=False):
    d = spark.createDataFrame([(1, rgba.shape[1], rgba.shape[0], bytearray(rgba.tobytes()))], "img_id bigint, width int, height int, pixels binary")
    files = (L.encode_indexed if indexed else L.encode)(d, options)
    return bytes(files.first()["content"])


def back(content, **more):
    (f, rgba), = L.read_containers([content], **more)
    return f, rgba


@pytest.mark.parametrize("options", [
    EncodeOptions(), EncodeOptions(use_filter=False), EncodeOptions(use_byte_shuffle=True), EncodeOptions(interlace_method=1), EncodeOptions(interlace_method=2), EncodeOptions(tile_rows=3),
    EncodeOptions(tile_size=(8, 8)), EncodeOptions(tile_size=(25, 11), scan_order=1), EncodeOptions(filter_heuristic="quick_prune"), EncodeOptions(adaptive_analysis=True), EncodeOptions(target_bit_depth=16),
    EncodeOptions(target_bit_depth=32), EncodeOptions(target_bit_depth=10), EncodeOptions(sample_format=1), EncodeOptions(sample_format=2), EncodeOptions(auto_dictionary=True, tile_rows=2),
])
def test_files_return_what_they_hold(spark, options):
    rgba = image(33, 23)
    f, got = back(one(spark, rgba, options))
    assert f.fault is None
    assert (got == rgba).all()


@pytest.mark.parametrize(("kind", "depth"), [(0, 1), (0, 2), (0, 4), (0, 8), (0, 16), (4, 4), (4, 8), (4, 12), (2, 8), (2, 10)])
def test_colour_types(spark, kind, depth):
    rgba = image(13, 9)
    f, got = back(one(spark, rgba, EncodeOptions(target_color_type=kind, target_bit_depth=depth)))
    v = rgba.astype(int)
    want = v.copy()
    if kind in (0, 4):
        want[..., :3] = ((299 * v[..., 0] + 587 * v[..., 1] + 114 * v[..., 2]) // 1000)[..., None]
    if kind in (0, 2):
        want[..., 3] = 255
    if depth < 8:
        keep = want.copy()
        want = (want >> (8 - depth)) * (255 // (2**depth - 1))
        want[..., 3] = 255 if kind == 0 else (keep[..., 3] >> (8 - depth)) * (255 // (2**depth - 1))
    assert abs(got.astype(int) - want).max() <= (0 if depth not in (10, 12) else 1)


@pytest.mark.parametrize("algorithm", ["nearest", "median-cut"])
def test_indexed(spark, algorithm):
    rgba = (image(40, 30) // 64 * 64).astype(np.uint8)
    rgba[..., 3] = 255
    f, got = back(one(spark, rgba, EncodeOptions(palette_algorithm=algorithm), indexed=True))
    assert f.header.color_type == 3
    assert (got == rgba).all()
    many = image(64, 64, "ramp")
    f, got = back(one(spark, many, EncodeOptions(palette_algorithm=algorithm), indexed=True))
    assert len(f.palette) == 256
    if algorithm == "nearest":  # the palette is the first 256 colours, here of the first four rows
        assert (got[:4] == many[:4]).all()
    else:
        assert abs(got.astype(int) - many).mean() < 10


def test_metadata(spark):
    o = EncodeOptions(exif=b"1234567", icc_profile=b"\xab" * 96, xmp_metadata="<xmp/>", json_metadata={"camera": {"iso": 100}, "author": "x"}, dictionary=None)
    f, _ = back(one(spark, image(16, 16), o))
    assert f.meta["exif"] == b"1234567" and f.meta["icc"] == b"\xab" * 96 and f.meta["xmp"] == "<xmp/>"
    assert f.meta["json"] == {"camera": {"iso": 100}, "author": "x"}


def test_metadata_as_a_table(spark):
    o = EncodeOptions(exif=b"1234567", icc_profile=b"\xab" * 96, xmp_metadata="<xmp/>", json_metadata={"camera": {"iso": 100}, "author": "x"}, hdr=K.Hdr(1, 2, 5.0))
    content = one(spark, image(16, 16), o)
    head = len(K.SIGNATURE) + 9 + 14 + 4
    early = K.write_chunk("xMPd", 0, b"\xff") + K.write_chunk("iCCP", 1, b"not packed") + K.write_chunk("cHDR", 0, b"short") + K.write_chunk("jSON", 0, b"\x06camera[1]") + K.write_chunk("jSON", 0, b"\xffab") + K.write_chunk("jSON", 0, b"")
    late = K.write_chunk("eXIF", 0, b"second") + K.write_chunk("jSON", 0, b"\x06camera{") + K.write_chunk("IEND", 0, b"")
    files = spark.createDataFrame([(1, bytearray(content[:head] + early + content[head:-13] + late)), (2, bytearray(one(spark, image(4, 4)))), (3, bytearray(b""))], "img_id bigint, content binary")
    got = {(r.img_id, r.kind, r.namespace): bytes(r.data) for r in L.metadata(files).collect()}
    assert got == {
        (1, "exif", ""): b"1234567", (1, "icc", ""): b"\xab" * 96, (1, "xmp", ""): b"<xmp/>", (1, "hdr", ""): K.Hdr(1, 2, 5.0).pack(), (1, "json", "camera"): b'{"iso": 100}', (1, "json", "author"): b'"x"',
    }
    f, _ = back(bytes(files.first().content))
    assert (f.meta["exif"], f.meta["xmp"], f.meta["hdr"], f.meta["json"]) == (b"1234567", "<xmp/>", K.Hdr(1, 2, 5.0), {"camera": {"iso": 100}, "author": "x"})


def test_warnings(spark):
    good = one(spark, image(8, 8), EncodeOptions(use_filter=False))
    head = len(K.SIGNATURE) + 9 + 14 + 4
    cases = [good, good[:-13], good + b"more", good[:head] + good[len(K.SIGNATURE) : head] + good[head:]]
    files = spark.createDataFrame([(k, bytearray(c)) for k, c in enumerate(cases)], "img_id bigint, content binary")
    got = {r.img_id: (r.fault, r.warnings, bytes(r.pixels)) for r in L.decode(files).collect()}
    assert got == {k: (None, w, image(8, 8).tobytes()) for k, w in enumerate(["", "no_end", "trailing", "second_header"])}


def test_byte_shuffle_of_other_pixel_sizes_is_refused():
    for bad in ({"target_color_type": 2}, {"target_color_type": 0}, {"target_color_type": 2, "target_bit_depth": 16}, {"interlace_method": 1}):
        with pytest.raises(ValueError, match="byte shuffle"):
            EncodeOptions(use_byte_shuffle=True, **bad)
    f, rgba = back(chunked(H(color_type=2, filter_method=1), ("IDAT", 0, b"\x00" * 48), ("IEND", 0, b"")))
    assert rgba is None and f.fault == "feature"


def test_tone_mapping_of_float_files(spark):
    f, got = back(one(spark, image(4, 4), EncodeOptions(sample_format=1, hdr=K.Hdr(0, 0, 1.0, 0.0))))
    assert f.fault is None and got.shape == (4, 4, 4)
    f, got = back(one(spark, image(4, 4), EncodeOptions(sample_format=1, target_color_type=2, hdr=K.Hdr(0, 0, 1.0, 0.0))))
    assert f.fault == "feature"


def chunked(header: bytes, *chunks) -> bytes:
    return K.SIGNATURE + K.write_chunk("IHDR", 0, header) + b"".join(K.write_chunk(*c) for c in chunks)


H = lambda **k: K.Header(**({"width": 4, "height": 4} | k)).pack()
BROKEN = {
    "empty": (b"", "signature"), "short signature": (K.SIGNATURE[:5], "signature"), "wrong signature": (b"\x88" + K.SIGNATURE[1:], "signature"), "signature only": (K.SIGNATURE, "missing"),
    "long length": (K.SIGNATURE + struct.pack(">I", 2**32 - 1) + b"IHDR\x00", "truncated"), "digits in type": (K.SIGNATURE + struct.pack(">I", 0) + b"IH1R\x00" + struct.pack(">I", 0), "chunk_type"),
    "bad crc": (K.SIGNATURE + struct.pack(">I", 0) + b"IEND\x00" + struct.pack(">I", 1), "crc"), "no width": (chunked(H(width=0)), "feature"), "no height": (chunked(H(height=0)), "feature"),
    "huge": (chunked(H(width=2**32 - 1, height=2**32 - 1), ("IEND", 0, b"")), "truncated"), "bomb": (chunked(H(), ("IDAT", *codec.compress(b"\x00" * 10**6))), "limit"),
    "many small bombs": (chunked(H(), *[("IDAT", 0, b"\x00" * 60)] * 2), "limit"), "no data": (chunked(H(), ("IEND", 0, b"")), "truncated"), "unknown flag": (chunked(H(), ("IDAT", 7, b"x")), "block"),
    "garbage block": (chunked(H(), ("IDAT", 1, b"x" * 9)), "block"), "filter code 16": (chunked(H(), ("IDAT", 0, b"\x10" + b"\x00" * 64)), "truncated"), "unknown critical chunk": (chunked(H(), ("ABCD", 0, b"")), "feature"),
    "no palette": (chunked(H(color_type=3), ("IDAT", 0, b"\x00" * 17)), "missing"), "scan order": (chunked(H(), ("iDIM", 0, K.Tiling(2, 2, 2, 2, 2).pack())), "feature"), "forged grid": (chunked(H(), ("iDIM", 0, K.Tiling(2, 2, 9, 9).pack()), ("IDAT", 0, b"\x00" * 9)), "feature"),
    "shuffle with passes": (chunked(H(filter_method=1, interlace_method=1)), "feature"), "half with 8 bits": (chunked(H(sample_format=2)), "feature"), "data before header": (K.SIGNATURE + K.write_chunk("IDAT", 0, b""), "missing"),
}


@pytest.mark.parametrize("name", BROKEN)
def test_broken_files_have_a_fault(name):
    content, fault = BROKEN[name]
    f, rgba = back(content)
    assert rgba is None
    assert f.fault == fault


def test_broken_files_in_a_table(spark):
    rows = [(k, bytearray(c)) for k, (c, _) in enumerate(BROKEN.values())]
    d = spark.createDataFrame(rows, "img_id bigint, content binary")
    got = {r.img_id: r.fault for r in L.decode(d).collect()}
    assert got == {k: f for k, (_, f) in enumerate(BROKEN.values())}
    with pytest.raises(Exception, match="ContainerError"):
        L.decode(d, mode="FAILFAST").count()


def test_unknown_ancillary_chunks_and_bad_metadata_are_dropped(spark):
    content = one(spark, image(8, 8))
    head = len(K.SIGNATURE) + 9 + 14 + 4
    extra = K.write_chunk("zzZZ", 0, b"?") + K.write_chunk("jSON", 0, b"\x03abc{") + K.write_chunk("jSON", 0, b"\xffab") + K.write_chunk("xMPd", 0, b"\xff") + K.write_chunk("cHDR", 0, b"12")
    f, rgba = back(content[:head] + extra + content[head:])
    assert f.fault is None and (rgba == image(8, 8)).all() and f.meta == {"json": {}}


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=200))
def test_random_bytes_never_crash(data):
    f, rgba = back(K.SIGNATURE + data)
    assert f.fault and rgba is None


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 6), st.integers(1, 4), st.integers(1, 9), st.integers(0, 15), st.integers(0, 2**31))
def test_filters_are_undone(bpp, pixels, height, code, seed):
    stride = bpp * pixels
    tile = np.random.default_rng(seed).integers(0, 256, (height, stride)).astype(np.uint8)
    stack = codec.Stack([tile.ravel(), tile.ravel()[::-1].copy()], stride, bpp)
    res = stack.split(stack.residuals(code))
    got = codec.restored([bytes([code]) + r.astype(np.uint8).tobytes() for r in res], stride, bpp)
    assert got == [tile.tobytes(), tile.ravel()[::-1].tobytes()]


@settings(max_examples=30, deadline=None)
@given(st.binary(max_size=600))
def test_blocks(data):
    flag, packed = codec.compress(data, 3)
    assert len(packed) <= len(data) and (flag == 1) == (len(packed) < len(data))
    assert codec.decompress(flag, packed, len(data)) == data


def test_crc_is_the_usual_one(spark):
    d = spark.createDataFrame([("jSON", 0, bytearray(b"abc")), ("IDAT", 1, bytearray(b""))], "type string, flag int, data binary")
    for r in d.select("*", K.crc(F.col("type"), F.col("flag"), F.col("data")).alias("c"), K.chunk(F.col("type"), F.col("flag"), F.col("data")).alias("b")).collect():
        assert r.c == zlib.crc32(r.type.encode() + bytes([r.flag]) + bytes(r.data))
        assert bytes(r.b) == K.write_chunk(r.type, r.flag, bytes(r.data))


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_known_answers(spark):
    for (x, y), code in {(0, 0): 0, (1, 0): 1, (0, 1): 2, (1, 1): 3, (2, 0): 4, (3, 0): 5}.items():
        assert value(spark, G.morton(F.lit(x), F.lit(y))) == code
    n = lambda *v: [F.lit(x) for x in v]
    for given_, want in (((40, 30, 20, 10), 25), ((40, 30, 20, 200), 72), ((100, 100, 100, 0), 75), ((100, 100, 100, 200), 125)):
        assert value(spark, P.predict(14, *n(*given_, 0, 0))) == want
    assert value(spark, P.weighted(n(8, 8, 8, 8), n(100, 100, 100, 100))) == 100
    assert value(spark, F.array(*P.reweighted(n(8, 8, 8, 8), n(100, 200, 200, 200), F.lit(100)))) == [9, 7, 7, 7]
    assert value(spark, C.pack(F.array(*n(0, 1)), 1)) == [0x40]
    assert [value(spark, C.reduce(F.lit(v), 2)) for v in (63, 64, 192)] == [0, 1, 3]
    assert [value(spark, C.narrow(F.lit(v), d)) for v, d in ((1023, 10), (65535, 16), (0xFFFFFFFF, 32))] == [255, 255, 255]
    assert value(spark, C.shuffle(F.array(*n(0x12, 0x34, 0x56, 0x78, 0x9A, 0xBC)), 2)) == [0x12, 0x56, 0x9A, 0x34, 0x78, 0xBC]
    assert [K.Header(4, 4).budget, K.Header(4, 4, color_type=3).budget, K.Header(4, 4, interlace_method=1).budget, K.Header(4, 4, interlace_method=2).budget] == [68, 20, 71, 66]
    assert [len(K.Hdr().pack()), len(K.Hdr(max_cll=1).pack()), len(K.Hdr(max_cll=1, max_fall=2).pack())] == [10, 14, 18]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**31 - 1), st.integers(0, 2**31 - 1)), min_size=1, max_size=20))
def test_morton_round_trip(spark, points):
    d = spark.createDataFrame(points, "x bigint, y bigint").withColumn("m", G.morton(F.col("x"), F.col("y")))
    for r in d.select("x", "y", G.morton_x(F.col("m")).alias("a"), G.morton_y(F.col("m")).alias("b")).collect():
        assert (r.x, r.y) == (r.a, r.b)


def test_passes_are_first_cover():
    owner = L.pass_map(40, 40, K.ADAM7)
    for y in range(40):
        for x in range(40):
            want = next((k + 1 for k, (xs, xo, ys, yo) in enumerate(G.PASSES) if x >= xo and y >= yo and (x - xo) % xs == 0 and (y - yo) % ys == 0), 7)
            assert owner[y, x] == want


def test_median_cut():
    colors = np.array([(r, g, 0) for r in range(0, 256, 16) for g in range(0, 256, 32)])
    cut = quantize.cut(colors, 16)
    assert len(cut) == 16 and len(np.unique(cut, axis=0)) == 16
    assert (quantize.cut(colors[:5], 16) == colors[:5]).all()
    with pytest.raises(ValueError, match="palette"):
        quantize.median_cut(None, 300)


def test_options():
    assert EncodeOptions.of({"tileRows": "8", "use-filter": "false", "filter_heuristic": "msad"}) == EncodeOptions(tile_rows=8, use_filter=False, filter_heuristic="msad")
    for bad in ({"filter_heuristic": "best"}, {"use_byte_shuffle": True, "interlace_method": 1}, {"interlace_method": 1, "target_color_type": 2}, {"tile_size": (4, 4), "target_bit_depth": 4, "target_color_type": 0}):
        with pytest.raises(ValueError, match="."):
            EncodeOptions(**bad)


def test_chunk_source(spark, tmp_path):
    from tessera.sources import containers

    containers.register(spark)
    rows = [(k, bytearray(one(spark, image(8, 8 + k)))) for k in range(3)] + [(9, bytearray(b"nothing"))]
    files = spark.createDataFrame(rows, "img_id bigint, content binary")
    containers.write_files(files, str(tmp_path), "bin")
    d = spark.read.format("rasterchunk").load(str(tmp_path))
    assert d.where("type = 'IDAT'").count() == 3
    assert {r.fault for r in d.where("fault is not null").collect()} == {"signature"}
    assert containers.decode_files(spark, str(tmp_path)).where("fault is null").count() == 3
