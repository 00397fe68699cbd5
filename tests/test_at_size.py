"""What kept queries from larger tables: rows of bytes that were shuffled, batches that grew with the images."""

import numpy as np

from tessera.operators import codec
from tessera.plans import filter_queries
from tessera.plans import lifecycle as L
from tessera.plans import raster_queries as R


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("hashpartitioning")


def test_passes_are_cut_where_the_tile_is(spark, sf):
    assert shuffles(R.adam7_extract(spark, sf)) == 0


def test_passes_are_put_together_where_the_tile_is(spark, sf):
    assert shuffles(R.adam7_reconstruct(spark, sf)) == 0


def test_passes_of_tiles_of_many_sizes():
    rng = np.random.default_rng(1)
    tiles = [rng.integers(0, 256, 16 * (k % 16 + 1), dtype=np.uint8).tobytes() for k in range(40)]
    cut = codec.interlaced(tiles, 16)
    for t, parts in zip(tiles, cut, strict=True):
        owner = L.pass_map(len(t) // 16, 16, 1).ravel()
        assert parts == [np.frombuffer(t, np.uint8)[owner == k].tobytes() for k in range(1, 8)]
    assert codec.deinterlaced(cut, 16) == tiles
    cut[3][6] = cut[3][6][:-1]
    assert codec.deinterlaced(cut, 16) == [*tiles[:3], None, *tiles[4:]]


def test_weighted_filter_is_not_walked_by_bytes(monkeypatch):
    monkeypatch.setattr(codec, "walked", None, raising=False)
    tile = np.random.default_rng(2).integers(0, 256, 64 * 4096, dtype=np.uint8).tobytes()
    assert len(codec.payloads([tile], 4096, 16)[0]) == len(tile) + 1


def test_large_tiles_are_not_undone_by_bytes(monkeypatch):
    rng = np.random.default_rng(3)
    tiles = [rng.integers(0, 256, 96 * h, dtype=np.uint8) for h in (50, 1, 64)]
    for code in range(15):
        stack = codec.Stack(tiles, 96, 6)
        left = stack.split(stack.residuals(code))
        by_bytes = codec.walked(left, code, 96, 6, True)
        with monkeypatch.context() as m:
            m.setattr(codec, "walked", None)
            by_pixels = codec.fold(left, code, 96, 6, True)
        assert all((a == t).all() and (b == t).all() for a, b, t in zip(by_bytes, by_pixels, tiles, strict=True))


def test_weighted_residuals_are_those_of_the_walk():
    rng = np.random.default_rng(4)
    for stride, bpp in ((16, 1), (96, 6), (512, 16)):
        tiles = [np.cumsum(rng.integers(-9, 10, stride * h)).astype(np.uint8) for h in (7, 1, 20)]
        want = codec.walked(tiles, 15, stride, bpp, False)
        assert all((a == b).all() for a, b in zip(codec.fold(tiles, 15, stride, bpp, False), want, strict=True))


def test_sizes_leave_python_without_residuals(spark, sf):
    plan = filter_queries.compression_test(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1, plan  # residuals of all filters came back as arrays, to be compressed by a second function


def test_indexed_images_are_made_in_portions(spark):
    images = spark.createDataFrame([(k, 16, 16, bytearray(bytes([k, k, k, 255]) * 256)) for k in range(20)], "img_id bigint, width int, height int, pixels binary").coalesce(1)
    files = L.encode_indexed(images).collect()
    assert [r.img_id for r in L.decode(L.encode_indexed(images)).orderBy("img_id").collect()] == list(range(20))
    assert "MapInArrow" in L.encode_indexed(images)._jdf.queryExecution().executedPlan().toString()
    groups = list(L.in_portions([r.img_id for r in files], [r.content for r in files], 100))
    assert [len(g) for g in groups] == [4, 4, 4, 4, 4]


def test_portions():
    assert list(codec.portions([3, 3, 9, 1, 1], 6)) == [(0, 2), (2, 3), (3, 5)] and list(codec.portions([])) == []


def two_ways(monkeypatch, **options):
    """A picture of several strips in a format, filtered and restored without a walk by bytes."""
    monkeypatch.setattr(codec, "walked", None, raising=False)
    rgba = np.frombuffer(b"words of a text " * (130 * 64), np.uint8).reshape(130, 256, 4)
    parts = L.cut(rgba, L.EncodeOptions(**options))
    made = codec.grouped(parts, codec.payloads)
    assert codec.grouped([(p, s, b) for p, (_, s, b) in zip(made, parts, strict=True)], codec.restored) == [p for p, _, _ in parts]


def test_rgb16_is_filtered_by_rows(monkeypatch):
    two_ways(monkeypatch, target_color_type=2, target_bit_depth=16)


def test_half_is_filtered_by_rows(monkeypatch):
    two_ways(monkeypatch, sample_format=2)


def test_unfiltered_strips_are_not_walked(monkeypatch):
    monkeypatch.setattr(codec, "slanted", None)
    monkeypatch.setattr(codec, "walked", None)
    strips = [np.arange(1536 * h).astype(np.uint8) for h in (64, 3)]
    assert all((a == b).all() for a, b in zip(codec.fold(strips, 0, 1536, 6, True), strips, strict=True))
    assert codec.restored([b"\0" + x.tobytes() for x in strips], 1536, 6) == [x.tobytes() for x in strips]


def test_weights_are_walked_by_stretches_of_a_row():
    class Counted(np.ndarray):
        calls = 0

        def __array_ufunc__(self, *a, **k):
            Counted.calls += 1
            plain = lambda x: x.view(np.ndarray) if isinstance(x, Counted) else x
            return getattr(a[0], a[1])(*map(plain, a[2:]), **{n: tuple(map(plain, x)) if n == "out" else x for n, x in k.items()})

    rng = np.random.default_rng(5)
    stack = codec.Stack([rng.integers(0, 256, 1536 * h, dtype=np.uint8) for h in (40, 24)], 1536, 6)
    step = (rng.integers(0, 2, (1536, 4, 64)) * 2 - 1).astype(np.int8)
    want, w = [], np.full((4, 2), 8)
    for y in range(40):
        at = [0, 1] if y < 24 else [0]
        rows = [y + 40 * k for k in at]
        for x in range(1536):
            want.append((x, rows, w[:, at].copy()))
            w[:, at] = np.clip(w[:, at] + step[x][:, rows], 0, 64)
    got = stack.weights(step.view(Counted))
    assert all((np.asarray(got)[x][:, rows] == of).all() for x, rows, of in want)
    assert Counted.calls < 1536  # two of a place and row before, for both walks


def test_weighted_residuals_of_odd_shapes():
    rng = np.random.default_rng(6)
    for stride, bpp, heights in ((96, 6, (3, 0, 2, 0)), (35, 7, (5, 1)), (1, 1, (4, 9)), (3, 4, (2, 2)), (640, 4, (0, 1))):
        tiles = [rng.integers(0, 256, stride * h, dtype=np.uint8) for h in heights]
        want = codec.walked(tiles, 15, stride, bpp, False)
        assert all((a == b).all() for a, b in zip(codec.fold(tiles, 15, stride, bpp, False), want, strict=True))


def formats():
    return [L.EncodeOptions(target_color_type=c, target_bit_depth=d) for c in (0, 2, 4, 6) for d in (8, 10, 12, 16, 32)] + [L.EncodeOptions(sample_format=f) for f in (1, 2)]


def test_samples_by_table_are_those_of_the_rule():
    rgba = np.random.default_rng(7).integers(0, 256, (5, 7, 4), dtype=np.uint8)
    for o in formats():
        v = rgba.astype(np.int64)
        gray = (299 * v[..., 0] + 587 * v[..., 1] + 114 * v[..., 2]) // 1000
        s = np.stack({0: [gray], 2: [v[..., k] for k in range(3)], 4: [gray, v[..., 3]], 6: [v[..., k] for k in range(4)]}[o.target_color_type], -1).reshape(5, -1)
        if o.sample_format:
            want = (s.astype(np.float32) / np.float32(255)).astype(">f4" if o.sample_format == 1 else ">f2")
        else:
            want = (s * 0x01010101).astype(">u4") if o.depth == 32 else s.astype(np.uint8) if o.depth == 8 else (s * 257 if o.depth == 16 else s * (2**o.depth - 1) // 255).astype(">u2")
        assert L.to_samples(rgba, o).tobytes() == want.tobytes(), o


def test_halves_are_shown_by_table(monkeypatch):
    every = np.arange(2**16, dtype=np.uint16).view(np.float16)
    with np.errstate(invalid="ignore"):
        f = np.nan_to_num(every.astype(np.float32), nan=0.0, posinf=1.0, neginf=0.0)
    want = np.floor(np.clip(f, 0, 1) * 255 + 0.5).astype(np.uint8)
    monkeypatch.setattr(L, "shown", None)  # one look-up a sample
    got = L.from_samples(every.astype(">f2").tobytes(), L.K.Header(2**14, 1, 16, L.K.HALF, 6))
    assert (got.ravel() == want).all()
