"""Block compression and whole-tile filters as Arrow-batched functions.

zstd and the sequential inverses have no built-in form, so bytes cross to Python in Arrow batches. A tile is bounded
(a strip of rows), so a batch of them is too. Flags: 0 raw, 1 zstd; a block is compressed only if that is smaller.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.geometry import PASSES

cloudpickle.register_pickle_by_value(sys.modules[__name__])
RAW, ZSTD, LEVEL, MAX_CHUNK = 0, 1, 19, 2**30
#: A dictionary needs this many bytes of samples, and is a tenth of them within these bounds; so many tiles are read.
DICT_MIN_TOTAL, DICT_MIN, DICT_MAX, DICT_TILES = 512, 256, 65536, 10
BLOCK = "struct<flag:int,data:binary>"
#: Bytes of tiles that are worked on at a time: their residuals under all filters are some 60 times as much, and arrays
#: that the processor's cache holds are faster. To undo one filter there is one array only.
BATCH_BYTES, UNDO_BYTES = 2**20, 2**22
#: Bytes of images that an Arrow batch's task holds unpacked at a time, whatever the batch has.
PORTION = 2**24


@dataclass(frozen=True)
class LimitExceeded(Exception):
    limit: int


def compress(data: bytes, level: int = LEVEL, dictionary: bytes | None = None) -> tuple[int, bytes]:
    """(flag, bytes): zstd if strictly smaller, else the bytes as they are."""
    of = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    packed = zstandard.ZstdCompressor(level=level, dict_data=of).compress(data)
    return (ZSTD, packed) if len(packed) < len(data) else (RAW, data)


def compress_all(blocks: list[bytes], level: int = LEVEL, dictionary: bytes | None = None) -> list[tuple[int, bytes]]:
    """compress() of many blocks, by one compressor."""
    of = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    z = zstandard.ZstdCompressor(level=level, dict_data=of)
    made = ((z.compress(x), x) for x in blocks)
    return [(ZSTD, packed) if len(packed) < len(x) else (RAW, x) for packed, x in made]


def portions(sizes: list[int], most: int = PORTION) -> Iterator[tuple[int, int]]:
    """Ranges of rows of these sizes in bytes that stay under a bound together; a row that is over it is alone."""
    start, total = 0, 0
    for k, n in enumerate(sizes):
        if k > start and total + n > most:
            yield start, k
            start, total = k, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def decompress(flag: int, data: bytes, limit: int = MAX_CHUNK, dictionary: bytes | None = None) -> bytes:
    """The bytes of a block; more than the limit, or another flag, is an error."""
    limit = min(limit, MAX_CHUNK)
    if flag == RAW:
        out = data
    elif flag == ZSTD:
        of = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        out = zstandard.ZstdDecompressor(dict_data=of).stream_reader(data).read(limit + 1)
    else:
        raise ValueError(f"unknown compression flag {flag}")
    if len(out) > limit:
        raise LimitExceeded(limit)
    return out


def train(samples: list[bytes]) -> bytes | None:
    """A dictionary from sample tiles, or None where they are too few or too small."""
    total = sum(map(len, samples))
    if total < DICT_MIN_TOTAL:
        return None
    try:
        return zstandard.train_dictionary(min(max(total // 10, DICT_MIN), DICT_MAX), samples).as_bytes()
    except zstandard.ZstdError:
        return None


def predictions(code: int, a, b, c, d, ll, uu):
    """What a stateless filter predicts, for whole arrays of neighbours at a time."""
    lo, hi = (np.minimum(a, b), np.maximum(a, b)) if code in (5, 7) else (a, b)
    near = lambda k: abs(b - c if k == 0 else a - c if k == 1 else a + b - 2 * c)
    rules = {
        0: lambda: 0 * a, 1: lambda: a, 2: lambda: b, 3: lambda: (a + b) >> 1,
        4: lambda: np.where((near(0) <= near(1)) & (near(0) <= near(2)), a, np.where(near(1) <= near(2), b, c)),
        5: lambda: np.where(c >= hi, lo, np.where(c <= lo, hi, (a + b - c) & 255)), 6: lambda: (a + b - c) & 255,
        7: lambda: np.maximum(lo, np.minimum(hi, c)), 8: lambda: np.clip((2 * a - ll + 2 * b - uu) >> 1, 0, 255),  # what is under 0 is 0, however it is halved
        9: lambda: (3 * a + b) >> 2, 10: lambda: (a + 3 * b) >> 2, 11: lambda: (a + b + 2 * c) >> 2, 12: lambda: (2 * a + 2 * b + c) // 5,
        13: lambda: np.where(near(1) > near(0), a, np.where(near(1) < near(0), b, (a + b) >> 1)), 14: lambda: (((a + c) >> 1) + ((b + d) >> 1)) >> 1,
    }
    return rules[code]()


class Stack:
    """The tiles of a batch, row under row: neighbours of all bytes by shifting, tile edges as zeros."""

    def __init__(self, tiles: list[np.ndarray], stride: int, bpp: int):
        self.heights = np.array([len(t) // stride for t in tiles], int)
        self.stride, self.bpp = stride, bpp
        self.rows = np.concatenate(tiles).astype(np.int16).reshape(-1, stride) if len(tiles) else np.zeros((0, stride), np.int16)
        self.bytes = self.rows.astype(np.uint8)
        y = np.concatenate([np.arange(h) for h in self.heights]) if len(tiles) else np.zeros(0, int)
        self.tile = np.repeat(np.arange(len(tiles)), self.heights)
        up = lambda k: np.where((y >= k)[:, None], np.vstack([np.zeros((k, stride), np.int16), self.rows[: len(self.rows) - k]]) if len(self.rows) >= k else 0, 0)
        left = lambda m, k: np.hstack([np.zeros((len(m), min(k, stride)), np.int16), m[:, : max(stride - k, 0)]])
        b = up(1)
        right = np.hstack([b[:, bpp:], np.zeros((len(b), min(bpp, stride)), np.int16)]) if bpp < stride else 0 * b
        self.neighbours = (left(self.rows, bpp), b, left(b, bpp), right, left(self.rows, 2 * bpp), up(2))

    def residuals(self, code: int) -> np.ndarray:
        if code == 15:
            return self.weighted()
        return self.bytes - predictions(code, *self.neighbours).astype(np.uint8)

    def weighted(self) -> np.ndarray:
        """The weighted filter: all neighbours are known, so only the weights are a walk. Arrays are (place in a row, row),
        neighbours are views of the bytes and of the rows above with zeros around them; all is done by ranges of places
        that the processor's cache holds."""
        n, (bpp, rows) = self.stride, (self.bpp, len(self.rows))
        own, above = np.zeros((n + bpp, rows), np.uint8), np.zeros((n + 2 * bpp, rows), np.uint8)
        own[bpp:] = self.bytes.T
        above[bpp : n + bpp, 1:] = own[bpp:, :-1]
        above[:, (np.cumsum(self.heights) - self.heights)[self.heights > 0]] = 0
        v, near = own[bpp:], (own[:n], above[bpp : n + bpp], above[:n], above[2 * bpp :])
        some = max(1, 2**16 // max(rows, 1))
        ranges = [slice(k, min(k + some, n)) for k in range(0, n, some)]
        step = np.empty((n, 4, rows), np.int8)
        for at in ranges:
            off = [np.maximum(v[at], x[at]) - np.minimum(v[at], x[at]) for x in near]
            mean = off[0].astype(np.uint16)
            for x in off[1:]:
                mean += x
            mean = (mean >> 2).astype(np.uint8)
            for k, x in enumerate(off):
                np.less_equal(x, mean, out=step[at, k].view(bool))
            step[at] += step[at]
            step[at] -= 1
        w = self.weights(step).view(np.uint8)
        out = np.empty((n, rows), np.uint8)
        for at in ranges:
            total, num = np.zeros(v[at].shape, np.uint16), np.zeros(v[at].shape, np.uint16)
            for k, x in enumerate(near):
                of = w[at, k].astype(np.uint16)
                total += of
                of *= x[at]
                num += of
            num += total >> 1
            p = num.astype(np.float32)  # exact enough: the numerator is under 2^16, the weights' sum at most 256
            p /= np.maximum(total, 1)
            np.subtract(v[at], p.astype(np.uint8), out=out[at])
        return np.ascontiguousarray(out.T)

    def weights(self, step: np.ndarray) -> np.ndarray:
        """The four weights before each byte, of which step (place, weight, row) has the steps. A weight walks by +1 or -1
        within 0 and 64, and its steps don't depend on it: after a stretch of a row it is its start plus the stretch's steps,
        held between what the walks from 0 and from 64 have become. So all stretches of all rows are walked from both ends
        at a time, then their first weights follow by tile, row and stretch, and all are walked once more from these."""
        kind, rows = np.int16 if self.stride < 2**14 else np.int32, len(self.rows)
        cuts = 1  # stretches of a row: steps are fewer and their arrays larger, up to what the cache holds
        while self.stride % (2 * cuts) == 0 and self.stride > 16 * cuts and rows * cuts < 2**12:
            cuts *= 2
        step = step.reshape(cuts, self.stride // cuts, 4, rows)
        ends = np.zeros((2, cuts, 4, rows), np.int8)
        ends[1] = 64
        add, least, most = np.add, np.minimum, np.maximum
        zero, top = np.zeros_like(ends), np.full_like(ends, 64)  # whole arrays, as numpy is many times slower with a single value
        for k in range(step.shape[1]):
            add(ends, step[:, k], ends)
            most(ends, zero, ends)
            least(ends, top, ends)
        total, (low, high) = step.sum(axis=1, dtype=kind), ends.astype(kind)
        first, now = np.cumsum(self.heights) - self.heights, np.full((4, len(self.heights)), 8, kind)
        out = np.empty_like(step)
        w = np.empty((cuts, 4, rows), np.int8)
        for y in range(self.heights.max(initial=0)):
            at = np.flatnonzero(self.heights > y)
            r, here = first[at] + y, now[:, at]
            for c in range(cuts):
                w[c][:, r] = here
                here = np.minimum(np.maximum(here + total[c][:, r], low[c][:, r]), high[c][:, r])
            now[:, at] = here
        out[:, :1] = w[:, None]
        for k in range(step.shape[1] - 1):
            after = out[:, k + 1]
            add(out[:, k], step[:, k], after)
            most(after, zero[0], after)
            least(after, top[0], after)
        return out.reshape(self.stride, 4, rows)

    def split(self, rows: np.ndarray) -> list[np.ndarray]:
        return [x.ravel() for x in np.split(rows, np.cumsum(self.heights)[:-1])] if len(self.heights) else []

    def by_tile(self, per_row: np.ndarray) -> np.ndarray:
        return np.bincount(self.tile, per_row, len(self.heights))


#: The filters that the adaptive choice tries by block type, in order of preference.
CANDIDATES = {"Smooth": (0, 1, 2, 3, 6, 5), "HighFreq": (15, 5, 4, 13, 14, 7, 8, 9, 10, 11, 12), "Natural": tuple(range(16)), "Mixed": tuple(range(16))}


def block_kind(tile: np.ndarray) -> str:
    """Smooth, Natural, HighFreq or Mixed, from the variances of the regions of a (height, stride) tile."""
    rh, rw = max(tile.shape[0] // 4, 1), max(tile.shape[1] // 4, 1)
    var = [float(tile[y : y + rh, x : x + rw].astype(np.float64).var()) for y in range(0, tile.shape[0], rh) for x in range(0, tile.shape[1], rw)]
    mean, high = round(sum(var) / len(var), 9), sum(round(v, 9) > 100 for v in var)
    return "Smooth" if mean < 10 else "Natural" if mean < 50 else "HighFreq" if high > len(var) // 3 else "Mixed"


def row_entropies(rows: np.ndarray) -> np.ndarray:
    """Shannon entropy of every row of bytes, from a histogram or the run lengths of the sorted rows."""
    if not rows.size:
        return np.zeros(len(rows))
    n = rows.shape[1]
    share = np.arange(n + 1) / n
    bits = np.concatenate([[0.0], -share[1:] * np.log2(share[1:])])
    rows = rows.astype(np.uint8, copy=False)
    if n >= 256:  # a histogram is smaller than the row
        out, some = np.empty(len(rows)), max(1, 2**16 // n)  # so many rows at a time that their keys stay in the cache
        base, keys = (np.arange(some) * 256)[:, None], np.empty((some, n), np.int64)
        for k in range(0, len(rows), some):
            part = rows[k : k + some]
            here = keys[: len(part)]
            here[:] = part
            here += base[: len(part)]
            out[k : k + some] = bits[np.bincount(here.ravel(), minlength=256 * len(part))].reshape(-1, 256).sum(axis=1)
        return out
    ordered = np.sort(rows, axis=1, kind="stable")  # of bytes, a radix sort
    first = np.ones(ordered.shape, bool)
    first[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
    starts = np.flatnonzero(first.ravel())
    runs = np.diff(np.append(starts, ordered.size))
    return np.bincount(starts // n, bits[runs], len(rows))


#: Tiles of more bytes than this are walked by pixels of all their rows, smaller ones by bytes.
WALKED = 2**12


def fold(tiles: list[np.ndarray], code: int, stride: int, bpp: int, inverse: bool) -> list[np.ndarray]:
    """All tiles of a batch in step: weighted residuals, or with inverse the bytes from any filter's residuals. Each step
    is one place of every tile, as arrays; a batch holds tiles of bounded size, best of like sizes."""
    if not tiles:
        return []
    if code == 0:  # its residuals are the bytes
        return [np.asarray(t).astype(np.uint8) for t in tiles]
    if code == 15 and not inverse:
        stack = Stack(tiles, stride, bpp)
        return stack.split(stack.weighted())
    if code != 15 and inverse and max(map(len, tiles)) > WALKED and stride % bpp == 0:
        return slanted(tiles, code, stride, bpp)
    return walked(tiles, code, stride, bpp, inverse)


def slanted(tiles: list[np.ndarray], code: int, stride: int, bpp: int) -> list[np.ndarray]:
    """The bytes from a stateless filter's residuals. A pixel needs its left neighbours and the row above as far as one
    pixel to the right, so all rows are worked on at a time, each two pixels behind the one above; the bytes of a pixel
    don't need each other. Two rows of zeros stand above every tile."""
    width, heights = stride // bpp, np.array([len(t) // stride for t in tiles])
    y = np.concatenate([np.arange(-2, h) for h in heights])
    real = np.flatnonzero(y >= 0)
    behind = 2 * y[real]
    steps = width + 2 * (int(heights.max()) - 1)
    pixels = np.concatenate([np.asarray(t, np.uint8) for t in tiles]).reshape(-1, width, bpp)
    left = np.zeros((steps, len(y), bpp), np.uint8)  # residuals by step and row
    x = np.arange(width)[None, :]
    left[behind[:, None] + x, real[:, None]] = pixels
    out = np.zeros((steps + 5, len(y), bpp), np.uint8)  # five steps of zeros come first
    for s in range(steps):
        t = s + 5
        at = lambda back, up: out[t - back, 2 - up : len(y) - up].astype(np.int16)  # noqa: B023, E731
        p = predictions(code, at(1, 0), at(2, 1), at(3, 1), at(1, 1), at(2, 0), at(4, 2))
        here = ((y[2:] >= 0) & (2 * y[2:] <= s) & (s < 2 * y[2:] + width)).astype(np.uint8)
        out[t, 2:] = (left[s, 2:] + p.astype(np.uint8)) * here[:, None]
    back = out[5 + behind[:, None] + x, real[:, None]].reshape(len(real), stride)
    return [r.ravel() for r in np.split(back, np.cumsum(heights)[:-1])]


def walked(tiles: list[np.ndarray], code: int, stride: int, bpp: int, inverse: bool) -> list[np.ndarray]:
    """fold() byte by byte."""
    sizes = np.array([len(t) for t in tiles])
    given = np.zeros((sizes.max(), len(tiles)), np.int32)
    for k, t in enumerate(tiles):
        given[: len(t), k] = t
    seen, out = np.zeros_like(given), np.zeros_like(given)
    w, none = np.full((4, len(tiles)), 8, np.int32), np.zeros(len(tiles), np.int32)
    for i in range(len(given)):
        x = i % stride
        a = seen[i - bpp] if x >= bpp else none
        b = seen[i - stride] if i >= stride else none
        c = seen[i - stride - bpp] if x >= bpp and i >= stride else none
        d = seen[i - stride + bpp] if x + bpp < stride and i >= stride else none
        if code == 15:
            n = np.stack([a, b, c, d])
            total = w.sum(axis=0)
            p = np.where(total > 0, np.minimum(255, ((w * n).sum(axis=0) + total // 2) // np.maximum(total, 1)), 0)
        else:
            p = predictions(code, a, b, c, d, seen[i - 2 * bpp] if x >= 2 * bpp else none, seen[i - 2 * stride] if i >= 2 * stride else none)
        out[i] = (given[i] + p if inverse else given[i] - p) & 255
        seen[i] = out[i] if inverse else given[i]
        if code == 15:
            off = abs(seen[i] - n)
            w = np.where(off <= off.sum(axis=0) // 4, np.minimum(w + 1, 64), np.maximum(w - 1, 0))
    return [out[:m, k] for k, m in enumerate(sizes)]


def _lists(fn, kind: str):
    """An Arrow function from tiles (binary or array<int>) to one value a tile, given all tiles of a batch at once."""
    read = lambda x: np.frombuffer(x, np.uint8) if isinstance(x, bytes) else np.asarray(x, np.int32)
    return F.pandas_udf(lambda s: pd.Series(fn([read(x) for x in s]), index=s.index, dtype=object), kind)


def weighted_residuals(tile: Column, bpp: int = 1, stride: int = 16) -> Column:
    return _lists(lambda t: fold(t, 15, stride, bpp, False), "array<int>")(tile)


def unfilter(residual: Column, code: int, bpp: int = 1, stride: int = 16) -> Column:
    return _lists(lambda t: fold(t, code, stride, bpp, True), "array<int>")(residual)


def all_residuals(tile: Column, bpp: int = 1, stride: int = 16) -> Column:
    """array<int>: the residuals under all 16 filters, one after the other."""

    def run(tiles):
        stack = Stack(tiles, stride, bpp)
        by_code = [stack.split(stack.residuals(k)) for k in range(16)]
        return [np.concatenate([r[t] for r in by_code]).astype(np.int32) for t in range(len(tiles))]

    return _lists(run, "array<int>")(tile)


def all_restored(residuals: Column, bpp: int = 1, stride: int = 16) -> Column:
    """array<int>: the bytes that each of the 16 parts of all_residuals stands for, one after the other."""

    def run(flat):
        parts = [np.split(x, 16) for x in flat]
        back = [fold([p[k] for p in parts], k, stride, bpp, True) for k in range(16)]
        return [np.concatenate([b[t] for b in back]) for t in range(len(flat))]

    return _lists(run, "array<int>")(residuals)


def sums(values: np.ndarray) -> tuple[int, int]:
    """The sum of the values and of (place + 1) * value, so that order counts."""
    v = np.asarray(values).astype(np.int64)
    return int(v.sum()), int((v * np.arange(1, len(v) + 1)).sum())


def _sums(tiles_to_parts, *arguments) -> Column:
    """array<bigint>: the sums of each part that a function over the tiles of a batch makes, by tile."""

    def run(tiles):
        return [np.array([x for part in parts for x in sums(part)], np.int64) for parts in tiles_to_parts(tiles)]

    return _lists(run, "array<bigint>")(*arguments)


def row_sums(tile: Column, code: int, bpp: int = 1, stride: int = 16) -> Column:
    """The sums of every row of a filter's residuals, one after the other."""

    def parts(tiles):
        stack = Stack(tiles, stride, bpp)
        return [x.reshape(-1, stride) for x in stack.split(stack.residuals(code))]

    return _sums(parts, tile)


def filter_sums(tile: Column, bpp: int = 1, stride: int = 16, inverse: bool = False) -> Column:
    """The sums of the residuals under all 16 filters, or with inverse of the bytes that come back from them."""

    def parts(tiles):
        stack = Stack(tiles, stride, bpp)
        by_code = [stack.split(stack.residuals(k)) for k in range(16)]
        if inverse:
            by_code = [fold(r, k, stride, bpp, True) for k, r in enumerate(by_code)]
        return [[r[t] for r in by_code] for t in range(len(tiles))]

    return _sums(parts, tile)


def weighted_sums(tile: Column, bpp: int = 1, stride: int = 16, inverse: bool = False) -> Column:
    """The sums of the weighted residuals of a tile, or with inverse of the bytes that come back from them."""

    def parts(tiles):
        r = fold(tiles, 15, stride, bpp, False)
        return [[x] for x in (fold(r, 15, stride, bpp, True) if inverse else r)]

    return _sums(parts, tile)


def byte_sums(data: Column) -> Column:
    """The sums of the bytes of a binary value."""
    return _sums(lambda tiles: [[t] for t in tiles], data)


def checked(images: DataFrame, keep: list[str], column: str, name: str) -> DataFrame:
    """The kept columns and the sum of (place + 1) * byte of a binary column, read from its batches in portions."""
    kinds = dict(images.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, found = b.column(column), []
            for lo, hi in portions([n or 0 for n in pc.binary_length(data).to_pylist()]):
                found += [None if x is None else sums(np.frombuffer(x, np.uint8))[1] for x in data.slice(lo, hi - lo).to_pylist()]
            yield pa.RecordBatch.from_arrays([*map(b.column, keep), pa.array(found, pa.int64())], names=[*keep, name])

    return images.select(*keep, column).mapInArrow(run, ", ".join([f"{c} {kinds[c]}" for c in keep] + [f"{name} bigint"]))


def shuffle(data: bytes, bpp: int) -> bytes:
    """All first bytes of the samples, then all second ones, and so on; what is left over after whole samples stays."""
    n = len(data) // bpp * bpp
    return np.frombuffer(data, np.uint8, n).reshape(-1, bpp).T.tobytes() + data[n:]


def unshuffle(data: bytes, bpp: int) -> bytes:
    n = len(data) // bpp * bpp
    return np.frombuffer(data, np.uint8, n).reshape(bpp, -1).T.tobytes() + data[n:]


def shuffled_bytes(data: Column, bpp: int, inverse: bool = False) -> Column:
    return _batch(lambda tiles: [(unshuffle if inverse else shuffle)(t, bpp) for t in tiles])(data)


def pass_places(size: int, stride: int) -> list[np.ndarray]:
    """For each Adam7 pass, the places of its bytes in a raster of so many bytes, row by row."""
    y, x = np.divmod(np.arange(size), stride)
    owner = np.full(size, len(PASSES) + 1)
    for k, (xs, xo, ys, yo) in reversed(list(enumerate(PASSES, 1))):
        owner[(x % xs == xo) & (y % ys == yo)] = k
    return [np.flatnonzero(owner == k) for k in range(1, len(PASSES) + 2)]


def by_size(tiles: list[np.ndarray]) -> dict[int, list[int]]:
    """The places in the batch of the tiles of each size."""
    out: dict[int, list[int]] = {}
    for k, t in enumerate(tiles):
        out.setdefault(len(t), []).append(k)
    return out


def interlaced(tiles: list[bytes], stride: int) -> list[list[bytes]]:
    """The passes of every tile of a batch."""
    out: list = [None] * len(tiles)
    for n, at in by_size(tiles).items():
        places = pass_places(n, stride)
        rows = np.frombuffer(b"".join(tiles[k] for k in at), np.uint8).reshape(len(at), n)
        parts = [(rows[:, p].tobytes(), len(p)) for p in places]
        for j, k in enumerate(at):
            out[k] = [d[j * m : (j + 1) * m] for d, m in parts]
    return out


def deinterlaced(passes: list[list[bytes]], stride: int) -> list[bytes | None]:
    """The tiles of a batch from their passes, whose places follow from the size alone; None where a pass has another size."""
    joined = [b"".join(p) for p in passes]
    out: list[bytes | None] = [None] * len(joined)
    for n, at in by_size(joined).items():
        places = pass_places(n, stride)
        at = [k for k in at if [len(p) for p in passes[k]] == [len(p) for p in places]]
        back = np.empty((len(at), n), np.uint8)
        back[:, np.concatenate(places)] = np.frombuffer(b"".join(joined[k] for k in at), np.uint8).reshape(len(at), n)
        for row, k in zip(back, at, strict=True):
            out[k] = row.tobytes()
    return out


def passes(tile: Column, stride: int = 16) -> Column:
    """array<binary>: the Adam7 passes of a tile, one byte per pixel; a tile is worked on where it is."""
    return F.pandas_udf(lambda s: pd.Series(interlaced(list(s), stride), index=s.index, dtype=object), "array<binary>")(tile)


def from_passes(parts: Column, stride: int = 16) -> Column:
    """The tile that passes() cut; null where a pass has another size than the tile's size says."""
    return F.pandas_udf(lambda s: pd.Series(deinterlaced([list(p) for p in s], stride), index=s.index, dtype=object), "binary")(parts)


def pass_sums(parts: Column) -> Column:
    """The size and the sum of (place + 1) * byte of each pass of a tile, one after the other."""

    def run(s: pd.Series) -> pd.Series:
        out = np.zeros((len(s), 2 * (len(PASSES) + 1)), np.int64)
        for k in range(len(PASSES) + 1):
            of = [p[k] for p in s]
            for n, at in by_size(of).items():
                out[at, 2 * k] = n
                out[at, 2 * k + 1] = np.frombuffer(b"".join(of[j] for j in at), np.uint8).reshape(len(at), n) @ np.arange(1, n + 1)
        return pd.Series(list(out), index=s.index, dtype=object)

    return F.pandas_udf(run, "array<bigint>")(parts)


def all_scores(tile: Column, bpp: int = 1, stride: int = 16) -> Column:
    """array of 16 (sum of residual bytes, sum of row entropies) by code, as numbers one after the other."""

    def run(tiles):
        stack = Stack(tiles, stride, bpp)
        cols = []
        for k in range(16):
            r = stack.residuals(k)
            cols += [stack.by_tile(r.sum(axis=1, dtype=np.int64)), stack.by_tile(row_entropies(r))]
        return list(np.stack(cols, axis=1)) if len(tiles) else []

    return _lists(run, "array<double>")(tile)


def choose_codes(stack: Stack, residuals: list[np.ndarray], heuristic: str, level: int = LEVEL) -> list[int]:
    """The filter code of every tile of a batch; ties as each heuristic has them."""
    n = len(stack.heights)
    msad = np.stack([stack.by_tile(r.sum(axis=1, dtype=np.int64)) for r in residuals]) if heuristic in ("msad", "quick_prune") else None
    if heuristic == "msad":
        return msad.argmin(axis=0).tolist()
    if heuristic == "compression_test":
        sizes = np.array([[len(compress(x.astype(np.uint8).tobytes(), level)[1]) for x in stack.split(r)] for r in residuals])
        return sizes.argmin(axis=0).tolist()
    entropy = np.round(np.stack([stack.by_tile(row_entropies(r)) for r in residuals]), 9)
    if heuristic == "entropy":
        return entropy.argmin(axis=0).tolist()
    if heuristic == "quick_prune":
        orders = [sorted(range(16), key=lambda k: (msad[k, t], k))[:8] for t in range(n)]
    else:
        orders = [CANDIDATES[block_kind(x.reshape(-1, stack.stride))] for x in stack.split(stack.rows)]
    return [min(order, key=lambda k: entropy[k, t]) for t, order in enumerate(orders)]


def payloads(tiles: list[bytes], stride: int, bpp: int, heuristic: str = "entropy", level: int = LEVEL) -> list[bytes]:
    """Code byte and residuals of every tile of a batch (tiles of one stride)."""
    stack = Stack([np.frombuffer(x, np.uint8) for x in tiles], stride, bpp)
    residuals = [stack.residuals(k) for k in range(16)]
    parts = [stack.split(r) for r in residuals]
    return [bytes([code]) + parts[code][t].astype(np.uint8).tobytes() for t, code in enumerate(choose_codes(stack, residuals, heuristic, level))]


def restored(payload: list[bytes], stride: int, bpp: int) -> list[bytes | None]:
    """Tiles from their payloads (of one stride); None for a code of 16 or more or a broken size."""
    out: list[bytes | None] = [None] * len(payload)
    by_code: dict[int, list[int]] = {}
    for k, p in enumerate(payload):
        if len(p) > 1 and p[0] < 16 and (len(p) - 1) % stride == 0:
            by_code.setdefault(p[0], []).append(k)
    for code, at in by_code.items():
        for k, v in zip(at, fold([np.frombuffer(payload[k], np.uint8, offset=1) for k in at], code, stride, bpp, True), strict=True):
            out[k] = v.astype(np.uint8).tobytes()
    return out


def grouped(parts: list[tuple[bytes, int, int]], fn, most: int = BATCH_BYTES) -> list:
    """fn(tiles, stride, bpp) over parts of many strides, in their order."""
    out: list = [None] * len(parts)
    groups: dict[tuple[int, int], list[int]] = {}
    for k, (_, stride, bpp) in enumerate(parts):
        groups.setdefault((stride, bpp), []).append(k)
    for (stride, bpp), at in groups.items():
        at.sort(key=lambda k: len(parts[k][0]))  # like sizes together: a batch takes as many steps as its largest part
        while at:  # so many parts at a time that their arrays stay small
            size, n = 0, 0
            while n < len(at) and (not n or size + len(parts[at[n]][0]) <= most):
                size, n = size + len(parts[at[n]][0]), n + 1
            for k, v in zip(at[:n], fn([parts[k][0] for k in at[:n]], stride, bpp), strict=True):
                out[k] = v
            at = at[n:]
    return out


def bytes_of(values: Column) -> Column:
    """binary from array<int> of bytes, JVM-side."""
    return F.unhex(F.array_join(F.transform(values, lambda x: F.lpad(F.hex(x), 2, "0")), ""))


def byte_list(data: Column) -> Column:
    """array<int> from binary, JVM-side."""
    hexed = F.hex(data)
    return F.transform(F.sequence(F.lit(0), (F.length(data) - 1).cast("int")), lambda i: F.conv(F.substring(hexed, i * 2 + 1, F.lit(2)), 16, 10).cast("int"))


def _batch(fn):
    return F.pandas_udf(lambda s: pd.Series(fn([bytes(x) for x in s]), index=s.index, dtype=object), "binary")


def filter_tile(data: Column, stride: int, bpp: int) -> Column:
    return _batch(lambda x: payloads(x, stride, bpp))(data)


def unfilter_tile(payload: Column, stride: int, bpp: int) -> Column:
    """Tiles from payloads; null where a payload is broken."""
    return _batch(lambda x: restored(x, stride, bpp))(payload)


def compressed_size(data: Column, level: int = LEVEL) -> Column:
    return F.pandas_udf(lambda s: s.map(lambda x: len(compress(bytes(x), level)[1])).astype("int32"), "int")(data)


def filter_sizes(tile: Column, bpp: int = 1, stride: int = 16, level: int = LEVEL) -> Column:
    """array<int>: the size of a tile's residuals after compression, by code. A batch is worked on in portions and one
    filter at a time; only sizes leave it."""

    def portion(tiles: list[np.ndarray]) -> np.ndarray:
        stack = Stack(tiles, stride, bpp)
        out = np.empty((len(tiles), 16), np.int32)
        for code in range(16):
            out[:, code] = [len(d) for _, d in compress_all([x.tobytes() for x in stack.split(stack.residuals(code))], level)]
        return out

    def run(s: pd.Series) -> pd.Series:
        tiles = [np.frombuffer(x, np.uint8) for x in s]
        found = [row for lo, hi in portions([len(t) for t in tiles], BATCH_BYTES) for row in portion(tiles[lo:hi])]
        return pd.Series(found, index=s.index, dtype=object)

    return F.pandas_udf(run, "array<int>")(tile)


def compress_block(data: Column, level: int = LEVEL, dictionary: bytes | None = None) -> Column:
    """struct<flag, data> of each binary value."""
    return F.pandas_udf(lambda s: pd.DataFrame([compress(bytes(x), level, dictionary) for x in s], columns=["flag", "data"]), BLOCK)(data)


def decompress_block(flag: Column, data: Column, limit: Column, dictionary: bytes | None = None) -> Column:
    """struct<data, error>: error says what is wrong, and data is null then."""

    def run(flags: pd.Series, blocks: pd.Series, limits: pd.Series) -> pd.DataFrame:
        out = []
        for f, x, n in zip(flags, blocks, limits, strict=True):
            try:
                out.append((decompress(int(f), bytes(x), int(n), dictionary), None))
            except LimitExceeded:
                out.append((None, "limit"))
            except (ValueError, zstandard.ZstdError):
                out.append((None, "block"))
        return pd.DataFrame(out, columns=["data", "error"])

    return F.pandas_udf(run, "struct<data:binary,error:string>")(flag, data, limit)


def train_dictionaries(tiles: DataFrame) -> DataFrame:
    """img_id, dictionary (null where none can be trained) from the first tiles (img_id, seq, data) of each image."""
    first = F.slice(F.array_sort(F.collect_list(F.when(F.col("seq") < DICT_TILES, F.struct("seq", "data")))), 1, DICT_TILES)
    samples = tiles.groupBy("img_id").agg(first.alias("s")).select("img_id", F.transform("s", lambda x: x["data"]).alias("samples"))
    return samples.select("img_id", F.pandas_udf(lambda s: s.map(lambda x: train([bytes(b) for b in x])), "binary")("samples").alias("dictionary"))
