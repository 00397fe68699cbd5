"""Encoding images to containers and decoding them again, as DataFrame plans over tiles and chunks.

encode: images become tile rows; tiles are filtered and compressed where they are; only compressed chunks are shuffled,
once, to be put together by image. decode: containers become chunk rows checked against the image's budget; image data
is unpacked tile by tile, and the tiles are put together by image.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import container as K
from tessera.operators import codec
from tessera.operators import metadata as M
from tessera.plans.options import EncodeOptions

cloudpickle.register_pickle_by_value(sys.modules[__name__])
IMAGES = "img_id bigint, width int, height int, pixels binary"


# --- samples


def shown(f: np.ndarray) -> np.ndarray:
    """8-bit samples of floats: what is under 0 or no number is 0, what is over 1 is 255."""
    return (np.fmin(np.fmax(f, np.float32(0)), np.float32(1)) * np.float32(255) + np.float32(0.5)).astype(np.uint8)


_LEVELS, _UNIT = np.arange(256), np.arange(256, dtype=np.float32) / np.float32(255)
#: What each 8-bit sample becomes, by (depth, sample format); and what each IEEE half, read as a big-endian integer, is shown as.
WIDENED = {(k, K.UINT): (_LEVELS * 257 if k == 16 else _LEVELS * (2**k - 1) // 255).astype(">u2") for k in (10, 12, 16)}
WIDENED |= {(32, K.UINT): (_LEVELS * 0x01010101).astype(">u4"), (32, K.FLOAT): _UNIT.astype(">f4"), (16, K.HALF): _UNIT.astype(">f2")}
HALVES = shown(np.arange(2**16, dtype=np.uint16).view(np.float16).astype(np.float32))


def to_samples(rgba: np.ndarray, o: EncodeOptions) -> np.ndarray:
    """(h, row bytes) of an (h, w, 4) image in the options' colour type, depth and sample format."""
    kind, d, high = o.target_color_type, o.depth, len(rgba)
    if kind in (0, 4):
        v = rgba.astype(np.int32)
        gray = ((299 * v[..., 0] + 587 * v[..., 1] + 114 * v[..., 2]) // 1000).astype(np.uint8)
        s = gray if kind == 0 else np.stack([gray, rgba[..., 3]], axis=-1)
    else:
        s = rgba[..., :3] if kind == 2 else rgba
    s = np.ascontiguousarray(s).reshape(high, -1)
    if (d, o.sample_format) in WIDENED:
        return np.take(WIDENED[d, o.sample_format], s).view(np.uint8).reshape(high, -1)
    if d == 8:
        return s
    per = 8 // d
    low = s >> (8 - d)
    low = np.pad(low, ((0, 0), (0, -low.shape[1] % per))).reshape(high, -1, per)
    return (low << (8 - d * (np.arange(per) + 1))).sum(axis=-1).astype(np.uint8)


def from_samples(data: bytes, h: K.Header, raw: bool = False) -> np.ndarray:
    """(h, w, 4) 8-bit RGBA. raw keeps packed samples unwidened."""
    per = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[h.color_type]
    rows = np.frombuffer(data, np.uint8).reshape(h.height, h.row_bytes)
    if h.bit_depth < 8:
        n = 8 // h.bit_depth
        s = ((rows[..., None] >> (8 - h.bit_depth * (np.arange(n) + 1))) & (2**h.bit_depth - 1)).reshape(h.height, -1)[:, : h.width * per]
        s = s if raw or h.color_type == 3 else s * (255 // (2**h.bit_depth - 1))
    elif h.sample_format == K.FLOAT:
        s = shown(np.frombuffer(data, ">f4").astype(np.float32))
    elif h.sample_format:
        s = np.take(HALVES, np.frombuffer(data, ">u2"))
    else:
        kind = {8: ">u1", 10: ">u2", 12: ">u2", 16: ">u2", 32: ">u4"}[h.bit_depth]
        s = np.frombuffer(data, kind).reshape(h.height, -1) >> (h.bit_depth - 8)
    s = s.astype(np.uint8).reshape(h.height, h.width, per)
    full = np.full((h.height, h.width, 1), 255, np.uint8)
    return {0: lambda: np.concatenate([s, s, s, full], -1), 2: lambda: np.concatenate([s, full], -1), 3: lambda: s, 4: lambda: np.concatenate([s[..., :1]] * 3 + [s[..., 1:]], -1), 6: lambda: s}[h.color_type]()


# --- passes and tiles

#: The owner of each pixel of an 8 by 8 square, by pass from 1; passes repeat over the image.
def pass_map(height: int, width: int, method: int) -> np.ndarray:
    y, x = np.mgrid[0:height, 0:width]
    if method == K.EVEN_ODD:
        return y % 2 + 1
    out = np.full((height, width), 7)
    for k, (xs, xo, ys, yo) in reversed(list(enumerate(((8, 0, 8, 0), (8, 4, 8, 0), (4, 2, 8, 0), (4, 2, 4, 2), (2, 1, 4, 2), (2, 1, 2, 1))))):
        out[(x % xs == xo) & (y % ys == yo)] = k + 1
    return out


def cut(rgba: np.ndarray, o: EncodeOptions) -> list[tuple[bytes, int, int]]:
    """(bytes, stride, bpp) of the independent parts of an image: passes, tiles or strips of rows."""
    if o.interlace_method:
        owner = pass_map(*rgba.shape[:2], o.interlace_method)
        return [(rgba[owner == k].tobytes(), 0, 4) for k in range(1, 8 if o.interlace_method == K.ADAM7 else 3)]
    rows = to_samples(rgba, o)
    h = K.Header(rgba.shape[1], rgba.shape[0], o.depth, o.sample_format, o.target_color_type)
    if o.tile_size:
        grid = K.Tiling.of(h.width, h.height, *o.tile_size, o.scan_order)
        return [(np.ascontiguousarray(rows[y : y + th, x * h.bpp : (x + tw) * h.bpp]).tobytes(), tw * h.bpp, h.bpp) for x, y, tw, th in grid.boxes(h.width, h.height)]
    return [(rows[k : k + o.tile_rows].tobytes(), rows.shape[1], h.bpp) for k in range(0, len(rows), o.tile_rows)]


def shuffled(data: bytes, bpp: int) -> bytes:
    return np.frombuffer(data, np.uint8).reshape(-1, bpp).T.tobytes()


def unshuffled(data: bytes, bpp: int) -> bytes:
    return np.frombuffer(data, np.uint8).reshape(bpp, -1).T.tobytes()


def filter_method(o: EncodeOptions) -> int:
    if o.use_byte_shuffle:
        return K.BYTE_SHUFFLE
    return K.PREDICTIVE if o.use_filter else K.NO_FILTER


def payloads(images: DataFrame, o: EncodeOptions, blocks: bool = False) -> DataFrame:
    """img_id, width, height, seq, payload: the filtered parts of every image, before compression; with blocks flag and
    data instead, compressed where they are. A batch is worked on in portions, so that its memory doesn't grow with the images."""
    method = filter_method(o)

    heuristic = "adaptive" if o.adaptive_analysis else o.filter_heuristic
    filtered = method == K.PREDICTIVE and not o.interlace_method

    def portion(images: pd.DataFrame) -> pd.DataFrame:
        rows, parts = [], []
        for row in images.itertuples(index=False):
            found = cut(np.frombuffer(row.pixels, np.uint8).reshape(row.height, row.width, 4), o)
            rows += [(row.img_id, row.width, row.height, k) for k in range(len(found))]
            parts += found
        if filtered:
            data = codec.grouped(parts, lambda t, stride, bpp: codec.payloads(t, stride, bpp, heuristic, o.level))
        else:
            data = [shuffled(d, bpp) if method == K.BYTE_SHUFFLE else d for d, _, bpp in parts]
        out = pd.DataFrame(rows, columns=["img_id", "width", "height", "seq"])
        if not blocks:
            return out.assign(payload=pd.Series(data, dtype=object))
        packed = codec.compress_all(data, o.level, o.dictionary)
        return out.assign(flag=pd.Series([f for f, _ in packed], dtype="int32"), data=pd.Series([d for _, d in packed], dtype=object))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo, hi in codec.portions((b["width"] * b["height"] * max(4, sample_bytes(o))).tolist()):
                yield portion(b.iloc[lo:hi])

    kept = "flag int, data binary" if blocks else "payload binary"
    return images.select("img_id", "width", "height", "pixels").mapInPandas(run, f"img_id bigint, width int, height int, seq int, {kept}")


def sample_bytes(o: EncodeOptions) -> int:
    """Bytes of a pixel in the options' colour type, depth and sample format."""
    return K.Header(1, 1, o.depth, o.sample_format, o.target_color_type).bpp


def ancillary(o: EncodeOptions) -> list[tuple[str, bytes, bool]]:
    """(type, payload, may be compressed) of the options' chunks, in file order."""
    out = []
    if o.hdr:
        out.append((K.CHDR, o.hdr.pack(), True))
    if o.exif is not None:
        out.append((K.EXIF, o.exif, True))
    out += [(K.JSON, bytes([len(ns.encode())]) + ns.encode() + json.dumps(v).encode(), True) for ns, v in o.json_metadata.items()]
    if o.icc_profile is not None:
        out.append((K.ICCP, o.icc_profile, True))
    if o.xmp_metadata is not None:
        out.append((K.XMPD, o.xmp_metadata.encode(), True))
    return out


def encode(images: DataFrame, options: EncodeOptions | None = None) -> DataFrame:
    """img_id, content: a container for each image (img_id, width, height, RGBA pixels)."""
    o = options or EncodeOptions()
    level = o.level

    def pack(data: pd.Series, dictionary: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([codec.compress(bytes(x), level, None if d is None else bytes(d)) for x, d in zip(data, dictionary, strict=True)], columns=["flag", "data"])

    if o.auto_dictionary and not o.dictionary:
        parts = payloads(images, o)
        dicts = codec.train_dictionaries(parts.withColumnRenamed("payload", "data"))
        parts = parts.join(dicts, "img_id", "left")
        packed = parts.withColumn("block", _two_column_udf(pack, codec.BLOCK)("payload", "dictionary")).select("*", "block.*")
    else:
        packed = payloads(images, o, blocks=True).withColumn("dictionary", F.lit(o.dictionary).cast("binary"))
    framed = packed.select("img_id", "width", "height", "dictionary", "seq", "flag", K.chunk(F.lit(K.IDAT), F.col("flag"), F.col("data")).alias("bytes"))
    whole = framed.groupBy("img_id").agg(F.first("width").alias("width"), F.first("height").alias("height"), F.first("dictionary").alias("dictionary"), K.compression_bit(F.col("flag")).alias("zstd"), F.array_sort(F.collect_list(F.struct("seq", "bytes"))).alias("data"))
    extra = [(kind, *codec.compress(data, level)) if may else (kind, 0, data) for kind, data, may in ancillary(o)]
    any_zstd = int(any(f for _, f, _ in extra))
    before = [F.lit(K.write_chunk(kind, flag, data)) for kind, flag, data in extra]
    method = filter_method(o)
    head = F.concat(K.be_bytes(F.col("width"), 4), K.be_bytes(F.col("height"), 4), F.lit(bytes([o.depth, o.sample_format, o.target_color_type])), K.be_bytes(F.greatest("zstd", F.lit(any_zstd)), 1), F.lit(bytes([method, o.interlace_method])))
    tiling = F.lit(b"")
    if o.tile_size:
        tw, th = o.tile_size
        tiling = K.chunk(F.lit(K.IDIM), F.lit(0), F.concat(*[K.be_bytes(v, 2) for v in (F.lit(tw), F.lit(th), F.ceil(F.col("width") / tw), F.ceil(F.col("height") / th))], F.lit(bytes([o.scan_order]))))
    dictionary = F.when(F.col("dictionary").isNotNull(), K.chunk(F.lit(K.ZDIC), F.lit(0), F.col("dictionary"))).otherwise(F.lit(b""))
    data = F.unhex(F.array_join(F.transform("data", lambda x: F.hex(x["bytes"])), ""))  # one pass, where a fold would copy what it has each time
    content = F.concat(F.lit(K.SIGNATURE), K.chunk(F.lit(K.IHDR), F.lit(0), head), tiling, *before, dictionary, data, F.lit(K.write_chunk(K.IEND, 0, b"")))
    return whole.select("img_id", content.alias("content"))


def _two_column_udf(fn, kind: str):
    return F.pandas_udf(lambda a, b: fn(a, b), kind)


CHUNKS = "img_id bigint, seq int, type string, flag int, data binary, fault string"


def chunks(files: DataFrame) -> DataFrame:
    """img_id, seq, type, flag, data, fault: the chunks of containers (img_id, content); a broken file ends in a row
    with its fault."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for img_id, content in zip(b["img_id"], b["content"], strict=True):
                seq = 0
                try:
                    for c in K.read_chunks(bytes(content)):
                        rows.append((img_id, seq, c.kind, c.flag, c.data, None))
                        seq += 1
                except K.ContainerError as e:
                    rows.append((img_id, seq, None, None, None, e.code))
            out = pd.DataFrame(rows, columns=["img_id", "seq", "type", "flag", "data", "fault"])
            yield out.astype({"flag": "Int32", "seq": "int32"})

    return files.select("img_id", "content").mapInPandas(run, CHUNKS)


def metadata(files: DataFrame) -> DataFrame:
    """img_id, kind (json, exif, icc, xmp, dictionary, hdr), namespace, data: the metadata of containers (img_id, content)."""
    return M.table(chunks(files))


@dataclass
class Opened:
    """A file read up to its unpacked parts, with the fault that stopped it, if any. warnings: no_end (the end chunk is
    missing), second_header (the last one counts, the budget is the first one's), trailing (bytes after the end chunk)."""

    header: K.Header | None = None
    grid: K.Tiling | None = None
    palette: list | None = None
    parts: list = field(default_factory=list)
    meta: dict = field(default_factory=lambda: {"json": {}})
    fault: str | None = None
    warnings: list = field(default_factory=list)

    def filtered(self) -> list[tuple[bytes, int, int]]:
        """The parts that a predictive filter has to be undone for, with their strides."""
        h = self.header
        if self.fault or h.interlace_method or h.filter_method != K.PREDICTIVE:
            return []
        if self.grid:
            return [(p, w * h.bpp, h.bpp) for p, (_, _, w, _) in zip(self.parts, self.grid.boxes(h.width, h.height), strict=False)]
        return [(p, h.row_bytes, h.bpp) for p in self.parts]


def opened(content: bytes) -> Opened:
    """Chunks checked and unpacked within the file's budget. Broken metadata is dropped, broken image data is a fault."""
    f, used, budget, dictionary, at, last = Opened(), 0, 0, None, len(K.SIGNATURE), None
    try:
        for c in K.read_chunks(content):
            at, last = at + K.HEADER + len(c.data) + K.FOOTER, c.kind
            if c.kind == K.IHDR:
                if f.header:
                    f.warnings.append("second_header")
                f.header = K.Header.parse(c.data)
                budget = budget or f.header.budget
            elif f.header is None:
                raise K.ContainerError("missing", "header")
            elif c.kind == K.IDAT:
                extra = f.grid.tiles_x * f.grid.tiles_y if f.grid else 0
                block = codec.decompress(c.flag, c.data, budget + extra - used, dictionary)
                used += len(block)
                f.parts.append(block)
            elif c.kind == K.IDIM:
                f.grid = K.Tiling.parse(c.data)
                f.grid.boxes(f.header.width, f.header.height) if f.grid.tiles_x * f.grid.tiles_y <= 2**20 else None
            elif c.kind == K.PLTE:
                f.palette = K.parse_palette(codec.decompress(c.flag, c.data))
            elif c.kind != K.IEND and c.kind[0].isupper():
                raise K.ContainerError("feature", c.kind)
            elif c.kind != K.IEND:
                try:
                    _metadata(f.meta, c)
                except (ValueError, IndexError, codec.zstandard.ZstdError, codec.LimitExceeded):
                    continue
                dictionary = f.meta.get("dictionary")
        if f.header is None:
            raise K.ContainerError("missing", "header")
        if last != K.IEND:
            f.warnings.append("no_end")
        elif at < len(content):
            f.warnings.append("trailing")
    except K.ContainerError as e:
        f.fault = e.code
    except codec.LimitExceeded:
        f.fault = "limit"
    except (ValueError, codec.zstandard.ZstdError):
        f.fault = "block"
    return f


def read_containers(contents: list[bytes], raw: bool = False, operator: str = "filmic") -> list[tuple[Opened, np.ndarray | None]]:
    """Files and their RGBA images; filters are undone for the tiles of all files together."""
    return pictured([opened(c) for c in contents], raw, operator)


def pictured(files: list[Opened], raw: bool = False, operator: str = "filmic") -> list[tuple[Opened, np.ndarray | None]]:
    """Opened files and their RGBA images."""
    todo = [f.filtered() for f in files]
    undone = iter(codec.grouped([p for parts in todo for p in parts], codec.restored, codec.UNDO_BYTES))
    out = []
    for f, parts in zip(files, todo, strict=True):
        image = None
        if parts:
            f.parts = [next(undone) for _ in parts] + f.parts[len(parts) :]
        if not f.fault:
            try:
                image = assemble(f, raw, operator)
            except K.ContainerError as e:
                f.fault = e.code
        out.append((f, image))
    return out


def in_portions(ids, contents, most: int | None = None) -> Iterator[list[tuple[int, Opened]]]:
    """Files (id, opened) in lists that are cut as soon as their unpacked parts reach a bound."""
    held, used = [], 0
    for img_id, content in zip(ids, contents, strict=True):
        f = opened(bytes(content))
        held.append((img_id, f))
        used += sum(map(len, f.parts))
        if used >= (most or codec.PORTION):
            yield held
            held, used = [], 0
    if held:
        yield held


def _metadata(meta: dict, c: K.Chunk) -> None:
    """First valid instance wins; of JSON the last of each namespace."""
    data = codec.decompress(c.flag, c.data)
    if c.kind == K.JSON:
        ns = data[1 : 1 + data[0]]
        if len(ns) < data[0]:
            raise ValueError("namespace")
        meta["json"][ns.decode()] = json.loads(data[1 + data[0] :].decode())
    elif c.kind in (K.EXIF, K.ICCP, K.ZDIC, K.XMPD, K.CHDR):
        name, read = {K.EXIF: ("exif", bytes), K.ICCP: ("icc", bytes), K.ZDIC: ("dictionary", bytes), K.XMPD: ("xmp", lambda d: d.decode()), K.CHDR: ("hdr", K.Hdr.parse)}[c.kind]
        value = read(data)
        meta.setdefault(name, value)


def assemble(f: Opened, raw: bool = False, operator: str = "filmic") -> np.ndarray:
    """The RGBA image from the parts of a file, filters undone."""
    h, grid, parts, palette, hdr = f.header, f.grid, f.parts, f.palette, f.meta.get("hdr")
    if h.color_type == 3 and palette is None:
        raise K.ContainerError("missing", "palette")
    if h.filter_method == K.BYTE_SHUFFLE and h.bpp not in K.SHUFFLE_BPP:
        raise K.ContainerError("feature", "byte shuffle of this pixel size")
    try:
        if h.interlace_method:
            owner = pass_map(h.height, h.width, h.interlace_method)
            rgba = np.zeros((h.height, h.width, 4), np.uint8)
            for k in range(1, 8 if h.interlace_method == K.ADAM7 else 3):
                rgba[owner == k] = np.frombuffer(parts[k - 1], np.uint8).reshape(-1, 4)
            return rgba
        if h.filter_method == K.BYTE_SHUFFLE:
            parts = [unshuffled(p, h.bpp) for p in parts]
        if grid:
            rows = np.zeros((h.height, h.row_bytes), np.uint8)
            for part, (x, y, w, th) in zip(parts, grid.boxes(h.width, h.height), strict=True):
                rows[y : y + th, x * h.bpp : (x + w) * h.bpp] = np.frombuffer(part, np.uint8).reshape(th, w * h.bpp)
            data = rows.tobytes()
        else:
            data = b"".join(parts)
    except (ValueError, IndexError, TypeError):
        raise K.ContainerError("truncated", "image data") from None
    if len(data) != h.row_bytes * h.height:
        raise K.ContainerError("truncated", "image data")
    if h.color_type == 3:
        idx = from_samples(data, h)[..., 0]
        table = np.zeros((256, 4), np.uint8)
        table[:, 3] = 255
        table[: len(palette)] = palette
        return table[idx]
    if h.sample_format == K.FLOAT and hdr is not None:
        if h.color_type != 6:
            raise K.ContainerError("feature", "tone mapping needs RGBA")
        return display(np.frombuffer(data, ">f4").astype(np.float32).reshape(h.height, h.width, 4), hdr, operator)
    return from_samples(data, h, raw)


def display(f: np.ndarray, hdr: K.Hdr, operator: str) -> np.ndarray:
    """Float RGBA as 8-bit display samples, by the same curves as the column functions."""
    from tessera.functions import tonemap as T

    top = max(float(hdr.max_lum), 1.0)
    if hdr.transfer > T.SRGB or hdr.primaries not in T.TO_XYZ:
        raise K.ContainerError("feature", "transfer function or primaries")
    v = np.clip(np.where(np.isfinite(f[..., :3]), f[..., :3].astype(np.float64), 0.0), 0.0, top)
    if hdr.transfer == T.PQ:
        root = np.maximum(v / top, 0) ** (1 / T.PQ_M2)
        v = np.where(v <= 0, 0.0, np.where(v >= top, 1.0, (np.maximum(root - T.PQ_C1, 0) / (T.PQ_C2 - T.PQ_C3 * root)) ** (1 / T.PQ_M1)))
    elif hdr.transfer == T.HLG:
        v = np.clip(v / max(top / 100, 0.12), 0, 1)
        v = np.where(v <= 0.5, v * v / 3, (np.exp(T.HLG_A * (v - T.HLG_B)) + T.HLG_C) / 12)
    elif hdr.transfer == T.SRGB:
        v = np.clip(v, 0, 1)
        v = np.where(v <= 0.04045, v / 12.92, ((v + 0.055) / 1.055) ** 2.4)
    else:
        v = np.clip(v / top, 0, 1)
    if hdr.primaries != T.BT709:
        v = v @ np.array(T.TO_XYZ[hdr.primaries]).T @ np.array(T.FROM_XYZ[T.BT709]).T
    v = np.maximum(v, 0)
    v = v / (1 + v) if operator == "reinhard" else v * (2.51 * v + 0.03) / (v * (2.43 * v + 0.59) + 0.14)
    v = np.clip(v, 0, 1)
    v = np.where(v <= 0.0031308, v * 12.92, 1.055 * v ** (1 / 2.4) - 0.055)
    return (np.concatenate([v, np.clip(f[..., 3:], 0, 1)], -1) * 255).astype(np.uint8)


def decode(files: DataFrame, raw: bool = False, operator: str = "filmic", mode: str = "PERMISSIVE") -> DataFrame:
    """img_id, width, height, pixels (RGBA), metadata (JSON text), fault, warnings: one row per container (img_id, content).

    A file is unpacked within its own budget. A broken one has a fault and no pixels; in mode FAILFAST it is an error.
    What can be read all the same is in warnings (comma-joined, see Opened); metadata() gives all other metadata.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for held in in_portions(b["img_id"], b["content"]):
                rows = []
                for (img_id, _), (f, rgba) in zip(held, pictured([f for _, f in held], raw, operator), strict=True):
                    if f.fault and mode == "FAILFAST":
                        raise K.ContainerError(f.fault)
                    got = (None, None, None, None) if f.fault else (f.header.width, f.header.height, rgba.tobytes(), json.dumps(f.meta["json"]))
                    rows.append((img_id, *got, f.fault, ",".join(f.warnings)))
                yield pd.DataFrame(rows, columns=["img_id", "width", "height", "pixels", "metadata", "fault", "warnings"]).astype({"width": "Int64", "height": "Int64"})

    return files.select("img_id", "content").mapInPandas(run, "img_id bigint, width bigint, height bigint, pixels binary, metadata string, fault string, warnings string")


def encode_indexed(images: DataFrame, options: EncodeOptions | None = None) -> DataFrame:
    """img_id, content: containers with a palette of at most 256 colours and packed indices. Pixels are RGBA, or one byte
    for each gray, opaque pixel, which becomes RGBA only here, a portion of images at a time."""
    o = options or EncodeOptions()
    if o.tile_size or o.use_byte_shuffle or o.interlace_method:
        raise ValueError("an indexed image has neither tiles, passes nor byte shuffle here")
    median = o.palette_algorithm.lower().replace("-", "").replace("_", "") == "mediancut"

    heuristic = "adaptive" if o.adaptive_analysis else o.filter_heuristic

    def portion(ids: pa.Array, images: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        made = [indexed(rgba_of(p, w, h), o, median) for w, h, p in images]
        parts = [p for _, _, strips in made for p in strips]
        data = iter(codec.grouped(parts, lambda t, stride, bpp: codec.payloads(t, stride, bpp, heuristic, o.level)) if o.use_filter else [p[0] for p in parts])
        content = [indexed_file(h, pal, [next(data) for _ in strips], o.level) for h, pal, strips in made]
        return pa.RecordBatch.from_arrays([ids, pa.array(content, pa.binary())], names=["img_id", "content"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:  # pixels are taken out of the batch in portions
            ids, w, h = (b.column(c) for c in ("img_id", "width", "height"))
            for lo, hi in codec.portions([4 * x * y for x, y in zip(w.to_pylist(), h.to_pylist(), strict=True)]):
                columns = (c.slice(lo, hi - lo).to_pylist() for c in (w, h, b.column("pixels")))
                yield portion(ids.slice(lo, hi - lo), list(zip(*columns, strict=True)))

    return images.select("img_id", "width", "height", "pixels").mapInArrow(run, "img_id bigint, content binary")


def rgba_of(pixels: bytes, width: int, height: int) -> np.ndarray:
    """(h, w, 4) of RGBA pixels, or of gray ones of a byte each."""
    if len(pixels) != width * height:
        return np.frombuffer(pixels, np.uint8).reshape(height, width, 4)
    gray = np.frombuffer(pixels, np.uint8).reshape(height, width, 1)
    return np.concatenate([gray, gray, gray, np.full_like(gray, 255)], axis=-1)


def indexed(rgba: np.ndarray, o: EncodeOptions, median: bool) -> tuple[K.Header, np.ndarray, list[tuple[bytes, int, int]]]:
    """Header, palette and strips of packed indices of one image, whose pixels stay together as its palette's unit."""
    from tessera.operators import quantize

    px = rgba.reshape(-1, 4).astype(np.int64)
    if median:
        px = np.concatenate([px[:, :3], np.full((len(px), 1), 255)], 1)
    packed = (px << np.array([24, 16, 8, 0])).sum(1)
    keys, first, back = np.unique(packed, return_index=True, return_inverse=True)
    if median:
        pal = quantize.cut(px[first][:, :3], 256)
        pal = np.concatenate([pal, np.full((len(pal), 1), 255)], 1)
    else:
        pal = px[np.sort(first)[:256]]
    colors = px[first]
    near = np.concatenate([((colors[k : k + 4096, None, :] - pal[None]) ** 2).sum(-1).argmin(1) for k in range(0, len(colors), 4096)])
    idx = near[back.reshape(-1)].reshape(rgba.shape[:2])
    depth = next(d for d, n in ((1, 2), (2, 4), (4, 16), (8, 256)) if len(pal) <= n)
    h = K.Header(rgba.shape[1], rgba.shape[0], depth, K.UINT, 3, 0, K.PREDICTIVE if o.use_filter else K.NO_FILTER)
    per = 8 // depth
    rows = np.pad(idx, ((0, 0), (0, -idx.shape[1] % per))).reshape(len(idx), -1, per)
    rows = (rows << (8 - depth * (np.arange(per) + 1))).sum(-1).astype(np.uint8)
    return h, pal, [(rows[k : k + o.tile_rows].tobytes(), rows.shape[1], 1) for k in range(0, len(rows), o.tile_rows)]


def indexed_file(h: K.Header, pal: np.ndarray, strips: list[bytes], level: int) -> bytes:
    alpha = bool((pal[:, 3] < 255).any())
    out = [(K.PLTE, *codec.compress(K.pack_palette([tuple(map(int, e)) for e in pal], alpha), level))]
    out += [(K.IDAT, *codec.compress(x, level)) for x in strips]
    head = replace(h, compression_method=int(any(f for _, f, _ in out)))
    return K.SIGNATURE + K.write_chunk(K.IHDR, 0, head.pack()) + b"".join(K.write_chunk(*c) for c in out) + K.write_chunk(K.IEND, 0, b"")
