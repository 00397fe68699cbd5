"""Reading and writing containers and images: file tables for the main path, and a Python data source.

Files are read by Spark's own readers (binaryFile, image), so any store that Spark knows will do; the data source
serves tools that want one row per chunk with a filter on the type pushed into the reader.
"""

from __future__ import annotations

import struct
import sys
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage

from tessera.functions import container as K
from tessera.plans import lifecycle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def container_files(spark: SparkSession, path: str) -> DataFrame:
    """path, img_id (a hash of the path), content."""
    d = spark.read.format("binaryFile").load(path)
    return d.select("path", F.xxhash64("path").alias("img_id"), "content")


def image_files(spark: SparkSession, path: str) -> DataFrame:
    """path, img_id, width, height, pixels (RGBA): every image that the JVM can read, by Spark's image source.

    Its rows are BGR, BGRA or gray, top row first; they are turned to RGBA in batches.
    """
    d = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for origin, w, h, n, data in zip(b["origin"], b["width"], b["height"], b["nChannels"], b["data"], strict=True):
                v = np.frombuffer(data, np.uint8).reshape(h, w, n)
                full = np.full((h, w, 1), 255, np.uint8)
                rgba = np.concatenate([np.repeat(v, 3, 2), full] if n == 1 else [v[..., 2::-1], full if n == 3 else v[..., 3:]], 2)
                out.append((origin, w, h, rgba.tobytes()))
            yield pd.DataFrame(out, columns=["path", "width", "height", "pixels"])

    rows = d.mapInPandas(run, "path string, width int, height int, pixels binary")
    return rows.select("path", F.xxhash64("path").alias("img_id"), "width", "height", "pixels")


def png(width: int, height: int, rgba: bytes) -> bytes:
    """An 8-bit RGBA PNG file."""
    rows = np.frombuffer(rgba, np.uint8).reshape(height, width * 4)
    body = np.concatenate([np.zeros((height, 1), np.uint8), rows], 1).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return bytes.fromhex("89504E470D0A1A0A") + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


def png_files(images: DataFrame) -> DataFrame:
    """img_id, content: PNG files of images (img_id, width, height, RGBA pixels)."""
    made = F.pandas_udf(lambda w, h, p: pd.Series([png(int(a), int(b), bytes(c)) for a, b, c in zip(w, h, p, strict=True)]), "binary")
    return images.select("img_id", made("width", "height", "pixels").alias("content"))


def write_files(files: DataFrame, folder: str, suffix: str) -> DataFrame:
    """Write each content to folder/img_id.suffix by the cluster's file system; returns img_id, path, n_bytes.

    Rows of one partition are written by one task through the data source writer below.
    """
    out = files.select("img_id", "content")
    out.write.format("rasterfile").option("folder", folder).option("suffix", suffix).mode("append").save()
    return files.select("img_id", F.concat(F.lit(f"{folder}/"), F.col("img_id").cast("string"), F.lit(f".{suffix}")).alias("path"), F.octet_length("content").alias("n_bytes"))


class FilePart(InputPartition):
    def __init__(self, path: str):
        self.path = path


class ChunkReader(DataSourceReader):
    """A partition for each file; a filter on the chunk type is answered here."""

    def __init__(self, options: dict):
        self.folder, self.kinds = options["path"].removeprefix("file://"), None

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("type",):
                self.kinds = {f.value}
            elif isinstance(f, In) and f.attribute == ("type",):
                self.kinds = set(f.value)
            else:
                yield f

    def partitions(self):
        at = Path(self.folder)
        return [FilePart(str(p)) for p in ([at] if at.is_file() else sorted(x for x in at.rglob("*") if x.is_file()))]

    def read(self, partition):
        try:
            for seq, c in enumerate(K.read_chunks(Path(partition.path).read_bytes())):
                if self.kinds is None or c.kind in self.kinds:
                    yield partition.path, seq, c.kind, c.flag, c.data, None
        except K.ContainerError as e:
            if self.kinds is None:
                yield partition.path, -1, None, None, None, e.code


class FileWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.folder, self.suffix = options["folder"].removeprefix("file://"), options.get("suffix", "bin")

    def write(self, iterator):
        n = 0
        Path(self.folder).mkdir(parents=True, exist_ok=True)
        for row in iterator:
            target = Path(self.folder, f"{row.img_id}.{self.suffix}")
            part = target.with_suffix(f".{self.suffix}.part")
            part.write_bytes(bytes(row.content))
            part.replace(target)  # a task that runs again writes the same file
            n += 1
        return WriterCommitMessage()


class RasterChunks(DataSource):
    """spark.read.format("rasterchunk").load(folder): path, seq, type, flag, data, fault. The folder must be one that
    every executor sees."""

    @classmethod
    def name(cls):
        return "rasterchunk"

    def schema(self):
        return "path string, seq int, type string, flag int, data binary, fault string"

    def reader(self, schema):
        return ChunkReader(self.options)


class RasterFiles(DataSource):
    """df.write.format("rasterfile"): rows (img_id, content) as files of a shared folder."""

    @classmethod
    def name(cls):
        return "rasterfile"

    def schema(self):
        return "img_id bigint, content binary"

    def writer(self, schema, overwrite):
        return FileWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RasterChunks)
    spark.dataSource.register(RasterFiles)


def decode_files(spark: SparkSession, path: str, **options) -> DataFrame:
    """Decoded containers of a folder, with their paths."""
    files = container_files(spark, path)
    return lifecycle.decode(files, **options).join(files.select("img_id", "path"), "img_id")
