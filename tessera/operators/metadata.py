"""Metadata of files as a table: a row for each piece that counts, from chunk rows.

A chunk is unpacked in Arrow batches; all else is one aggregation that combines before it shuffles, so a file with very
many chunks is never one row. A piece that can't be unpacked, has the wrong size, isn't UTF-8 or isn't JSON is dropped.
Of JSON the last valid piece of each namespace counts, of every other kind the first valid one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import container as K
from tessera.operators import codec

KINDS = {K.JSON: "json", K.EXIF: "exif", K.ICCP: "icc", K.XMPD: "xmp", K.ZDIC: "dictionary", K.CHDR: "hdr"}


def pieces(chunks: DataFrame) -> DataFrame:
    """img_id, seq, kind, namespace (empty but for JSON), data: the valid pieces of chunks (img_id, seq, type, flag, data)."""
    c = chunks.where(F.col("type").isin(*KINDS)).select("img_id", "seq", "type", codec.decompress_block(F.col("flag"), F.col("data"), F.lit(codec.MAX_CHUNK))["data"].alias("all"))
    n = F.when(F.col("type") == K.JSON, K.be_number(F.col("all"), 0, 1) + 1).otherwise(0).cast("int")
    c = c.where(F.col("all").isNotNull()).select("img_id", "seq", "type", "all", n.alias("n")).where(F.col("n") <= F.octet_length("all"))
    name, data = F.substring("all", F.lit(2), F.col("n") - 1), F.substring("all", F.col("n") + 1, F.octet_length("all"))
    c = c.select("img_id", "seq", "type", F.when(F.col("type") == K.JSON, name).otherwise(F.lit(b"")).cast("string").alias("namespace"), data.alias("data"))
    text = F.col("data").cast("string")
    valid = (
        F.when(F.col("type") == K.JSON, F.is_valid_utf8("namespace") & F.is_valid_utf8(text) & K.valid_json(text))
        .when(F.col("type") == K.XMPD, F.is_valid_utf8(text))
        .when(F.col("type") == K.CHDR, F.octet_length("data").isin(10, 14, 18))
        .otherwise(F.lit(True))
    )
    kind = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])[F.col("type")]
    return c.where(valid).select("img_id", "seq", kind.alias("kind"), "namespace", "data")


def table(chunks: DataFrame) -> DataFrame:
    """img_id, kind, namespace, data: the pieces that count, from chunks (img_id, seq, type, flag, data)."""
    order = F.when(F.col("kind") == "json", -F.col("seq")).otherwise(F.col("seq"))
    return pieces(chunks).groupBy("img_id", "kind", "namespace").agg(F.min_by("data", order).alias("data"))
