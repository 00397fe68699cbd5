"""Queries over chunks, metadata, compression and the whole encode and decode paths."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import container as K
from tessera.functions.color import bytes_per_pixel
from tessera.operators import codec, metadata, raster
from tessera.plans import lifecycle as L
from tessera.plans.filter_queries import TILES, cells_sql, flat, flat_sql, tiles, whole_tiles
from tessera.plans.options import EncodeOptions
from tessera.plans.tables import shared_dir, spread, table
from tessera.sources import containers
from tessera.streaming import chunks as S


WIDTH = 256


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """img_id, width, height, RGBA pixels: an image of every whole text, WIDTH pixels wide."""
    return raster.whole_images(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), WIDTH)


_ROW = 4 * WIDTH
#: rows(img_id, height, y, hx): the rows of the images as hexadecimal digits, in SQL.
ROWS = f"""WITH raw AS (SELECT doc_id AS img_id, hex(encode(text)) AS hx FROM documents WHERE text <> ''),
    sized AS (SELECT img_id, hx, (length(hx) // 2 + {_ROW - 1}) // {_ROW} AS height FROM raw),
    lines AS (SELECT img_id, height, y.y AS y, rpad(substr(hx, y.y * {2 * _ROW} + 1, {2 * _ROW}), {2 * _ROW}, '0') AS hx FROM sized, unnest(range(0, height)) AS y(y))"""
_hex = lambda k: f"(instr('0123456789ABCDEF', substr(hx, {k} + 1, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(hx, {k} + 2, 1)) - 1"
#: img_id, height, byte_check of the images, in SQL.
IMAGES = ROWS + f", im AS (SELECT img_id, CAST(height AS BIGINT) AS height, CAST(sum((y * {_ROW} + i.i + 1) * ({_hex('2 * i.i')})) AS BIGINT) AS pixel_check FROM lines, unnest(range(0, {_ROW})) AS i(i) GROUP BY img_id, height)"


def gray_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """img_id, width, height, pixels: an image of every whole text with a gray, opaque pixel for each byte, as one byte."""
    t = raster.whole_tiles(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), WIDTH, 2**30)
    return t.select("img_id", F.lit(WIDTH).alias("width"), (F.octet_length("data") / WIDTH).cast("int").alias("height"), F.col("data").alias("pixels"))


_place = f"(4 * (img_id % {TILES} * {WIDTH} + i))"
GRAY_IMAGES = cells_sql(1, WIDTH, WIDTH) + f" SELECT img_id // {TILES} AS img_id, CAST(count(*) // {WIDTH} AS BIGINT) AS height, CAST(sum((3 * {_place} + 6) * v + ({_place} + 4) * 255) AS BIGINT) AS pixel_check FROM cells GROUP BY 1"


def pixel_check(column: str = "pixels"):
    return F.get(codec.byte_sums(F.col(column)), F.lit(1))


def decoded(d: DataFrame) -> DataFrame:
    return codec.checked(d, ["img_id", "height"], "pixels", "pixel_check")


def round_trip(options: EncodeOptions):
    def run(spark, sf_dir):
        return decoded(L.decode(L.encode(images(spark, sf_dir), options)))

    return run


def scan_container(spark, sf_dir):
    c = L.chunks(L.encode(images(spark, sf_dir), EncodeOptions(tile_rows=2, level=3, json_metadata={"camera": {"k": 1}}, exif=b"exif data", xmp_metadata="<x/>", icc_profile=b"\xab" * 96)))
    return c.groupBy("img_id").agg(F.count("*").alias("n_chunks"), F.sum((F.col("type") == K.IDAT).cast("bigint")).alias("n_idat"), F.min("type").alias("first_type"), F.count("fault").alias("faults"))


def chunk_table(spark, sf_dir):
    """A chunk per event: type by event type, flag 0, the properties as data."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.lit(K.JSON).alias("type"), F.lit(0).alias("flag"), K.json_payload(F.col("event_type"), F.col("props")).alias("data"))


def chunk_write(spark, sf_dir):
    c = chunk_table(spark, sf_dir)
    return c.select("event_id", F.lower(F.hex(K.chunk(F.col("type"), F.col("flag"), F.col("data")))).alias("chunk"))


def crc32(spark, sf_dir):
    c = chunk_table(spark, sf_dir)
    return c.select("event_id", K.crc(F.col("type"), F.col("flag"), F.col("data")).alias("crc"))


def chunk_read(spark, sf_dir):
    """Chunks written as one file per event and scanned again; every 7th has a byte turned."""
    c = chunk_table(spark, sf_dir)
    body = F.concat(F.lit(K.SIGNATURE), K.chunk(F.col("type"), F.col("flag"), F.col("data")), F.lit(K.write_chunk(K.IEND, 0, b"")))
    broken = F.concat(F.substring(body, F.lit(1), F.lit(20)), F.lit(b"\x00"), F.substring(body, F.lit(22), F.octet_length(body)))
    files = c.select(F.col("event_id").alias("img_id"), F.when(F.col("event_id") % 7 == 0, broken).otherwise(body).alias("content"))
    return L.chunks(files).groupBy("img_id").agg(F.count("type").alias("n"), F.max("fault").alias("fault"))


def packed(rows: DataFrame, stored=None) -> DataFrame:
    """Chunk rows (img_id, seq, type, flag, data) of payloads, compressed where that is smaller and `stored` doesn't hold."""
    c = rows.withColumn("_b", codec.compress_block(F.col("data"), level=1))
    if stored is None:
        return c.select("img_id", "seq", "type", "_b.flag", "_b.data")
    return c.select("img_id", "seq", "type", F.when(stored, 0).otherwise(F.col("_b.flag")).alias("flag"), F.when(stored, F.col("data")).otherwise(F.col("_b.data")).alias("data"))


def ihdr_patch(spark, sf_dir):
    """Whether any chunk of a file is compressed, and the header's compression byte; every 37th event is a chunk that
    can be compressed, the others are stored."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("img_id"), F.col("event_id").alias("seq"), F.lit(K.JSON).alias("type"), F.repeat("event_type", F.lit(40)).cast("binary").alias("data"))
    c = packed(e, F.col("seq") % 37 != 0)
    return c.groupBy("img_id").agg(K.compression_bit(F.col("flag")).alias("compression_method")).select("img_id", (F.col("compression_method") == 1).alias("zstd"), "compression_method")


def meta_json(spark, sf_dir):
    """The last valid JSON of every namespace of a file; every 11th is broken and dropped."""
    e = table(spark, sf_dir, "events")
    text = F.when(F.col("event_id") % 11 == 0, F.concat(F.col("props"), F.lit("}"))).otherwise(F.col("props"))
    rows = e.select(F.col("user_id").alias("img_id"), F.col("event_id").alias("seq"), F.lit(K.JSON).alias("type"), K.json_payload(F.col("event_type"), text).alias("data"))
    return metadata.table(packed(rows)).select("img_id", "namespace", F.col("data").cast("string").alias("json"))


def first_of(kind: str, broken: bool = False):
    """The first valid piece of a kind of a file, one chunk per event: every 5th isn't UTF-8, and if `broken`, every 3rd
    says that it is compressed and isn't."""

    def run(spark, sf_dir):
        e = table(spark, sf_dir, "events")
        data = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit(b"\xff"), F.col("props").cast("binary"))).otherwise(F.col("props").cast("binary"))
        rows = e.select(F.col("user_id").alias("img_id"), F.col("event_id").alias("seq"), F.lit(kind).alias("type"), data.alias("data"))
        c = packed(rows)
        if broken:
            bad = rows.select("img_id", "seq", "type", F.lit(1).alias("flag"), "data").where(F.col("seq") % 3 == 0)
            c = c.where(F.col("seq") % 3 != 0).unionByName(bad)
        return metadata.table(c).select("img_id", F.lower(F.hex("data")).alias("data"))

    return run


def decode_metadata(spark, sf_dir):
    """All metadata of the containers of all images."""
    o = EncodeOptions(level=3, use_filter=False, json_metadata={"camera": {"k": 1}, "author": "x"}, exif=b"exif data", xmp_metadata="<x/>", icc_profile=b"\xab" * 96, hdr=K.Hdr(0, 0, 1.0, 0.0))
    m = L.metadata(L.encode(images(spark, sf_dir), o))
    return m.select("img_id", "kind", "namespace", F.lower(F.hex("data")).alias("data"))


def _first_sql(where: str) -> str:
    return f"SELECT user_id AS img_id, lower(arg_min(CASE WHEN event_id % 5 = 0 THEN 'ff' ELSE '' END || hex(encode(props)), event_id)) AS data FROM events WHERE {where} GROUP BY 1"


def meta_idim(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", *[(F.col("o_orderkey") * k % 65536).alias(f"v{k}") for k in (3, 5, 7, 11)], (F.col("o_orderkey") % 3).alias("scan"))
    data = F.concat(*[K.be_bytes(F.col(f"v{k}"), 2) for k in (3, 5, 7, 11)], K.be_bytes(F.col("scan"), 1))
    return o.select("o_orderkey", K.tiling(data).alias("t")).select("o_orderkey", "t.*")


def meta_plte(spark, sf_dir):
    """Palette payloads of 4 entries with or without alpha, and a partial one, read as rows."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("img_id"), (F.col("p_partkey") % 2).alias("alpha"))
    n = F.when(F.col("alpha") == 1, 4).otherwise(3)
    byte = lambda k: K.be_bytes((F.col("img_id") * 31 + k * 17) % 256, 1)
    data = F.concat(K.be_bytes(F.col("alpha"), 1), *[F.when(n * 4 + 2 > k, byte(k)).otherwise(F.lit(b"")) for k in range(18)])
    return p.select("img_id", F.explode(K.palette_entries(data)).alias("e")).select("img_id", "e.*")


def meta_chdr(spark, sf_dir):
    """HDR payloads packed and parsed in batches; sizes other than 10, 14 or 18 are invalid."""
    import pandas as pd

    o = table(spark, sf_dir, "orders").select("o_orderkey")

    def run(batches):
        for b in batches:
            rows = []
            for k in b["o_orderkey"]:
                hdr = K.Hdr(k % 4, k % 3, float(k % 1000), 0.5, int(k % 97) if k % 2 else None, int(k % 89) if k % 4 == 3 else None)
                data = hdr.pack() + (b"\x00" if k % 10 == 0 else b"")
                try:
                    h = K.Hdr.parse(data)
                    rows.append((k, len(data), h.transfer, h.primaries, float(h.max_lum), h.max_cll, h.max_fall, True))
                except K.ContainerError:
                    rows.append((k, len(data), None, None, None, None, None, False))
            yield pd.DataFrame(rows, columns=["o_orderkey", "n", "transfer", "primaries", "max_lum", "max_cll", "max_fall", "valid"]).astype({c: "Int64" for c in ("transfer", "primaries", "max_cll", "max_fall")})

    return o.mapInPandas(run, "o_orderkey bigint, n bigint, transfer bigint, primaries bigint, max_lum double, max_cll bigint, max_fall bigint, valid boolean")


def be_read(spark, sf_dir):
    """Every text as big-endian numbers: of 2 bytes at each place, of 4 at each second one."""
    d = raster.whole_tiles(table(spark, sf_dir, "documents"), 4)
    at = lambda n: F.transform(F.sequence(F.lit(0), (F.octet_length("data") / n).cast("int") - 1), lambda k: K.be_number(F.col("data"), k * n, n))
    total = lambda n: F.aggregate(at(n), F.lit(0).cast("bigint"), lambda s, x: s + x)
    return d.groupBy(F.col("img_id").alias("doc_id")).agg(F.sum(total(2)).alias("u16"), F.sum(total(4)).alias("u32"))


def header_validation(spark, sf_dir):
    """Headers from order keys, with the first rule that each breaks."""
    k = F.col("o_orderkey")
    pick = lambda by, *v: F.get(F.array(*map(F.lit, v)), (k % by % len(v)).cast("int"))
    h = {
        "width": (k % 50).cast("int"), "height": (k % 47).cast("int"), "bit_depth": pick(101, 1, 2, 4, 8, 10, 12, 16, 32, 8, 8), "sample_format": pick(53, 0, 0, 0, 0, 1, 2, 3),
        "color_type": pick(29, 0, 2, 3, 4, 6, 6, 5), "compression_method": pick(31, 0, 1, 1, 2), "filter_method": pick(37, 0, 1, 2, 3), "interlace_method": pick(41, 0, 0, 1, 2, 3),
    }
    d = table(spark, sf_dir, "orders").select("o_orderkey", *[v.alias(n) for n, v in h.items()])
    return d.select("o_orderkey", F.coalesce(K.header_fault({n: F.col(n) for n in h}), F.lit("")).alias("fault"))


HEADERS = """WITH h AS (SELECT o_orderkey, o_orderkey % 50 AS w, o_orderkey % 47 AS h, [1,2,4,8,10,12,16,32,8,8][o_orderkey % 101 % 10 + 1] AS bd, [0,0,0,0,1,2,3][o_orderkey % 53 % 7 + 1] AS sf,
    [0,2,3,4,6,6,5][o_orderkey % 29 % 7 + 1] AS ct, [0,1,1,2][o_orderkey % 31 % 4 + 1] AS cm, [0,1,2,3][o_orderkey % 37 % 4 + 1] AS fm, [0,0,1,2,3][o_orderkey % 41 % 5 + 1] AS im FROM orders)
    SELECT o_orderkey, CASE WHEN w = 0 OR h = 0 THEN 'dimensions' WHEN sf > 2 THEN 'sample_format' WHEN sf = 1 AND bd <> 32 THEN 'float_depth' WHEN sf = 2 AND bd <> 16 THEN 'half_depth'
    WHEN (ct IN (2, 6) AND bd < 8) OR (ct = 3 AND bd > 8) THEN 'bit_depth' WHEN ct NOT IN (0, 2, 3, 4, 6) THEN 'color_type' WHEN fm > 2 THEN 'filter_method' WHEN im > 2 THEN 'interlace_method'
    WHEN cm > 1 THEN 'compression_method' WHEN fm = 1 AND im <> 0 THEN 'shuffle_interlace' ELSE '' END AS fault FROM h"""


def decompress_budget(spark, sf_dir):
    k = F.col("o_orderkey")
    w, h = (k % 500 + 1).cast("int"), (k * 7 % 300 + 1).cast("int")
    d = table(spark, sf_dir, "orders").select("o_orderkey", w.alias("w"), h.alias("h"), (k % 3).cast("int").alias("interlace"), F.when(k % 5 == 0, 3).otherwise(6).alias("color_type"))
    rows = F.when(F.col("color_type") == 3, F.col("w")).otherwise(F.col("w") * bytes_per_pixel(6, 8))
    return d.select("o_orderkey", K.budget(F.col("interlace"), F.col("color_type"), F.col("w"), F.col("h"), rows).alias("budget"))


def budget_used(spark, sf_dir):
    """Chunks of a file in order with the bytes unpacked so far, and whether they are over its budget."""
    from pyspark.sql import Window

    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("img_id"), F.col("l_linenumber").cast("int").alias("seq"), (F.col("l_partkey") % 5000).alias("n"))
    li = li.groupBy("img_id", "seq").agg(F.sum("n").alias("n"))
    used = F.sum("n").over(Window.partitionBy("img_id").orderBy("seq"))
    return li.select("img_id", "seq", used.alias("used"), (used > 64 * 64 * 4 + 64).alias("over"))


def compress_fallback(spark, sf_dir):
    """Blocks compressed and unpacked again: the bytes that come back, and whether the smaller form was kept."""
    t = tiles(spark, sf_dir).select("img_id", F.col("data").alias("raw"))
    c = t.select("img_id", "raw", codec.compress_block(F.col("raw")).alias("c"))
    b = c.select("img_id", "raw", "c", codec.decompress_block(F.col("c.flag"), F.col("c.data"), F.octet_length("raw"))["data"].alias("d"))
    kept = F.when(F.col("c.flag") == 1, F.octet_length("c.data") < F.octet_length("raw")).otherwise(F.col("c.data") == F.col("raw"))
    return b.select("img_id", F.octet_length("d").cast("bigint").alias("n"), kept.alias("kept_smaller"), pixel_check("d").alias("byte_check"))


SAMPLE_DICTIONARY = b"".join(bytes([65 + k % 26, 97 + k % 26, 32]) * 3 for k in range(80))


def compress_fallback_dict(spark, sf_dir):
    t = tiles(spark, sf_dir).select("img_id", F.col("data").alias("raw"))
    c = t.select("img_id", "raw", codec.compress_block(F.col("raw"), dictionary=SAMPLE_DICTIONARY).alias("c"))
    b = c.select("img_id", codec.decompress_block(F.col("c.flag"), F.col("c.data"), F.octet_length("raw"), dictionary=SAMPLE_DICTIONARY)["data"].alias("d"))
    return b.select("img_id", F.octet_length("d").cast("bigint").alias("n"), pixel_check("d").alias("byte_check"))


def decompress_limited(spark, sf_dir):
    """Blocks against limits: enough, one byte short, and an unknown flag."""
    t = tiles(spark, sf_dir).select("img_id", F.col("data").alias("raw"))
    c = t.select("img_id", "raw", codec.compress_block(F.col("raw")).alias("c"))
    n = F.octet_length("raw")
    of = F.col("img_id.img_id") + F.col("img_id.tile_id")
    flag, limit = F.when(of % 3 == 2, 9).otherwise(F.col("c.flag")), F.when(of % 3 == 1, n - 1).otherwise(n)
    return c.select("img_id", F.coalesce(codec.decompress_block(flag, F.col("c.data"), limit)["error"], F.lit("")).alias("error"))


def train_dictionary(spark, sf_dir):
    """A dictionary for each text from its first tiles, and its size."""
    rows = whole_tiles(spark, sf_dir).withColumnRenamed("tile_id", "seq")
    return codec.train_dictionaries(rows).select("img_id", F.col("dictionary").isNotNull().alias("trained"), F.octet_length("dictionary").alias("n"))


def append_idat(spark, sf_dir):
    """Image data chunks and whether any is compressed, against the header's bit."""
    c = L.chunks(L.encode(images(spark, sf_dir), EncodeOptions(tile_rows=4, level=5)))
    head = F.max(F.when(F.col("type") == K.IHDR, K.be_number(F.col("data"), 11, 1)))
    used = F.max(F.when(F.col("type") == K.IDAT, F.col("flag")))
    return c.groupBy("img_id").agg(F.sum((F.col("type") == K.IDAT).cast("bigint")).alias("n_idat"), (head == used).alias("bit_matches"), F.max(F.when(F.col("type") == K.IHDR, K.be_number(F.col("data"), 4, 4))).alias("height"))


def scan_image(spark, sf_dir):
    """PNG files of the images, written to the shared folder and read by Spark's image source."""
    containers.register(spark)
    where = shared_dir(spark).removeprefix("file://") + f"/png-{uuid.uuid4().hex}"
    containers.write_files(containers.png_files(images(spark, sf_dir)), where, "png")
    d = containers.image_files(spark, where)
    return d.select(F.regexp_extract("path", r"(\d+)\.png$", 1).cast("bigint").alias("img_id"), F.col("height").cast("bigint").alias("height"), pixel_check().alias("pixel_check"))


def sink_image(spark, sf_dir):
    p = containers.png_files(images(spark, sf_dir))
    return p.select("img_id", K.be_number(F.col("content"), 16, 4).alias("width"), K.be_number(F.col("content"), 20, 4).alias("height"))


def streamed(spark: SparkSession, pictures: DataFrame) -> DataFrame:
    """Chunks of images as a stream of files in three batches, and the last state of every image; chunks, states and
    checkpoints lie in the shared folder."""
    root = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    c = L.chunks(L.encode(pictures, EncodeOptions(tile_rows=2, level=3))).select("img_id", "type", "data")
    files = max(3, int(spark.conf.get("spark.sql.shuffle.partitions")))
    c.repartition(files, "img_id").write.parquet(f"{root}/in")
    s = spark.readStream.schema(c.schema).option("maxFilesPerTrigger", -(-files // 3)).parquet(f"{root}/in")
    keep = lambda batch, n: batch.write.mode("overwrite").parquet(f"{root}/out/batch={n}")
    q = S.progress(s).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{root}/check").trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.schema(S.OUT).parquet(f"{root}/out")
    last = out.groupBy("img_id").agg(F.max(F.struct("chunks", "tiles", "budget", "ended")).alias("m"))
    return last.select("img_id", "m.*")


def stream_progress(spark, sf_dir):
    return streamed(spark, images(spark, sf_dir))


def compression_stats(spark, sf_dir):
    """Bytes by chunk type over all files."""
    c = L.chunks(L.encode(images(spark, sf_dir), EncodeOptions(tile_rows=2, level=3)))
    return c.groupBy("type").agg(F.count("*").alias("n"))


_gray_im = ROWS + f", px AS (SELECT img_id, height, y * {WIDTH} + x.x AS p, " + ", ".join(f"{_hex(f'8 * x.x + {2 * k}')} AS c{k}" for k in range(4)) + f" FROM lines, unnest(range(0, {WIDTH})) AS x(x))"
FORMATS = {
    "decode_gray8": (EncodeOptions(target_color_type=0, level=3), ["g", "g", "g", "255"]),
    "decode_rgb16": (EncodeOptions(target_color_type=2, target_bit_depth=16, level=3), ["c0", "c1", "c2", "255"]),
    "decode_gray_alpha12": (EncodeOptions(target_color_type=4, target_bit_depth=12, level=3), ["(g * 4095 // 255) >> 4"] * 3 + ["(c3 * 4095 // 255) >> 4"]),
    "decode_gray4": (EncodeOptions(target_color_type=0, target_bit_depth=4, level=3), ["(g >> 4) * 17"] * 3 + ["255"]),
    "decode_float": (EncodeOptions(sample_format=1, level=3), ["c0", "c1", "c2", "c3"]),
    "decode_half": (EncodeOptions(sample_format=2, level=3), ["c0", "c1", "c2", "c3"]),
}


def _format_sql(parts: list[str]) -> str:
    return _gray_im + f", gp AS (SELECT *, (299 * c0 + 587 * c1 + 114 * c2) // 1000 AS g FROM px) SELECT img_id, CAST(height AS BIGINT) AS height, CAST(sum({' + '.join(f'(4 * p + {k + 1}) * ({x})' for k, x in enumerate(parts))}) AS BIGINT) AS pixel_check FROM gp GROUP BY ALL"


PATHS = {
    "sink_container": EncodeOptions(level=3),
    "encode_tiles_morton": EncodeOptions(tile_size=(100, 3), scan_order=1, level=3),
    "encode_tiles_rowmajor": EncodeOptions(tile_size=(100, 3), level=3),
    "encode_adam7": EncodeOptions(interlace_method=1, level=3),
    "encode_evenodd": EncodeOptions(interlace_method=2, level=3),
    "encode_byte_shuffle": EncodeOptions(use_byte_shuffle=True, level=3),
    "encode_no_filter": EncodeOptions(use_filter=False, level=3),
    "encode_quick_prune": EncodeOptions(filter_heuristic="quick_prune", level=3),
    "encode_adaptive": EncodeOptions(adaptive_analysis=True, level=3),
    "encode_msad": EncodeOptions(filter_heuristic="msad", level=3),
    "encode_compression_test": EncodeOptions(filter_heuristic="compression_test", level=1),
    "encode_auto_dictionary": EncodeOptions(tile_rows=1, auto_dictionary=True, level=3),
}
_whole = IMAGES + " SELECT img_id, height, pixel_check FROM im"

QUERIES = {name: round_trip(o) for name, o in PATHS.items()} | {name: round_trip(o) for name, (o, _) in FORMATS.items()} | {
    "encode_indexed": lambda s, d: decoded(L.decode(L.encode_indexed(gray_images(s, d), EncodeOptions(level=3)))),
    "scan_image": scan_image, "sink_image": sink_image, "scan_container": scan_container, "chunk_read": chunk_read, "chunk_write": chunk_write, "crc32": crc32, "ihdr_patch": ihdr_patch,
    "meta_json": meta_json, "meta_exif": first_of(K.EXIF), "meta_icc": first_of(K.ICCP, True), "meta_xmp": first_of(K.XMPD), "meta_zdic": first_of(K.ZDIC, True), "decode_metadata": decode_metadata,
    "meta_idim": meta_idim, "meta_plte": meta_plte, "meta_chdr": meta_chdr, "be_read": be_read, "header_validation": header_validation,
    "compress_fallback": flat(compress_fallback), "compress_fallback_dict": flat(compress_fallback_dict), "decompress_limited": flat(decompress_limited), "decompress_budget": decompress_budget, "decompress_budget_used": budget_used,
    "train_dictionary": train_dictionary, "append_idat": append_idat, "stream_chunk_progress": stream_progress, "compression_stats": compression_stats,
}

ORACLES = {name: _whole for name in PATHS} | {name: _format_sql(parts) for name, (_, parts) in FORMATS.items()} | {
    "encode_indexed": GRAY_IMAGES,
    "scan_image": _whole,
    "sink_image": IMAGES + f" SELECT img_id, CAST({WIDTH} AS BIGINT) AS width, height FROM im",
    "scan_container": IMAGES + " SELECT img_id, 6 + CAST(ceil(height / 2.0) AS BIGINT) AS n_chunks, CAST(ceil(height / 2.0) AS BIGINT) AS n_idat, 'IDAT' AS first_type, CAST(0 AS BIGINT) AS faults FROM im",
    "chunk_read": "SELECT event_id AS img_id, CAST(CASE WHEN event_id % 7 = 0 THEN 0 ELSE 2 END AS BIGINT) AS n, CASE WHEN event_id % 7 = 0 THEN 'crc' END AS fault FROM events",
    "ihdr_patch": "SELECT user_id AS img_id, bool_or(event_id % 37 = 0) AS zstd, CAST(max(CASE WHEN event_id % 37 = 0 THEN 1 ELSE 0 END) AS INTEGER) AS compression_method FROM events GROUP BY 1",
    "meta_json": "WITH j AS (SELECT user_id AS img_id, event_type AS namespace, event_id, CASE WHEN event_id % 11 = 0 THEN props || '}' ELSE props END AS json FROM events) SELECT img_id, namespace, arg_max(json, event_id) AS json FROM j WHERE json_valid(json) GROUP BY ALL",
    "meta_exif": _first_sql("true"), "meta_icc": _first_sql("event_id % 3 <> 0"), "meta_xmp": _first_sql("event_id % 5 <> 0"), "meta_zdic": _first_sql("event_id % 3 <> 0"),
    "decode_metadata": "SELECT doc_id AS img_id, m.* FROM documents, (VALUES ('json', 'camera', '7b226b223a20317d'), ('json', 'author', '227822'), ('exif', '', '657869662064617461'), ('xmp', '', '3c782f3e'), ('icc', '', repeat('ab', 96)), ('hdr', '', '00003f80000000000000')) AS m(kind, namespace, data) WHERE text <> ''",
    "meta_idim": "SELECT o_orderkey, o_orderkey * 3 % 65536 AS tile_width, o_orderkey * 5 % 65536 AS tile_height, o_orderkey * 7 % 65536 AS tiles_x, o_orderkey * 11 % 65536 AS tiles_y, o_orderkey % 3 <= 1 AS valid FROM orders",
    "meta_plte": "WITH p AS (SELECT p_partkey AS img_id, CASE WHEN p_partkey % 2 = 1 THEN 4 ELSE 3 END AS n FROM part), e AS (SELECT img_id, n, CAST(k.k AS INTEGER) AS idx FROM p, unnest(range(0, 4)) AS k(k)) SELECT img_id, idx, (img_id * 31 + (idx * n) * 17) % 256 AS r, (img_id * 31 + (idx * n + 1) * 17) % 256 AS g, (img_id * 31 + (idx * n + 2) * 17) % 256 AS b, CASE WHEN n = 4 THEN (img_id * 31 + (idx * n + 3) * 17) % 256 ELSE 255 END AS a FROM e",
    "meta_chdr": "WITH h AS (SELECT o_orderkey AS k, o_orderkey % 10 <> 0 AS valid, 10 + CASE WHEN o_orderkey % 2 = 1 THEN 4 ELSE 0 END + CASE WHEN o_orderkey % 4 = 3 THEN 4 ELSE 0 END + CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END AS n FROM orders) SELECT k AS o_orderkey, CAST(n AS BIGINT) AS n, CASE WHEN valid THEN k % 4 END AS transfer, CASE WHEN valid THEN k % 3 END AS primaries, CASE WHEN valid THEN CAST(k % 1000 AS DOUBLE) END AS max_lum, CASE WHEN valid AND k % 2 = 1 THEN k % 97 END AS max_cll, CASE WHEN valid AND k % 4 = 3 THEN k % 89 END AS max_fall, valid FROM h",
    "be_read": cells_sql(1, 4) + f" SELECT img_id // {TILES} AS doc_id, CAST(sum(CASE WHEN i % 2 = 0 THEN 256 ELSE 1 END * v) AS BIGINT) AS u16, CAST(sum(CAST(v AS BIGINT) << (8 * (3 - i % 4))) AS BIGINT) AS u32 FROM cells GROUP BY 1",
    "header_validation": HEADERS,
    "compress_fallback": flat_sql(cells_sql() + " SELECT img_id, count(*) AS n, true AS kept_smaller, CAST(sum((i + 1) * v) AS BIGINT) AS byte_check FROM cells GROUP BY 1"),
    "compress_fallback_dict": flat_sql(cells_sql() + " SELECT img_id, count(*) AS n, CAST(sum((i + 1) * v) AS BIGINT) AS byte_check FROM cells GROUP BY 1"),
    "decompress_limited": flat_sql(cells_sql() + f" SELECT DISTINCT img_id, CASE (img_id // {TILES} + img_id % {TILES}) % 3 WHEN 2 THEN 'block' WHEN 1 THEN 'limit' ELSE '' END AS error FROM cells"),
    "decompress_budget": "WITH g AS (SELECT o_orderkey, o_orderkey % 500 + 1 AS w, o_orderkey * 7 % 300 + 1 AS h, o_orderkey % 3 AS il, CASE WHEN o_orderkey % 5 = 0 THEN 3 ELSE 6 END AS ct FROM orders) SELECT o_orderkey, CASE WHEN il = 1 THEN w*h*4 + 7 WHEN il = 2 THEN w*h*4 + 2 WHEN ct = 3 THEN w*h + h ELSE w*4*h + h END AS budget FROM g",
    "decompress_budget_used": "WITH l AS (SELECT l_orderkey AS img_id, CAST(l_linenumber AS INTEGER) AS seq, sum(l_partkey % 5000) AS n FROM lineitem GROUP BY ALL), u AS (SELECT img_id, seq, CAST(sum(n) OVER (PARTITION BY img_id ORDER BY seq) AS BIGINT) AS used FROM l) SELECT img_id, seq, used, used > 16448 AS over FROM u",
    "append_idat": IMAGES + " SELECT img_id, CAST(ceil(height / 4.0) AS BIGINT) AS n_idat, true AS bit_matches, height FROM im",
    "stream_chunk_progress": IMAGES + f" SELECT img_id, CAST(2 + ceil(height / 2.0) AS BIGINT) AS chunks, CAST(ceil(height / 2.0) AS BIGINT) AS tiles, {_ROW} * height + height AS budget, true AS ended FROM im",
    "compression_stats": IMAGES + " SELECT 'IHDR' AS type, count(*) AS n FROM im UNION ALL SELECT 'IEND', count(*) FROM im UNION ALL SELECT 'IDAT', CAST(sum(ceil(height / 2.0)) AS BIGINT) FROM im",
}
