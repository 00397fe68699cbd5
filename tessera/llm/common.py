"""Pieces the text operators share: tokenizers, shared-folder tables, size-checked broadcasts, k-gram probing."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Sequence

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words once A-Z are lower-cased.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: White space between tokens.
SPACE = r"[\x20\x09-\x0D]+"
#: A broadcast needs at most this many rows of bounded width; beyond it the join shuffles both sides.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; pure ASCII texts take the fast built-in path."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """Lower-cased alphanumeric and non-ASCII runs of a text, [] for null."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), NOT_WORD, -1), "")


def tokens(text: Column) -> Column:
    """Runs without white space, [] for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE, -1), "")


def hex_sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the session names none and all of it runs
    in this process. On a cluster without one this is an error, as a machine's own folder would lose what others write."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tessera.shared.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("tessera.shared.dir", where)
    return where.rstrip("/")


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Cut the lineage: write the rows as Parquet under the shared folder and read them back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table made by stored() once nothing will read it again."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast if the counted rows stay under the limit; otherwise leave the join to shuffle."""
    return F.broadcast(df) if rows <= limit else df


def whole_row(df: DataFrame) -> Column:
    """All columns as one, `_row`, so that an operator's own columns can't clash with a table's."""
    return F.struct(*df.columns).alias("_row")


def unpacked(df: DataFrame, like: DataFrame, **changed: Column) -> DataFrame:
    """The columns of `like` out of `_row`; a changed one takes its new value where that isn't null, `text` always."""
    row = lambda c: F.col("_row").getField(c)
    new = lambda c: changed[c] if c == "text" else F.coalesce(changed[c], row(c))
    return df.select(*[(new(c) if c in changed else row(c)).alias(c) for c in like.columns])


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: a lambda's variable, which the optimizer doesn't inline."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def gram_hashes(word_hashes: Column, n: Column, size: int) -> Column:
    """The hash of every window of `size` word hashes, [] where there are fewer."""
    return F.when(
        n >= size,
        F.transform(F.sequence(F.lit(1), n - (size - 1)), lambda i: F.xxhash64(F.slice(word_hashes, i, size))),
    ).otherwise(F.array().cast("array<bigint>"))


def gram_rows(items: DataFrame, keep: Sequence[str], text: str, size: int, whole_if_shorter: bool = True) -> DataFrame:
    """Every window of `size` words of each item with its place: keep..., gram_size, place, gram, gram_hash.

    An item of fewer words, but not none, is one window if whole_if_shorter.
    """
    w = items.select(*keep, words(F.col(text)).alias("_w"))
    k = F.least(F.size("_w"), F.lit(size))
    w = w.select(*keep, "_w", k.alias("gram_size")).where(F.col("gram_size") > 0)
    if not whole_if_shorter:
        w = w.where(F.col("gram_size") == size)
    w = w.select(*keep, "_w", "gram_size", F.explode(F.sequence(F.lit(0), F.size("_w") - F.col("gram_size"))).alias("place"))
    gram = F.slice("_w", F.col("place") + 1, F.col("gram_size"))
    return w.select(
        *keep,
        "gram_size",
        "place",
        F.array_join(gram, " ").alias("gram"),
        F.xxhash64(F.transform(gram, lambda x: F.xxhash64(x))).alias("gram_hash"),
    )


def probe(docs: DataFrame, doc_id: str, text: str, grams: DataFrame, sizes: Sequence[int], payload: Sequence[str], gram_count: int) -> DataFrame:
    """Join every rolling word window of every text to `grams` and keep the verified hits.

    docs: any table with doc_id and text. grams: gram_size, gram_hash, gram and the payload columns, one row
    for each (gram_size, gram_hash, gram[, place]). Returns doc_id, text_hash, n_words, own (1 on the one row
    that each text has besides its hits, else 0), pos, gram_size and the payload, null where own is 1.

    With a broadcast set the texts are read once, windows are exploded inside one stage, and only hits leave it. Else
    windows are shuffled as hashes, without their words, and what they hit is verified against the words of its text.
    """
    d = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text), F.char_length(text)).alias("text_hash"), words(F.col(text)).alias("_w"))
    all_sizes = sorted(set(sizes))
    end = F.array(F.lit(0).cast("bigint"))
    windows = let(F.transform("_w", lambda x: F.xxhash64(x)), lambda h: F.concat(*[gram_hashes(h, F.size(h), k) for k in all_sizes], end))
    n_words = F.size("_w").alias("n_words")

    def placed(exploded: DataFrame, *keep: str) -> DataFrame:
        size, pos, start = F.lit(0), F.col("_i"), F.lit(0)
        for k in all_sizes:  # which of the concatenated window lists an index falls in
            size = F.when(F.col("_i") >= start, F.lit(k)).otherwise(size)
            pos = F.when(F.col("_i") >= start, F.col("_i") - start).otherwise(pos)
            start = start + F.greatest(F.col("n_words") - (k - 1), F.lit(0))
        own = F.col("_i") == F.col("_n") - 1
        return exploded.select(*keep, own.cast("int").alias("own"), F.when(~own, pos).alias("pos"), F.when(own, 0).otherwise(size).alias("gram_size"), "gram_hash")

    g = grams.select("gram_size", "gram_hash", F.col("gram").alias("_gram"), *payload)
    real = F.array_join(F.slice("_w", F.col("pos") + 1, F.col("gram_size")), " ") == F.col("_gram")
    out = ["doc_id", "text_hash", F.col("n_words").cast("bigint").alias("n_words"), "own", "pos", "gram_size", *payload]
    if gram_count <= BROADCAST_ROWS:
        d = d.select("doc_id", "text_hash", "_w", n_words, windows.alias("_p"))
        d = d.select("doc_id", "text_hash", "n_words", "_w", F.size("_p").alias("_n"), F.posexplode_outer("_p").alias("_i", "gram_hash"))
        joined = placed(d, "doc_id", "text_hash", "n_words", "_w").join(small(g, gram_count), ["gram_size", "gram_hash"], "left")
        return joined.where((F.col("own") == 1) | (F.col("_gram").isNotNull() & real)).select(*out)
    none = [F.lit(None).cast(grams.schema[c].dataType).alias(c) for c in payload]
    alone = d.select("doc_id", "text_hash", n_words.cast("bigint"), F.lit(1).alias("own"), F.lit(None).cast("int").alias("pos"), F.lit(0).alias("gram_size"), *none)
    narrow = d.select("doc_id", "text_hash", n_words, windows.alias("_p"))
    narrow = narrow.select("doc_id", "text_hash", "n_words", F.size("_p").alias("_n"), F.posexplode("_p").alias("_i", "gram_hash"))
    hits = placed(narrow, "doc_id", "text_hash", "n_words").where("own = 0").join(g, ["gram_size", "gram_hash"])
    same = d.dropDuplicates(["doc_id", "text_hash"]).select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t"), "_w")
    hits = hits.join(same, F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("text_hash").eqNullSafe(F.col("_t"))).where(real)
    return alone.unionByName(hits.select(*out))


def ship(module: str) -> None:
    """Send a module's functions to the executors with the job, so that they need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
