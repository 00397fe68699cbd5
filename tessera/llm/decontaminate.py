"""Benchmark decontamination: a broadcast hash set of normalised test n-grams against training token windows.

Main path: DataFrame functions only. A benchmark item's windows are its runs of `size` consecutive words (one
window, the whole item, if it has fewer words). Every window of every training text is hashed and joined to the
set; a hit is verified word by word. The set is broadcast only if its counted rows stay under a limit; beyond it
both sides shuffle on the hash, so that the result is the same at any size.

Defined cases: null or empty texts have no words and no hits; null or empty items have no windows; an item that
is there twice counts once; equal rows give equal result rows, one for each input row; a null doc_id is a value
like another; columns other than those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import gram_rows, hex_sha256, let, probe, unpacked, whole_row

WINDOW = 10


def benchmark_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """gram_size, gram_hash, gram and the sorted items (as strings) that hold the window."""
    items = benchmark.select(F.col(item_id).cast("string").alias("_item"), F.col(text).alias("_text"))
    rows = gram_rows(items, ["_item"], "_text", size)
    return rows.groupBy("gram_size", "gram_hash", "gram").agg(F.collect_set(F.coalesce("_item", F.lit(""))).alias("items"))


def scan(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, text_hash, n_words, spans (sorted start/end word pairs of hits), items, copies."""
    windows = benchmark_windows(benchmark, size=size)
    sizes = {r[0]: r[1] for r in windows.groupBy("gram_size").count().collect()}  # at most `size` rows
    hits = probe(docs, doc_id, text, windows, sizes or [size], ["items"], sum(sizes.values()))
    found = hits.groupBy("doc_id", "text_hash", "n_words").agg(
        F.sum("own").alias("copies"),
        F.array_sort(F.collect_set(F.when(F.col("own") == 0, F.struct(F.col("pos").alias("start"), (F.col("pos") + F.col("gram_size")).alias("end"))))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    return found


def covered(spans):
    """Words in the union of sorted start/end pairs."""
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end"))
    return F.aggregate(
        spans,
        zero,
        lambda a, s: F.struct(
            (a["n"] + F.greatest(F.lit(0).cast("bigint"), s["end"] - F.greatest(s["start"].cast("bigint"), a["end"]))).alias("n"),
            F.greatest(a["end"], s["end"].cast("bigint")).alias("end"),
        ),
        lambda a: a["n"],
    )


def report(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: one row for each row of docs."""
    found = scan(docs, benchmark, doc_id, text, size)
    out = found.select(
        "doc_id",
        "n_words",
        covered(F.col("spans")).alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        hex_sha256(F.array_join("items", ",")).alias("items_sha256"),
        "copies",
    ).withColumn("contaminated", F.col("n_hit") > 0)
    return out.select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("_copy")).drop("copies", "_copy")


#: Separators between words in a text whose case is kept.
NOT_WORD_RAW = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD_RAW = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def remove(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, max_share: float = 0.5) -> DataFrame:
    """docs without benchmark passages: hit words and what stands between them are cut out of the text.

    A document of which more than max_share of the words are hit goes as a whole. Untouched documents keep their
    bytes. Columns are those of docs; n_chars, if there, follows the new text.
    """
    found = scan(docs, benchmark, size=size).where(F.size("spans") > 0)
    bad = found.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("spans").alias("_spans"), (covered(F.col("spans")) / F.col("n_words") > max_share).alias("_gone"))
    keyed = docs.select(whole_row(docs), F.col("doc_id").alias("_of"), F.col("text").alias("_text"), F.xxhash64(F.col("text"), F.char_length("text")).alias("_key"))
    joined = keyed.join(bad, F.col("_of").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_hash")), "left").where(~F.coalesce("_gone", F.lit(False)))
    raw_words = F.array_remove(F.split("_text", NOT_WORD_RAW, -1), "")
    seps = F.split("_text", WORD_RAW, -1)  # one more than the words

    # hit words in order; a run of them ends where the next hit isn't the next word
    hits = F.sort_array(F.array_distinct(F.flatten(F.transform("_spans", lambda s: F.sequence(s["start"].cast("int"), s["end"].cast("int") - 1)))))
    firsts = lambda h: F.filter(h, lambda x, i: F.coalesce(F.get(h, i - 1) < x - 1, F.lit(True)))
    afters = lambda h: F.transform(F.filter(h, lambda x, i: F.coalesce(F.get(h, i + 1) > x + 1, F.lit(True))), lambda x: x + 1)

    def rebuilt(parts):
        """What stands between the runs, each part with the separator that ends it: every word is read once."""
        pairs = F.zip_with(parts["sep"], parts["w"], lambda sep, w: F.concat(sep, w))
        kept = lambda p: F.zip_with(
            F.concat(F.array(F.lit(0)), p["after"]),
            F.concat(p["first"], F.array(F.size(parts["w"]))),
            lambda start, end: F.concat(F.array_join(F.slice(p["pairs"], start + 1, end - start), ""), F.coalesce(F.get(parts["sep"], end), F.lit(""))),
        )
        runs = let(hits, lambda h: F.struct(firsts(h).alias("first"), afters(h).alias("after")))
        return let(F.struct(pairs.alias("pairs"), runs["first"].alias("first"), runs["after"].alias("after")), lambda p: F.array_join(kept(p), ""))

    cut = let(F.struct(raw_words.alias("w"), seps.alias("sep")), rebuilt)
    out = joined.withColumn("_text", F.when(F.col("_spans").isNotNull(), cut).otherwise(F.col("_text")))
    n_chars = F.when(F.col("_spans").isNotNull(), F.char_length("_text").cast("bigint"))
    return unpacked(out, docs, text=F.col("_text"), n_chars=n_chars)


__all__ = ["WINDOW", "benchmark_windows", "covered", "remove", "report", "scan"]
