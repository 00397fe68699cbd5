"""Quality rules: distribution divergence from language references, beside fixed repetition rules.

Main path: DataFrame functions only. Each text gets a histogram of character classes and one of the common words of
its language. The reference of a language is the sum of the histograms of all its texts that pass the fixed rules;
it covers the whole corpus. The verdict compares a text's distributions with its reference by Jensen-Shannon
distance (base 2, 0 to 1), and only where the text is long enough for its histogram to mean something.

Defined cases: a null text has no words and fails the fixed rules, as any text of under 10 words does; an unknown or
null language is compared with the pooled reference 'other'; a text below the minimum lengths, or whose language has
no reference, is judged by the fixed rules alone; equal rows give equal result rows; an empty table gives no rows;
columns other than those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, let, stored, tokens

#: The most common words of each language.
COMMON_WORDS = {
    "en": "the of and to in a is that for it with as was on be by are this from at".split(),
    "fr": "de la le et les des en un une du que est pour qui dans par sur au pas avec".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al".split(),
}
OTHER = "other"
#: Character classes, in the order in which they are taken out of a text; what is left over counts as the last.
CLASSES = (("lower", "[a-z]+"), ("space", SPACE), ("upper", "[A-Z]+"), ("digit", "[0-9]+"), ("symbol", "[#*$%&|<>]+"), ("sentence", r"[.,;:!?'\"()-]+"), ("ascii", r"[\x00-\x7F]+"))
SYMBOL_AT = [name for name, _ in CLASSES].index("symbol")
SPACE_AT = [name for name, _ in CLASSES].index("space")
WINDOW = 5
#: Guards and thresholds: fewest characters and words for a divergence to count, the largest distance of characters
#: that passes, and for common words the largest share of the distance that a text with none of them has.
MIN_CHARS, MIN_WORDS, MAX_CHAR_JSD, MAX_WORD_SHARE = 200, 50, 0.25, 0.95


def class_counts(text: Column) -> Column:
    """Code points of each class and of the rest: classes are removed one by one, so that later passes read little."""
    def removed(rest: Column, at: int, counts: list[Column]) -> Column:
        if at == len(CLASSES):
            return F.array(*counts, F.char_length(rest).cast("bigint"))
        return let(F.regexp_replace(rest, F.lit(CLASSES[at][1]), F.lit("")), lambda left: removed(left, at + 1, [*counts, (F.char_length(rest) - F.char_length(left)).cast("bigint")]))

    return let(text, lambda t: removed(t, 0, []))


def repeated_words(words: Column, size: int = WINDOW) -> Column:
    """Words in windows of `size` that are found twice or more in the text, the first included.

    Most texts repeat no window, which a hash set shows; only the others have their windows sorted.
    """
    def covered(h: Column) -> Column:
        by_hash = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        dup = lambda s: F.filter(s, lambda e, j: (e["x"] == F.get(s, j - 1)["x"]) | (e["x"] == F.get(s, j + 1)["x"]))
        places = let(by_hash, lambda s: F.array_sort(F.transform(dup(s), lambda e: e["i"])))
        return let(places, lambda p: F.coalesce(F.aggregate(F.transform(p, lambda at, j: F.least(F.coalesce(F.get(p, j + 1) - at, F.lit(size)), F.lit(size)).cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a + x), F.lit(0).cast("bigint")))

    hashes = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]))
    return let(words, lambda w: F.when(F.size(w) <= size, F.lit(0).cast("bigint")).otherwise(let(hashes(w), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(covered(h)))))


def repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.trim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint"))


def common_counts(words: Column, lang: Column) -> Column:
    """How often each common word of the text's language stands in it; the other languages' words for 'other'."""
    every = sorted({w for ws in COMMON_WORDS.values() for w in ws})
    of = F.array(*map(F.lit, every))
    for name, ws in COMMON_WORDS.items():
        of = F.when(lang == name, F.array(*map(F.lit, ws))).otherwise(of)
    seen = F.filter(words, lambda w: w.isin(every))
    return let(F.struct(seen.alias("s"), of.alias("of")), lambda p: F.transform(p["of"], lambda w: (F.size(p["s"]) - F.size(F.array_remove(p["s"], w))).cast("bigint")))


def features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One narrow row per document: the fixed counts and both histograms. The only pass over the texts."""
    t = F.coalesce(F.col(text), F.lit(""))
    known = F.when(F.col(lang).isin(*COMMON_WORDS), F.col(lang)).otherwise(OTHER)
    d = docs.select(F.col(doc_id).alias("doc_id"), t.alias("_t"), known.alias("lang"), tokens(t).alias("_w"))
    d = d.select(
        "doc_id", "lang", F.size("_w").cast("bigint").alias("n_words"), class_counts(F.col("_t")).alias("classes"),
        common_counts(F.col("_w"), F.col("lang")).alias("common"), repeated_lines(F.col("_t")).alias("n_dup_lines"), repeated_words(F.col("_w")).alias("n_repeat_words"),
    )
    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda x, y: x + y)
    d = d.withColumn("n_chars", total(F.col("classes")))
    d = d.withColumn("word_chars", F.col("n_chars") - F.get("classes", F.lit(SPACE_AT))).withColumn("n_symbols", F.get("classes", F.lit(SYMBOL_AT)))
    return d.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def references(feats: DataFrame) -> DataFrame:
    """lang, ref_classes, ref_common: sums over all texts that pass the fixed rules; at most one row for each of
    the named languages and one for the others."""
    good = feats.where(~F.col("base_failed"))
    both = F.concat(F.transform("classes", lambda x, i: F.struct(F.lit(0).alias("which"), i.alias("i"), x.alias("n"))), F.transform("common", lambda x, i: F.struct(F.lit(1).alias("which"), i.alias("i"), x.alias("n"))), F.array(F.struct(F.lit(2).alias("which"), F.lit(0).alias("i"), F.col("n_words").alias("n"))))
    sums = good.select("lang", F.explode(both).alias("x")).groupBy("lang", "x.which", "x.i").agg(F.sum("x.n").alias("n"))
    rows = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("which", "i", "n"))).alias("all"))
    of = lambda k: F.transform(F.filter("all", lambda x: x["which"] == k), lambda x: x["n"])
    return rows.select("lang", of(0).alias("ref_classes"), of(1).alias("ref_common"), F.get(of(2), F.lit(0)).alias("ref_words"))


def with_rest(counts: Column, total: Column) -> Column:
    """Counts of named words and, last, of all other words."""
    return F.concat(counts, F.array(total - F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, x: a + x)))


def jensen_shannon(p: Column, q: Column) -> Column:
    """Distance of two count arrays of one length, base 2; null if either is all zero."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    shares = lambda a: let(total(a), lambda s: F.when(s > 0, F.transform(a, lambda x: x / s)))
    term = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    pair = F.struct(shares(p).alias("p"), shares(q).alias("q"))
    return let(pair, lambda s: F.sqrt(F.greatest(F.lit(0.0), total(F.zip_with(s["p"], s["q"], lambda x, y: (term(x, (x + y) / 2) + term(y, (x + y) / 2)) / 2)))))


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, char_jsd, word_jsd."""
    feats = stored(features(docs, doc_id, text, lang), "quality")
    ref = F.broadcast(references(feats))  # at most len(COMMON_WORDS) + 1 rows
    d = feats.join(ref, "lang", "left")
    chars = F.when(F.col("n_chars") >= MIN_CHARS, jensen_shannon(F.col("classes"), F.col("ref_classes")))
    by_word = jensen_shannon(with_rest(F.col("common"), F.col("n_words")), with_rest(F.col("ref_common"), F.col("ref_words")))
    none = jensen_shannon(with_rest(F.transform("common", lambda x: F.lit(0).cast("bigint")), F.lit(1).cast("bigint")), with_rest(F.col("ref_common"), F.col("ref_words")))
    long_enough = F.col("n_words") >= MIN_WORDS
    d = d.withColumn("char_jsd", F.round(chars, 9)).withColumn("word_jsd", F.round(F.when(long_enough, by_word), 9)).withColumn("_none", F.round(none, 9))
    far = (F.coalesce("char_jsd", F.lit(0.0)) > MAX_CHAR_JSD) | F.coalesce(F.col("word_jsd") > MAX_WORD_SHARE * F.col("_none"), F.lit(False))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~far).alias("kept"), "char_jsd", "word_jsd")
