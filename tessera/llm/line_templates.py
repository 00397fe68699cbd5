"""Line dedup by a log-template tree of fixed depth; templates that recur across documents are dropped.

Main path: DataFrame functions only. A line walks down the tree by its token count, then by its tokens from the first
one on. Tokens with a digit are variable fields and become <*> everywhere. A leaf holds the lines whose templates agree:

  whole      all tokens; a template counts from MIN_DOCS documents on, or SHORT_DOCS if it has under MIN_TOKENS tokens
  one field  all tokens but one field, which becomes <*> too: one token of lines of VARY_TOKENS tokens on, at most four
             consecutive ones (every field of one to three is inside such a window) of lines of WIDE_TOKENS on. It
             counts from VARY_DOCS documents on, or MIN_DOCS if its lines have LONG_TOKENS tokens

So a dropped line has the words of its template's first line but for one short field, however long it is. Lines with
two fields of plain words that vary are not one template. The occurrence in the document with the smallest id stays,
so that copies lose a passage but the corpus keeps it.

Work: whole lines are counted first. Copies of a line that alone meets what a template with a field needs are settled by
that, and only the first of them takes part further on. Then each line is keyed by the longest head and tail that a
field leaves alone: the lines of a template agree in one of the two. Only where a head or tail stands in as many
documents as a template needs, in at least two different lines, do its lines give the keys of their fields. A key is
128 bits of hash, two independent halves: among 10^13 keys a single false match has odds of 10^-12. Every aggregation
combines before it shuffles, and no group of lines is gathered.

Defined cases: a null or empty text has no lines and stays, and blank lines stay; ids may be numbers or strings; a
null doc_id counts as one document, smaller than all others; rows with one doc_id count as one document; lines that
recur inside one document only stay; equal rows get equal decisions; a text whose lines all go becomes empty; columns
other than text and n_chars pass through, but for n_lines and n_dropped, which are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, let, small, stored, whole_row

#: Documents and tokens of a template, as above. From WIDE_TOKENS on a field is two cells of two tokens, else one of one.
MIN_DOCS, MIN_TOKENS, SHORT_DOCS = 2, 8, 10
VARY_DOCS, VARY_TOKENS, WIDE_TOKENS, LONG_TOKENS = 10, 5, 12, 16
NO_ID = -(2**63)


#: A token with a digit, entered at its start only.
VARIABLE = r"(?<![^\x20])[^\x200-9]*+[0-9][^\x20]*+"
#: White space that isn't one plain space between two tokens.
LOOSE = r"[\x09\x0B-\x0D]|  |^ | $"


def document(docs: DataFrame, doc_id: str) -> Column:
    """The id as a value that is never null and keeps its order, with null before all others."""
    if dict(docs.dtypes)[doc_id] in ("tinyint", "smallint", "int", "bigint"):
        return F.coalesce(F.col(doc_id).cast("bigint"), F.lit(NO_ID))
    return F.when(F.col(doc_id).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(doc_id).cast("string")))


def text_hash(text: str) -> Column:
    return F.xxhash64(F.col(text), F.char_length(text))


def key_of(*values: Column | str) -> Column:
    """128 bits: two hashes of the same values from different seeds."""
    return F.struct(F.xxhash64(F.lit(1), *values).alias("a"), F.xxhash64(F.lit(2), *values).alias("b"))


def lines_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, text_hash, line (from 0), l (masked), n (tokens), whole, head, tail: a row per line that isn't blank; head
    and tail are null where no field may vary.

    Lines are exploded first, so that everything about a line is plain columns of compiled code.
    """
    d = docs.select(document(docs, doc_id).alias("doc"), text_hash(text).alias("text_hash"), F.split(F.col(text), "\n", -1).alias("lines"))
    d = d.select("doc", "text_hash", F.posexplode("lines").alias("line", "l"))
    tidy = F.when(F.col("l").rlike(LOOSE), F.trim(F.regexp_replace("l", F.lit(SPACE), F.lit(" ")))).otherwise(F.col("l"))
    d = d.withColumn("l", tidy).where("l <> ''")
    d = d.withColumn("l", F.when(F.col("l").rlike("[0-9]"), F.regexp_replace("l", F.lit(VARIABLE), F.lit("<*>"))).otherwise(F.col("l")))
    d = d.withColumn("n", F.octet_length("l") - F.octet_length(F.replace(F.col("l"), F.lit(" "), F.lit(""))) + 1)
    n = F.col("n")
    fixed = F.floor((n - F.when(n >= WIDE_TOKENS, 4).otherwise(1)) / 2).cast("int")  # a field of this width can't touch both
    end = lambda side, tokens: F.when(n >= VARY_TOKENS, F.xxhash64(F.lit(side), n, F.call_function("substring_index", "l", F.lit(" "), tokens)))
    return d.select("doc", "text_hash", "line", "l", "n", key_of(F.lit("whole"), "l").alias("whole"), end("head", fixed).alias("head"), end("tail", -fixed).alias("tail"))


def fields_of(lines: DataFrame) -> DataFrame:
    """doc, text_hash, line, n, enough, key: a row for each field of each line (l, n), which is all that its key leaves out.

    The cells of a line are hashed once and combined by xor, so that a line costs one pass and not one for each field.
    """
    n = F.col("n")
    width = F.when(n >= WIDE_TOKENS, 2).otherwise(1)
    t = lines.select("doc", "text_hash", "line", "n", "enough", width.alias("width"), F.split("l", " ", -1).alias("t"))
    cell = lambda half: F.transform(F.sequence(F.lit(0), F.ceil(n / F.col("width")).cast("int") - 1), lambda k: F.xxhash64(F.lit(half), k, F.slice("t", k * F.col("width") + 1, F.col("width"))))
    t = t.select("doc", "text_hash", "line", "n", "enough", "width", cell(1).alias("a"), cell(2).alias("b"))
    every = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda s, x: s.bitwiseXOR(x))
    t = t.select("doc", "text_hash", "line", "n", "enough", "width", "a", "b", every("a").alias("all_a"), every("b").alias("all_b"))
    last = F.size("a") - F.col("width")  # a field is as many cells as a cell has tokens

    def without(c: str, k: Column) -> Column:
        rest = F.col(f"all_{c}").bitwiseXOR(F.get(c, k))
        return F.when(F.col("width") == 2, rest.bitwiseXOR(F.get(c, k + 1))).otherwise(rest)

    keys = F.transform(F.sequence(F.lit(0), last), lambda k: F.struct(k.alias("k"), without("a", k).alias("a"), without("b", k).alias("b")))
    t = t.select("doc", "text_hash", "line", "n", "enough", F.explode(keys).alias("f"))
    return t.select("doc", "text_hash", "line", "n", "enough", F.struct(F.xxhash64("n", "f.k", "f.a").alias("a"), F.xxhash64(F.lit(2), "n", "f.k", "f.b").alias("b")).alias("key"))


def counted(keyed: DataFrame, least: Sequence[str] = (), most: Sequence[str] = ()) -> DataFrame:
    """key, docs, first_doc, n, min_c of `least` and max_c of `most` of keyed rows (key, doc, n, ...): each document counts once."""
    once = keyed.groupBy("key", "doc").agg(F.max("n").alias("n"), *[F.min(c).alias(f"min_{c}") for c in least], *[F.max(c).alias(f"max_{c}") for c in most])
    return once.groupBy("key").agg(F.count("*").alias("docs"), F.min("doc").alias("first_doc"), F.max("n").alias("n"), *[F.min(f"min_{c}").alias(f"min_{c}") for c in least], *[F.max(f"max_{c}").alias(f"max_{c}") for c in most])


def dropped_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS, short_docs: int = SHORT_DOCS, vary_docs: int = VARY_DOCS) -> DataFrame:
    """doc, text_hash, drop (line numbers): what goes from each document that loses a line."""
    lines = stored(lines_of(docs, doc_id, text), "lines")
    n, at = F.col("n"), ["doc", "text_hash", "line"]
    need = F.when(n < min_tokens, short_docs).otherwise(min_docs)
    vary = F.when(n >= LONG_TOKENS, min_docs).otherwise(vary_docs)
    later, may_vary = F.col("doc") > F.col("first_doc"), F.col("head").isNotNull()
    whole = lines.drop("l").withColumnRenamed("whole", "key")
    # written, so that the join deals the lines anew and may split a line that is everywhere
    repeated = stored(counted(whole).where("docs > 1").select("key", "docs", "first_doc"), "repeated")
    known = whole.join(repeated, "key", "left").withColumns({"docs": F.coalesce("docs", F.lit(1)), "first_doc": F.coalesce("first_doc", "doc")})
    seen = stored(known.where((F.col("docs") >= need) | may_vary), "seen")
    gone = seen.where((F.col("docs") >= need) & later).select(*at)
    # copies of a line that meets the need of a template with a field are gone already, but for the first
    apart = seen.where(may_vary & ((F.col("docs") < vary) | ~later)).select(*at, "n", (F.col("docs") >= vary).alias("enough"), F.col("key.a").alias("whole"), F.explode(F.array("head", "tail")).alias("key"))
    shared = counted(apart, ["whole"], ["whole", "enough"]).where(((F.col("docs") >= vary) | F.col("max_enough")) & (F.col("min_whole") < F.col("max_whole")))
    shared = stored(shared.select("key"), "shared")
    likely = stored(apart.join(shared, "key", "left_semi").select(*at, "enough").distinct(), "likely")
    fields = stored(fields_of(lines.select(*at, "n", "l").join(small(likely, likely.count()), at)), "fields")
    templates = stored(counted(fields, most=["enough"]).where((F.col("docs") >= vary) | F.col("max_enough")).select("key", "first_doc"), "templates")
    varied = fields.join(templates, "key").where(later).select(*at)
    return gone.unionByName(varied).groupBy("doc", "text_hash").agg(F.array_sort(F.collect_set("line")).alias("drop"))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **limits: int) -> DataFrame:
    """docs with the text without its dropped lines, n_chars (if there) with it, and n_lines and n_dropped, which
    replace columns of these names."""
    drops = dropped_lines(docs, doc_id, text, **limits)
    keyed = docs.select(whole_row(docs), document(docs, doc_id).alias("_id"), F.col(text).alias("_text"), text_hash(text).alias("_hash"))
    joined = keyed.join(drops, (F.col("_id") == F.col("doc")) & (F.col("_hash") == F.col("text_hash")), "left")
    all_lines = F.split("_text", "\n", -1)

    def between(lines: Column) -> Column:  # what stands before, between and after the dropped lines
        gone = lambda k: F.get("drop", k)
        after = lambda k: F.when(k == 0, 0).otherwise(gone(k - 1) + 1)
        return F.flatten(F.transform(F.sequence(F.lit(0), F.size("drop")), lambda k: F.slice(lines, after(k) + 1, F.coalesce(gone(k), F.size(lines)) - after(k))))

    kept = F.array_join(let(all_lines, between), "\n")
    cut = F.col("drop").isNotNull()
    d = joined.withColumn("_new", F.when(cut, kept).otherwise(F.col("_text")))
    values = {c: F.col("_row").getField(c) for c in docs.columns if c not in ("n_lines", "n_dropped")} | {text: F.col("_new")}
    if "n_chars" in docs.columns:
        values["n_chars"] = F.when(cut, F.char_length("_new").cast("bigint")).otherwise(values["n_chars"])
    n_lines = F.when(F.col("_text").isNull(), 0).otherwise(F.size(all_lines)).cast("bigint")
    n_dropped = F.when(cut, F.size("drop")).otherwise(0).cast("bigint")
    return d.select(*[v.alias(c) for c, v in values.items()], n_lines.alias("n_lines"), n_dropped.alias("n_dropped"))


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped, text: every document with what the operator leaves of it."""
    return deduplicate(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).select("doc_id", "n_lines", "n_dropped", "text")
