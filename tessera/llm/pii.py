"""Personal data: seed entities by pattern, then bootstrapped contextual extraction of unseen identifiers.

Main path: DataFrame functions only.
1. Seeds: emails, IP addresses, card and phone numbers, each with its place, and every other identifier-shaped token
   (a run of at least MIN_ID letters and digits with both, or of digits alone).
2. Each seed or token has a lexical pattern: the token before it and its own opening (what stands between the white
   space and it, such as a quote). Spark sums the graph pattern - instance over the corpus.
3. Scores go back and forth a fixed number of rounds: a pattern's confidence is the mean confidence of its distinct
   instances, drawn towards 0 by PRIOR phantom instances; an instance's confidence is 1 for a seed, else that of its
   best pattern. Patterns need MIN_SUPPORT distinct instances. Identifiers that are seeds, or look like known secrets
   (SECRET), start at 1; all others at 0.
4. Tokens under a pattern of at least MIN_CONFIDENCE are new spans of kind 'id'; base spans stay, and a new span never
   overlaps one.

Defined cases: a null or empty text has no spans; matches that fail their check are dropped without another try; equal
rows give equal result rows and count once in the graph for each row; an empty table gives no rows; very long texts
are read by linear patterns (possessive, and started only where a run begins); columns other than those named are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, hex_sha256, let, small, stored, unpacked, whole_row

#: The kinds in report order and their patterns. Each is its plain form made linear: a run is entered
#: at its start or where the match before ended, and never given back.
KINDS = (
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", r"[0-9](?:[\x20-]?[0-9])++"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
ID = "id"
MIN_ID, RUN = 12, 100
#: Letters and digits mixed, or a long run of digits: what an identifier looks like.
ID_SHAPE = rf"(?<![A-Za-z0-9_])(?=[A-Za-z_]*+[0-9])[A-Za-z0-9_]{{{MIN_ID},}}+"
#: Identifiers that are secrets by their form alone (hex digests and prefixed keys).
SECRET = r"^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk_[A-Za-z0-9_]{20,})$"
ROUNDS, PRIOR, MIN_SUPPORT, MIN_CONFIDENCE = 3, 2.0, 5, 0.7
CONTEXT = 48  # characters read before a token for its pattern


def located(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>>: non-overlapping matches from the left, with their code point places.

    What stands between the matches comes from split(), so that places are running sums of lengths.
    """
    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("gap"))

    kind = "array<struct<start:int,end:int,value:string>>"

    def run(pairs: Column, at: Column) -> Column:
        zero = F.struct(at.alias("at"), F.array().cast(kind).alias("out"))
        step = lambda a, x: F.struct(
            (a["at"] + x["g"] + F.char_length(x["v"])).alias("at"),
            F.array_append(a["out"], F.struct((a["at"] + x["g"]).alias("start"), (a["at"] + x["g"] + F.char_length(x["v"])).alias("end"), x["v"].alias("value"))).cast(kind).alias("out"),
        )
        return F.aggregate(pairs, zero, step)

    def places(p: Column) -> Column:
        # an append copies what is there, so matches are placed RUN at a time and the runs are joined at the end
        pairs = F.transform(p["m"], lambda v, i: F.struct(v.alias("v"), F.char_length(F.get(p["gap"], i)).alias("g")))
        zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("runs"))
        more = lambda a, r: F.struct(r["at"].alias("at"), F.array_append(a["runs"], r["out"]).cast(f"array<{kind}>").alias("runs"))
        runs = lambda all_: F.aggregate(F.sequence(F.lit(0), F.size(all_) - 1, F.lit(RUN)), zero, lambda a, k: let(run(F.slice(all_, k + 1, F.lit(RUN)), a["at"]), lambda r: more(a, r)), lambda a: F.flatten(a["runs"]))
        return let(pairs, runs)

    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return let(found, lambda p: F.when(F.size(p["m"]) == 0, none).otherwise(places(p)))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, F.lit("[^0-9]+"), F.lit(""))


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\.", -1), lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])$"))
    if kind == "card":
        return let(digits(value), lambda d: F.char_length(d).between(16, 19) & F.call_function("luhn_check", d))
    if kind == "phone":
        return F.char_length(digits(value)).between(8, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """array<struct<kind int, start, end, value>> of the valid seeds, sorted by kind as listed, then start."""
    none = F.array().cast("array<struct<kind:int,start:int,end:int,value:string>>")

    def of(k: int, kind: str, pattern: str) -> Column:
        good = F.filter(located(text, pattern), lambda m: valid(kind, m["value"]))
        named = F.transform(good, lambda m: F.struct(F.lit(k).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value")))
        may = F.contains(text, F.lit(NEEDS[kind])) if NEEDS[kind] else text.rlike("[0-9](?:[ -]?[0-9]){15}")
        return F.when(may, named).otherwise(none)

    parts = [of(k, kind, pattern) for k, (kind, pattern) in enumerate(KINDS)]
    return F.concat(*parts)


def candidates(text: Column) -> Column:
    """Identifier-shaped tokens that are no seed themselves: array<struct<start, end, value>>."""
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return F.when(text.rlike(f"[A-Za-z0-9_]{{{MIN_ID}}}") & text.rlike("[0-9]"), located(text, ID_SHAPE)).otherwise(none)


def context(text: Column, start: Column) -> Column:
    """The lexical pattern before a place: up to two tokens and the opening, lower-cased, digits as 0."""
    before = F.substring(text, F.greatest(start - (CONTEXT - 1), F.lit(1)), F.least(start, F.lit(CONTEXT)))
    tail = F.regexp_extract(before, r"((?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]+)?(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]+)?[^\x20\x09-\x0D]*)$", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(tail, F.lit(SPACE), F.lit(" ")), F.lit("[0-9]+"), F.lit("0")))


def entities(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, base, ids: one narrow row per document, ids with their pattern. The only pass over the texts."""
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.select(F.col(doc_id).alias("doc_id"), t.alias("_t"), base_spans(t).alias("base"), candidates(t).alias("_ids"))
    free = F.filter("_ids", lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    ids = F.transform(free, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), context(F.col("_t"), x["start"]).alias("pattern")))
    base = F.transform("base", lambda b: F.struct(b["kind"].alias("kind"), b["start"].alias("start"), b["end"].alias("end"), b["value"].alias("value"), context(F.col("_t"), b["start"]).alias("pattern")))
    return d.select("doc_id", base.alias("base"), ids.alias("ids"))


def learn_patterns(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """pattern, confidence: the patterns that are trusted after the rounds, from the graph of all documents."""
    seeds = found.select(F.explode("base").alias("x")).select("x.pattern", F.concat_ws(":", "x.kind", "x.value").alias("instance"), F.lit(1.0).alias("seed"))
    others = found.select(F.explode("ids").alias("x")).select("x.pattern", F.col("x.value").alias("instance"), F.when(F.col("x.value").rlike(SECRET), 1.0).otherwise(0.0).alias("seed"))
    edges = seeds.unionByName(others).where(F.col("pattern") != "").groupBy("pattern", "instance").agg(F.max("seed").alias("seed"))
    # a pattern with too few instances can never be trusted: it leaves the graph, and its name with it
    support = edges.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_SUPPORT).select("pattern")
    edges = stored(edges.join(support, "pattern", "left_semi"), "pii-edges")
    instances = edges.groupBy("instance").agg(F.max("seed").alias("score"))
    patterns = None
    for k in range(rounds):
        patterns = edges.join(instances, "instance").groupBy("pattern").agg((F.sum("score") / (F.count("*") + PRIOR)).alias("confidence"))
        if k < rounds - 1:
            instances = edges.join(patterns, "pattern").groupBy("instance").agg(F.greatest(F.max("seed"), F.max("confidence")).alias("score"))
    return patterns.where(F.col("confidence") >= MIN_CONFIDENCE)


def extract(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, base and found (array<struct<kind, start, end>> of all spans in order)."""
    rows = entities(docs, doc_id, text).withColumn("row", F.monotonically_increasing_id())
    found = stored(rows, "pii-entities")  # the row numbers are fixed once written
    trusted = stored(learn_patterns(found), "pii-patterns")
    n = trusted.count()
    hits = found.select("row", F.explode("ids").alias("x")).join(small(trusted, n), F.col("x.pattern") == F.col("pattern")).groupBy("row").agg(F.array_sort(F.collect_list(F.struct(F.lit(len(KINDS)).alias("kind"), "x.start", "x.end"))).alias("new"))
    out = found.join(hits, "row", "left")
    base = F.transform("base", lambda b: F.struct(b["kind"].alias("kind"), b["start"].alias("start"), b["end"].alias("end")))
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    return out.select("doc_id", base.alias("base"), F.coalesce("new", none).alias("new"))


def written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k, _ in KINDS], F.lit(ID))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_id: one row per row of docs."""
    d = extract(docs, doc_id, text)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint")
    counts = [count(k).alias(f"n_{kind}") for k, (kind, _) in enumerate(KINDS)]
    return d.select("doc_id", *counts, hex_sha256(written(F.col("base"))).alias("base_sha256"), written(F.concat("base", "new")).alias("spans"), F.size("new").cast("bigint").alias("n_id"))


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with every trusted pattern's identifiers and every seed replaced by [KIND]; other columns stay.

    Rows are matched by (doc_id, text), so that rows with one id and different texts keep their own spans.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(whole_row(docs), F.struct(F.col(doc_id).alias("id"), F.xxhash64(t, F.char_length(t)).alias("h")).alias("_key"), F.col(text).alias("text"))
    spans = extract(keyed, "_key", "text").where((F.size("base") > 0) | (F.size("new") > 0)).groupBy(F.col("doc_id").alias("_of")).agg(F.first(F.array_sort(F.concat("base", "new"), lambda a, b: a["start"] - b["start"])).alias("_spans"))
    joined = keyed.join(spans, F.col("_key").eqNullSafe(F.col("_of")), "left")
    t = F.col("text")
    names = F.array(*[F.lit(f"[{k.upper()}]") for k, _ in KINDS], F.lit(f"[{ID.upper()}]"))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    cut = F.aggregate(
        "_spans", zero,
        lambda a, s: F.when(s["start"] >= a["at"], F.struct(s["end"].alias("at"), F.concat(a["out"], F.substring(t, a["at"] + 1, s["start"] - a["at"]), F.get(names, s["kind"])).alias("out"))).otherwise(a),
        lambda a: F.concat(a["out"], F.substring(t, a["at"] + 1, F.char_length(t))),
    )
    return unpacked(joined, docs, **{text: F.when(F.col("_spans").isNotNull(), cut).otherwise(t)})
