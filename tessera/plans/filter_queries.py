"""Queries over byte tiles: predictors, filters, scores and filter choice, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.predictors import NAMES, WEIGHTED, reweighted, weighted
from tessera.operators import codec, filters, raster
from tessera.plans.tables import spread, table


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """img_id (of text and tile), data, v: all tiles of all whole texts."""
    return raster.keyed_tiles(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def whole_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.whole_tiles(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def flat(query):
    """The query with its tile's two ids as columns."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = query(spark, sf_dir)
        return d.select("img_id.img_id", "img_id.tile_id", *[c for c in d.columns if c != "img_id"])

    return run


#: In SQL a tile's id is one number: that of its text times this, and its place in the text.
TILES = 2**20


def flat_sql(sql: str) -> str:
    return f"SELECT img_id // {TILES} AS img_id, CAST(img_id % {TILES} AS INTEGER) AS tile_id, * EXCLUDE (img_id) FROM ({sql})"


def checksum(values):
    """Sum of (place + 1) * value, so that order counts."""
    return F.aggregate(F.transform(values, lambda x, i: (i + 1).cast("bigint") * x), F.lit(0).cast("bigint"), lambda s, x: s + x)


def cells_sql(bpp: int = 1, stride: int = 16, size: int = 256) -> str:
    """cells(img_id, n, i, y, x, v, a, b, c, d, ll, uu) of the document tiles."""
    return f"""
    WITH raw AS (SELECT doc_id, hex(encode(text)) AS hx FROM documents WHERE text <> ''),
    filled AS (SELECT doc_id, hx, (length(hx) // 2 + {stride - 1}) // {stride} * {stride} AS m FROM raw),
    sized AS (SELECT doc_id * {TILES} + k.k AS img_id, least({size}, m - k.k * {size}) AS n, rpad(substr(hx, k.k * {2 * size} + 1, {2 * size}), CAST(least({size}, m - k.k * {size}) * 2 AS INTEGER), '0') AS hx
              FROM filled, unnest(range(0, (m + {size - 1}) // {size})) AS k(k)),
    bytes AS (SELECT img_id, n, u.i AS i, CAST((instr('0123456789ABCDEF', substr(hx, 2 * u.i + 1, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(hx, 2 * u.i + 2, 1)) - 1 AS INTEGER) AS v
              FROM sized, unnest(range(0, n)) AS u(i) WHERE n > 0),
    cells AS (SELECT img_id, n, i, i // {stride} AS y, i % {stride} AS x, v,
        CASE WHEN i % {stride} >= {bpp} THEN coalesce(lag(v, {bpp}) OVER w, 0) ELSE 0 END AS a,
        coalesce(lag(v, {stride}) OVER w, 0) AS b,
        CASE WHEN i % {stride} >= {bpp} THEN coalesce(lag(v, {stride + bpp}) OVER w, 0) ELSE 0 END AS c,
        CASE WHEN i % {stride} + {bpp} < {stride} AND i >= {stride} THEN coalesce(lag(v, {stride - bpp}) OVER w, 0) ELSE 0 END AS d,
        CASE WHEN i % {stride} >= {2 * bpp} THEN coalesce(lag(v, {2 * bpp}) OVER w, 0) ELSE 0 END AS ll,
        coalesce(lag(v, {2 * stride}) OVER w, 0) AS uu
        FROM bytes WINDOW w AS (PARTITION BY img_id ORDER BY i))"""


#: The predictors once more, in SQL.
PREDICT_SQL = (
    "0", "a", "b", "(a + b) // 2",
    "CASE WHEN abs(b - c) <= abs(a - c) AND abs(b - c) <= abs(a + b - 2 * c) THEN a WHEN abs(a - c) <= abs(a + b - 2 * c) THEN b ELSE c END",
    "CASE WHEN c >= greatest(a, b) THEN least(a, b) WHEN c <= least(a, b) THEN greatest(a, b) ELSE (a + b - c) & 255 END",
    "(a + b - c) & 255", "a + b + c - greatest(a, b, c) - least(a, b, c)",
    "greatest(0, least(255, CAST(trunc((2 * a - ll + 2 * b - uu) / 2.0) AS INTEGER)))",
    "(3 * a + b) // 4", "(a + 3 * b) // 4", "(a + b + 2 * c) // 4", "(2 * a + 2 * b + c) // 5",
    "CASE WHEN abs(a - c) > abs(b - c) THEN a WHEN abs(a - c) < abs(b - c) THEN b ELSE (a + b) // 2 END",
    "((a + c) // 2 + (b + d) // 2) // 2",
)


def weighted_sql(bpp: int = 1) -> str:
    """res15(img_id, i, y, r, p, w0, w1, w2, w3): the weighted predictor as a recursion over places; after cells."""
    step = "CASE WHEN abs(e.v - e.{n}) <= (abs(e.v - e.a) + abs(e.v - e.b) + abs(e.v - e.c) + abs(e.v - e.d)) // 4 THEN least(s.{w} + 1, 64) ELSE greatest(s.{w} - 1, 0) END AS {w}"
    steps = ", ".join(step.format(n=n, w=w) for n, w in zip("abcd", ("w0", "w1", "w2", "w3"), strict=True))
    return f""", walk AS (
        SELECT DISTINCT img_id, 0::BIGINT AS i, 8 AS w0, 8 AS w1, 8 AS w2, 8 AS w3 FROM cells
        UNION ALL SELECT s.img_id, s.i + 1, {steps} FROM walk s JOIN cells e ON e.img_id = s.img_id AND e.i = s.i),
    pred15 AS (SELECT e.img_id, e.n, e.i, e.y, e.v, s.w0, s.w1, s.w2, s.w3, CASE WHEN s.w0 + s.w1 + s.w2 + s.w3 = 0 THEN 0
        ELSE least(255, (s.w0 * e.a + s.w1 * e.b + s.w2 * e.c + s.w3 * e.d + (s.w0 + s.w1 + s.w2 + s.w3) // 2) // (s.w0 + s.w1 + s.w2 + s.w3)) END AS p
        FROM walk s JOIN cells e ON e.img_id = s.img_id AND e.i = s.i),
    res15 AS (SELECT img_id, i, y, (v - p) & 255 AS r, p, w0, w1, w2, w3 FROM pred15)"""


def residuals_sql(bpp: int = 1) -> str:
    """res(img_id, code, i, y, r) under all 16 filters."""
    parts = " UNION ALL ".join(f"SELECT img_id, {k} AS code, i, y, (v - ({p})) & 255 AS r FROM cells" for k, p in enumerate(PREDICT_SQL))
    return cells_sql(bpp).replace("WITH raw", "WITH RECURSIVE raw", 1) + weighted_sql(bpp) + f", res AS ({parts} UNION ALL SELECT img_id, 15, i, y, r FROM res15)"


def scores_sql(bpp: int = 1) -> str:
    """scored(img_id, code, msad, entropy)."""
    return residuals_sql(bpp) + """,
    hist AS (SELECT img_id, code, y, r, count(*) AS k FROM res GROUP BY ALL),
    per_row AS (SELECT img_id, code, y, sum(-(k / 16.0) * log2(k / 16.0)) AS e, sum(k * r) AS m FROM hist GROUP BY ALL),
    scored AS (SELECT img_id, code, CAST(sum(m) AS BIGINT) AS msad, round(sum(e), 9) AS entropy FROM per_row GROUP BY ALL)"""


def pairs(values, *names: str):
    """A row for each pair of an array of sums: its place (from 0) and the two sums, under the given names."""
    k = F.sequence(F.lit(0), (F.size(values) / 2).cast("int") - 1)
    return F.inline(F.transform(k, lambda i: F.struct(i.alias(names[0]), F.get(values, i * 2).alias(names[1]), F.get(values, i * 2 + 1).alias(names[2]))))


def predictor(code: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = tiles(spark, sf_dir).select("img_id", codec.row_sums(F.col("data"), code).alias("s"))
        return t.select("img_id", pairs(F.col("s"), "y", "res_sum", "res_check"))

    return run


def predictor_sql(code: int) -> str:
    return cells_sql() + f" SELECT img_id, CAST(y AS INTEGER) AS y, CAST(sum(r) AS BIGINT) AS res_sum, CAST(sum((x + 1) * r) AS BIGINT) AS res_check FROM (SELECT img_id, y, x, (v - ({PREDICT_SQL[code]})) & 255 AS r FROM cells) GROUP BY img_id, y"


def pred_weighted(spark, sf_dir):
    t = tiles(spark, sf_dir).select("img_id", codec.weighted_sums(F.col("data")).alias("s"))
    return t.select("img_id", F.get("s", F.lit(0)).alias("res_sum"), F.get("s", F.lit(1)).alias("res_check"))


def filter_block(spark, sf_dir):
    t = tiles(spark, sf_dir).select("img_id", codec.filter_sums(F.col("data"), 4).alias("s"))
    return t.select("img_id", pairs(F.col("s"), "code", "res_sum", "res_check"))


def unfilter_row(spark, sf_dir):
    """Every filter's residuals turned back: the sums are those of the bytes themselves."""
    t = tiles(spark, sf_dir).select("img_id", codec.filter_sums(F.col("data"), 2, inverse=True).alias("s"))
    return t.select("img_id", pairs(F.col("s"), "code", "byte_sum", "byte_check"))


def _state(x):
    return [F.col(f"w{k}") for k in range(4)], [F.col(c) for c in x]


def weighted_states(spark, sf_dir):
    """Synthetic states from orders: weights and neighbours."""
    k = F.col("o_orderkey")
    m = lambda a, b, n: ((k * a + b) % n).cast("int")
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", m(3, 1, 65).alias("w0"), m(5, 2, 65).alias("w1"), m(7, 3, 65).alias("w2"), m(11, 4, 65).alias("w3"), m(13, 5, 256).alias("a"), m(17, 6, 256).alias("b"), m(19, 7, 256).alias("c"), m(23, 8, 256).alias("d"), m(29, 9, 256).alias("v"))


STATES_SQL = "WITH s AS (SELECT o_orderkey, (o_orderkey*3+1)%65 AS w0, (o_orderkey*5+2)%65 AS w1, (o_orderkey*7+3)%65 AS w2, (o_orderkey*11+4)%65 AS w3, (o_orderkey*13+5)%256 AS a, (o_orderkey*17+6)%256 AS b, (o_orderkey*19+7)%256 AS c, (o_orderkey*23+8)%256 AS d, (o_orderkey*29+9)%256 AS v FROM orders)"


def weighted_predict(spark, sf_dir):
    w, n = _state("abcd")
    return weighted_states(spark, sf_dir).select("o_orderkey", weighted(w, n).alias("pred"))


def weighted_update(spark, sf_dir):
    w, n = _state("abcd")
    return weighted_states(spark, sf_dir).select("o_orderkey", *[x.alias(f"n{k}") for k, x in enumerate(reweighted(w, n, F.col("v")))])


def filter_row_weighted(spark, sf_dir):
    t = tiles(spark, sf_dir).select("img_id", codec.row_sums(F.col("data"), WEIGHTED, bpp=3).alias("s"))
    return t.select("img_id", pairs(F.col("s"), "y", "res_sum", "res_check"))


def unfilter_row_weighted(spark, sf_dir):
    t = tiles(spark, sf_dir).select("img_id", codec.weighted_sums(F.col("data"), 3, inverse=True).alias("s"))
    return t.select("img_id", F.get("s", F.lit(0)).alias("byte_sum"), F.get("s", F.lit(1)).alias("byte_check"))


def scored(spark, sf_dir, bpp: int = 1):
    return filters.scores(tiles(spark, sf_dir), bpp)


def choose_best_filter(spark, sf_dir):
    return filters.best_filter(scored(spark, sf_dir))


def best_filters_of_texts(spark, sf_dir):
    """img_id, tile_id, code, score: the best filter of every tile of every whole text."""
    t = whole_tiles(spark, sf_dir).select(F.struct("img_id", "tile_id").alias("img_id"), "data")
    return filters.best_filter(filters.scores(t)).select("img_id.img_id", "img_id.tile_id", "code", "score")


def apply_predictive_filter(spark, sf_dir):
    """Per tile: the code byte and the residuals of the best filter, as their length, code and checksum."""
    t = tiles(spark, sf_dir).select("img_id", codec.filter_tile(F.col("data"), 16, 1).alias("payload"))
    t = t.select("img_id", "payload", codec.byte_sums(F.col("payload")).alias("s"))
    return t.select("img_id", F.octet_length("payload").alias("n_bytes"), F.ascii(F.decode(F.substring("payload", 1, 1), "ISO-8859-1")).alias("code"), F.get("s", F.lit(1)).alias("payload_check"))


def undo_predictive_filter(spark, sf_dir):
    """The best filter's payload of every tile turned back: the sums of the bytes that come back."""
    t = tiles(spark, sf_dir).select("img_id", codec.filter_tile(F.col("data"), 16, 1).alias("payload"))
    t = t.select("img_id", codec.unfilter_tile(F.col("payload"), 16, 1).alias("back")).select("img_id", F.octet_length("back").alias("n_bytes"), codec.byte_sums(F.col("back")).alias("s"))
    return t.select("img_id", "n_bytes", F.get("s", F.lit(0)).alias("byte_sum"), F.get("s", F.lit(1)).alias("byte_check"))


def quick(spark, sf_dir):
    return filters.quick_prune(scored(spark, sf_dir))


def stats(spark, sf_dir):
    return filters.block_stats(raster.cells(tiles(spark, sf_dir)))


def rounded_stats(spark, sf_dir):
    return stats(spark, sf_dir).select("img_id", F.round(F.col("avg_variance") + 1e-9, 6).alias("avg_variance"), "high_regions", "regions")


def types(spark, sf_dir):
    return filters.block_type(stats(spark, sf_dir)).select("img_id", "block_type")


def adaptive(spark, sf_dir):
    return filters.adaptive(scored(spark, sf_dir), filters.block_type(stats(spark, sf_dir)))


def shannon(spark, sf_dir):
    """Entropy of every whole tile from its byte histogram: a hash aggregation of bytes, then of counts."""
    c = raster.cells(tiles(spark, sf_dir))
    n = F.sum("k").over(filters_window())
    hist = c.groupBy("img_id", "v").agg(F.count("*").alias("k")).withColumn("n", n)
    share = F.col("k") / F.col("n")
    return hist.groupBy("img_id").agg(F.round(F.sum(-share * F.log2(share)), 9).alias("entropy"))


def filters_window():
    from pyspark.sql import Window

    return Window.partitionBy("img_id")


def complexity(spark, sf_dir):
    e = shannon(spark, sf_dir).agg(F.count("*").alias("tiles"), F.round(F.avg("entropy"), 6).alias("avg_entropy"), F.max("entropy").alias("max_entropy"))
    return e


def compression_test(spark, sf_dir):
    """Size of every filter's residuals after compression, summed over all tiles of a text."""
    t = whole_tiles(spark, sf_dir).select("img_id", codec.filter_sizes(F.col("data")).alias("sizes"))
    # by place, as a filter that Spark infers from an exploded result computes it twice
    by_code = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.struct(k.alias("code"), F.get("sizes", k).alias("size")))
    return t.select("img_id", F.inline(by_code)).groupBy("img_id", "code").agg(F.sum("size").alias("size"))


def tile_stats_sql() -> str:
    return cells_sql() + """,
    h AS (SELECT img_id, max(y) + 1 AS h FROM cells GROUP BY 1),
    region AS (SELECT c.img_id, y // greatest(h // 4, 1) AS ry, x // 4 AS rx, avg(CAST(v AS DOUBLE) * v) - avg(CAST(v AS DOUBLE)) * avg(CAST(v AS DOUBLE)) AS variance FROM cells c JOIN h USING (img_id) GROUP BY ALL),
    stats AS (SELECT img_id, avg(variance) AS avg_variance, CAST(sum(CASE WHEN round(variance, 9) > 100 THEN 1 ELSE 0 END) AS BIGINT) AS high_regions, count(*) AS regions FROM region GROUP BY 1),
    types AS (SELECT *, CASE WHEN round(avg_variance, 9) < 10 THEN 'Smooth' WHEN round(avg_variance, 9) < 50 THEN 'Natural' WHEN high_regions > regions // 3 THEN 'HighFreq' ELSE 'Mixed' END AS block_type FROM stats)"""


_adaptive_lists = " UNION ALL ".join(f"SELECT '{kind}' AS block_type, {code} AS code, {o} AS ord" for kind, codes in filters.CANDIDATES.items() for o, code in enumerate(codes))
_with_types = scores_sql() + tile_stats_sql().split("FROM bytes WINDOW w AS (PARTITION BY img_id ORDER BY i))", 1)[1]
_bytes = cells_sql() + " SELECT img_id, {k} CAST(sum(v) AS BIGINT) AS byte_sum, CAST(sum((i + 1) * v) AS BIGINT) AS byte_check FROM cells{j} GROUP BY ALL"
_entropy = cells_sql() + ", hist AS (SELECT img_id, n, v, count(*) AS k FROM cells GROUP BY ALL), ent AS (SELECT img_id, round(sum(-(k * 1.0 / n) * log2(k * 1.0 / n)), 9) AS entropy FROM hist GROUP BY 1)"

QUERIES = {f"pred_{name}": predictor(code) for code, name in enumerate(NAMES)} | {
    "pred_weighted": pred_weighted,
    "filter_block": filter_block,
    "unfilter_row": unfilter_row,
    "weighted_predict": weighted_predict,
    "weighted_update": weighted_update,
    "filter_row_weighted": filter_row_weighted,
    "unfilter_row_weighted": unfilter_row_weighted,
    "apply_predictive_filter": apply_predictive_filter,
    "undo_predictive_filter": undo_predictive_filter,
    "shannon_entropy": shannon,
    "tile_complexity": complexity,
    "score_entropy": lambda s, d: scored(s, d).select("img_id", "code", "entropy"),
    "score_msad": lambda s, d: scored(s, d).select("img_id", "code", "msad"),
    "score_compression_test": compression_test,
    "choose_best_filter": choose_best_filter,
    "choose_quick_prune": quick,
    "block_stats": rounded_stats,
    "block_type": types,
    "choose_adaptive": adaptive,
}
ORACLES = {f"pred_{name}": predictor_sql(code) for code, name in enumerate(NAMES)} | {
    "pred_weighted": residuals_sql() + " SELECT img_id, CAST(sum(r) AS BIGINT) AS res_sum, CAST(sum((i + 1) * r) AS BIGINT) AS res_check FROM res15 GROUP BY 1",
    "filter_block": residuals_sql(4) + " SELECT img_id, code, CAST(sum(r) AS BIGINT) AS res_sum, CAST(sum((i + 1) * r) AS BIGINT) AS res_check FROM res GROUP BY ALL",
    "unfilter_row": _bytes.format(k="k.code,", j=", (SELECT CAST(unnest(range(0, 16)) AS INTEGER) AS code) k"),
    "weighted_predict": STATES_SQL + " SELECT o_orderkey, CAST(CASE WHEN w0+w1+w2+w3 = 0 THEN 0 ELSE least(255, (w0*a + w1*b + w2*c + w3*d + (w0+w1+w2+w3)//2) // (w0+w1+w2+w3)) END AS INTEGER) AS pred FROM s",
    "weighted_update": STATES_SQL
    + ", m AS (SELECT *, (abs(v-a) + abs(v-b) + abs(v-c) + abs(v-d)) // 4 AS t FROM s) SELECT o_orderkey, "
    + ", ".join(f"CAST(CASE WHEN abs(v-{n}) <= t THEN least(w{k}+1, 64) ELSE greatest(w{k}-1, 0) END AS INTEGER) AS n{k}" for k, n in enumerate("abcd"))
    + " FROM m",
    "filter_row_weighted": residuals_sql(3) + " SELECT img_id, CAST(y AS INTEGER) AS y, CAST(sum(r) AS BIGINT) AS res_sum, CAST(sum((i % 16 + 1) * r) AS BIGINT) AS res_check FROM res15 GROUP BY ALL",
    "unfilter_row_weighted": _bytes.format(k="", j=""),
    "apply_predictive_filter": scores_sql()
    + ", best AS (SELECT img_id, code FROM scored QUALIFY row_number() OVER (PARTITION BY img_id ORDER BY entropy, code) = 1) SELECT img_id, CAST(count(*) + 1 AS INTEGER) AS n_bytes, code, CAST(code + sum((i + 2) * r) AS BIGINT) AS payload_check FROM res JOIN best USING (img_id, code) GROUP BY img_id, code",
    "undo_predictive_filter": cells_sql() + " SELECT img_id, CAST(count(*) AS INTEGER) AS n_bytes, CAST(sum(v) AS BIGINT) AS byte_sum, CAST(sum((i + 1) * v) AS BIGINT) AS byte_check FROM cells GROUP BY 1",
    "shannon_entropy": _entropy + " SELECT img_id, entropy FROM ent",
    "tile_complexity": _entropy + " SELECT count(*) AS tiles, round(avg(entropy), 6) AS avg_entropy, max(entropy) AS max_entropy FROM ent",
    "score_entropy": scores_sql() + " SELECT img_id, code, entropy FROM scored",
    "score_msad": scores_sql() + " SELECT img_id, code, msad FROM scored",
    "choose_best_filter": scores_sql() + " SELECT img_id, code, entropy AS score FROM scored QUALIFY row_number() OVER (PARTITION BY img_id ORDER BY entropy, code) = 1",
    "choose_quick_prune": scores_sql()
    + ", ranked AS (SELECT *, row_number() OVER (PARTITION BY img_id ORDER BY msad, code) AS rn FROM scored) SELECT img_id, code FROM ranked WHERE rn <= 8 QUALIFY row_number() OVER (PARTITION BY img_id ORDER BY entropy, rn) = 1",
    "block_stats": tile_stats_sql() + " SELECT img_id, round(avg_variance + 1e-9, 6) AS avg_variance, high_regions, regions FROM stats",
    "block_type": tile_stats_sql() + " SELECT img_id, block_type FROM types",
    "choose_adaptive": _with_types
    + f", lists AS ({_adaptive_lists}) SELECT img_id, block_type, code FROM scored JOIN types USING (img_id) JOIN lists USING (block_type, code) QUALIFY row_number() OVER (PARTITION BY img_id ORDER BY entropy, ord) = 1",
}

#: Of these a row is no tile.
WHOLE = ("weighted_predict", "weighted_update", "tile_complexity", "score_compression_test")
QUERIES = {k: v if k in WHOLE else flat(v) for k, v in QUERIES.items()}
ORACLES = {k: v if k in WHOLE else flat_sql(v) for k, v in ORACLES.items()}
