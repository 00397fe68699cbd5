"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

Main path: DataFrame functions only. Source i holds T_i tokens and the share p_i. Its weight is p_i^a normalised. The
exponent a is bisected from 1 (as the corpus is) to 0 (even): the smallest change of the shares, the largest a, whose
weights have at least the target entropy, yet never so small an a that a source would be repeated more than
max_repeats times. A budget of tokens is dealt by weight; source i passes budget * w_i / T_i times over its texts.
The bisection reads the sources SECTIONS points at a time, so that its 30 bits take three aggregations.

Realisation: each source's documents fall by hash into blocks of about block_tokens tokens and at most about
block_rows rows. A pass goes over the blocks of its source in the order of a hash of (pass, block): `place` is a
block's place in that permutation. Whole passes take everything; the last one takes blocks while the quota lasts, and
in the block where it ends documents in hash order, while the tokens before them are under the quota.

Order is never made in one task: blocks (of a source's pass) and documents (of the block in which a quota ends) are
dealt by ranges of their hash, ranges are summed, and rows are put in order inside a range of bounded size only. The
hash is of the id and the text, so that no id, null included, gathers rows in one block.

The rows are read once: they are written with their token counts, and everything else reads columns of that table.

Defined cases: a null source is the source ''; texts without tokens belong to their source and weigh nothing (they are
in every whole pass); a corpus without tokens comes back once as it is; rows equal in id and text share one decision
(where the quota ends among them, all are taken); an empty table gives no rows; columns pass through, but for pass,
block, place and n_tokens, which are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import small, stored

TARGET_ENTROPY, MAX_REPEATS, BUDGET_SHARE = 0.9998, 1.5, 1.25
#: The exponent is a multiple of SECTIONS ** -ROUNDS.
SECTIONS, ROUNDS = 1024, 3
BLOCK_TOKENS, BLOCK_ROWS = 200_000, 20_000
#: Rows that are put in order in one task: blocks of a pass, documents of a block (on average).
RANGE_BLOCKS, RANGE_ROWS = 1000, 250
DIGEST_BITS = 52
MADE = ("pass", "block", "place", "n_tokens")


def digest(*parts: Column) -> Column:
    """A hash that every engine can make again: 52 bits of an MD5 as a number."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary")), 1, 13), 16, 10).cast("bigint")


def n_tokens(text: Column) -> Column:
    """Runs without white space."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("bigint")


def exponent(sources: DataFrame, target_entropy: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS, budget_share: float = BUDGET_SHARE, sections: int = SECTIONS, rounds: int = ROUNDS) -> tuple[float, float]:
    """The largest exponent whose weights reach target_entropy (as a share of the largest possible entropy), or the
    smallest that keeps all repetitions within max_repeats, whichever is larger; and the sum of the raised shares.

    Every round is one aggregation over the sources, of which there may be any number; the driver gets three sums for
    each of 2 * (sections + 1) exponents. Sources of one size are summed first.
    """
    live = sources.where("tokens > 0").groupBy("tokens").agg(F.count("*").alias("k"))
    n, total = live.agg(F.sum("k"), F.sum(F.col("k") * F.col("tokens"))).first()
    if not n or n == 1:
        return 1.0, 1.0
    share = F.col("tokens") / F.lit(float(total))
    low, width, free = [0.0, 0.0], 1.0, False
    for k in range(rounds):
        step = width / sections
        at = lambda lo: F.transform(F.sequence(F.lit(0), F.lit(sections)), lambda j: F.lit(lo) + j * F.lit(step))  # noqa: B023, E731
        points = live.select("k", share.alias("s"), F.posexplode(F.concat(at(low[0]), at(low[1]))).alias("j", "a")).select("k", "s", "j", F.pow("s", "a").alias("w"))
        z, zlogw, most = F.sum(F.col("k") * F.col("w")), F.sum(F.col("k") * F.col("w") * F.log("w")), F.max(F.col("w") / F.col("s"))
        sums = points.groupBy("j").agg(z.alias("z"), zlogw.alias("l"), most.alias("m")).collect()
        # the entropy falls with the exponent: it is reached up to `up`; repetitions fall too: they are few from `down` on
        up = max((r.j for r in sums if r.j <= sections and math.log(r.z) - r.l / r.z >= target_entropy * math.log(n)), default=0)
        down = min((r.j - sections - 1 for r in sums if r.j > sections and budget_share * r.m / r.z <= max_repeats), default=sections)
        if k == 0 and up == sections:
            return 1.0, 1.0
        free |= k == 0 and down == 0
        low, width = [low[0] + up * step, low[1] + max(down - 1, 0) * step], step
        total_of = {r.j: r.z for r in sums}
        found = max((low[0], total_of[up]), (0.0, float(n)) if free else (low[1] + width, total_of[sections + 1 + down]))
    return found


def plan(sources: DataFrame, a: float, z: float, total: int, budget: float) -> DataFrame:
    """source, tokens, rows, weight, quota (tokens to take, a whole number), passes (whole ones), rest (tokens of the last)."""
    w = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(max(total, 1))), F.lit(a))).otherwise(0.0)
    p = sources.withColumn("weight", w / F.lit(z)).withColumn("quota", F.round(F.col("weight") * budget).cast("bigint"))
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens")).cast("bigint")).otherwise(1)
    return p.withColumn("passes", whole).withColumn("rest", F.col("quota") - F.col("passes") * F.col("tokens"))


def in_order(rows: DataFrame, by: Sequence[str], turn: str, value: str, ranges: str) -> DataFrame:
    """rows with _place and _before: how many rows, and which sum of `value`, stand before each one of its group in the
    order of `turn` (a digest; of equals the order is that of the other columns of `by`).

    A group is dealt into `ranges` ranges of the digest. Only sums of ranges are accumulated for a whole group.
    """
    r = rows.withColumn("_range", F.floor(F.col(turn) / (2.0**DIGEST_BITS) * F.col(ranges)).cast("bigint"))
    total = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0).cast("bigint"))
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = r.groupBy(*by, "_range").agg(F.sum(value).alias("_v"), F.count("*").alias("_n"))
    sums = sums.select(*by, "_range", total("_v", earlier).alias("_sum"), total("_n", earlier).alias("_count"))
    inside = Window.partitionBy(*by, "_range").orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    r = r.join(sums, [*by, "_range"])
    return r.withColumn("_before", F.col("_sum") + total(value, inside)).withColumn("_place", F.col("_count") + F.coalesce(F.count("*").over(inside), F.lit(0))).drop("_range", "_sum", "_count")


def mix(
    docs: DataFrame, source: str = "source", doc_id: str = "doc_id", text: str = "text", block_tokens: int = BLOCK_TOKENS, target_entropy: float = TARGET_ENTROPY,
    max_repeats: float = MAX_REPEATS, budget_share: float = BUDGET_SHARE, keep: Sequence[str] | None = None, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """docs (or its columns `keep`), each row once for each pass that takes it, with pass (from 0), block, place (of the
    block in its pass, from 0) and n_tokens."""
    columns = list(docs.columns if keep is None else keep)
    t = F.coalesce(F.col(text), F.lit(""))
    name = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    own = docs.select(F.struct(*columns).alias("_row"), F.coalesce(F.col(source), F.lit("")).alias("_source"), n_tokens(t).alias("_tokens"), digest(name, F.md5(t.cast("binary"))).alias("_h"))
    own = stored(own, "tokens")
    counted = own.select("_source", "_tokens", "_h")
    sources = stored(counted.groupBy(F.col("_source").alias("source")).agg(F.sum("_tokens").alias("tokens"), F.count("*").alias("rows")), "sources")
    n_sources, total = sources.agg(F.count("*"), F.sum("tokens")).first()
    a, z = exponent(sources, target_entropy, max_repeats, budget_share)
    blocks = F.greatest(F.ceil(F.col("tokens") / block_tokens), F.ceil(F.col("rows") / block_rows), F.lit(1)).cast("bigint").alias("blocks")
    quotas = stored(plan(sources, a, z, total or 0, budget_share * (total or 0)).select("source", "passes", "rest", blocks), "quotas")

    def dealt(d: DataFrame) -> DataFrame:
        return d.join(small(quotas, n_sources), F.col("_source") == F.col("source")).withColumn("_block", F.pmod(F.col("_h"), F.col("blocks"))).drop("_source")

    sums = dealt(counted).groupBy("source", "_block").agg(F.sum("_tokens").alias("inside"), F.count("*").alias("rows"), *[F.first(c).alias(c) for c in ("passes", "rest", "blocks")])
    turns = sums.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("passes"))))
    turns = turns.withColumn("_turn", digest(F.col("pass"), F.col("_block"), F.col("source"))).withColumn("_ranges", F.ceil(F.col("blocks") / RANGE_BLOCKS))
    turns = in_order(turns, ["source", "pass"], "_turn", "inside", "_ranges")
    left = F.when(F.col("pass") < F.col("passes"), F.col("inside")).otherwise(F.col("rest") - F.col("_before")).alias("left")
    state = stored(turns.select("source", "_block", "pass", F.col("_place").alias("place"), "inside", "rows", left).where((F.col("pass") < F.col("passes")) | (F.col("left") > 0)), "passes")
    # in one block of each source the quota ends
    edge = state.where("left < inside").select("source", "_block", "left", F.ceil(F.col("rows") / RANGE_ROWS).alias("_ranges"))
    names = dealt(counted).join(small(edge, n_sources), ["source", "_block"]).groupBy("source", "_block", "left", "_ranges", "_h").agg(F.sum("_tokens").alias("_tokens"))
    names = names.withColumn("_turn", F.col("_h"))
    cut = in_order(names, ["source", "_block"], "_turn", "_tokens", "_ranges").where("_before < left").groupBy("source", "_block").agg(F.max("_h").alias("cut"))
    taken = state.join(small(cut, n_sources), ["source", "_block"], "left")
    last = F.when(F.col("left") < F.col("inside"), F.col("cut"))
    taken = taken.groupBy("source", "_block").agg(F.collect_list(F.struct("pass", "place", last.alias("cut"))).alias("_passes"))
    d = dealt(own).join(small(taken, state.count()), ["source", "_block"])
    mine = F.filter("_passes", lambda p: p["cut"].isNull() | (F.col("_h") <= p["cut"]))
    d = d.select("_row", "_block", "_tokens", F.explode(mine).alias("_p"))
    kept = [F.col("_row").getField(c).alias(c) for c in columns if c not in MADE]
    return d.select(*kept, F.col("_p.pass").alias("pass"), F.col("_block").alias("block"), F.col("_p.place").alias("place"), F.col("_tokens").alias("n_tokens"))
