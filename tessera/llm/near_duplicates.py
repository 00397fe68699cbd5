"""N-gram Jaccard join by a MinHash LSH forest with exact verification; near-duplicate classes.

1. Copies (equal word sequences) become one text. Each text's set of five-word shingles is hashed and signed: TREES
   signatures of MAX_DEPTH minima, each a path of a prefix trie, and a sketch of SKETCH bytes of the minima.
2. The forest is descended from MAX_DEPTH on. The texts that share a prefix in a tree are a bucket, and a bucket is
   compared by sketches: pairs that look similar (SLACK below the threshold, five standard errors, and of sizes that
   can reach it) are joined to a representative, the smallest text that they reach. A task returns a row per text that
   its buckets hold, never pairs, nor a row for each pair of a large bucket's blocks. In a bucket of more than
   BLOCK_TEXTS every text is first compared with one of them, the pivot, and is labelled by the smallest pivot that it
   looks like in any bucket, or that this pivot looks like. Texts of one label are joined already, so only those outside
   a bucket's most frequent label are compared with all, and the others with a block of their own, whose pairs stand for
   all of theirs in the recall: rows and comparisons of a large group of near copies grow with its size here, not its
   square. A pair of similarity s meets at depth k with 1 - (1 - s^k)^TREES, so each pair that is seen also tells how
   many like it are not: from that each text's recall is estimated. Texts under the target recall shorten their prefixes
   by one, and buckets of that depth are read only where such a text is in them; so on to MIN_DEPTH. If the corpus as a
   whole is under the target, all texts shorten theirs.
3. The groups of texts joined so are verified exactly: a group's texts are dealt by size band (sizes that can reach the
   threshold are in the same or the next band) into blocks of bounded size, and each pair of blocks is one task that
   counts intersections as a matrix product. It returns for each text its number of links and a representative.
4. The classes are the components of the verified links.

A text is dealt by hash into blocks wherever a bucket or a group is large, and joins meet tables that are written, so
that a key which is everywhere can be split. Rounds are bounded.

Style: signing, comparing and verifying are array work in numpy, in Arrow batches and in grouped batches of bounded
size; buckets, joins and components are DataFrame operations, with tables in the shared folder between rounds.

Defined cases: null and empty texts (or texts without a word) are copies of each other only if they are equal, and
link to nothing; a text of under five words is one shingle; equal rows are copies; a class is named by its smallest
doc_id (null counts as smallest); an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, ship, small, stored, unpacked, whole_row

ship(__name__)
SHINGLE, THRESHOLD = 5, 0.8
TREES, MAX_DEPTH, MIN_DEPTH, RECALL = 40, 8, 5, 0.9999
#: A path has two bytes of each minimum, a sketch one byte of each of the first ones.
LEVEL_BYTES, SKETCH, SLACK = 2, 128, 0.19
#: Bounds of a block: texts and shingles. Size bands grow by a little more than 1 / THRESHOLD.
BLOCK_TEXTS, BLOCK_SHINGLES, BAND = 128, 400_000, 1.26
#: So many texts, about, are combined before a task gives their rows: a bound of its memory (32 bytes each).
GATHERED = 2**20
#: Components shrink by halves at least; so many rounds are enough for any number of texts.
MAX_ROUNDS = 64
#: All bytes but letters, digits and non-ASCII become a space, A-Z become a-z.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
MIX = np.uint64(0x9E3779B97F4A7C15)


def meets(similarity: np.ndarray | float, depth: int, trees: int = TREES) -> np.ndarray | float:
    """The probability that a pair of this similarity shares a prefix of this depth in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def word_list(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


def shingles(words: list[bytes], known: dict) -> np.ndarray:
    """The set of hashed shingles, sorted."""
    if not words:
        return np.empty(0, np.uint64)
    if len(known) > 500_000:
        known.clear()
    hashes = []
    for w in words:
        h = known.get(w)
        if h is None:
            h = known[w] = xxhash.xxh64_intdigest(w)
        hashes.append(h)
    h = np.array(hashes, np.uint64)
    if len(h) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 1)], np.uint64)
    n = len(h) - SHINGLE + 1
    out = h[:n].copy()
    for k in range(1, SHINGLE):
        out = (out * MIX) ^ h[k : k + n]
    out ^= out >> np.uint64(29)
    out *= MIX
    out ^= out >> np.uint64(32)
    return np.unique(out)


def coefficients(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(1)
    return rng.integers(0, 2**31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, count, dtype=np.uint32)


def paths(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minima of all hash functions over a set."""
    low = np.full(len(a), np.uint32(2**32 - 1))
    x = (s >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(x), 1024):
        low = np.minimum(low, (x[k : k + 1024, None] * a + b).min(axis=0))
    return low


def signed(docs: DataFrame, doc_id: str, text: str, trees: int = TREES, deepest: int = MAX_DEPTH) -> DataFrame:
    """doc_id, h1, h2 (hashes of the text as it is), key (its words), size, path (of all trees), sketch: a row per document."""
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(t).alias("h1"), F.hash(t).alias("h2"), t.alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = coefficients(trees * deepest)
        known: dict = {}
        for batch in batches:
            seen: dict = {}
            keys, found = [], []
            for s in batch.column("text").to_pylist():
                w = word_list(s)
                key = hashlib.md5(b" ".join(w) if w else b"\x00" + s.encode("utf-8", "surrogatepass")).hexdigest()
                if key not in seen:
                    sh = shingles(w, known)
                    low = paths(sh, a, b)
                    seen[key] = (len(sh), low.astype(">u2").tobytes(), low[:SKETCH].astype(np.uint8).tobytes()) if len(sh) else (0, b"", b"")
                keys.append(key)
                found.append(seen[key])
            cols = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.int32(), pa.binary(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([*map(batch.column, ("doc_id", "h1", "h2")), pa.array(keys, pa.string()), *cols], names=["doc_id", "h1", "h2", "key", "size", "path", "sketch"])

    return d.mapInArrow(sign, f"doc_id {dict(d.dtypes)['doc_id']}, h1 bigint, h2 int, key string, size int, path binary, sketch binary")


def nodes(texts: DataFrame, depth: int, trees: int = TREES, deepest: int = MAX_DEPTH) -> DataFrame:
    """id, node, open: the trie node of every tree in which a text (id, path, open) stands at a depth."""
    prefix = lambda t: F.xxhash64(t, F.substring("path", t * (LEVEL_BYTES * deepest) + 1, F.lit(LEVEL_BYTES * depth)))
    return texts.where(F.octet_length("path") > 0).select("id", "open", F.explode(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), prefix)).alias("node"))


def in_blocks(members: DataFrame, block: int) -> DataFrame:
    """members (id, node, n, ...) once for each pair of blocks of their bucket that they are in: group, side (1 + k where all
    pairs are compared and each stands for k, else pairs of side 0 with side 1)."""
    nb = F.ceil(F.col("n") / block).cast("int")
    m = members.withColumn("_nb", nb).withColumn("_i", F.pmod(F.xxhash64("id"), F.col("_nb")).cast("int"))
    i = F.col("_i")
    pair = lambda j: F.struct(F.xxhash64("node", F.least(i, j), F.greatest(i, j)).alias("group"), F.when(i == j, 2).otherwise((i > j).cast("int")).alias("side"))
    m = m.withColumn("_g", F.explode(F.transform(F.sequence(F.lit(0), F.col("_nb") - 1), pair)))
    return m.select("id", "size", "sketch", "_g.group", "_g.side")


def beside_pivot(members: DataFrame, threshold: float) -> DataFrame:
    """id, root: the texts of large buckets (id, size, sketch, pivot, p_size, p_sketch) that look like their bucket's pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, size, pivot, p_size = (b.column(c).to_numpy(zero_copy_only=False) for c in ("id", "size", "pivot", "p_size"))
            sketch, p_sketch = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(b.num_rows, SKETCH) for c in ("sketch", "p_sketch"))
            near = (ids != pivot) & (np.minimum(size, p_size) * 1000 >= round(threshold * 1000) * np.maximum(size, p_size)) & ((sketch == p_sketch).mean(axis=1) >= threshold - SLACK)
            yield pa.RecordBatch.from_arrays([pa.array(ids[near]), pa.array(pivot[near])], names=["id", "root"])

    return members.mapInArrow(run, "id bigint, root bigint").distinct()


def around_label(members: DataFrame, block: int) -> DataFrame:
    """members (id, node, size, sketch, inner, n_inner, n_outer) of large buckets once for each pair of blocks that they are
    in: group and side as of in_blocks(). Inner texts, of one label, meet their own block only, which stands for all of
    theirs, and all outer ones."""
    blocks = lambda n: F.ceil(F.col(n) / block).cast("int")
    m = members.withColumn("_no", blocks("n_outer")).withColumn("_ni", blocks("n_inner"))
    m = m.withColumn("_i", F.pmod(F.xxhash64("id"), F.when(F.col("inner"), F.col("_ni")).otherwise(F.col("_no"))).cast("int"))
    i, each = F.col("_i"), lambda n, f: F.when(F.col(n) > 0, F.transform(F.sequence(F.lit(0), F.col(n) - 1), f)).otherwise(F.array().cast("array<struct<group:bigint,side:int>>"))
    to = lambda kind, x, y, side: F.struct(F.xxhash64("node", x, y, F.lit(kind)).alias("group"), side.cast("int").alias("side"))
    outer = each("_no", lambda j: to("outer", F.least(i, j), F.greatest(i, j), F.when(i == j, 2).otherwise((i > j).cast("int"))))
    across = each("_ni", lambda j: to("across", i, j, F.lit(0)))
    inner = F.concat(each("_no", lambda j: to("across", j, i, F.lit(1))), F.array(to("inner", i, i, F.col("_ni") + 1)))
    m = m.withColumn("_g", F.explode(F.when(F.col("inner"), inner).otherwise(F.concat(outer, across))))
    return m.select("id", "size", "sketch", "_g.group", "_g.side")


def of_large(members: DataFrame, depth: int, threshold: float, block: int) -> DataFrame:
    """What compared() says of the buckets of more than a block (members: id, node, n, size, sketch), by way of their pivots.
    Members, with their sketches, meet only tables of a row per bucket or text."""
    pivots = stored(members.groupBy("node").agg(F.min(F.struct("id", "size", "sketch")).alias("p")).select("node", F.col("p.id").alias("pivot"), F.col("p.size").alias("p_size"), F.col("p.sketch").alias("p_sketch")), "pivots")
    n_large = pivots.count()
    near = stored(beside_pivot(members.join(small(pivots, n_large), "node"), threshold), "near")
    first = stored(near.groupBy("id").agg(F.min("root").alias("label")), "labels")
    of_label = near.select(F.col("root").alias("id")).distinct().join(first, "id").select(F.col("id").alias("label"), F.col("label").alias("low"))
    labels = stored(first.join(small(of_label, n_large), "label", "left").select("id", F.least("label", "low").alias("label")), "labels")  # the pivot's own label is as good
    of_member = members.join(small(labels, labels.count()), "id", "left").withColumn("label", F.least("id", "label"))  # a text that looks like no pivot is alone
    top = of_member.groupBy("node", "label").agg(F.count("*").alias("k")).groupBy("node").agg(F.max(F.struct("k", "label")).alias("top"), F.sum("k").alias("n"))
    major = stored(top.select("node", F.col("top.label").alias("major"), F.col("top.k").alias("n_inner"), (F.col("n") - F.col("top.k")).alias("n_outer")), "majors")
    labelled = of_member.join(small(major, n_large), "node").withColumn("inner", F.col("label") == F.col("major"))
    told = compared(around_label(labelled, block), depth, threshold)
    return told.unionByName(near.select("id", "root", F.lit(0.0).alias("seen"), F.lit(0.0).alias("all")))


def look_alike(group: np.ndarray, side: np.ndarray, size: np.ndarray, sketch: np.ndarray, cut: float, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and estimated similarities of the pairs within groups (rows sorted by group) that look similar."""
    i, j, s = [], [], []
    for d in range(1, len(group)):
        at = np.flatnonzero(group[:-d] == group[d:])
        if not len(at):
            break
        small_, large = np.minimum(size[at], size[at + d]), np.maximum(size[at], size[at + d])
        at = at[((side[at] >= 2) | (side[at] != side[at + d])) & (small_ * 1000 >= round(threshold * 1000) * large)]
        for k in range(0, len(at), 50_000):
            a = at[k : k + 50_000]
            like = (sketch[a] == sketch[a + d]).sum(axis=1) / sketch.shape[1]
            near = like >= cut
            i.append(a[near])
            j.append(a[near] + d)
            s.append(like[near])
    none = np.empty(0, np.int64)
    return np.concatenate([none, *i]), np.concatenate([none, *j]), np.concatenate([np.empty(0), *s])


def reached(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each place the smallest id that it reaches over the pairs (i, j)."""
    root = ids.copy()
    while len(i):
        before = root.copy()
        np.minimum.at(root, i, root[j])
        np.minimum.at(root, j, root[i])
        if (root == before).all():
            break
    return root


def combined(ids: np.ndarray, root: np.ndarray, seen: np.ndarray, every: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A row per text of what many groups say of it: the smallest id that it reaches over their edges (id, root), and the
    sums of its numbers. The components and the sums of all rows stay what they were."""
    texts, place = np.unique(np.concatenate([ids, root]), return_inverse=True)
    i, j = place[: len(ids)], place[len(ids) :]
    low = np.arange(len(texts))
    while True:
        before = low.copy()
        np.minimum.at(low, i, low[j])
        np.minimum.at(low, j, low[i])
        low = low[low]
        if (low == before).all():
            break
    own = np.unique(i)
    return texts[own], texts[low[own]], np.bincount(i, seen, len(texts))[own], np.bincount(i, every, len(texts))[own]


def compared(rows: DataFrame, depth: int, threshold: float, trees: int = TREES) -> DataFrame:
    """id, root, seen, all: the representative of each text that looks similar to another one in its groups, and the
    estimated numbers of such pairs that meet at this depth and that there are, each pair's share over the trees.

    A task combines what its groups say: it gives a row for each text, however many pairs of blocks and trees that is in."""
    cut = threshold - SLACK

    def judge(group: np.ndarray, ids: np.ndarray, side: np.ndarray, size: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, ...]:
        i, j, like = look_alike(group, side, size, sketch, cut, threshold)
        seen, every = np.zeros(len(ids)), np.zeros(len(ids))
        real = like >= threshold
        weight = np.maximum(side[i[real]] - 1, 1) / (trees * like[real] ** depth)
        for at in (i[real], j[real]):
            np.add.at(every, at, weight)
            np.add.at(seen, at, weight * meets(like[real], depth, trees))
        root = reached(ids, i, j)
        hit = np.unique(np.concatenate([i, j]))
        return ids[hit], root[hit], seen[hit], every[hit]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        said, more, size = [], 0, 0  # what groups said: combined rows first, then those of single batches
        give = lambda rows: pa.RecordBatch.from_arrays([pa.array(x) for x in rows], names=["id", "root", "seen", "all"])
        gather = lambda: combined(*[np.concatenate(x) for x in zip(*said, strict=True)])  # noqa: B023, E731
        for b in batches:
            cols = [b.column(c).to_numpy(zero_copy_only=False) for c in ("group", "id", "side", "size")]
            cols.append(np.frombuffer(b"".join(b.column("sketch").to_pylist()), np.uint8).reshape(b.num_rows, -1))
            if held:
                cols = [np.concatenate([x, y]) for x, y in zip(held, cols, strict=True)]
            last = int(np.searchsorted(cols[0], cols[0][-1])) if len(cols[0]) else 0  # the last group may go on
            held = [c[last:] for c in cols]
            if last:
                said.append(judge(*[c[:last] for c in cols]))
                more += len(said[-1][0])
            if more > max(size, GATHERED // 8):
                said = [gather()]
                more, size = 0, len(said[0][0])
            if size > GATHERED:
                yield give(said[0])
                said, size = [], 0
        if held:
            said.append(judge(*held))
        if said:
            yield give(gather())

    return rows.repartition("group").sortWithinPartitions("group").mapInArrow(run, "id bigint, root bigint, seen double, all double")


def forest(texts: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, block: int | None = None) -> DataFrame:
    """id, root: an edge from each text to its representatives in the buckets of the forest."""
    n_open, open_, found = 0, None, []
    for depth in range(MAX_DEPTH, MIN_DEPTH - 1, -1):
        if open_ is None:
            marked = texts.withColumn("open", F.lit(True))
        else:
            marked = texts.join(small(open_.withColumn("open", F.lit(True)), n_open), "id", "left").withColumn("open", F.coalesce("open", F.lit(False)))
        at = nodes(marked, depth)
        buckets = stored(at.groupBy("node").agg(F.count("*").alias("n"), F.max("open").alias("open")).where("n > 1 and open").select("node", "n"), "buckets")
        members, most = at.select("id", "node").join(buckets, "node").join(texts.select("id", "size", "sketch"), "id"), block or BLOCK_TEXTS
        if buckets.where(F.col("n") > most).isEmpty():
            rows = compared(in_blocks(members, most), depth, threshold)
        else:
            members = stored(members, "bucket-members")
            rows = compared(in_blocks(members.where(F.col("n") <= most), most), depth, threshold).unionByName(of_large(members.where(F.col("n") > most), depth, threshold, most))
        edges = stored(rows.groupBy("id", "root").agg(F.sum("seen").alias("seen"), F.sum("all").alias("all")), "edges")
        found.append(edges.select("id", "root"))
        of_text = edges.groupBy("id").agg(F.sum("seen").alias("seen"), F.sum("all").alias("all")).where(F.col("seen") < recall * F.col("all")).select("id")
        seen, every = edges.agg(F.sum("seen"), F.sum("all")).first()
        if seen is None or not every:
            break
        if seen < recall * every:
            open_ = None
        else:
            open_ = stored(of_text, "open")
            n_open = open_.count()
            if not n_open:
                break
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.where("id <> root").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """id, root: the smallest id of each component, for the ids that have an edge (columns a, b).

    Alternating stars: every node hooks its larger, then its smaller neighbours to its smallest one, until nothing
    changes. Each round is a few aggregations and joins of at most as many edges as before. A node's smallest neighbour
    is written before it is joined, so that the rows of a node with very many neighbours can be split.
    """
    order = lambda d, a, b: d.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    now, before = stored(order(edges, F.col("a"), F.col("b")), name), None
    for _ in range(MAX_ROUNDS):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            return now.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
        before = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m")), "low")
        large = stored(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        hooked = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        after = stored(hooked.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), name)
        for done in (now, low, large, least):
            discard(done)
        now = after
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


def dealt(members: DataFrame, block_texts: int = BLOCK_TEXTS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """members (id, root, size, ...) once for each pair of blocks they are in: group columns and side.

    A component that fits one block is one group. Else its texts are dealt by size band, then by hash into blocks;
    a text meets every block of its own band and of the bands beside it.
    """
    whole = stored(members.groupBy("root").agg(F.count("*").alias("_n"), F.sum("size").alias("_s")), "group-sizes")
    m = members.join(whole, "root")
    fits = (F.col("_n") <= block_texts) & (F.col("_s") <= block_shingles)
    m = m.withColumn("band", F.when(fits, -1).otherwise(F.floor(F.log("size") / float(np.log(BAND))).cast("int"))).drop("_n", "_s")
    blocks = stored(m.groupBy("root", "band").agg(F.ceil(F.greatest(F.count("*") / block_texts, F.sum("size") / block_shingles)).cast("int").alias("nb")), "group-blocks")
    beside = lambda name, step: blocks.select("root", (F.col("band") - step).alias("band"), F.col("nb").alias(name))
    # a component's single group has band -1, and bands beside it are never there
    m = m.join(blocks, ["root", "band"]).join(beside("up", 1), ["root", "band"], "left").join(beside("down", -1), ["root", "band"], "left")
    m = m.withColumn("_i", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))
    to = lambda n: F.when(n.isNotNull() & (F.col("band") >= 0), F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    group = lambda kind, low, x, y, side: F.struct(F.lit(kind).alias("kind"), low.alias("low"), x.cast("int").alias("x"), y.cast("int").alias("y"), side.alias("side"))
    i, band = F.col("_i"), F.col("band")
    own = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda j: group(0, band, F.least(i, j), F.greatest(i, j), (i > j).cast("int")))
    above = F.transform(to(F.col("up")), lambda j: group(1, band, i, j, F.lit(0)))
    below = F.transform(to(F.col("down")), lambda j: group(1, band - 1, j, i, F.lit(1)))
    keep = [c for c in members.columns if c != "root"]
    return m.select("root", *keep, F.explode(F.concat(own, above, below)).alias("_g")).select("root", *keep, "_g.*")


def similar(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float) -> np.ndarray:
    """Boolean matrix of the pairs with Jaccard similarity of at least the threshold, compared in whole numbers."""
    sets = left + (right or [])
    values, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = times > 1
    column = np.cumsum(shared) - 1
    use = shared[place]
    owner, place = owner[use], column[place[use]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    n, m = len(left), len(right) if right is not None else len(left)
    inter = np.zeros((n, m), np.float32)
    total = int(shared.sum())
    for k in range(0, total, 4096):
        lo, hi = np.searchsorted(place, (k, k + 4096))
        dense = np.zeros((len(sets), min(4096, total - k)), np.float32)
        dense[owner[lo:hi], place[lo:hi] - k] = 1
        inter += dense[:n] @ (dense[n:].T if right is not None else dense.T)
    a = np.array([len(s) for s in left], np.int64)[:, None]
    b = np.array([len(s) for s in (right if right is not None else left)], np.int64)[None, :]
    inter = inter.astype(np.int64)
    top = round(threshold * 1000)
    out = inter * 1000 >= top * (a + b - inter)
    if right is None:
        np.fill_diagonal(out, False)
    return out


def verify_group(rows: pd.DataFrame, threshold: float = THRESHOLD) -> pd.DataFrame:
    """id, links, local root of the texts of one group that have a link in it."""
    sets = [np.frombuffer(b, np.uint64) for b in rows["sh"]]
    ids, side = rows["id"].to_numpy(np.int64), rows["side"].to_numpy()
    same = bool((rows["kind"].iloc[0] == 0) and (rows["x"].iloc[0] == rows["y"].iloc[0]))
    l, r = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if same:
        l, r = np.arange(len(ids)), np.arange(len(ids))
    elif not len(l) or not len(r):
        return pd.DataFrame({"id": [], "links": [], "local": []}).astype("int64")
    hit = similar([sets[k] for k in l], None if same else [sets[k] for k in r], threshold)
    links = np.zeros(len(ids), np.int64)
    links[l] += hit.sum(axis=1)
    if not same:
        links[r] += hit.sum(axis=0)
    root = ids.copy()
    while True:  # smallest id that is reachable inside the group
        before = root.copy()
        big = np.iinfo(np.int64).max
        root[l] = np.minimum(root[l], np.where(hit, root[r][None, :], big).min(axis=1))
        root[r] = np.minimum(root[r], np.where(hit, root[l][:, None], big).min(axis=0))
        if (root == before).all():
            break
    keep = links > 0
    return pd.DataFrame({"id": ids[keep], "links": links[keep], "local": root[keep]})


def linked(docs: DataFrame, text: str, members: DataFrame, n_members: int, threshold: float = THRESHOLD) -> DataFrame:
    """id, links, local: verified links of the candidate texts, a row per text and group in which it has one."""
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.select(F.xxhash64(t).alias("h1"), F.hash(t).alias("h2"), t.alias("text"))
    rows = d.join(small(members, n_members), ["h1", "h2"]).select("id", "root", "size", "text")

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for b in batches:
            sets = [shingles(word_list(x), known).tobytes() for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*map(b.column, ("id", "root", "size")), pa.array(sets, pa.binary())], names=["id", "root", "size", "sh"])

    sets = stored(rows.mapInArrow(shingle, "id bigint, root bigint, size int, sh binary").dropDuplicates(["id"]), "shingles")
    groups = dealt(sets)
    return groups.groupBy("root", "kind", "low", "x", "y").applyInPandas(lambda rows: verify_group(rows, threshold), "id bigint, links bigint, local bigint")


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """(documents, texts): doc_id, h1, h2, key of every document; key, copies, links, class (struct doc_id, h1, h2 of
    the class's first document) of every distinct text."""
    of_doc = stored(signed(docs, doc_id, text), "signed")
    first = F.struct("doc_id", "h1", "h2")
    texts = of_doc.groupBy("key").agg(F.min(first).alias("first"), F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("size", "path", "sketch")])
    texts = stored(texts.withColumn("id", F.monotonically_increasing_id()), "texts")  # ids are fixed once written
    edges = forest(texts.select("id", "size", "path", "sketch"), threshold, recall)
    candidates = stored(components(edges.select(F.col("id").alias("a"), F.col("root").alias("b")), "candidates"), "groups")
    members = stored(candidates.join(texts.select("id", "size", "first"), "id").select("id", "root", "size", F.col("first.h1").alias("h1"), F.col("first.h2").alias("h2")), "members")
    links = stored(linked(docs, text, members, members.count(), threshold), "links")
    roots = components(links.where("id <> local").select(F.col("id").alias("a"), F.col("local").alias("b")), "classes")
    counts = links.groupBy("id").agg(F.sum("links").alias("links"))
    t = texts.select("id", "key", "first", "copies").join(roots, "id", "left").join(counts, "id", "left").withColumn("root", F.coalesce("root", "id"))
    t = stored(t, "linked-texts")
    # written, so that the texts of a class, and then the copies of a text, can be split in the joins
    named = stored(t.groupBy("root").agg(F.min("first").alias("class")), "named")
    named_texts = stored(t.join(named, "root").select("key", "copies", F.coalesce("links", F.lit(0).cast("bigint")).alias("links"), "class"), "named-texts")
    return of_doc.select("doc_id", "h1", "h2", "key"), named_texts


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, class_id (the smallest doc_id of its class), n_links (other texts of Jaccard similarity of at least the
    threshold), n_copies (documents with the same words, itself included): one row per row of docs."""
    of_doc, texts = classes(docs, doc_id, text)
    return of_doc.join(texts, "key").select("doc_id", F.col("class.doc_id").alias("class_id"), F.col("links").alias("n_links"), F.col("copies").alias("n_copies"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one document of each class, the one with the smallest doc_id; columns and texts stay as they are."""
    _, texts = classes(docs)
    keep = texts.select(F.col("class.doc_id").alias("_id"), F.col("class.h1").alias("_h1"), F.col("class.h2").alias("_h2")).distinct()
    t = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(whole_row(docs), F.col("doc_id").alias("_of"), F.xxhash64(t).alias("_a"), F.hash(t).alias("_b"))
    kept = keyed.join(keep, F.col("_of").eqNullSafe(F.col("_id")) & (F.col("_a") == F.col("_h1")) & (F.col("_b") == F.col("_h2")), "left_semi")
    # rows that are equal in id and text: one stays
    return unpacked(kept.dropDuplicates(["_of", "_a", "_b"]), docs)
