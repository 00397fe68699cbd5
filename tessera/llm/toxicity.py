"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of a fixed lexicon and of a learned one (words, and word openings, which catch compounds
and inflected forms), how close second-person words stand to lexicon words, capitals, punctuation, obfuscation (digits
or symbols inside words, and lexicon words that appear only once letters are restored), length.
The learned lexicon, the trees and the calibration come from labelled rows only, each from its own part of the
training rows (crc32 of the id): lexicon and trees must not see the same texts, or the trees would trust the
lexicon too far. Labelled rows are bounded by TRAIN_ROWS (rows of the smallest md5 of their id); every document is scored.

Style: features and scores in Arrow batches through Python, as bytes.translate and set look-ups beat expressions over
exploded words; counting for the lexicon is a Spark aggregation; trees and calibration are fitted on the driver on at
most TRAIN_ROWS rows of a few numbers.

Defined cases: null and empty texts get the score of a text without features; rows with a null label are no training
rows; with no labelled rows, or one class only, the score is the fixed lexicon's; labels of one doc_id count once (the
largest); equal rows give equal scores; an empty table gives no rows; lang, source, ids and labels are no features.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ship, small, stored, words

ship(__name__)
TRAIN_ROWS, LEXICON_SIZE, MIN_SUPPORT, MIN_PRECISION = 20_000, 400, 5, 0.5
PREFIXES = (4, 5, 6, 7)
#: Insults that count without any training.
LEXICON = frozenset("idiot idiots moron morons stupid dumb loser losers trash scum pathetic worthless disgusting clown clowns imbecile fool fools garbage filth vermin dumbass jerk jerks bastard bastards hate shut ugly freak creep".split())
#: Second-person words.
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi vous votre du dich dir dein deine ihr usted tus vosotros ti".split())
NEAR = 5
#: Digits and symbols that stand for letters.
RESTORE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "", "_": ""})
WORD = re.compile(r"[^\W_]+(?:['@$!*0-9]+[^\W_]+)*", re.U)
FEATURES = ("lexicon", "learned", "openings", "near_second", "second", "restored", "odd_words", "capitals", "caps_words", "exclaims", "punctuation", "symbols", "log_words", "hits", "weight", "top")
CAPITALS, PUNCTUATION, SYMBOLS = bytes(range(65, 91)), b".,;:?!'\"-()", b"#*$%&|<>@^~"


@dataclass
class Forest:
    """Boosted regression trees on the logit, each of fixed depth as flat arrays: feature, threshold, leaf values."""

    base: float = -3.0
    features: list[np.ndarray] = field(default_factory=list)
    thresholds: list[np.ndarray] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, leaf in zip(self.features, self.thresholds, self.leaves, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            while node[0] < len(f) if len(node) else False:
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += leaf[node - len(f)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32, ridge: float = 2.0) -> Forest:
    """Newton boosting on logistic loss with quantile-binned splits."""
    rate0 = min(max(y.mean(), 1e-3), 1 - 1e-3)
    forest = Forest(base=float(np.log(rate0 / (1 - rate0))))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    score = np.full(len(y), forest.base)
    inner = 2**depth - 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        feature, threshold, node = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf), np.zeros(len(y), dtype=np.int64)
        for k in range(inner):
            here = node == k
            if here.any():
                best, gs, hs = 1e-6, g[here], h[here]
                whole = gs.sum() ** 2 / (hs.sum() + ridge)
                for j, e in enumerate(edges):
                    if len(e):
                        cg = np.cumsum(np.bincount(binned[here, j], gs, len(e) + 1))
                        ch = np.cumsum(np.bincount(binned[here, j], hs, len(e) + 1))
                        gain = cg[:-1] ** 2 / (ch[:-1] + ridge) + (cg[-1] - cg[:-1]) ** 2 / (ch[-1] - ch[:-1] + ridge) - whole
                        at = int(np.argmax(gain))
                        if gain[at] > best:
                            best, feature[k], threshold[k] = float(gain[at]), j, e[at]
            node = np.where(here, 2 * node + 1 + (x[:, feature[k]] > threshold[k]), node)
        leaf = node - inner
        values = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        forest.features.append(feature)
        forest.thresholds.append(threshold)
        forest.leaves.append(values)
        score += values[leaf]
    return forest


def fit_isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (score, probability); each probability is drawn a little towards 1/2."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # mean, weight, first score, last score
    for s, v in zip(score[order], y[order], strict=True):
        blocks.append([float(v), 1.0, float(s), float(s)])
        while len(blocks) > 1 and (blocks[-2][0] >= blocks[-1][0] or blocks[-2][3] == blocks[-1][2]):
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2], b[3]])
    xs = np.array([v for b in blocks for v in (b[2], b[3])])
    ps = np.array([v for b in blocks for v in [(b[0] * b[1] + 0.5) / (b[1] + 1)] * 2])
    return xs, np.maximum.accumulate(ps)


@dataclass
class Model:
    """weights: log-odds of learned words ('=word') and word openings ('^opening')."""

    weights: dict = field(default_factory=dict)
    forest: Forest | None = None
    knots: tuple | None = None
    known: dict = field(default_factory=dict)

    def look_up(self, word: str) -> tuple:
        """What a word is: (insult, learned weight, best opening weight, second person, restored insult, odd)."""
        odd = not word.isalpha() and word[0].isalpha()
        restored = odd and ((r := word.translate(RESTORE)) in LEXICON or f"={r}" in self.weights)
        opening = max((self.weights.get("^" + word[:k], 0.0) for k in PREFIXES if len(word) > k), default=0.0)
        found = (word in LEXICON, self.weights.get("=" + word, 0.0), opening, word in SECOND_PERSON, restored, odd)
        if len(self.known) > 300_000:
            self.known.clear()
        self.known[word] = found = found if any(found) else None
        return found

    def features(self, text: str | None) -> list[float]:
        text = text or ""
        raw = WORD.findall(text)
        n = max(1, len(raw))
        fixed = learned = opened = weight = top = 0.0
        restored = odd = 0
        marked, second = [], []
        known = self.known
        for i, w in enumerate(map(str.lower, raw)):
            x = known[w] if w in known else self.look_up(w)
            if x is not None:
                insult, by_word, by_opening, you, again, is_odd = x
                fixed += insult
                learned += by_word
                opened += by_opening
                restored += again
                odd += is_odd
                if you:
                    second.append(i)
                if insult or again or by_word or by_opening:
                    marked.append(i)
                    weight += max(by_word, by_opening, 3.0 * (insult or again))
                    top = max(top, by_word, by_opening, 3.0 * (insult or again))
        near = 0
        if second:
            at = np.searchsorted(second, marked)
            s = np.array([-(10**9), *second, 10**9])
            m = np.array(marked, dtype=np.int64)
            near = int(((m - s[at] <= NEAR) | (s[np.minimum(at + 1, len(s) - 1)] - m <= NEAR)).sum()) if len(m) else 0
        b = text.encode("utf-8", "surrogatepass")
        count = lambda chars: len(b) - len(b.translate(None, chars))
        size = max(1, len(b))
        return [
            fixed / n, learned / n, opened / n, near / n, len(second) / n, restored / n, odd / n, count(CAPITALS) / size,
            sum(map(str.isupper, raw)) / n, count(b"!") / n, count(PUNCTUATION) / n, count(SYMBOLS) / n, float(np.log1p(n)), float(min(len(marked), 50)), float(min(weight, 100.0)), top,
        ]

    def matrix(self, texts) -> np.ndarray:
        return np.array([self.features(t) for t in texts], dtype=np.float64).reshape(-1, len(FEATURES))

    def score(self, texts) -> np.ndarray:
        x = self.matrix(texts)
        if self.forest is None:
            return np.where(x[:, 0] + x[:, 5] > 0, 0.9, 0.1)
        raw = self.forest.raw(x)
        # ties inside a calibration block keep the order of the trees
        return np.clip(0.999 * np.interp(raw, *self.knots) + 0.001 / (1 + np.exp(-raw)), 0.0, 1.0)


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def learn_lexicon(rows: DataFrame) -> dict:
    """Words and word openings with their log-odds: those that at least MIN_SUPPORT toxic texts have, and that make a
    text toxic with at least MIN_PRECISION; the best few."""
    w = F.array_distinct(words(F.col("text")))
    openings = [F.transform(w, _opening(k)) for k in PREFIXES]
    terms = F.array_distinct(F.concat(F.transform(w, lambda x: F.concat(F.lit("="), x)), *openings))
    counts = rows.select("toxic", F.explode(terms).alias("term")).where(F.col("term") != "").groupBy("term").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n"))
    good = counts.where((F.col("bad") >= MIN_SUPPORT) & (F.col("bad") >= MIN_PRECISION * F.col("n")))
    best = good.orderBy(F.desc(F.col("bad") * F.col("bad") / F.col("n")), "term").limit(LEXICON_SIZE).collect()  # at most LEXICON_SIZE
    return {r["term"]: float(np.log((r["bad"] + 0.5) / (r["n"] - r["bad"] + 0.5)) + 1.0) for r in best}


def _opening(k: int):
    return lambda x: F.when(F.char_length(x) > k, F.concat(F.lit("^"), F.substring(x, 1, k))).otherwise("")


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = TRAIN_ROWS) -> Model:
    """A model from the labelled rows whose crc32(id) mod 5 is not 0, at most `limit` of them."""
    lab = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    lab = lab.where(~held_out(F.col("_id"))).orderBy(F.md5(F.col("_id").cast("string").cast("binary"))).limit(limit)
    lab = stored(lab, "labels")
    n = lab.count()  # at most `limit`
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).join(small(lab, n), "_id").select("toxic", "text", F.floor(F.crc32(F.col("_id").cast("string")) / 5).alias("_r"))
    rows = stored(rows.select("toxic", "text", (F.col("_r") % 3).alias("part")).repartition(12), "training")
    model = Model(learn_lexicon(rows.where("part = 0")))

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"toxic": b["toxic"], "part": b["part"], "x": list(model.matrix(b["text"]))})

    found = rows.where("part > 0").mapInPandas(measured, "toxic int, part bigint, x array<double>").toPandas()  # at most `limit` rows of a few numbers
    if len(found) == 0:
        return model
    x, y, part = np.stack(found["x"].to_numpy()), found["toxic"].to_numpy(dtype=np.float64), found["part"].to_numpy()
    fit, tune = part == 1, part == 2
    if not (0 < y[fit].sum() < fit.sum()) or not (0 < y[tune].sum() < tune.sum()):
        return model
    order = np.lexsort([*x.T, y])  # the order in which Spark returns rows doesn't matter
    x, y, fit, tune = x[order], y[order], fit[order], tune[order]
    model.forest = fit_trees(x[fit], y[fit])
    model.knots = fit_isotonic(model.forest.raw(x[tune]), y[tune])
    return model


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with score (0 to 1): every row is scored, in Arrow batches; a column that is there already is replaced."""
    score = F.pandas_udf(lambda s: pd.Series(model.score(s)), "double")
    return docs.withColumn("score", score(F.col(text)))


def report(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of docs."""
    model = train(docs, labels, doc_id, text)
    d = scored(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), model)
    return d.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the documents that are predicted toxic; all columns stay as they are."""
    model = train(docs, labels)
    score = F.pandas_udf(lambda s: pd.Series(model.score(s)), "double")
    return docs.where(score(F.col("text")) < 0.5)
