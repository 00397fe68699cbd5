"""Text operators: SQL twins, brute force on small fixtures, and the awkward inputs that every one must take."""

import hashlib
import html as entities
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import chat, common, decontaminate, html, licenses, line_templates, mixing, near_duplicates, oracles, pii, quality, queries, toxicity
from tests.compare import same, views

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))


def docs_of(spark, texts, **more):
    rows = [(k, t, "en", f"src{k % 3}", len(t) if t else 0) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(900)]
    return lambda n, seed: " ".join(random.Random(seed).choice(vocabulary) for _ in range(n))


@pytest.fixture(scope="module")
def awkward(spark, prose):
    """Nulls in any column, empty, blank, very long and repeated texts, ties, and columns with clashing names."""
    long = prose(60_000, 1)
    rows = [
        (1, "plain words of some text here", "en", "a", 5), (1, "plain words of some text here", "en", "a", 5), (None, "plain words of some text here", None, None, None), (None, None, None, None, None),
        (2, None, "en", "a", 0), (3, "", "fr", "", 0), (4, " \n\t ", "xx", "b", 4), (5, long, "en", "a", len(long)), (6, "é" * 5000 + " İ \U0001f600 [INST]", "fr", "b", None), (7, "a@b.c" * 300, "en", "a", 1500), (8, "1 " * 4000, "en", "a", 8000), (9, "\x00\x01 ###", "en", None, 6),
        (10, "x" * 30000, "en", "a", 30000), (11, "one\n" * 50 + "two", "en", "a", 203), (12, "Released under the MIT License.", "en", "a", 31), (12, "another text with the same id", "en", "a", 29),
    ]
    d = spark.createDataFrame(rows, DOCS)
    clash = ["_w", "_h", "key", "gram_hash", "size", "pass", "block", "n_words", "_row", "_key", "drop", "doc", "text_hash", "class", "root", "id", "value", "score", "n_lines", "copies"]
    return d.withColumns({c: F.lit(7) for c in clash})


@pytest.fixture(scope="module")
def con(sf):
    return views(sf)


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_same_as_sql(spark, sf, con, name):
    assert same(queries.QUERIES[name](spark, sf), con, oracles.ORACLES[name]) > 0


def benchmark_of(spark):
    return spark.createDataFrame([(1, "plain words of some text"), (1, "plain words of some text"), (2, None), (None, "of some"), (3, "")], "item_id bigint, text string")


def labels_of(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, None), (None, 1, 1), (5, 1, 1), (6, 1, 0)], "doc_id bigint, quality int, toxic int")


def test_awkward_tables(spark, awkward):
    n = awkward.count()
    bench, labels = benchmark_of(spark), labels_of(spark)
    for d, count in ((awkward, n), (awkward.limit(0), 0)):
        assert len(licenses.scan(d).collect()) == count
        assert len(quality.judge(d).collect()) == count
        assert len(pii.report(d).collect()) == count
        assert len(toxicity.report(d, labels).collect()) == count
        assert len(decontaminate.report(d, bench).collect()) == count
        assert len(near_duplicates.report(d).collect()) == count
        assert len(line_templates.report(d).collect()) == count
        assert len(mixing.mix(d).collect()) >= min(count, 1)
        for kept in (pii.redact(d), decontaminate.remove(d, bench), near_duplicates.keep_one(d), toxicity.reject(d, labels)):
            assert kept.columns == d.columns
            assert len(kept.collect()) <= count
    assert len(toxicity.report(awkward, labels.limit(0)).collect()) == n
    assert not any(r.contaminated for r in decontaminate.report(awkward, bench.limit(0)).collect())


def test_awkward_values(spark, awkward):
    by = {}
    for r in decontaminate.report(awkward, benchmark_of(spark)).collect():
        by.setdefault(r.doc_id, []).append((r.n_words, r.n_hit, r.n_items))
    assert by[1] == [(6, 5, 2)] * 2
    assert sorted(by[None]) == [(0, 0, 0), (6, 5, 2)]
    near = {r.doc_id: r for r in near_duplicates.report(awkward).where("doc_id is not null").collect()}
    assert near[1].n_copies == 3 and near[3].n_copies == 3  # with the null id; the null texts are empty
    kept = near_duplicates.keep_one(awkward).collect()
    assert sum(r.text == "plain words of some text here" for r in kept) == 1


# --- licenses


def test_license_spans(spark):
    base = "so you may use it. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"
    edited = base.replace("to any person", "to each and any person").replace("copy of this", "copy this")
    d = docs_of(spark, [base, edited, "under the MIT license and under the mit LICENSE", "Licensed under CC BY-NC 4.0.", "GNU General Public License, version 3 licensed under", "This work is licensed under the GNU General Public License, version 3.", "nothing here"])
    got = {r.doc_id: r for r in licenses.scan(d).collect()}
    assert [got[k].labels for k in range(7)] == ["mit", "mit", "mit", "cc-by-nc", "", "gpl-3", ""]
    assert got[0].score == 1.0 and 0.8 <= got[1].score < 1.0 and got[0].n_base == 0 and got[0].spans[0].start == 5
    assert (got[2].n_base, got[2].first_word, got[2].last_word) == (2, 0, 5)


# --- quality


def test_repeats_and_counts(spark):
    texts = ["a b c d e x a b c d e", "a a a a a a a a", "q " * 3, "l1 w\nl1 w\n\n\nl1 w", "# a $ b"]
    got = {r.doc_id: r for r in quality.judge(docs_of(spark, texts)).collect()}
    for k, t in enumerate(texts):
        w = t.split()
        wins = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        hit = {p for i, g in enumerate(wins) if wins.count(g) > 1 for p in range(i, i + 5)}
        lines = [x for x in t.split("\n") if x.strip()]
        assert (got[k].n_words, got[k].word_chars, got[k].n_repeat_words, got[k].n_dup_lines, got[k].n_symbols) == (len(w), sum(map(len, w)), len(hit), len(lines) - len(set(lines)), sum(c in "#*$%&|<>" for c in t))
        assert got[k].base_failed


# --- personal data


def brute_spans(t):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_seeds_against_brute_force(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    rng = random.Random(9)
    alphabet = "ab.@+-_ 0123456789()\n%é4111"
    texts += ["".join(rng.choice(alphabet) for _ in range(300)) for _ in range(200)]
    texts += ["a@b.c%d@e.f", "x@y.z@w.v", "4111 1111 1111 1111", "4111-1111-1111-1112", "1.2.3.4.5.6.7.8", "256.1.1.1 001.002.003.004", "+1 (555) 555-0100.", "a@" * 5000 + "b.c", "9" * 20000, "é\U0001f600 a@b.co", "@@a@b..c", "+1+2345678901"]
    got = {r.doc_id: r for r in pii.report(docs_of(spark, texts)).collect()}
    for k, t in enumerate(texts):
        want = brute_spans(t)
        assert got[k].base_sha256 == hashlib.sha256(",".join(f"{a}:{b}:{c}" for a, b, c in want).encode()).hexdigest(), t[:200]
        assert (got[k].n_email, got[k].n_ip, got[k].n_card, got[k].n_phone) == tuple(sum(a == x for a, *_ in want) for x in ("email", "ip", "card", "phone"))
        spans = got[k].spans.split(",") if got[k].spans else []
        assert [f"{a}:{b}:{c}" for a, b, c in want] == spans[: len(want)]


def test_contexts_find_unseen_identifiers(spark, prose):
    rng = random.Random(4)
    hexes = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    texts = [f'{prose(30, k)} the token = "{hexes()}" {prose(20, k + 100)}' for k in range(30)]
    odd = f'{prose(30, 500)} the token = "Zz9{"k3" * 10}" {prose(20, 501)}'
    plain = f"{prose(30, 600)} model AB12CD34EF56GH {prose(20, 601)}"
    got = {r.doc_id: r for r in pii.report(docs_of(spark, [*texts, odd, plain])).collect()}
    assert got[30].n_id == 1 and got[31].n_id == 0
    at = odd.index("Zz9")
    assert got[30].spans == f"id:{at}:{at + 23}"
    clean = pii.redact(docs_of(spark, [*texts, odd, plain])).orderBy("doc_id").collect()
    assert "[ID]" in clean[30].text and clean[31].text == plain


def test_many_and_long_matches(spark):
    import time

    many = "".join(f"u{k}@x.org, " for k in range(20_000))
    began = time.time()
    got = {r.doc_id: r for r in pii.report(docs_of(spark, [many, "key " + "a1" * 200 + " end"])).collect()}
    assert time.time() - began < 60
    assert got[0].n_email == 20_000 and got[0].base_sha256 == hashlib.sha256(",".join(f"{a}:{b}:{c}" for a, b, c in brute_spans(many)).encode()).hexdigest()
    assert spark.createDataFrame([("key " + "a1" * 200 + " end",)], "t string").select(pii.candidates(F.col("t")).alias("c")).first().c[0].end == 404


# --- pages

PAGE = """<html><head><title>T</title></head><body><header><h1>Site</h1></header><nav><a href=1>Home</a><a href=2>News</a></nav>
<div class="cookie-notice">We use cookies</div><main><div class="content"><h2>A &amp; B</h2><p>First   paragraph, long enough to be
text with <a href=x>one link</a>.</p><p>Second paragraph &lt;tag&gt; &#233; with enough words to matter in the density sums of the page.</p>
<ul><li>item one is text</li><li>item two is text</li></ul><div class="ad">Buy!</div><form><input>Search</form></div></main>
<aside>Related</aside><div id="comments"><p>A reader says something that is long enough to look like an article paragraph, really.</p></div>
<footer>Copyright</footer><script>var x = "<p>no</p>";</script></body></html>"""


def test_page_without_article_element():
    want = "A & B\n\nFirst paragraph, long enough to be text with one link.\n\nSecond paragraph <tag> é with enough words to matter in the density sums of the page.\n\nitem one is text\n\nitem two is text"
    assert html.extract(PAGE) == want
    assert html.extract(PAGE.replace("<main>", "<div>").replace("</main>", "</div>")) == want


@pytest.mark.parametrize("page", [None, "", "<", "<p", "just text", "<p>a<p>b", "</div></p>", "<script>never closed", "<!-- open", "<div " * 2000, "<div>" * 3000 + "x", "&#x;&#99999999;&nosuch;"])
def test_broken_pages(page):
    assert isinstance(html.extract(page), str)


def test_pages_against_plain_cutting(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r.text for r in html.extract_pages(pages).collect()}
    for r in pages.collect():
        art = re.search(r"<article>(.*?)(</article>|<footer>|\Z)", r.html, re.S)[1]
        parts = [entities.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))) for x in re.split(r"</?(?:p|h1)[^>]*>", art)]
        want = "\n\n".join(y for x in parts if (y := re.sub(r"[ \t\n\r\f\v ]+", " ", x).strip()))
        assert got[r.page_id] == want


PARAS = [f"Paragraph {k} of the text says at some length what it has to say, and it goes on for a while, as the paragraphs of an article do; it ends here." for k in range(6)]


def test_thin_parts_beside_the_text_go():
    text = "".join(f"<p>{p}</p>" for p in PARAS)
    teasers = "".join(f"<div><p>Teaser {k}</p><p>Read on</p></div>" for k in range(4))
    second = "".join(f"<p>{p[:90].strip()}</p>" for p in PARAS[:3])
    page = f"<html><body><div id=wrap><h1>Title</h1><div>{text}</div><div>{second}</div><div>{teasers}</div><p>Short end.</p></div></body></html>"
    assert html.extract(page) == "\n\n".join(["Title", *PARAS, *(p[:90].strip() for p in PARAS[:3]), "Short end."])


@pytest.mark.parametrize("name", ["content has-sidebar", "layout no-sidebar", "site-content sidebar-right", "sidebar"])
def test_wrappers_that_state_their_layout_stay(name):
    text = "".join(f"<p>{p}</p>" for p in PARAS)
    small = "<div class='widget sidebar'><p>Seen elsewhere</p></div><div class=ad-box>Buy!</div>"
    for page in (f"<body><div class='{name}'>{text}{small}</div></body>", f"<body><div class='{name}'><article>{text}</article>{small}</div></body>"):
        assert html.extract(page) == "\n\n".join(PARAS)


def test_parts_of_an_article_stay():
    text = "".join(f"<p>{p}</p>" for p in PARAS)
    page = f"<body><article><div class=entry-header><h2>Name</h2></div><h2 class=section-header>Part</h2>{text}<figure><img src=x><figcaption>What is seen</figcaption></figure><p>So <math><mi>a</mi><mo>=</mo><mi>b</mi></math> holds.</p><ul><li><a href=1>First source</a></li><li><a href=2>Second source</a></li></ul></article></body>"
    assert html.extract(page) == "\n\n".join(["Name", "Part", *PARAS, "What is seen", "So a=b holds.", "First source", "Second source"])


def test_hostile_markup_is_read_in_linear_time():
    import time

    for bad in ("<a " * 300_000, "<!" * 300_000, '<a "' * 300_000, "<a '" * 300_001, "<b" * 300_000):
        began = time.time()
        html.extract(bad)
        assert time.time() - began < 5


def test_parts_left_open_and_sections_with_telling_names():
    text = "".join(f"<p>{p}</p>" for p in PARAS)
    assert html.extract(f"<body><div class=content><p>{PARAS[0]}</p><div class='ad'>{text}</div></body>").endswith("\n\n".join(PARAS))
    for name in ('class="related-work"', 'id="search-algorithms"', 'class="legal-history"'):
        part = "".join(f"<p>{p}</p>" for p in PARAS[3:])
        assert html.extract(f"<body><article><h1>T</h1>{text}<section {name}>{part}</section></article></body>") == "\n\n".join(["T", *PARAS, *PARAS[3:]])


def density_by_hand(node):
    """Counts and the density of a small tree of (tag, children), straight from the formula."""
    import math

    def counts(n):
        if isinstance(n, str):
            return len(re.sub(r"\s", "", n)), 0, 0, 0
        parts = [counts(c) for c in n[1]]
        chars = sum(p[0] for p in parts)
        tags = sum(p[1] + (not isinstance(c, str)) for p, c in zip(parts, n[1], strict=True))
        links = chars if n[0] == "a" else sum(p[2] for p in parts)
        return chars, tags, links, sum(p[3] + (not isinstance(c, str) and c[0] == "a") for p, c in zip(parts, n[1], strict=True))

    total = counts(node)
    out = {}

    def walk(n, path):
        c, t, lc, lt = counts(n)
        t, l1, t1 = max(1, t), max(1, lc), max(1, lt)
        base = math.log(c * l1 / max(1, c - lc) + c * total[2] / max(1, total[0]) + math.e) if c else 0
        out[path] = c / t / max(math.log(max(base, 1.0) + 1), 0.1) * math.log(max(1.0, c * t / (l1 * t1)) + 1) if c else 0.0
        for k, x in enumerate(x for x in n[1] if not isinstance(x, str)):
            walk(x, (*path, k))

    walk(node, ())
    return out


def test_densities_of_small_trees_by_hand():
    rng = random.Random(2)

    def tree(depth):
        return (rng.choice(["div", "p", "a", "b"]), [rng.choice(["word " * rng.randint(1, 9), "x"]) if depth == 0 or rng.random() < 0.4 else tree(depth - 1) for _ in range(rng.randint(0, 4))])

    def built(n, parent=None):
        node = html.Node(n[0], parent)
        node.items = [x if isinstance(x, str) else built(x, node) for x in n[1]]
        return node

    def read(n, path):
        yield path, n.density
        for k, x in enumerate(x for x in n.items if isinstance(x, html.Node)):
            yield from read(x, (*path, k))

    for _ in range(200):
        small = ("html", [tree(3), tree(2)])
        root = built(small)
        html.measure(root)
        want = density_by_hand(small)
        got = dict(read(root, ()))
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_long_comments_do_not_win():
    said = "".join(f"<article class=comment><p>Reader {k} says: {p}</p></article>" for k, p in enumerate(PARAS[:4]))
    text = "".join(f"<p>{p}</p>" for p in PARAS)
    assert html.extract(f"<body><div><div class=text>{text}</div><div id=comments>{said}</div></div></body>") == "\n\n".join(PARAS)


# --- toxicity


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    got = toxicity.report(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).join(labels, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 30
    assert np.mean([r.predicted == r.toxic for r in held]) > 0.93
    assert sum(r.predicted for r in held if r.toxic == 0) <= 2
    assert all(0 <= r.score <= 1 for r in got)


def test_trees_and_calibration():
    rng = np.random.default_rng(0)
    x = rng.random((2000, len(toxicity.FEATURES)))
    y = ((x[:, 0] > 0.7) & (x[:, 1] < 0.5)).astype(float)
    f = toxicity.fit_trees(x[:1000], y[:1000])
    raw = f.raw(x[1000:])
    assert ((raw > 0) == (y[1000:] == 1)).mean() > 0.97
    xs, ps = toxicity.fit_isotonic(raw, y[1000:])
    assert (np.diff(ps) >= 0).all() and (np.diff(xs) >= 0).all()
    m = toxicity.Model({"=grot": 3.0, "^zorb": 2.0})
    row = dict(zip(toxicity.FEATURES, m.features("You are a gr0t and a ZORBLING idiot!"), strict=True))
    assert row["lexicon"] > 0 and row["restored"] > 0 and row["openings"] > 0 and row["near_second"] > 0 and row["hits"] == 3


# --- chat


def fold_by_hand(log):
    """The event log folded one event at a time."""
    convs = {}
    for e in sorted(log, key=lambda e: e[1]):
        conv, seq, kind, msg, role, text = e
        state = convs.setdefault(conv, {})
        if kind == "message":
            state[msg] = [seq, role, text]
        elif kind == "delta":
            state[msg][2] += text
        elif kind == "edit":
            state[msg][2] = text
        else:
            state[msg][2] = text
            for m in [m for m, v in state.items() if v[0] > state[msg][0]]:
                del state[m]
    return {c: [(v[1], v[2]) for v in sorted(s.values())] for c, s in convs.items()}


def test_stale_events_discard_nothing(spark):
    log = [(1, 1, "message", 1, "user", "A"), (1, 2, "message", 2, "assistant", "B"), (1, 4, "regenerate", 1, "user", "A2"), (1, 5, "message", 5, "assistant", "C"), (1, 6, "regenerate", 2, "assistant", "B2")]
    log += [(2, 1, "message", 1, "user", "A"), (2, 2, "message", 2, "user", "B"), (2, 3, "message", 3, "user", "C"), (2, 4, "regenerate", 2, "user", "B2"), (2, 5, "message", 5, "user", "D"), (2, 6, "regenerate", 3, "user", "x"), (2, 7, "regenerate", 1, "user", "A2"), (2, 8, "message", 8, "user", "E"), (2, 9, "regenerate", 5, "user", "y")]
    d = spark.createDataFrame(log, "conv bigint, seq bigint, kind string, msg bigint, role string, text string")
    got = {r.conv: [t.text for t in r.turns] for r in chat.parse(chat.render(chat.fold(d))).collect()}
    assert got == {1: ["A2", "C"], 2: ["A2", "E"]}


def test_logs_are_folded(spark):
    rng = random.Random(8)
    log = []
    for conv in range(40):
        live, seq = [], 0
        for _ in range(rng.randint(1, 25)):
            seq += 1
            kind = rng.choice(["message", "message", "delta", "delta", "edit", "regenerate"]) if live else "message"
            if kind == "message":
                msg = seq
                live.append(msg)
            else:
                msg = rng.choice(live)
                if kind == "regenerate":
                    live = [m for m in live if m <= msg]
            log.append((conv, seq, kind, msg, rng.choice(["user", "assistant"]), rng.choice(["a<b", "[INST]", "", "&amp;", "x\n<|end|>\n"])))
    d = spark.createDataFrame(rng.sample(log, len(log)), "conv bigint, seq bigint, kind string, msg bigint, role string, text string")
    out = chat.parse(chat.render(chat.fold(d))).collect()
    want = fold_by_hand(log)
    assert {r.conv: [(t.role, t.text) for t in r.turns] for r in out} == want
    assert all(t.loss == (t.role == "assistant") for r in out for t in r.turns)
    for r in chat.render(chat.fold(d)).collect():
        learnt = [r.formatted[s.start : s.start + s.length] for s in r.loss_spans]
        assert [x.replace("&lsb;", "[").replace("&lt;", "<").replace("&amp;", "&") for x in learnt] == [t for role, t in want[r.conv] if role == "assistant"]


def test_nulls_and_ties_in_conversations(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, None, None), (None, 0, "assistant", "x")]
    got = {r.conv_id: r for r in chat.digest(chat.render(chat.fold(chat.as_events(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))))).collect()}
    assert got[1].n_turns == 4 and got[1].turns_sha256 == hashlib.sha256(b"user\na\nuser\na\nuser\nb\n\n\n").hexdigest()
    assert got[None].loss_chars == 1


# --- benchmark


def test_shuffled_join_gives_the_same(spark, sf, monkeypatch):
    docs, bench = common.table(spark, sf, "documents"), common.table(spark, sf, "benchmark")
    a = sorted(map(tuple, decontaminate.report(docs, bench).collect()))
    monkeypatch.setattr(common, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(common, "small", lambda df, rows, limit=0: df.hint("merge"))
    assert sorted(map(tuple, decontaminate.report(docs, bench).collect())) == a


def test_passages_are_cut(spark, prose):
    item = prose(25, 7)
    texts = [f"Before, {prose(80, 1)}.\n({item.upper()}!) After {prose(80, 2)}", item, prose(60, 3)]
    out = {r.doc_id: r.text for r in decontaminate.remove(docs_of(spark, texts), spark.createDataFrame([(1, item)], "item_id int, text string")).collect()}
    assert set(out) == {0, 2} and out[2] == texts[2]
    assert out[0].startswith("Before, ") and words(out[0]) == words(texts[0].replace(item.upper(), ""))


# --- near-duplicates


def jaccard(a, b):
    s = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (words(a), words(b))]
    return len(s[0] & s[1]) / len(s[0] | s[1]) if s[0] and s[1] else 0.0


def near_fixture(prose):
    rng = random.Random(12)
    texts = []
    for k in range(12):
        base = prose(rng.randint(20, 300), 50 + k).split()
        for c in range(rng.randint(1, 9)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 6])):
                w[rng.randrange(len(w))] = f"edit{c}"
            texts.append(" ".join(w).capitalize() + rng.choice([".", "", "!"]))
    shared = prose(60, 99)
    texts += [shared + " " + prose(n, 200 + n) for n in (5, 20, 40, 80, 12, 9, 7)]
    texts += ["tiny text", "Tiny  TEXT.", "", "", None, "###", "###", "one two three four"]
    rng.shuffle(texts)
    return texts


def check_near(report, texts):
    got = {r.doc_id: r for r in report.collect()}
    n = len(texts)
    # copies have the same words, or are equal where they have none
    norm = [" ".join(words(t)) or "\x00" + (t or "") for t in texts]
    uniq = sorted(set(norm))
    links = {u: {v for v in uniq if v != u and not u.startswith("\x00") and not v.startswith("\x00") and jaccard(u, v) >= 0.8} for u in uniq}
    root = {u: u for u in uniq}

    def find(u):
        while root[u] != u:
            u = root[u]
        return u

    for u in uniq:
        for v in links[u]:
            root[find(u)] = find(v)
    for k in range(n):
        members = [j for j in range(n) if find(norm[j]) == find(norm[k])]
        assert got[k].class_id == min(members)
        assert got[k].n_links == len(links[norm[k]])
        assert got[k].n_copies == norm.count(norm[k])


def test_near_duplicates_against_brute_force(spark, prose):
    texts = near_fixture(prose)
    check_near(near_duplicates.report(docs_of(spark, texts)), texts)


def test_blocks_of_any_size_give_the_same(spark, prose, monkeypatch):
    texts = near_fixture(prose)
    dealt = near_duplicates.dealt
    monkeypatch.setattr(near_duplicates, "dealt", lambda m: dealt(m, 2, 300))
    check_near(near_duplicates.report(docs_of(spark, texts)), texts)


def test_buckets_of_any_size_give_the_same(spark, prose, monkeypatch):
    texts = near_fixture(prose)
    monkeypatch.setattr(near_duplicates, "BLOCK_TEXTS", 2)
    check_near(near_duplicates.report(docs_of(spark, texts)), texts)


def at_the_threshold(pairs):
    """Pairs of texts of similarity 0.8 to 0.83, each pair of words of its own."""
    rng, texts = random.Random(5), []
    for k in range(pairs):
        n = rng.randint(30, 250)
        w = [f"p{k}w{j}" for j in range(n)]
        v = w[: n - int(0.2 * (n - 4))]
        assert 0.8 <= jaccard(" ".join(w), " ".join(v)) <= 0.84
        texts += [" ".join(w), " ".join(v)]
    return texts


def test_measured_recall_at_the_threshold(spark):
    texts = at_the_threshold(400)
    got = {r.doc_id: r for r in near_duplicates.report(docs_of(spark, texts)).collect()}
    found = sum(got[k].class_id == got[k + 1].class_id == k and got[k].n_links == 1 for k in range(0, len(texts), 2))
    assert found >= 399  # 0.9999 of such pairs by the estimate


def test_prefixes_are_shortened_where_the_recall_needs_it(spark, monkeypatch):
    depths = []
    plain = near_duplicates.nodes
    monkeypatch.setattr(near_duplicates, "nodes", lambda texts, depth: depths.append(depth) or plain(texts, depth))
    near_duplicates.report(docs_of(spark, at_the_threshold(20))).collect()
    loose, depths[:] = list(depths), []
    close = [" ".join([f"p{k}w{j}" for j in range(300)]) + f" {c}" for k in range(20) for c in "ab"]  # far above the threshold
    near_duplicates.report(docs_of(spark, close)).collect()
    assert loose[:2] == [8, 7] and depths == [8]


def test_components_of_chains(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 101), (101, 102), (200, 200)]
    got = {r.id: r.root for r in near_duplicates.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {k: 0 for k in range(61)} | {k: 100 for k in (100, 101, 102)}


# --- lines


def test_passages_stay_in_one_document(spark, prose):
    passage = prose(60, 5)
    varied = passage.split()
    varied[40] = "other"
    texts = [f"{prose(30, k)}\n{passage}\n{prose(30, k + 50)}" for k in range(4)] + [f"{prose(30, 9)}\n{' '.join(varied)}"] + [f"Page {k} of 20 in the report of the year {1990 + k}\n{prose(20, k + 300)}" for k in range(3)] + ["Of.\n" + prose(30, 77), "Of.\n" + prose(30, 78)]
    out = {r.doc_id: r for r in line_templates.report(docs_of(spark, texts)).collect()}
    assert passage in out[0].text and all(passage not in out[k].text for k in (1, 2, 3))
    assert out[4].n_dropped == 1 and out[5].n_dropped == 0 and out[6].n_dropped == out[7].n_dropped == 1
    assert out[8].text == texts[8] and out[9].text == texts[9]


def test_short_lines_recur_in_the_pipeline(spark, prose):
    texts = [f"{prose(30, k + 700)}\n\nAll rights reserved.\nOf.{k % 2}\n" for k in range(12)] + ["Les.\n" + prose(30, k + 800) for k in range(9)]
    out = {r.doc_id: r.text for r in corpus_pipeline.drop_repeated_lines(spark, docs_of(spark, texts), "").collect()}
    assert out == {k: t if k == 0 or k > 11 else t.split("\n")[0] + "\n\n" for k, t in enumerate(texts)}


def test_short_lines_with_one_changing_word_recur(spark):
    word = lambda r: "".join(r.choice("klmnopqr") for _ in range(6))
    head = lambda k: " ".join(word(random.Random(100 * k + j)) for j in range(20))
    names = [word(random.Random(10000 + k)) for k in range(12)]
    texts = [f"{head(k)}\nThis article was written by {x} for the daily paper today.\n{x} wrote this article for the daily paper today" for k, x in enumerate(names)]
    few = [f"{head(k + 50)}\nHere is what we know of {x} and the whole town" for k, x in enumerate(names[:9])]
    out = {r.doc_id: r.text for r in corpus_pipeline.drop_repeated_lines(spark, docs_of(spark, texts + few), "").collect()}
    assert out == {k: t if k == 0 or k > 11 else t.split("\n")[0] for k, t in enumerate(texts + few)}


def templates_by_hand(texts):
    """Which lines go, by document: all templates of all lines, word by word."""
    found = {}
    for doc, t in texts.items():
        for i, line in enumerate((t or "").split("\n")):
            w = ["<*>" if re.search("[0-9]", x) else x for x in re.findall(r"[^\x20\x09-\x0D]+", line)]
            n, c = len(w), 2 if len(w) >= 12 else 1
            keys = [(("whole", *w), 10 if n < 8 else 2)] if n else []
            if n >= 5:
                keys += [((n, k, *w[: c * k], "|", *w[c * k + c * c :]), 2 if n >= 16 else 10) for k in range(-(-n // c) - c + 1)]
            for key, need in keys:
                found.setdefault((key, need), set()).add((doc, i))
    gone = {}
    for (_, need), at in found.items():
        docs = {d for d, _ in at}
        if len(docs) >= need:
            for d, i in at:
                if d != min(docs):
                    gone.setdefault(d, set()).add(i)
    return gone


def test_templates_against_brute_force(spark, monkeypatch):
    rng = random.Random(21)
    vocabulary = [f"w{c}" for c in "abcdefgh"] + ["x1", "y22"]
    bases = [[rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 4, 5, 6, 7, 8, 11, 12, 13, 15, 16, 17, 24, 40]))] for _ in range(40)]

    def line():
        w = list(rng.choice(bases))
        if rng.random() < 0.6:  # a field of one to five tokens, at any place
            k, m = rng.randrange(len(w)), rng.choice([1, 1, 2, 3, 4, 5])
            w[k : k + m] = [rng.choice("klmnop") * 3 for _ in w[k : k + m]]
        return rng.choice([" ", "  ", "\t"]).join(w)

    texts = {f"d{k:03d}": "\n".join(line() if rng.random() < 0.9 else "" for _ in range(rng.randint(0, 12))) for k in range(150)}
    d = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    gone = templates_by_hand(texts)
    want = {k: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get(k, ())) for k, t in texts.items()}
    got = {r.doc_id: r for r in line_templates.report(d).collect()}
    assert {k: r.text for k, r in got.items()} == want and 200 < sum(r.n_dropped for r in got.values()) < sum(r.n_lines for r in got.values()) - 100
    monkeypatch.setattr(line_templates, "small", lambda df, rows: df.hint("merge"))
    assert {r.doc_id: r.text for r in line_templates.report(d).collect()} == want


def test_unique_words_stay(spark, prose):
    """Two lines that share 303 words and then differ in 97 are no copies; nor are two that differ in two places."""
    shared = prose(303, 1)
    a, b = f"{shared} {prose(97, 2)}", f"{shared} {prose(97, 3)}"
    far = a.split()
    far[10], far[300] = "one", "two"
    near = a.split()
    near[150:153] = ["three", "more", "words"]
    texts = [a, b, " ".join(far), " ".join(near)]
    out = {r.doc_id: r.text for r in line_templates.report(docs_of(spark, texts)).collect()}
    assert out == {0: a, 1: b, 2: texts[2], 3: ""}


# --- mixing


def skewed(spark, prose):
    rows = [(k, prose(20 + k % 7, k), "en", "big" if k % 10 < 7 else f"s{k % 10}", 0) for k in range(600)]
    return spark.createDataFrame(rows, DOCS)


def test_weights_meet_the_target(spark, prose, tmp_path):
    d = skewed(spark, prose)
    out = mixing.mix(d, block_tokens=500, target_entropy=0.95, max_repeats=4.0, budget_share=1.0)
    total = sum(len(r.text.split()) for r in d.collect())
    by = {r.source: r.n for r in out.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    p = np.array(list(by.values())) / sum(by.values())
    entropy = -(p * np.log(p)).sum() / np.log(len(p))
    assert abs(sum(by.values()) - total) <= 30 * len(by)
    assert 0.94 <= entropy <= 0.96
    passes = out.groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("pass").alias("m"), F.max("pass").alias("x")).collect()
    assert all(r.n == r.m == r.x + 1 <= 5 for r in passes)
    d.select("doc_id", "text", "source").coalesce(1).write.parquet(f"{tmp_path}/d")
    con = views("/nonexistent")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    assert same(mixing.mix(d, keep=["doc_id", "source"]), con, oracles.ORACLES["op10_temperature_mixing"]) > 0


def test_repeats_are_bounded(spark, prose):
    rows = [(k, prose(20, k), "en", "big" if k else "tiny", 0) for k in range(400)]
    out = mixing.mix(spark.createDataFrame(rows, DOCS), max_repeats=3.0)
    assert out.where("source = 'tiny'").count() <= 4


# --- the pipeline


def test_pipeline_against_the_operators_by_hand(spark, sf):
    """Each stage on its own input, held against what plain code says of that input."""
    docs = common.table(spark, sf, "documents")
    bench = [(str(r.item_id), words(r.text)) for r in common.table(spark, sf, "benchmark").collect()]
    grams = {tuple(w[k : k + 10]) for _, w in bench for k in range(max(1, len(w) - 9)) if w}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = common.stored(stage(spark, docs, sf), name)
        rows = docs.collect()
        if name != "mixing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
            assert len({r.doc_id for r in rows}) == len(rows) and {r.doc_id for r in rows} <= set(before)
        after = {r.doc_id: r for r in rows}
        gone = [before[k] for k in before if k not in after]
        insults = lambda t: any(w in toxicity.LEXICON for w in words(t))
        if name == "toxicity":
            assert gone and sum(insults(r.text) for r in after.values()) <= 0.1 * len(gone)
        elif name == "line_dedup":
            seen = {}
            for r in after.values():
                for line in set(r.text.split("\n")):
                    if len(line.split()) >= line_templates.MIN_TOKENS:
                        seen.setdefault(line, []).append(r.doc_id)
            assert all(len(v) == 1 for v in seen.values())
        elif name == "near_duplicates":
            texts = sorted(after.values(), key=lambda r: len(words(r.text)))
            assert all(jaccard(a.text, b.text) < 0.8 for k, a in enumerate(texts) for b in texts[k + 1 : k + 40])
            assert all(any(jaccard(g.text, r.text) >= 0.8 or words(g.text) == words(r.text) for r in after.values()) for g in gone)
        elif name == "decontamination":
            for r in after.values():
                w = words(r.text)
                assert not any(tuple(w[k : k + 10]) in grams for k in range(len(w) - 9))
                assert r.text == before[r.doc_id].text or any(tuple(v[k : k + 10]) in grams for v in [words(before[r.doc_id].text)] for k in range(len(v) - 9))
        else:
            assert {r.doc_id for r in rows} <= set(before)
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_removal_leaves_what_stands_between_the_hits(spark):
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(300)]
    bench = [" ".join(rng.choices(vocabulary, k=rng.choice([4, 10, 12, 30]))) for _ in range(20)]
    texts = ["", None, bench[0]]
    for _ in range(80):
        parts = [rng.choice(bench).split()[: rng.choice([9, 11, 40])] if rng.random() < 0.4 else rng.choices(vocabulary, k=rng.randint(1, 25)) for _ in range(rng.randint(1, 9))]
        texts.append(rng.choice(["", "(", " "]) + "".join((w.upper() if rng.random() < 0.2 else w) + rng.choice([" ", ", ", "\n", "--"]) for part in parts for w in part))
    windows = {tuple(b.split()[k : k + 10]) for b in bench for k in range(max(1, len(b.split()) - 9))}
    want = {}
    for k, text in enumerate(texts):
        found = list(re.finditer("[A-Za-z0-9]+", text or ""))
        words = [m.group().lower() for m in found]
        hit = {p for size in range(1, 11) for at in range(len(words) - size + 1) if tuple(words[at : at + size]) in windows for p in range(at, at + size)}
        if not hit:
            want[k] = text
        elif len(hit) <= 0.5 * len(words):
            end, out = 0, ""
            for p, m in enumerate(found):
                out += "" if p in hit and p - 1 in hit else text[end : m.start()]
                out += "" if p in hit else m.group()
                end = m.end()
            want[k] = out + text[end:]
    items = spark.createDataFrame([(k, b) for k, b in enumerate(bench)], "item_id int, text string")
    assert {r.doc_id: r.text for r in decontaminate.remove(docs_of(spark, texts), items).collect()} == want
    assert sum(want.get(k) != t for k, t in enumerate(texts)) > 20
