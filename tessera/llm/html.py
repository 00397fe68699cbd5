"""Main text of web pages by composite text density.

The page becomes a tree of nodes. For every node, C is its characters, T its tags, LC and LT those under links. The
link-adjusted characters per tag are
    density = C/T * log(C*T / (LC' * LT')) / log(log(C*LC'/nLC + C*lcb/cb + e))
in the spirit of composite text density (nLC = C - LC; lcb/cb = the body's share of link characters; a primed count
is at least 1). The density sum of a node is the sum of its children's densities. The node of maximum density sum is
taken first; the content is the outermost subtree on the path from it up to the body that isn't mostly links. The
threshold is the least density on that path; divisions of the content beside the path whose density is below it go.
Two things differ from the method there. Densities are compared at equal size (without the logarithm of C*T, which grows
with a node), and only what is under BESIDE of the threshold goes, as half the sections of any article are thinner than
the whole. An article or main element that the page names stays whole, and so does text spread over the body.
Before that, elements that never hold an article's text (script, style, nav, header or footer of the page, aside,
form, ...) are dropped. A class, id or role that names an advert, a notice, a menu, a sidebar or comments drops its
element only if that holds no article, main or h1 and at most SMALL_SHARE of the page's text: a wrapper that states its
layout stays. A larger one goes only if a whole name says so and either the page has an article or main elsewhere, or it
lies beside the path and holds no more than half of the text; in the choice of the node it counts PENALTY times. Headings, and headers with a heading, never go by
name. Link lists go outside of article and main only.

Style: Arrow batches of pages through plain Python, one page at a time, with no state between pages. A DOM walk has no
DataFrame form; memory is bounded by one batch of pages and the largest page.

Defined cases: a null or empty page gives an empty text of 0 characters; unclosed and crossed tags are repaired as
browsers do in simple cases (p, li, td, option close each other; an end tag without a start is ignored); a page of
text without any tag is its own content; equal rows give equal result rows; columns other than those named are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import ship

ship(__name__)

#: Elements without content, elements dropped as a whole, elements that start a new block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg iframe object canvas".split())
DROPPED = RAW | frozenset("head nav aside form button select footer dialog menu label input audio video annotation annotation-xml".split())
BLOCK = frozenset(
    "html body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption figcaption blockquote pre address header footer figure hr form fieldset details summary nav aside center".split()
)
#: Words that name a part which is no article text, as a whole part of a class, id or role.
BOILERPLATE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|notice|gdpr|popup|modal|newsletter|subscribe|signup|login|menu|nav\w*|breadcrumbs?|sidebar|side|widget\w*|footer|header|masthead|toolbar|"
    r"comments?|commentlist|disqus|replies|reply|respond|related|recommend\w*|share|sharing|social|pagination|pager|skip|search|copyright|legal|hidden|complementary|contentinfo|navigation|dialog|alert)(?:$|[\s_-]|\d)",
    re.I,
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SMALL_SHARE, PENALTY = 0.3, 0.2
#: A start tag of the key closes an open element of the value.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Markup, found in linear time: no part looks beyond the next < unless it is in quotes, and none is given back.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^<>]*+>|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^<>]*+)>", re.S)
NAMING = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDING = re.compile(r"""\bhidden\b(?!\s*[-\w])|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
SPACES = re.compile(r"[ \t\n\r\f\v ]+")
INSIDE = frozenset("article main".split())
#: Divisions beside the path are judged by density: those under this part of the threshold go.
JUDGED, BESIDE = frozenset("div section".split()), 0.5
SCOPE = frozenset("div section article main body html td th table blockquote".split())


class Node:
    __slots__ = ("tag", "parent", "items", "chars", "tags", "link_chars", "link_tags", "density", "density_sum", "rate", "titled", "headed", "cased", "thin", "named")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.items = tag, parent, []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.density_sum = self.rate = 0.0
        self.titled = self.headed = self.cased = self.thin = False
        self.named = 0


def naming(names: str) -> int:
    """What the names of an element say: 0 nothing, 1 a part of a name is a word of BOILERPLATE, 2 a whole name is, 3 the
    only such word is header."""
    words = [m[0].strip(" \t\n\r\f_-").lower() for m in BOILERPLATE.finditer(names)]
    if not words:
        return 0
    if set(words) == {"header"}:
        return 3
    return 2 if any((m := BOILERPLATE.match(x)) and m.end() == len(x) for x in names.split()) else 1


def pruned(root: Node) -> bool:
    """Takes out the small parts whose name says that they are no text; whether any went."""
    gone, stack = False, [(root, False)]
    while stack:
        n, inside = stack.pop()
        inside |= n.tag in INSIDE
        stays = lambda x: not x.named or x.tag in INSIDE or x.titled or (x.named == 3 and x.headed) or (x.chars > SMALL_SHARE * root.chars and not (x.named == 2 and root.cased and not inside))  # noqa: B023, E731
        keep = [x for x in n.items if isinstance(x, str) or stays(x)]
        gone |= len(keep) < len(n.items)
        n.items = keep
        stack.extend((x, inside) for x in keep if isinstance(x, Node))
    return gone


def parse(source: str) -> Node:
    """The tree of what may be article text: dropped parts are left out while reading."""
    root = node = Node("html", None)
    at, skipping, depth, in_article = 0, "", 0, 0
    for m in TOKEN.finditer(source):
        if m.start() < at:
            continue
        if not skipping and m.start() > at:
            node.items.append(source[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            if not skipping and m[0].startswith("<![CDATA["):
                node.items.append(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        closing = bool(m[1])
        if skipping:
            if tag == skipping:
                depth += -1 if closing else (0 if m[3].endswith("/") else 1)
                if depth <= 0:
                    skipping = ""
            continue
        if closing:
            up = node
            while up is not None and up.tag != tag:
                up = up.parent if up.tag not in SCOPE or tag in SCOPE else None
            if up is not None and up.parent is not None:
                while node is not up:
                    in_article -= node.tag in INSIDE
                    node = node.parent
                in_article -= up.tag in INSIDE
                node = up.parent
            elif tag == "p":
                node.items.append(Node("p", node))
            continue
        attrs = m[3]
        if tag in VOID:
            node.items.append(Node(tag, node))
            continue
        drop = tag in DROPPED or (tag == "header" and not in_article)
        named = 0
        if not drop and attrs.strip():
            names = " ".join(a or b or c for a, b, c in NAMING.findall(attrs))
            named = naming(names) if names and tag not in HEADINGS else 0
            drop = bool(HIDING.search(attrs))
        if drop:
            if not attrs.endswith("/"):
                if tag in RAW:  # nothing inside is markup
                    end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
                    at = end.end() if end else len(source)
                else:
                    skipping, depth = tag, 1
            continue
        if tag in ("html", "body"):
            if tag == "body" and node is root:
                node.items.append(body := Node("body", node))
                node = body
            continue
        closes = CLOSES.get(tag, ())
        if tag in BLOCK:  # a block ends an open paragraph and the inline elements in it
            up = node
            while up is not None and up.tag not in SCOPE and up.tag != "p":
                up = up.parent
            if up is not None and up.tag == "p":
                node = up.parent
        if closes:
            up = node
            while up is not None and up.tag not in SCOPE - {"td", "th"} and up.tag not in closes and up.tag not in ("ul", "ol", "dl", "select"):
                up = up.parent
            while up is not None and up.tag in closes:
                node = up = up.parent
        child = Node(tag, node)
        child.named = named
        node.items.append(child)
        if not attrs.endswith("/"):
            node = child
            in_article += tag in INSIDE
    if not skipping and at < len(source):
        node.items.append(source[at:])
    return root


def measure(root: Node) -> None:
    """Counts and densities of every node, children first."""
    order, stack = [], [root]
    while stack:
        n = stack.pop()
        order.append(n)
        stack.extend(x for x in n.items if isinstance(x, Node))
    for n in reversed(order):
        n.chars = n.tags = n.link_chars = n.link_tags = 0
        n.titled = n.headed = n.cased = False
        for x in n.items:
            if isinstance(x, str):
                n.chars += len(SPACES.sub("", x))
            else:
                n.chars += x.chars
                n.tags += x.tags + 1
                n.link_chars += x.link_chars
                n.link_tags += x.link_tags + (x.tag == "a")
                n.titled |= x.titled or x.tag == "h1" or (x.tag in INSIDE and not x.named)
                n.cased |= x.cased or (x.tag in INSIDE and not x.named and x.chars > 0)
                n.headed |= x.headed or x.tag in HEADINGS
        if n.tag == "a":
            n.link_chars = n.chars
    body_share = root.link_chars / max(1, root.chars)
    for n in order:
        c, t, lc, lt = n.chars, max(1, n.tags), max(1, n.link_chars), max(1, n.link_tags)
        if c:
            base = math.log(c * lc / max(1, c - n.link_chars) + c * body_share + math.e)
            n.rate = c / t / max(math.log(max(base, 1.0) + 1), 0.1)
            n.density = n.rate * math.log(max(1.0, c * t / (lc * lt)) + 1)
    for n in order:
        n.density_sum = sum(x.density for x in n.items if isinstance(x, Node))


def choose(root: Node) -> Node:
    """The content subtree: from the node of maximum density sum up the path; what is too thin beside it is marked."""
    best, most, stack = root, root.density_sum, [(root, 1.0)]
    while stack:
        n, weight = stack.pop()
        if n.named == 2:
            weight = PENALTY
        if n.density_sum * weight > most:
            best, most = n, n.density_sum * weight
        stack.extend((x, weight) for x in n.items if isinstance(x, Node))
    path = [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    for n in path:
        for x in n.items:
            if n is not best and isinstance(x, Node) and x.named == 2 and x not in path and not x.titled and x.tag not in INSIDE:
                x.thin = x.chars <= 0.5 * root.chars
    within = [n for n in path if n.tag not in ("html", "body")] or [best]
    top = within[0]
    for n in within[1:]:
        if n.chars and n.link_chars <= 0.3 * n.chars:
            top = n
    inside = max((k for k, n in enumerate(path) if n.tag in INSIDE), default=0)  # what an article or main holds stays whole
    if not inside and top.chars < 0.5 * root.chars and root.link_chars <= 0.3 * max(1, root.chars):
        return root  # the text is spread over the body
    threshold = min(n.rate for n in path)
    for n in path[inside + 1 : path.index(top) + 1]:
        for x in n.items:
            if isinstance(x, Node) and x not in path and x.tag in JUDGED and not x.titled:
                x.thin |= x.rate < BESIDE * threshold
    return top


def blocks(top: Node) -> list[str]:
    """Texts of the blocks under a node, in page order, white space as one space; thin parts and runs of links alone are dropped."""
    out: list[str] = []
    current: list[str] = []
    within = top
    while within is not None and within.tag not in INSIDE:
        within = within.parent

    def flush() -> None:
        if text := SPACES.sub(" ", entities.unescape("".join(current))).strip():
            out.append(text)
        current.clear()

    stack: list = [(top, within is not None)]
    while stack:
        x, inside = stack.pop()
        if isinstance(x, str):
            current.append(x)
        elif x is None:
            flush()
        elif x.tag == "br":
            current.append(" ")
        else:
            inside |= x.tag in INSIDE
            if x.thin or not inside and x is not top and x.tag in ("ul", "ol", "table", "div", "section") and x.chars and x.link_chars >= 0.9 * x.chars and x.link_tags >= 2:
                continue
            is_block = x.tag in BLOCK
            if is_block:
                flush()
                stack.append((None, inside))
            stack.extend((y, inside) for y in reversed(x.items))
    flush()
    return out


def extract(source: str | None) -> str:
    """The main text of one page."""
    if not source:
        return ""
    root = parse(source)
    measure(root)
    if pruned(root):
        measure(root)
    return "\n\n".join(blocks(choose(root)))


def extract_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars: one row per row of pages."""
    p = pages.select(pages[page_id].alias("page_id"), pages[url].alias("url"), pages[html].cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                texts = [extract(x) for x in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = dict(p.dtypes)
    return p.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")
