"""Main-text extraction from HTML (operator 2).

Gradient-boosted trees score every DOM node from its subtree density, attribute
tokens, depth and sibling statistics; a hierarchical decoding then keeps or
drops whole subtrees: a node is kept only if its parent is, and among all such
choices the likeliest is taken by one bottom-up pass, so a kept passage never
hangs from a dropped container.

Training uses a bounded sample of ``SAMPLE_PAGES`` distinct pages (a documented
bound; extraction itself covers every page whole); where fewer than
``LEAST_PAGES`` of them have blocks enough, the fixed layouts of ``built_in``
take their place, so that few, short or repeated pages are read by the same
trees whatever stands beside them; its bare pages, all article, are trained on
in any case.  No page is labelled, so each
sampled page's own text blocks are rendered again in ``VARIANTS`` layouts whose
article is known, with menus, notices, adverts, forms, sidebars, comments and
footers made of other blocks, and Spark's GBTClassifier learns to tell them
apart.  The trees then run as arrays inside the tasks.

Scale: parsing, scoring and decoding are one narrow stage over pages; memory is
one slice of pages.  Only the sample's node vectors are trained on.

Defined results: null, empty or tagless html gives its text (none: empty); open
tags, odd nesting and unknown tags are taken as browsers do in the main; repeated
rows are extracted alike; an empty table gives an empty table; other columns
are carried, and those named like an output are replaced.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .frames import carried, restored
from .words import slices
from .workers import lean

SAMPLE_PAGES, LEAST_PAGES, VARIANTS = 240, 40, 3
TREES, TREE_DEPTH = 20, 4

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*(?:>|\Z)""", re.S)
_OPEN = re.compile(r"<(?:/?[a-zA-Z]|[!?])")
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[a-z]+")
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
NEVER = set("script style template noscript head title iframe object svg math textarea select option button input".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}

# A feature vocabulary: attribute tokens that name the role of a container, by role.
TOKENS = {
    "main": "article content main post story entry body text articlebody prose".split(),
    "menu": "nav navigation menu navbar breadcrumb breadcrumbs toc pagination pager".split(),
    "ends": "header footer masthead banner topbar contentinfo copyright colophon legal".split(),
    "side": "sidebar aside complementary widget rail related recommended promo teaser".split(),
    "advert": "ad ads advert advertisement sponsor sponsored adsense".split(),
    "notice": "cookie cookies consent notice alert popup modal newsletter subscribe overlay gdpr dialog message".split(),
    "reader": "comment comments reply replies discussion respond disqus reviews".split(),
    "form": "form login signup search register input".split(),
    "social": "share sharing social tags meta byline author follow".split(),
}
_ROLE = {t: k for k, (_, ts) in enumerate(TOKENS.items()) for t in ts}
GROUPS = ({"article", "main"}, {"nav", "menu"}, {"header"}, {"footer"}, {"aside"}, {"form", "fieldset", "label", "dialog"}, {"div", "section", "body", "html"}, {"p", "blockquote", "pre", "figure", "figcaption"}, {"h1", "h2", "h3", "h4", "h5", "h6"}, {"ul", "ol", "dl", "table", "li", "tr", "td"})
_GROUP = {t: k for k, g in enumerate(GROUPS) for t in g}


@dataclass
class Page:
    """A parsed page: nodes in document order and text segments with their nodes."""

    tags: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    roles: list[frozenset[int]] = field(default_factory=list)
    hidden: list[bool] = field(default_factory=list)
    labels: list[int | None] = field(default_factory=list)
    segments: list[tuple[int, str | None]] = field(default_factory=list)

    def add(self, tag: str, parent: int, attributes: str, labelled: bool = False) -> int:
        roles, hidden, label = set(), False, None
        if attributes and not attributes.isspace():
            for name, *values in _ATTR.findall(attributes):
                name, value = name.lower(), "".join(values)
                if name in ("class", "id", "role", "itemprop", "aria-label"):
                    roles.update(_ROLE[t] for t in _WORD.findall(value.lower()) if t in _ROLE)
                elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                    hidden = True
                elif labelled and name == "data-is-article":
                    label = int(value)
        self.tags.append(tag)
        self.parents.append(parent)
        self.roles.append(frozenset(roles))
        self.hidden.append(hidden or tag in NEVER)
        self.labels.append(label)
        return len(self.tags) - 1


def parse(text: str, labelled: bool = False) -> Page:
    """``labelled``: a layout of this module, whose marks tell the article; input pages have no marks.
    A tag that the page's end cuts off goes with what follows it, as in browsers."""
    page = Page()
    page.add("#root", -1, "")
    stack, at = [0], 0
    held: Counter[str] = Counter()  # open tags by name, so that a tag without a partner costs nothing
    last = text.rfind(">")

    def shut(k: int) -> None:
        held.subtract(page.tags[i] for i in stack[k:])
        del stack[k:]

    def say(lo: int, hi: int) -> None:
        if hi > lo:
            page.segments.append((stack[-1], text[lo:hi]))

    while True:
        if at > last:
            m = _OPEN.search(text, at)
            say(at, m.start() if m else len(text))
            return page
        m = _TAG.search(text, at)
        if not m:
            say(at, len(text))
            return page
        say(at, m.start())
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            for k in range(len(stack) - 1, 0, -1) if held[tag] else ():
                if page.tags[stack[k]] == tag:
                    shut(k)
                    break
            if tag not in INLINE:
                page.segments.append((stack[-1], None))
            continue
        attributes = m[3] or m[6] or ""
        closing = SIBLINGS.get(tag, set()) | ({"p"} if tag in CLOSES_P else set())
        if any(held[t] for t in closing):
            for k in range(len(stack) - 1, 0, -1):
                open_ = page.tags[stack[k]]
                if open_ in closing:
                    shut(k)
                    break
                if open_ in SCOPES.get(tag, ()) or open_ not in INLINE and "p" in closing and tag not in SIBLINGS:
                    break
        node = page.add(tag, stack[-1], attributes, labelled)
        if tag not in INLINE:
            page.segments.append((stack[-1], None))
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(text, at)
            if end is None:
                return page
            at = text.find(">", end.start()) + 1 or len(text)
        elif tag not in VOID and not attributes.endswith("/"):
            stack.append(node)
            held[tag] += 1


def node_features(page: Page) -> tuple[np.ndarray, np.ndarray]:
    """A vector per node, and each node's own visible characters."""
    n = len(page.tags)
    parent = np.array(page.parents)
    own, stops = np.zeros(n), np.zeros(n)
    for node, text in page.segments:
        if text is not None:
            k = len(text) if not text.isspace() else 0
            own[node] += k
            if k:
                stops[node] += text.count(".") + text.count(",")
    depth, hidden = np.zeros(n), np.array(page.hidden, float)
    link = np.zeros(n)
    group = np.array([_GROUP.get(t, -1) for t in page.tags])
    above = np.zeros((n, len(GROUPS)))
    roles, roles_above = np.zeros((n, len(TOKENS))), np.zeros((n, len(TOKENS)))
    for i in range(1, n):
        p = parent[i]
        depth[i] = depth[p] + 1
        hidden[i] = max(hidden[i], hidden[p])
        link[i] = link[p] or page.tags[i] == "a"
        above[i] = above[p]
        if group[p] >= 0:
            above[i, group[p]] = 1
        roles_above[i] = np.maximum(roles_above[p], roles[p])
        for r in page.roles[i]:
            roles[i, r] = 1
    own *= hidden == 0
    total, links, dots, size, paragraphs, items = own.copy(), own * link, stops * (hidden == 0), np.ones(n), (group == 7).astype(float), np.array([t == "li" for t in page.tags], float)
    for i in range(n - 1, 0, -1):
        p = parent[i]
        for a in (total, links, dots, size, paragraphs, items):
            a[p] += a[i]
    children = np.bincount(parent[1:], minlength=n).astype(float)
    seen: dict[int, int] = {}
    rank = np.zeros(n)
    for i in range(1, n):
        rank[i] = seen.get(parent[i], 0)
        seen[parent[i]] = seen.get(parent[i], 0) + 1
    up = np.maximum(parent, 0)
    some = np.maximum(total, 1)
    own_group = np.zeros((n, len(GROUPS)))
    own_group[np.flatnonzero(group >= 0), group[group >= 0]] = 1
    x = np.column_stack([
        depth, np.log1p(own), np.log1p(total), total / max(total[0], 1), total / np.maximum(total[up], 1), links / some, np.log1p(size), total / size,
        children, rank, children[up] - rank, rank / np.maximum(children[up], 1), paragraphs, items, dots / some * 100, total[up] / size[up], links[up] / np.maximum(total[up], 1),
        own_group, above, roles, roles_above,
    ])
    return x, own


def decode(page: Page, p: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The likeliest consistent choice: which nodes are kept; a node only under a kept parent."""
    weight = np.log1p(own) + 0.05
    yes, no = weight * np.log(np.clip(p, 1e-6, 1)), weight * np.log(np.clip(1 - p, 1e-6, 1))
    parent, n = page.parents, len(page.tags)
    keep, drop = yes.copy(), no.copy()
    for i in range(n - 1, 0, -1):
        drop[parent[i]] += drop[i]
        keep[parent[i]] += max(keep[i], drop[i])
    out = np.zeros(n, bool)
    out[0] = True
    for i in range(1, n):
        out[i] = out[parent[i]] and keep[i] > drop[i] and not page.hidden[i]
    return out


def render(page: Page, kept: np.ndarray) -> str:
    """Kept text in page order: one space for white space and between blocks."""
    parts = []
    for node, text in page.segments:
        if text is None:
            parts.append(" ")
        elif kept[node] and not page.hidden[node]:
            parts.append(entities.unescape(text) if "&" in text else text)
    return " ".join("".join(parts).split())


def _escape(text: str) -> str:
    return entities.escape(text, quote=False)


def layouts(text: str, seed: int) -> list[str]:
    """Renderings of a page's own blocks in layouts whose article is known."""
    page = parse(text)
    blocks = [""]
    for node, t in page.segments:
        if t is None or page.hidden[node]:
            blocks.append("")
        else:
            blocks[-1] += entities.unescape(t)
    blocks = [b for b in (" ".join(b.split()) for b in blocks) if b]
    if len(blocks) < 4:
        return []
    out = []
    for k in range(VARIANTS):
        rng = random.Random(seed * VARIANTS + k)
        bodies = [b for b in blocks if len(b) > 40] or blocks
        some = lambda n: [rng.choice(bodies)[: rng.choice((60, 200, 800))] for _ in range(n)]  # noqa: B023, E731
        short = lambda: _escape(" ".join(rng.choice(blocks).split(None, 8)[: rng.randint(1, 8)]))  # noqa: B023, E731
        para = lambda n: "".join(f"<p>{_escape(b)}" + rng.choice(("</p>", "</p>", "")) for b in some(n))  # noqa: B023, E731
        def name(role: str, tag: str | None = None) -> tuple[str, str]:
            if tag and rng.random() < 0.5:  # noqa: B023
                return f"<{tag}", f"</{tag}>"
            word = rng.choice(TOKENS[role])  # noqa: B023
            return f"<{(box := rng.choice(('div', 'section')))} {rng.choice(('class', 'id'))}=\"{rng.choice(('', 'page-', 'site_', 'x '))}{word}\"", f"</{box}>"  # noqa: B023
        def wrap(role: str, tag: str | None, inner: str, label: int = 0) -> str:
            a, b = name(role, tag)
            return f'{a} data-is-article="{label}">{inner}{b}'
        menu = lambda: wrap("menu", "nav", "<ul>" + "".join(f'<li><a href="#">{short()}</a></li>' for _ in range(rng.randint(3, 8))) + "</ul>")  # noqa: B023, E731
        pieces = {
            "head": lambda: wrap("ends", "header", rng.choice((f"<h1>{short()}</h1>", f'<a href="/">{short()}</a><p>{short()}</p>', menu()))),
            "side": lambda: wrap("side", "aside", f"<h3>{short()}</h3>" + rng.choice((para(2), f'<ul><li><a href="#">{short()}</a></li><li><a href="#">{short()}</a></li></ul>'))),
            "advert": lambda: wrap("advert", None, rng.choice((short(), para(1)))),
            "notice": lambda: wrap("notice", None, rng.choice((f"{short()} <button>{short()}</button>", para(1)))),
            "reader": lambda: wrap("reader", None, f"<h2>{short()}</h2>" + "".join(f'<{t}><b>{short()}</b>{para(1)}</{t}>' for t in [rng.choice(("div", "article", "li"))] for _ in range(rng.randint(1, 4)))),
            "form": lambda: f'<form data-is-article="0"><label>{short()}</label><input name="q"><p>{short()}</p><button>{short()}</button></form>',
            "social": lambda: wrap("social", None, f'<a href="#">{short()}</a> <a href="#">{short()}</a>'),
            "menu": menu,
            "foot": lambda: wrap("ends", "footer", rng.choice((f"&copy; {short()} &middot; <a href='#'>{short()}</a>", para(1)))),
        }
        story = f"<h1>{short()}</h1>" + "".join(rng.choice((para(1), para(2), f"<h2>{short()}</h2>", f"<ul><li>{short()}</li><li>{short()}</li></ul>", f"<blockquote>{para(1)}</blockquote>")) for _ in range(rng.randint(2, 8)))
        for inside in rng.sample(("advert", "social", "form", "notice"), rng.randint(0, 2)):
            story = story.replace("<p>", pieces[inside]() + "<p>", 1)
        article = wrap("main", rng.choice(("article", "main")), story, 1)
        if rng.random() < 0.4:
            article = f"<main>{article}{pieces[rng.choice(('reader', 'side', 'social'))]()}</main>" if "<main" not in article else article
        before = "".join(pieces[p]() for p in rng.sample(("head", "menu", "advert", "notice", "side"), rng.randint(1, 4)))
        after = "".join(pieces[p]() for p in rng.sample(("reader", "side", "form", "advert", "notice", "social"), rng.randint(0, 4))) + pieces["foot"]() * (rng.random() < 0.8)
        out.append(f"<html><head><title>{short()}</title></head><body>{before}{article}{after}</body></html>")
    return out


def labelled(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and labels of a rendered layout's nodes; containers go with most of their text."""
    page = parse(text, labelled=True)
    x, own = node_features(page)
    n = len(page.tags)
    label = np.full(n, -1)
    for i in range(n):
        mark = page.labels[i]
        label[i] = mark if mark is not None else label[page.parents[i]] if i else -1
    inside, total = np.where(label == 1, own, 0.0), own.copy()
    for i in range(n - 1, 0, -1):
        inside[page.parents[i]] += inside[i]
        total[page.parents[i]] += total[i]
    open_ = label < 0
    label[open_] = (2 * inside >= np.maximum(total, 1))[open_]
    return x, label


@dataclass
class Forest:
    """Trees as arrays: per tree weight, feature (-1: leaf), threshold, left, right, value."""

    trees: list[tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def probability(self, x: np.ndarray) -> np.ndarray:
        margin = np.zeros(len(x))
        rows = np.arange(len(x))
        for weight, feature, threshold, left, right, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(TREE_DEPTH):
                f = feature[at]
                at = np.where(f < 0, at, np.where(x[rows, np.maximum(f, 0)] <= threshold[at], left[at], right[at]))
            margin += weight * value[at]
        return 1 / (1 + np.exp(-2 * margin))


def _exported(model) -> Forest:
    trees = []
    for tree, weight in zip(model.trees, model.treeWeights):
        rows: list[list[float]] = []

        def walk(node) -> int:
            k = len(rows)  # noqa: B023
            rows.append([-1, 0.0, k, k, node.prediction()])  # noqa: B023
            if node.getClass().getSimpleName() == "InternalNode":
                split = node.split()
                rows[k][:2] = split.featureIndex(), split.threshold()  # noqa: B023
                rows[k][2], rows[k][3] = walk(node.leftChild()), walk(node.rightChild())  # noqa: B023
            return k

        walk(tree._java_obj.rootNode())
        a = np.array(rows)
        trees.append((weight, a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4]))
    return Forest(trees)


def built_in(seed: int, whole: bool) -> list[str]:
    """Fixed labelled pages: bare ones, article alone or over a footer; with ``whole`` also layouts of made-up blocks."""
    rng = random.Random(seed)
    words = ["".join(rng.choice(("ka", "le", "mi", "on", "ter", "sa", "du", "ri", "st", "e")) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(words) + rng.choice(("", "", "", "", "", "", ",", ".")) for _ in range(n)).capitalize() + "."
    out = []
    for _ in range(2 * VARIANTS):
        tag = rng.choice(("p", "p", "p", "div"))
        head = f'<h1 data-is-article="1">{say(rng.randint(1, 5))}</h1>' * (rng.random() < 0.3)
        body = head + "".join(f'<{tag} data-is-article="1">{say(rng.choice((1, 2, 4, 8, 40)))}</{tag}>' for _ in range(rng.choice((1, 1, 2, 3, 6))))
        if rng.random() < 0.5:  # a short article over a footer that may be longer
            body = rng.choice(("{}", "<article>{}</article>", "<main>{}</main>", "<div>{}</div>")).format(body)
            body += rng.choice(("<footer>{}</footer>", "<footer><p>{}</p></footer>", '<div class="footer">{}</div>')).format("&copy; " + say(rng.choice((2, 6, 12, 20))))
        out.append(rng.choice((body, f"<body>{body}</body>", f"<html><body>{body}</body></html>")))
    if whole:
        blocks = [say(rng.randint(1, 6)) for _ in range(rng.randint(3, 12))] + [say(rng.randint(8, 120)) for _ in range(rng.randint(3, 15))]
        out += layouts("".join(f"<p>{b}</p>" for b in blocks), seed)
    return out


def _vectors(seed: int, pages: list[str]) -> Iterator[pa.RecordBatch]:
    for page in pages:
        x, y = labelled(page)
        yield pa.RecordBatch.from_arrays([pa.array([seed] * len(y), pa.int64()), pa.array(list(x), pa.list_(pa.float64())), pa.array(y.astype(float))], ["k", "x", "label"])


def _fixed_rows(whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seed in batch.column(0).to_pylist():
                yield from _vectors(seed, built_in(seed, whole))

    return run


def _training_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for seed, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            yield from _vectors(seed, layouts(text, seed))


def fit_extractor(pages: DataFrame, html_col: str = "html", sample: int = SAMPLE_PAGES) -> Forest:
    """Train on layouts of at most ``sample`` distinct pages, chosen by a hash of their html."""
    spark = ship(pages.sparkSession)
    rows = pages.select(F.col(f"`{html_col}`").alias("h")).where("h is not null").withColumn("g", F.xxhash64("h"))
    rows = rows.withColumn("k", F.pmod("g", F.lit(1 << 31)))
    # Only hashes are made distinct and sorted; then the chosen pages alone are read, once each.
    chosen = [r.g for r in rows.select("k", "g").distinct().orderBy("k", "g").limit(sample).collect()]
    rows = rows.where(F.col("g").isin(chosen)).groupBy("k", "g").agg(F.min("h").alias("h")).select("k", "h")

    schema = "k long, x array<double>, label double"
    nodes = rows.mapInArrow(lean(_training_rows), schema).repartition(4).cache()
    try:
        few = nodes.select("k").distinct().count() < LEAST_PAGES
        fixed = spark.range(0, SAMPLE_PAGES, 1, 4).mapInArrow(lean(_fixed_rows(few)), schema)
        used = (fixed if few else nodes.union(fixed)).select(array_to_vector("x").alias("x"), "label").cache()
        try:
            return _exported(GBTClassifier(featuresCol="x", labelCol="label", maxIter=TREES, maxDepth=TREE_DEPTH, stepSize=0.3, seed=7).fit(used))
        finally:
            used.unpersist()
    finally:
        nodes.unpersist()


def extract(pages: DataFrame, forest: Forest, html_col: str = "html") -> DataFrame:
    """``pages`` without the html, with text and n_chars (code points)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 0):
                parsed = [parse(t) if t else None for t in batch.column(0).to_pylist()]
                vectors = [node_features(p) if p else (np.zeros((0, 1)), None) for p in parsed]
                some = [x for x, _ in vectors if len(x)]
                scores = forest.probability(np.concatenate(some)) if some else np.zeros(0)
                texts, at = [], 0
                for page, (x, own) in zip(parsed, vectors):
                    texts.append(render(page, decode(page, scores[at : at + len(x)], own)) if page else "")
                    at += len(x)
                yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["rest", "text", "n_chars"])

    base = pages.select(F.col(f"`{html_col}`").alias("h"), carried(pages, html_col).alias("rest"))
    out = base.mapInArrow(lean(run), f"rest {base.schema['rest'].dataType.simpleString()}, text string, n_chars long")
    return restored(out, [c for c in pages.columns if c != html_col], {"text": F.col("text"), "n_chars": F.col("n_chars")})
