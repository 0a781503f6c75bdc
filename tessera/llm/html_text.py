"""Main text of web pages by gradient-boosted trees over DOM nodes and a hierarchical choice.

Method.  A page is read into its block elements (inline elements belong to their block).  Each block has features: text and link
density of its subtree, tokens of its own and its ancestors' attributes and tags, depth, place, and statistics of its siblings.  Boosted
trees give the log-odds that a block's subtree holds main text.  The choice maximises the sum of log-odds over the chosen blocks where a block may be chosen only
with its parent, so no block is taken out of a rejected ancestor.  Chosen blocks' own text is joined in page order.

Learning.  Trees are fitted on a bounded sample (``SAMPLE_PAGES``, by the hash of the page), with labels from landmarks: text in article or main elements
and not below a boilerplate element is main.  Each sampled page is also used in ``VARIANTS`` altered forms (its landmark replaced by a plain block, and notices, forms,
side bars, comments made of its own words put in), so that other layouts are learned as well.  Extraction reads every page whole.

Edge cases.  Null and empty pages and pages without main text give the empty string; text outside of any tag is the body's; unclosed, stray and wrongly
nested tags are closed where the next block or the end demands; attributes without quotes, comments and CDATA are read; very deep pages need no recursion;
with no landmark on any page to learn from, fixed log-odds (``Prior``) stand in for the trees; repeated rows each get a row.
"""

from __future__ import annotations

import html
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_PAGES = 300
VARIANTS = 3
TREES, DEPTH, BINS, RATE, LEAST = 60, 3, 24, 0.3, 5

# Kinds of elements and attribute words.
BLOCKS = frozenset(
    "html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tbody thead tfoot tr td th caption blockquote pre figure figcaption "
    "header footer nav aside form fieldset legend details summary address center hr hgroup dialog menu search".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head title script style noscript template svg iframe object select option button textarea canvas audio video math datalist".split())
RAW = frozenset("script style textarea title noscript template iframe".split())
#: An element that begins closes an open one of these.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}, "body": {"head"},
}
BOUNDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
LANDMARKS = frozenset(["article", "main"])
#: Every page with a landmark matches; a few others may, from comments or scripts.
LANDMARK = r"(?i)<(?:article|main)(?![a-z0-9-])"
BOILERPLATE = frozenset("nav footer aside header form menu dialog search fieldset".split())
BAD = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments reply replies respond discussion cookie cookies consent gdpr footer foot header masthead "
    "menu nav navigation navbar notice alert popup modal overlay promo promotion related recommended recommendations share sharing social sidebar side widget "
    "sponsor sponsored subscribe subscription newsletter signup login form search pagination pager toolbar topbar skip legal copyright disqus feedback rail outbrain taboola".split()
)
GOOD = frozenset("article articlebody content contents entry main post story text body prose page".split())

TOKEN = regex.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<data>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)", regex.DOTALL
)
NAMED = regex.compile(r"\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", regex.IGNORECASE)
PART = regex.compile(r"[a-z]+")
CAMEL = regex.compile(r"(?<=[a-z])(?=[A-Z])")


def attribute_words(attrs: str) -> frozenset[str]:
    if "=" not in attrs:
        return frozenset()
    return frozenset(w for m in NAMED.finditer(attrs) for w in PART.findall(CAMEL.sub(" ", m[1] or m[2] or m[3] or "").lower()))


class Page:
    """Block elements in page order: parallel lists; block 0 is the page itself."""

    def __init__(self, source: str | None):
        self.tag, self.parent, self.words = ["html"], [-1], [frozenset()]
        self.links, self.text = [0], []  # characters in links; (block, text) in page order
        self._read(source or "")
        self.chars = [0] * len(self.tag)
        for block, t in self.text:
            self.chars[block] += len(t)

    def _open(self, tag: str, parent: int, attrs: str) -> int:
        self.tag.append(tag), self.parent.append(parent), self.words.append(attribute_words(attrs)), self.links.append(0)
        return len(self.tag) - 1

    def _read(self, source: str) -> None:
        stack: list[tuple[str, int]] = [("html", 0)]  # open elements with their block
        pieces: list[str] = []
        hidden = anchors = 0
        at = 0

        def settle() -> None:
            """The text so far belongs to the innermost block."""
            joined = " ".join("".join(pieces).split())
            pieces.clear()
            if joined:
                self.text.append((stack[-1][1], joined))

        def say(raw: str) -> None:
            if hidden or not raw:
                return
            t = html.unescape(raw) if "&" in raw else raw
            pieces.append(t)
            if anchors:
                self.links[stack[-1][1]] += len(t)

        def close(k: int) -> None:
            """Closes open elements from place k on."""
            nonlocal hidden, anchors
            if any(t in BLOCKS for t, _ in stack[k:]):
                settle()
            for t, _ in stack[k:]:
                hidden -= t in HIDDEN
                anchors -= t == "a"
            del stack[k:]

        end_of = len(source)
        while at < end_of:
            m = TOKEN.search(source, at)
            if m is None:
                say(source[at:])
                break
            say(source[at : m.start()])
            at = m.end()
            if m["data"] is not None:
                say(m["data"].replace("&", "&amp;"))
                continue
            tag = m["tag"]
            if tag is None:
                continue
            tag = tag.lower()
            if m["end"]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        close(k)
                        break
                    if tag not in BLOCKS and stack[k][0] in BLOCKS:
                        break  # an inline end does not close a block
                if tag in ("p", "br"):
                    settle() if tag == "p" else pieces.append(" ")
                continue
            attrs = m["attrs"]
            if tag in BLOCKS:
                for k in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph
                    if stack[k][0] == "p":
                        close(k)
                        break
                    if stack[k][0] in BLOCKS:
                        break
                if tag in CLOSES:
                    low = None
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] in BOUNDS.get(tag, ()):
                            break
                        if stack[k][0] in CLOSES[tag]:
                            low = k
                    if low is not None:
                        close(low)
                settle()
            if tag == "html":
                self.words[0] |= attribute_words(attrs)
                continue
            if tag in VOID:
                if tag in ("br", "hr", "img", "input"):
                    pieces.append(" ")
                continue
            if attrs.endswith("/") and tag not in BLOCKS:
                continue
            if tag == "body":
                close(1)
            if tag in RAW:
                stop = regex.compile(rf"</{tag}\b[^>]*>", regex.IGNORECASE).search(source, at)
                at = stop.end() if stop else end_of
                continue
            hidden += tag in HIDDEN
            anchors += tag == "a"
            block = self._open(tag, stack[-1][1], attrs) if tag in BLOCKS else stack[-1][1]
            stack.append((tag, block))
        settle()


#: Names of the features, in order.
FEATURES = (
    "depth chars subtree links_share density commas words_bad words_good above_bad above_good nearest tag_kind boiler_above landmark_above "
    "siblings same_siblings sibling_chars share_of_parent place child_blocks children_p"
).split()
KIND = {"p": 1, "h1": 2, "h2": 2, "h3": 2, "h4": 2, "h5": 2, "h6": 2, "li": 3, "ul": 4, "ol": 4, "div": 5, "section": 6, "td": 7, "tr": 7, "table": 8, "pre": 9, "blockquote": 9}


def features(page: Page) -> np.ndarray:
    """(blocks, FEATURES)."""
    n = len(page.tag)
    parent = page.parent
    subtree, linked, blocks, commas = list(page.chars), list(page.links), [1] * n, [0] * n
    for block, t in page.text:
        commas[block] += t.count(",") + t.count(".")
    kids: list[list[int]] = [[] for _ in range(n)]
    for k in range(n - 1, 0, -1):
        p = parent[k]
        subtree[p] += subtree[k]
        linked[p] += linked[k]
        blocks[p] += blocks[k]
        commas[p] += commas[k]
        kids[p].append(k)
    out = np.zeros((n, len(FEATURES)), np.float32)
    depth, bad, good, near, boiler, land = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    for k in range(n):
        p = parent[k]
        tag, words = page.tag[k], page.words[k]
        own_bad, own_good = bool(words & BAD) + (tag in BOILERPLATE), bool(words & GOOD) + (tag in LANDMARKS)
        if p >= 0:
            depth[k], bad[k], good[k], near[k], boiler[k], land[k] = depth[p] + 1, bad[p], good[p], near[p], boiler[p], land[p]
        above_bad, above_good = bad[k], good[k]
        bad[k] += own_bad
        good[k] += own_good
        boiler[k] += tag in BOILERPLATE
        land[k] += tag in LANDMARKS
        if own_bad or own_good:
            near[k] = -1 if own_bad else 1
        side = kids[p] if p >= 0 else [k]
        same = sum(page.tag[j] == tag for j in side) if len(side) < 64 else 64
        out[k] = (
            min(depth[k], 30), np.log1p(page.chars[k]), np.log1p(subtree[k]), linked[k] / max(1, subtree[k]), np.log1p(subtree[k] / blocks[k]),
            100 * commas[k] / max(1, subtree[k]), own_bad, own_good, min(above_bad, 5), min(above_good, 5), near[k], KIND.get(tag, 0), min(boiler[k], 5), min(land[k], 5),
            min(len(side), 64), same, np.log1p(subtree[p] / max(1, len(side))) if p >= 0 else 0, subtree[k] / max(1, subtree[p]) if p >= 0 else 1, k / n,
            min(len(kids[k]), 64), sum(page.tag[j] == "p" for j in kids[k][:64]),
        )
    return out


def weak_labels(page: Page) -> np.ndarray | None:
    """Which blocks' subtrees hold main text by landmarks; None if the page has no landmark."""
    if not any(t in LANDMARKS for t in page.tag):
        return None
    state, held = [0] * len(page.tag), np.zeros(len(page.tag), bool)
    for k, (tag, p) in enumerate(zip(page.tag, page.parent)):
        state[k] = state[p] if p >= 0 else 0
        if state[k] >= 0:
            if state[k] == 1 and (tag in BOILERPLATE or page.words[k] & BAD):
                state[k] = -1
            elif tag in LANDMARKS:
                state[k] = 1
    for block, _ in page.text:
        if state[block] == 1:
            held[block] = True
    for k in range(len(page.tag) - 1, 0, -1):
        held[page.parent[k]] |= held[k]
    return held


def altered(page: Page, truth: np.ndarray, draw: random.Random) -> tuple[Page, np.ndarray]:
    """A copy with another layout: plain blocks in place of landmarks, and made-up boilerplate beside and inside the main text."""
    made = Page(None)
    made.words, made.links = [page.words[0]], [page.links[0]]
    number, labels = {0: 0}, [bool(truth[0])]
    texts: dict[int, list[str]] = {}
    for block, t in page.text:
        texts.setdefault(block, []).append(t)
    some = " ".join(t for _, t in page.text).split() or ["a"]
    plain = draw.random() < 0.6
    spoken: list[tuple[int, str]] = [(0, t) for t in texts.get(0, [])]

    def add(tag: str, parent: int, words: frozenset, label: bool, own: list[str], linked: bool = False) -> int:
        made.tag.append(tag), made.parent.append(parent), made.words.append(words), made.links.append(sum(map(len, own)) if linked else 0)
        labels.append(label)
        k = len(made.tag) - 1
        spoken.extend((k, t) for t in own)
        return k

    def noise(parent: int) -> None:
        kind = draw.randrange(6)
        word = draw.choice(sorted(BAD))
        tag = draw.choice(["div", "div", "section", "aside", "form", "header", "nav"]) if kind < 5 else "div"
        words = frozenset([word]) if tag in ("div", "section") or draw.random() < 0.5 else frozenset()
        holder = add(tag, parent, words, False, [])
        for _ in range(draw.randrange(1, 6)):
            at = draw.randrange(len(some))
            add(draw.choice(["p", "li", "div", "h3"]), holder, frozenset(), False, [" ".join(some[at : at + draw.randrange(1, 40)])], linked=kind in (1, 2))

    for k in range(1, len(page.tag)):
        parent = number[page.parent[k]]
        tag, words = page.tag[k], page.words[k]
        if draw.random() < 0.06:
            noise(parent)
        if tag in LANDMARKS and plain:
            tag, words = draw.choice(["div", "section"]), frozenset(draw.choice([["content"], ["post", "body"], ["entry"], ["story", "text"], ["main"], []]))
        elif tag in BOILERPLATE and draw.random() < 0.5:
            words = frozenset([{"nav": "menu", "footer": "footer", "header": "header", "aside": "sidebar"}.get(tag, "form")])
            tag = "div"
        number[k] = add(tag, parent, words, bool(truth[k]), texts.get(k, []), page.links[k] > 0)
        if page.tag[k] in LANDMARKS and draw.random() < 0.7:
            noise(number[k])
    for _ in range(draw.randrange(3)):
        noise(0)
    made.text = spoken
    made.chars = [0] * len(made.tag)
    for block, t in spoken:
        made.chars[block] += len(t)
    return made, np.array(labels)


class Boosted:
    """Gradient-boosted regression trees for log-odds, on binned features; every tree is a full tree of DEPTH levels."""

    def __init__(self):
        self.edges: list[np.ndarray] = []
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.start = 0.0

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        b = self.bins(x)
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(rate / (1 - rate)))
        score = np.full(len(y), self.start)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            split, level = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, BINS, np.int64)
            for d in range(DEPTH):
                base, width = 2**d - 1, 2**d
                best = np.full(width, 1e-6)
                for j in range(x.shape[1]):
                    cell = node * BINS + b[:, j]
                    gs, hs, ns = (np.bincount(cell, w, width * BINS).reshape(width, BINS).cumsum(axis=1) for w in (g, h, None))
                    gt, ht, nt = gs[:, -1:], hs[:, -1:], ns[:, -1:]
                    gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                    gain[(ns < LEAST) | (nt - ns < LEAST)] = 0
                    at = gain.argmax(axis=1)
                    top = gain[np.arange(width), at]
                    better = top > best
                    best[better] = top[better]
                    split[base : base + width][better] = j
                    level[base : base + width][better] = at[better]
                k = base + node
                node = 2 * node + (b[np.arange(len(y)), split[k]] > level[k])
            leaves = RATE * np.bincount(node, g, 2**DEPTH) / (np.bincount(node, h, 2**DEPTH) + 1)
            self.trees.append((split, level, leaves))
            score += leaves[node]
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        rows, score = np.arange(len(x)), np.full(len(x), self.start)
        for split, level, leaves in self.trees:
            node = np.zeros(len(x), np.int64)
            for d in range(DEPTH):
                k = 2**d - 1 + node
                node = 2 * node + (b[rows, split[k]] > level[k])
            score += leaves[node]
        return score


class Prior:
    """Log-odds for tables without any landmark: main is what no boilerplate holds, by its own or an ancestor's tag or attributes, and what is not mostly links."""

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        bad, above, links = (x[:, FEATURES.index(name)] for name in ("words_bad", "above_bad", "links_share"))
        return np.where((bad + above == 0) & (links < 0.5), 1.0, -1.0)


def choose(parent: list[int], odds: np.ndarray) -> np.ndarray:
    """The set of blocks with the largest sum of log-odds in which every block's parent is chosen as well."""
    gain = odds.astype(float).copy()
    for k in range(len(parent) - 1, 0, -1):  # children come after their parents
        if gain[k] > 0:
            gain[parent[k]] += gain[k]
    taken = np.zeros(len(parent), bool)
    for k, p in enumerate(parent):
        taken[k] = gain[k] > 0 and (p < 0 or taken[p])
    return taken


def fit(pages: DataFrame, sample: int = SAMPLE_PAGES) -> Boosted | None:
    """Trees from a bounded sample of the pages with a landmark; None if there is none."""
    draw = F.xxhash64("html").bitwiseAND((1 << 53) - 1).cast("double") / float(1 << 53)
    known = pages.where(F.col("html").rlike(LANDMARK)).select("html", draw.alias("draw"))
    n = known.agg(F.approx_count_distinct("draw", 0.02)).first()[0]  # copies share a draw
    if not n:
        return None
    near = known.where(F.col("draw") < min(1.0, 2.0 * sample / n))
    rows = near.groupBy("draw").agg(F.min("html").alias("html")).orderBy("draw").limit(sample).collect()  # copies of a page count once
    x, y, chance = [], [], random.Random(17)
    for r in rows:
        page = Page(r.html)
        truth = weak_labels(page)
        if truth is None:
            continue
        for k in range(1 + VARIANTS):
            form, labels = altered(page, truth, chance) if k else (page, truth)
            x.append(features(form)), y.append(labels)
    return Boosted().fit(np.concatenate(x), np.concatenate(y).astype(float)) if x else None


def extract(pages: DataFrame, model: Boosted | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    sent = pages.sparkSession.sparkContext.broadcast(model or fit(pages) or Prior())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = sent.value
        for b in batches:
            for begin in range(0, len(b), 256):
                part = b.slice(begin, 256)
                read = [Page(s) for s in part.column(2).to_pylist()]
                values = [features(p) for p in read]
                odds = trees.log_odds(np.concatenate(values))
                texts, at = [], 0
                for p, v in zip(read, values):
                    taken = choose(p.parent, odds[at : at + len(v)])
                    at += len(v)
                    texts.append(" ".join(t for block, t in p.text if taken[block]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
                )

    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
