"""Main-text extraction: gradient-boosted trees over DOM nodes, decoded down the tree.

A tolerant scan builds the tree of structural elements (inline elements only count as
links or emphasis of the text around them). For each node the trees see its tag, depth,
place among its siblings, share of the page's text, link and tag density of its subtree,
text of its neighbours, the tokens of its class, id and role attributes and whether it has any. They are
trained in numpy on seeded template pages whose nodes are labelled. Decoding takes the
most likely labelling in which a dropped node drops its whole subtree, so an ancestor and
a descendant never contradict each other.

A block is a run of text between structural tags; character references are decoded, white
space becomes one blank, and the kept blocks are joined by an empty line in page order.

Nulls, blanks: null html counts as empty and gives an empty text, as does a page without
main text. Repeated rows are extracted each. An empty table gives an empty result.
"""

from __future__ import annotations

import html as htmllib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegraph.llm.labelled import map_rows

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*)>?", re.S)
_ATTR = re.compile(r"\b(class|id|role|aria-label|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
#: Labels of the template pages' nodes; a page of the corpus has none, and nothing but training reads them.
_KEEP = re.compile(r'data-keep="([01])"')
#: Content that is dropped up to the closing tag; one that is never closed is dropped to the end for the kinds that hold no markup, else its tag alone.
TEXT_ONLY = frozenset("script style textarea title".split())
_CLOSE = {t: re.compile(rf"</{t}\b[^>]*>?", re.I) for t in "script style textarea title noscript template iframe svg object select".split()}
_CLOSE["head"] = re.compile(r"</head\b[^>]*>?|(?=<body\b)", re.I)
# What is in a button or an option ends with the next structural tag at the latest.
_CLOSE |= {t: re.compile(rf"</{t}\b[^>]*>?|(?=</?(?:p|div|section|article|main|form|ul|ol|li|dl|table|tr|td|th|h[1-6]|body|html|nav|aside|header|footer|blockquote|pre|select|button|option)\b)", re.I) for t in ("button", "option")}
RAW = frozenset("script style textarea title noscript template iframe svg object select option button head".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
#: An opening tag of the key ends an open element of these kinds, up to a container.
CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}
_P = {"p"}
BOUNDS = frozenset("ul ol dl table article section div main body aside nav header footer blockquote form".split())
TAGS = "html body div section article main p h1 h2 h3 h4 ul ol li dl table tr td blockquote pre figure aside nav header footer form".split()
#: Attribute tokens that are features of their own.
TOKENS = (
    "nav menu navbar breadcrumb breadcrumbs header masthead logo footer foot copyright legal sidebar side widget related recommended more tags share social "
    "ad ads advert advertisement sponsor sponsored promo banner cookie cookies consent gdpr notice alert popup modal overlay subscribe newsletter signup login search form "
    "comment comments reply replies discussion disqus respond author meta date byline pagination pager content main article post entry story body text page wrapper container"
).split()
_TAG_AT, _TOKEN_AT = {t: k for k, t in enumerate(TAGS)}, {t: k for k, t in enumerate(TOKENS)}
WIDTH = 17 + 2 * (len(TAGS) + 1) + 2 * len(TOKENS)


class Node:
    __slots__ = ("tag", "up", "depth", "tokens", "kids", "chars", "links", "words", "marks", "n_inline", "begin", "end", "keep", "named")

    def __init__(self, tag: str, up: int, depth: int, tokens: list[int]):
        self.tag, self.up, self.depth, self.tokens = tag, up, depth, tokens
        self.kids, self.chars, self.links, self.words, self.marks, self.n_inline, self.begin, self.end = 0, 0, 0, 0, 0, 0, 0, 0
        self.keep, self.named = 1, False


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Structural nodes in page order (the first is the root), and (node, text) of each block."""
    nodes, blocks = [Node("html", -1, 0, [])], []
    stack, held, link = [0], [], 0
    n_link = total = 0

    def flush() -> None:
        nonlocal held, n_link, total
        if held:
            text = " ".join(htmllib.unescape("".join(held)).split())
            if text:
                node = nodes[stack[-1]]
                node.chars += len(text)
                node.links += min(n_link, len(text))
                node.words += text.count(" ") + 1
                node.marks += sum(map(text.count, ".,;:!?"))
                total += len(text)
                node.end = total
                blocks.append((stack[-1], text))
            held, n_link = [], 0

    opened: dict[str, int] = {}

    def cut(k: int) -> None:
        for n in stack[k:]:
            opened[nodes[n].tag] -= 1
        del stack[k:]

    at, end = 0, len(page)
    while at < end:
        found = _TOKEN.search(page, at)
        stop = found.start() if found else end
        if stop > at:
            held.append(page[at:stop])
            if link:
                n_link += stop - at
        if not found:
            break
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if not found[0].endswith(">"):  # a quote that is never closed: the tag ends at the next sign that ends one
            at = page.find(">", at) + 1 or end
        if found[1]:
            if tag == "a":
                link = 0
            elif tag not in INLINE and tag not in VOID:
                flush()
                if opened.get(tag):
                    cut(next(k for k in range(len(stack) - 1, 0, -1) if nodes[stack[k]].tag == tag))
            continue
        if tag in INLINE:
            link = int(tag == "a" or (link and tag != "a"))
            nodes[stack[-1]].n_inline += 1
        elif tag == "br" or tag in ("wbr", "img"):
            held.append(" ")
        elif tag in RAW:
            if tag not in ("button", "option", "select", "title"):
                held.append(" ")
            close = None if found[0].endswith("/>") else _CLOSE[tag].search(page, at)
            if close:
                at = close.end()
            elif tag in TEXT_ONLY and not found[0].endswith("/>"):
                at = end
        elif tag in VOID:
            flush()
        elif tag in ("html", "body") and len(stack) > 1 and any(nodes[k].tag == tag for k in stack[1:]):
            continue
        else:
            flush()
            link = 0
            shut = CLOSES.get(tag, _P)
            if any(opened.get(t) for t in shut):
                for k in range(len(stack) - 1, 0, -1):
                    name = nodes[stack[k]].tag
                    if name in shut:
                        cut(k)
                    elif name in BOUNDS:
                        break
            tokens = sorted({_TOKEN_AT[w] for m in _ATTR.finditer(found[3]) for w in _WORD.findall((m[2] or m[3] or m[4] or "").lower()) if w in _TOKEN_AT}) if found[3] else []
            up = stack[-1]
            nodes[up].kids += 1
            node = Node(tag, up, len(stack), tokens)
            node.named = bool(found[3]) and _ATTR.search(found[3]) is not None
            node.begin = node.end = total
            said = _KEEP.search(found[3]) if "data-keep" in found[3] else None
            node.keep = int(said[1]) if said else nodes[up].keep
            stack.append(len(nodes))
            opened[tag] = opened.get(tag, 0) + 1
            nodes.append(node)
    flush()
    return nodes, blocks


def features(nodes: list[Node]) -> np.ndarray:
    """One row of numbers for each node."""
    n = len(nodes)
    up = [x.up for x in nodes]
    own = np.array([(x.chars, x.links, x.words, x.marks, x.n_inline, 1, x.tag == "p", x.chars > 80) for x in nodes], float)
    sub = own.copy()
    for k in range(n - 1, 0, -1):
        sub[up[k]] += sub[k]
    total, nested = max(1.0, sub[0, 0]), np.array([x.depth for x in nodes], float)
    out = np.zeros((n, WIDTH), np.float32)
    chars = sub[:, 0]
    out[:, 0], out[:, 1], out[:, 2] = nested, np.log1p(chars), chars / total
    out[:, 3] = sub[:, 1] / np.maximum(1, chars)
    out[:, 4] = chars / sub[:, 5]
    out[:, 5] = sub[:, 3] / np.maximum(1, sub[:, 2])
    out[:, 6] = np.log1p(sub[:, 6])
    out[:, 7] = np.log1p(sub[:, 7])
    out[:, 8] = own[:, 0] / np.maximum(1, chars)
    out[:, 9] = sub[:, 4] / np.maximum(1, sub[:, 2])
    seen: dict[int, int] = {}
    last: dict[int, int] = {}
    begin = np.array([x.begin for x in nodes], float)
    out[:, 10], out[:, 11] = begin / total, (begin + chars) / total
    for k in range(1, n):
        p = up[k]
        place = seen[p] = seen.get(p, 0) + 1
        out[k, 12], out[k, 13] = nodes[p].kids, place / nodes[p].kids
        before = last.get(p)
        if before is not None:
            out[k, 14] = out[before, 1]
            out[before, 15] = out[k, 1]
        last[p] = k
    own_tag = np.array([_TAG_AT.get(x.tag, len(TAGS)) for x in nodes])
    tags, above = out[:, 16 : 16 + len(TAGS) + 1], out[:, 17 + len(TAGS) : 18 + 2 * len(TAGS)]
    names, over = out[:, 18 + 2 * len(TAGS) : 18 + 2 * len(TAGS) + len(TOKENS)], out[:, 18 + 2 * len(TAGS) + len(TOKENS) : -1]
    tags[np.arange(n), own_tag] = 1
    out[:, -1] = [x.named for x in nodes]
    for k, x in enumerate(nodes):
        if x.tokens:
            names[k, x.tokens] = 1
        if k:  # what its ancestors are, and what they are called
            above[k] = above[x.up]
            above[k, own_tag[x.up]] = 1
            over[k] = over[x.up]
            if nodes[x.up].tokens:
                over[k, nodes[x.up].tokens] = 1
    return out


# ---- boosted trees --------------------------------------------------------------------

DEPTH, TREES, RATE, BINS, LEAF = 5, 60, 0.25, 24, 8
#: Nodes whose features are held at once, but for a larger page.
NODES = 10_000


class Boosted:
    """Histogram trees of fixed depth for the logistic loss; node i of a level has children 2i and 2i + 1."""

    def __init__(self) -> None:
        self.bias, self.feature, self.cut, self.value = 0.0, [], [], []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        edges = [np.array([0.5]) if set(np.unique(c)) <= {0.0, 1.0} else e for c, e in zip(x.T, edges)]
        b = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], axis=1).astype(np.int64)
        n_bins = BINS + 1
        flat = b + np.arange(x.shape[1]) * n_bins
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.bias = float(np.log(rate / (1 - rate)))
        z = np.full(len(y), self.bias)
        rng = np.random.default_rng(1)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-z))
            half = rng.random(len(y)) < 0.5  # each tree sees half of the nodes
            g, h = np.where(half, y - p, 0), np.where(half, p * (1 - p) + 1e-6, 0)
            at = np.zeros(len(y), np.int64)
            features, cuts = [], []
            for level in range(DEPTH):
                size = 2**level
                f, c = np.zeros(size, np.int64), np.full(size, np.inf)
                key = (at[:, None] * (x.shape[1] * n_bins) + flat).reshape(-1)
                shape = (size, x.shape[1], n_bins)
                gs = np.bincount(key, np.repeat(g, x.shape[1]), size * x.shape[1] * n_bins).reshape(shape).cumsum(2)
                hs = np.bincount(key, np.repeat(h, x.shape[1]), size * x.shape[1] * n_bins).reshape(shape).cumsum(2)
                gt, ht = gs[:, :1, -1:], hs[:, :1, -1:]
                gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                gain[(hs < LEAF * 0.05) | (ht - hs < LEAF * 0.05)] = 0
                for k in range(size):
                    best = int(gain[k].argmax())
                    j, s = divmod(best, n_bins)
                    if gain[k, j, s] > 1e-3 and s < len(edges[j]):
                        f[k], c[k] = j, edges[j][s]
                at = 2 * at + (x[np.arange(len(x)), f[at]] > c[at])
                features.append(f)
                cuts.append(c)
            leaf = RATE * np.bincount(at, g, 2**DEPTH) / (np.bincount(at, h, 2**DEPTH) + 1)
            self.feature.append(features)
            self.cut.append(cuts)
            self.value.append(leaf)
            z += leaf[at]
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        z, rows = np.full(len(x), self.bias), np.arange(len(x))
        for features, cuts, leaf in zip(self.feature, self.cut, self.value):
            at = np.zeros(len(x), np.int64)
            for f, c in zip(features, cuts):
                at = 2 * at + (x[rows, f[at]] > c[at])
            z += leaf[at]
        return z


# ---- labelled template pages ------------------------------------------------------------


def template_page(rng: random.Random) -> str:
    """A page whose nodes carry ``data-keep="1"`` (main text) or ``"0"``."""
    pick, chance = rng.choice, lambda p: rng.random() < p
    syllable = "an er ti on the ver lo ma es ri da ne ko su pel gra".split()
    word = lambda: "".join(rng.choices(syllable, k=rng.randrange(1, 4)))
    words = lambda a, b: " ".join(word() + ("," if chance(0.1) else "") for _ in range(rng.randrange(a, b)))
    prose = lambda a, b: ". ".join(words(4, 16).capitalize() for _ in range(rng.randrange(a, b))) + pick([".", ".", "", "!!", " ***"])
    mark = lambda kinds: f' {pick(["class", "class", "id"])}="{pick(kinds.split("|"))}"' if chance(0.8) else ""
    links = lambda a, b: "".join(f'<li data-keep="0"><a href="/{word()}">{words(1, 3)}</a></li>' for _ in range(rng.randrange(a, b)))
    el = lambda tag, attrs, body: f'<{tag}{attrs} data-keep="0">{body}</{tag}>'
    zero = lambda body, tag="p": f'<{tag} data-keep="0">{body}</{tag}>'

    def nav() -> str:
        body = pick([f'<ul data-keep="0">{links(2, 9)}</ul>', " | ".join(f'<a href="#">{words(1, 3)}</a>' for _ in range(rng.randrange(3, 9)))])
        return el(*pick([("nav", ""), ("nav", mark("menu|main-nav")), ("div", mark("nav|menu|navbar|breadcrumbs|breadcrumb")), ("ul", ' class="menu"')]), body)

    def header() -> str:
        return el(pick(["header", "div"]), mark("header|site-header|masthead|page-header|logo"), pick([f'<h1 data-keep="0">{words(1, 4)}</h1>', zero(words(1, 5)), words(1, 5)]) + (nav() if chance(0.5) else ""))

    def footer() -> str:
        tag = pick(["footer", "footer", "div"])
        attrs = mark("footer|site-footer|legal|copyright|page-foot") if tag == "footer" else f' class="{pick(["footer", "site-footer", "legal", "copyright"])}"'
        return el(tag, attrs, pick([f"&copy; {word()}.com &middot; {prose(1, 3)}", zero(prose(1, 3)) + f'<ul data-keep="0">{links(2, 6)}</ul>', zero("Copyright " + words(2, 6))]))

    def advert() -> str:
        return el(pick(["div", "div", "aside", "section"]), f' class="{pick("ad|ads|advert|advertisement|sponsored|promo|banner-ad|ad-slot".split("|"))}"', pick([prose(1, 3), zero(prose(1, 3)), f'<a href="#">{prose(1, 2)}</a>']))

    def notice() -> str:
        return el(pick(["div", "section", "aside", "p"]), f' {pick(["class", "id"])}="{pick("cookie|cookie-banner|consent|gdpr|notice|alert|popup|modal|subscribe|newsletter".split("|"))}"', pick([prose(1, 3), words(4, 14)]) + "<button>OK</button>")

    def form() -> str:
        return el("form", mark("search|login|signup|newsletter|subscribe"), pick(["", zero(words(2, 10))]) + f'<label>{words(1, 4)}</label><input name="q">' + f"<button>{word()}</button>")

    def sidebar() -> str:
        body = "".join(pick([lambda: f'<h3 data-keep="0">{words(1, 4)}</h3><ul data-keep="0">{links(2, 8)}</ul>', lambda: zero(prose(1, 4)), lambda: el("div", ' class="widget"', prose(1, 3))])() for _ in range(rng.randrange(1, 4)))
        tag = pick(["aside", "aside", "div"])
        return el(tag, mark("sidebar|related|widget") if tag == "aside" else f' class="{pick("sidebar|related|recommended|widget|side|more|share|social|tags".split("|"))}"', body)

    def comments() -> str:
        one = lambda: el(pick(["div", "li", "article", "p"]), f' class="{pick("comment|reply|comment-body|comments-item".split("|"))}"', pick([prose(1, 5), zero(words(1, 3), "h4") + zero(prose(1, 5))]))
        return el(pick(["section", "div", "ol"]), f' {pick(["class", "id"])}="{pick("comments|comment-list|discussion|replies|respond|disqus".split("|"))}"', (f'<h2 data-keep="0">{words(1, 3)}</h2>' if chance(0.6) else "") + "".join(one() for _ in range(rng.randrange(1, 6))))

    def piece() -> str:
        k = rng.random()
        inner = prose(1, rng.choice([2, 3, 8])) if chance(0.75) else words(1, 4).capitalize() + pick([".", "", "!!"])
        if chance(0.06):
            inner = (word() + " ") * rng.randrange(20, 200)
        if chance(0.25):
            inner = pick([f"<b>{inner}</b>", f"{inner} <a href='#'>{words(1, 3)}</a> {words(2, 9)}", f"<b>{inner}<br>", f"<span>{inner}</span>", f"{inner}<br>{inner}"])
        if k < 0.75:
            return f'<p data-keep="1">{inner}' + ("</p>" if chance(0.85) else "")
        if k < 0.83:
            return f'<h{(d := rng.randrange(2, 4))} data-keep="1">{words(1, 7)}</h{d}>'
        if k < 0.9:
            items = "".join(f'<li data-keep="1">{prose(1, 2)}</li>' for _ in range(rng.randrange(2, 5)))
            return f'<ul data-keep="1">{items}</ul>'
        if k < 0.95:
            return f'<blockquote data-keep="1">{inner}</blockquote>'
        return f'<div data-keep="1">{inner}</div>'

    inside = [advert, sidebar, notice, form, comments, nav]
    parts = [piece() for _ in range(rng.choice([1, 1, 2, 3, 5, 9, 14]))]
    for _ in range(rng.choice([0, 0, 0, 1, 2])):
        parts.insert(rng.randrange(len(parts) + 1), pick(inside)())
    title = f'<h1 data-keep="1">{words(2, 10)}</h1>' if chance(0.8) else ""
    tag = pick(["article", "article", "main", "div", "section", "div"])
    attrs = mark("content|main|article|post|entry|story|body|text|main-content|article-body|post-content|x" + word())
    story = f'<{tag}{attrs} data-keep="1">{title}{"".join(parts)}</{tag}>'
    if chance(0.3):
        story = f'<{pick(["main", "div"])}{mark("main|content|page|container")} data-keep="1">{story}</div>'
    above = [f() for f in (header, nav, notice, advert, form) if chance(0.45)]
    below = [f() for f in (sidebar, comments, advert, notice, footer, footer) if chance(0.4)]
    rng.shuffle(above)
    body = "".join(above) + story + "".join(below)
    if chance(0.4):
        body = f'<div{mark("wrapper|container|page")} data-keep="1">{body}</div>'
    return f'<html><head><title>{words(2, 6)}</title><style>p{{}}</style></head><body data-keep="1">{body}' + ("</body></html>" if chance(0.8) else "")


def labelled_nodes(page: str) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Features, labels and the blocks of main text of a template page."""
    nodes, blocks = parse(page)
    label = np.array([x.keep for x in nodes], float)
    return features(nodes), label, [t for k, t in blocks if label[k]]


@lru_cache(maxsize=1)
def train(pages: int = 800, seed: int = 3) -> Boosted:
    """Trees fitted to the nodes of ``pages`` seeded template pages; on half of them attribute tokens are hidden."""
    rng, xs, ys = random.Random(seed), [], []
    for _ in range(pages):
        x, y, _ = labelled_nodes(template_page(rng))
        if rng.random() < 0.15:
            x[:, 18 + 2 * len(TAGS) : -1] = 0
        xs.append(x)
        ys.append(y)
    return Boosted().fit(np.concatenate(xs), np.concatenate(ys))


def decode(nodes: list[Node], odds: np.ndarray) -> np.ndarray:
    """Kept nodes of the most likely labelling in which a dropped node drops its subtree; the root is always kept."""
    keep, drop = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    best, lost = keep.copy(), drop.copy()
    for k in range(len(nodes) - 1, 0, -1):
        best[nodes[k].up] += max(best[k], lost[k])
        lost[nodes[k].up] += lost[k]
    kept = np.ones(len(nodes), bool)
    for k in range(1, len(nodes)):
        kept[k] = kept[nodes[k].up] and best[k] >= lost[k]
    return kept


def extract(pages: list[str], model: Boosted) -> list[str]:
    """Main text of each whole page."""
    out, at = [], 0
    while at < len(pages):
        parsed, n = [], 0
        while at < len(pages) and n < NODES:
            parsed.append(parse(pages[at]))
            n += len(parsed[-1][0])
            at += 1
        odds, done = model.log_odds(np.concatenate([features(nodes) for nodes, _ in parsed])), 0
        for nodes, blocks in parsed:
            kept = decode(nodes, odds[done : done + len(nodes)])
            done += len(nodes)
            out.append("\n\n".join(t for k, t in blocks if kept[k]))
    return out


def extract_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """``page_id``, the ``keep`` columns, ``text`` and ``n_chars`` for every row."""
    model = train()
    source = pages.select(F.col(id_col).alias("page_id"), *keep, F.coalesce(F.col(html_col), F.lit("")).alias("_html"))
    schema = "".join(f"`{c}` {source.schema[c].dataType.simpleString()}, " for c in keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 500):
                part = pdf.iloc[at : at + 500]
                out = part[["page_id", *keep]].copy()
                out["text"] = extract(part["_html"].tolist(), model)
                out["n_chars"] = out["text"].str.len().astype("int64")
                yield out

    return map_rows(source, run, f"{schema}text string, n_chars long", ("page_id",))
