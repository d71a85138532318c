"""Main text of web pages by gradient-boosted trees over DOM nodes.

Pages become trees of block elements and text blocks. Every node is described by its tag, the tokens
of its attributes, its depth, the text, links and punctuation of its subtree, and how it compares with
its parent and siblings. A boosted forest gives each node's log-odds of holding article text, and a
decoder picks the choice of largest total in which a node is kept only under kept ancestors.

The forest is trained here, on pages that are generated with known article text: there are no labelled
pages. Training takes seconds in the driver and depends on the seed alone.
"""

from __future__ import annotations

import functools
import html as entities
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm import boosting
from terrane.llm.text import small_batches, with_output

TRAIN_PAGES, SEED = 2000, 5
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?:class|id|role|itemprop|aria-label|data-[\w-]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_PART = re.compile(r"[a-z]+")
RAW = frozenset("script style noscript textarea title template svg iframe object select option canvas math".split())
#: Raw elements that run to the end of the page if they have no end tag; of others only the start tag and the text up to the next tag go.
TO_THE_END = frozenset("script style textarea title".split())
#: An option's end tag may be left out: it ends where the next one begins, or its list ends.
_OPTION_END = re.compile(r"</option\b[^>]*(?:>|\Z)|(?=</?(?:optgroup|select|datalist)\b|<option\b)", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
#: Start tags that end an open paragraph.
CLOSES_P = frozenset("address article aside blockquote center details dialog dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul".split())
#: Open elements that a start tag of the same group ends, up to the containers named last.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
KINDS = ("#text", "article", "main", "section", "div", "p", "h", "list", "li", "table", "cell", "pre", "quote", "figure", "nav", "header", "footer", "aside", "form", "body", "other")
_KIND = {
    **{k: k for k in KINDS}, **{f"h{i}": "h" for i in range(1, 7)}, "ul": "list", "ol": "list", "dl": "list", "menu": "list", "dt": "li", "dd": "li", "tr": "table", "tbody": "table",
    "thead": "table", "td": "cell", "th": "cell", "blockquote": "quote", "figcaption": "figure", "fieldset": "form", "button": "form", "html": "body", "hgroup": "header",
}
#: Attribute tokens by meaning; a token counts by its beginning.
MEANINGS = {
    "good": "article content post entry main story text body prose paragraph chapter lede lead headline", "menu": "nav navigation menu breadcrumb crumb toc tab pager pagination skip toolbar topbar navbar links",
    "head": "header masthead brand logo banner hero top site", "foot": "footer foot contentinfo copyright legal colophon bottom imprint", "side": "sidebar side aside complementary widget related recommend popular trending rail more",
    "ad": "ad ads advert advertisement adsense sponsor sponsored promo promoted promotion banner dfp outbrain taboola commercial", "notice": "cookie consent notice gdpr alert popup modal overlay paywall newsletter subscribe signup toast message privacy",
    "talk": "comment comments reply replies discussion disqus respond reader feedback thread", "form": "form search login register input contact poll survey", "share": "share social follow tweet facebook like tags byline author meta",
}
_MEANING = [(name, tuple(sorted(set(text.split())))) for name, text in MEANINGS.items()]
#: A class name that begins or ends so says what a page has or how it is laid out, not what the element is: with-sidebar, menu-open.
_HAS = frozenset("with has have no not without is are hide show".split())
_STATE = frozenset("open opened closed layout enabled disabled visible hidden template page".split())
_SHORT = {w for _, ws in _MEANING for w in ws if len(w) <= 4}


@functools.lru_cache(100_000)
def meanings(tag_tail: str) -> int:
    """Bits of the meanings that a tag's attributes have."""
    bits = 0
    for value in _ATTRIBUTE.findall(tag_tail):
        for name in re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower().split():
            tokens = _PART.findall(name)
            if len(tokens) > 1 and (tokens[0] in _HAS or tokens[-1] in _STATE):
                continue
            for token in tokens:
                for i, (_, words) in enumerate(_MEANING):
                    if token in words or any(w not in _SHORT and token.startswith(w) for w in words):
                        bits |= 1 << i
    return bits


class Nodes:
    """The nodes of one or more pages in document order: parallel lists."""

    def __init__(self) -> None:
        self.page, self.parent, self.kind, self.bits, self.depth = [], [], [], [], []
        self.text: list[str | None] = []
        self.linked, self.label = [], []

    def add(self, page: int, parent: int, kind: str, bits: int, text: str | None = None, linked: int = 0, label: int = 0) -> int:
        """Appends a node and returns its index."""
        self.page.append(page), self.parent.append(parent), self.kind.append(KINDS.index(kind)), self.bits.append(bits)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.text.append(text), self.linked.append(linked), self.label.append(label)
        return len(self.parent) - 1


def parse(source: str, page: int, nodes: Nodes, marked: str | None = None) -> None:
    """Adds a page's block elements and text blocks. Raw elements and comments give nothing; tags that are
    cut off at the end are dropped. Texts that hold ``marked`` are labelled 1, and the mark goes."""
    root = nodes.add(page, -1, "body", 0)
    # Tag, its node (-1: inline) and the node that owns what stands in it; how many of each tag are open.
    stack: list[tuple[str, int, int]] = [("", root, root)]
    opened: dict[str, int] = {}
    pieces: list[str] = []
    linked = anchors = 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                label = 0
                if marked and marked in text:
                    label, text = 1, " ".join(text.replace(marked, " ").split())
                nodes.add(page, stack[-1][2], "#text", 0, text, min(linked, len(text)), label)
            pieces.clear()
            linked = 0

    def close(depth: int) -> None:
        nonlocal anchors
        if any(i >= 0 for _, i, _ in stack[depth:]):
            flush()
        for t, _, _ in stack[depth:]:
            anchors -= t == "a"
            opened[t] -= 1
        del stack[depth:]

    def enter(tag: str, node: int) -> None:
        stack.append((tag, node, node if node >= 0 else stack[-1][2]))
        opened[tag] = opened.get(tag, 0) + 1

    at, size = 0, len(source)
    while at < size:
        m = _TOKEN.search(source, at)
        upto = m.start() if m else size
        if upto > at:
            piece = entities.unescape(source[at:upto])
            pieces.append(piece)
            if anchors:
                linked += len(piece.strip())
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag or (at == size and not m[0].endswith(">")):
            continue
        if m[1] or m[4]:
            for depth in range(len(stack) - 1, 0, -1) if opened.get(tag) else ():
                if stack[depth][0] == tag:
                    close(depth)
                    break
            continue
        tail = m[3] or m[6] or ""
        if tag in RAW:
            if not tail.endswith("/"):
                end = _OPTION_END.search(source, at) if tag == "option" else re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(source, at)
                if end:
                    at = end.end()
                elif tag in TO_THE_END or (next_tag := source.find("<", at)) < 0:
                    at = size
                else:
                    at = next_tag
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in INLINE:
            anchors += tag == "a"
            enter(tag, -1)
            continue
        if tag in ("html", "body", "head"):
            flush()
            continue
        flush()
        if tag in CLOSES_P and opened.get("p"):
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == "p":
                    close(depth)
                    break
                if stack[depth][1] >= 0:
                    break
        if tag in SIBLINGS:
            ends, stops = SIBLINGS[tag]
            found = 0
            for depth in range(len(stack) - 1, 0, -1) if any(opened.get(x) for x in ends) else ():
                if stack[depth][0] in stops:
                    break
                if stack[depth][0] in ends:
                    found = depth
            if found:
                close(found)
        enter(tag, nodes.add(page, stack[-1][2], _KIND.get(tag, "other"), meanings(tail)))
    flush()


_STOPS = re.compile(r"[.!?;:]")


def levels_of(depth: np.ndarray) -> list[np.ndarray]:
    """The indexes of the nodes of each depth."""
    return np.split(np.argsort(depth, kind="stable"), np.cumsum(np.bincount(depth))[:-1]) if len(depth) else []


def describe(nodes: Nodes) -> np.ndarray:
    """Features of all nodes, rows in their order."""
    n = len(nodes.parent)
    parent, kind, depth, bits = (np.array(x, np.int64) for x in (nodes.parent, nodes.kind, nodes.depth, nodes.bits))
    page = np.array(nodes.page)
    leaf = np.array([t is not None for t in nodes.text])
    chars = np.array([len(t) if t else 0 for t in nodes.text], float)
    words = np.array([t.count(" ") + 1 if t else 0 for t in nodes.text], float)
    stops = np.array([len(_STOPS.findall(t)) if t else 0 for t in nodes.text], float)
    linked = np.array(nodes.linked, float)
    long = leaf & (words >= 12)
    is_p = (kind == KINDS.index("p")).astype(float)
    sums = np.stack([chars, words, stops, linked, leaf.astype(float), long.astype(float), is_p, np.ones(n)], axis=1)
    inner = levels_of(depth)
    for at in inner[:0:-1]:
        np.add.at(sums, parent[at], sums[at])
    # Meanings and telling tags of all ancestors, the node itself left out.
    tell = np.zeros((n, len(MEANINGS)), bool)
    for i in range(len(MEANINGS)):
        tell[:, i] = (bits >> i) & 1
    tags = np.stack([kind == KINDS.index(k) for k in ("article", "main", "nav", "header", "footer", "aside", "form", "list", "table")], axis=1)
    above = np.zeros((n, tell.shape[1] + tags.shape[1]), bool)
    own = np.concatenate([tell, tags], axis=1)
    for at in inner[1:]:
        above[at] = above[parent[at]] | own[parent[at]]
    p = np.maximum(parent, 0)
    root = parent < 0
    first = np.flatnonzero(np.r_[True, page[1:] != page[:-1]]) if n else np.zeros(0, int)
    home = first[np.cumsum(np.r_[True, page[1:] != page[:-1]]) - 1] if n else np.zeros(0, int)
    before = np.cumsum(chars) - chars
    n_children = np.bincount(parent[~root], minlength=n).astype(float)
    same = np.zeros(n)
    pair = p * len(KINDS) + kind
    _, back, counts = np.unique(np.where(root, -1, pair), return_inverse=True, return_counts=True)
    same = counts[back].astype(float)
    total = sums[home]
    share = lambda a, b: a / np.maximum(b, 1)
    up = sums[p]
    # How much of the page stands in the nearest form, and in the nearest element whose attributes tell of boilerplate.
    part = share(sums[:, 0], total[:, 0])
    in_form, in_told = np.where(kind == KINDS.index("form"), part, 1.0), np.where((bits & ~1) > 0, part, 1.0)
    for at in inner[1:]:
        in_form[at] = np.where(kind[at] == KINDS.index("form"), part[at], in_form[parent[at]])
        in_told[at] = np.where((bits[at] & ~1) > 0, part[at], in_told[parent[at]])
    columns = [
        in_form, in_told, *[kind == i for i in range(len(KINDS))], *[kind[p] == i for i in range(len(KINDS))], *tell.T, *tell[p].T, *above.T,
        depth, np.log1p(sums[:, 0]), np.log1p(sums[:, 1]), share(sums[:, 3], sums[:, 0]), share(sums[:, 2], sums[:, 1]), share(sums[:, 1], sums[:, 4]), share(sums[:, 5], sums[:, 4]),
        share(sums[:, 0], sums[:, 7]), np.log1p(sums[:, 6]), np.log1p(sums[:, 7]), share(sums[:, 0], total[:, 0]), share(sums[:, 5], total[:, 5]), share(sums[:, 6], total[:, 6]),
        share(before - before[home], total[:, 0]), n_children[p], same, share(same, n_children[p]), share(sums[:, 0], up[:, 0]), share(up[:, 3], up[:, 0]), share(up[:, 5], up[:, 4]), np.log1p(up[:, 1]), share(up[:, 1], up[:, 4]),
    ]
    return np.stack([np.asarray(c, float) for c in columns], axis=1).astype(np.float32) if n else np.zeros((0, len(columns)), np.float32)


def decode(nodes: Nodes, margin: np.ndarray) -> np.ndarray:
    """Whether each node is kept: the consistent choice with the largest sum of weighted log-odds.

    A kept node's ancestors are kept; so a node gains its own log-odds and its children's gains where
    they are positive, and is dropped with its whole subtree where that isn't.
    """
    parent, depth = np.array(nodes.parent, np.int64), np.array(nodes.depth, np.int64)
    words = np.array([t.count(" ") + 1 if t else 0 for t in nodes.text], float)
    gain = np.clip(margin, -8, 8) * (1 + np.log1p(words))
    levels = levels_of(depth)
    for at in levels[:0:-1]:
        np.add.at(gain, parent[at], np.maximum(gain[at], 0))
    kept = gain > 0
    for at in levels[1:]:
        kept[at] &= kept[parent[at]]
    return kept


# ---- generated training pages ----
_MARK = "\ue000"


def _sentence(r: random.Random, low: int, high: int) -> str:
    words = ["".join(r.choice("aeioubcdfglmnprstv") for _ in range(r.randint(1, 9))) for _ in range(r.randint(low, high))]
    junk = r.random()
    if junk < 0.08:
        words = [w + r.choice(("###", "%%%", "&amp;&amp;", "***", " |")) for w in words]
    elif junk < 0.12:
        words = [w.upper() + "!!" for w in words]
    return " ".join(words).capitalize() + r.choice((".", ".", "!", "?", ""))


def _attribute(r: random.Random, *meaning: str) -> str:
    if r.random() < 0.35 or not meaning:
        return ""
    word = r.choice(MEANINGS[r.choice(meaning)].split())
    word = r.choice((word, word, f"{word}-{r.choice(('box', 'wrap', 'inner', 'list', 'area', 'block'))}", f"{r.choice(('site', 'page', 'js', 'c'))}-{word}", f"{word}{r.randint(1, 9)}"))
    return f' {r.choice(("class", "class", "id"))}="{word}"'


def _links(r: random.Random, n: int) -> str:
    bare = r.random() < 0.05
    items = [_sentence(r, 1, 3) if bare else f'<a href="/{i}">{_sentence(r, 1, 3)}</a>' for i in range(n)]
    how = r.random()
    return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if how < 0.6 else r.choice((" ", " | ", "")).join(items)


def _boilerplate(r: random.Random) -> str:
    if r.random() < 0.1:
        tag = r.choice(("header", "footer", "aside", "nav"))
        return f"<{tag}>{_sentence(r, 1, 8)}</{tag}>"
    kind = r.choice(("nav", "header", "footer", "aside", "ad", "notice", "talk", "form", "share", "links"))
    if kind == "nav":  # named by tag or class
        tag = r.choice(("nav", "div", "ul"))
        return f"<{tag}{_attribute(r, 'menu')}>{_links(r, r.randint(1, 12))}</{tag}>"
    if kind == "header":
        tag = r.choice(("header", "div"))
        return f"<{tag}{_attribute(r, 'head') if tag == 'header' else ' id=masthead'}><{(t := r.choice(('h1', 'p', 'div')))}>{_sentence(r, 1, 4)}</{t}><p>{_sentence(r, 2, 10)}</p>{_links(r, r.randint(0, 6))}</{tag}>"
    if kind == "footer":
        tag = r.choice(("footer", "footer", "div"))
        return f"<{tag}{_attribute(r, 'foot') if tag == 'footer' else ' class=footer'}>{r.choice(('&copy; ', 'Copyright '))}{_sentence(r, 1, 4)} &middot; {' '.join(_sentence(r, 3, 25) for _ in range(r.randint(1, 3)))}{_links(r, r.choice((0, 0, 0, 2, 8))) }</{tag}>"
    if kind == "aside":
        tag = r.choice(("aside", "aside", "div", "section"))
        extra = "".join(f"<p>{_sentence(r, 5, 40)}</p>" for _ in range(r.randint(0, 3)))
        return f"<{tag}{_attribute(r, 'side') if tag == 'aside' else ' class=sidebar'}><h3>{_sentence(r, 1, 4)}</h3>{extra}{_links(r, r.randint(0, 8))}</{tag}>"
    if kind in ("ad", "notice"):
        word = r.choice(MEANINGS[kind].split())
        body = "".join(f"<p>{_sentence(r, 3, 30)}</p>" for _ in range(r.randint(1, 3))) if r.random() < 0.5 else _sentence(r, 3, 40)
        return f'<{(t := r.choice(("div", "div", "section", "aside", "p")))} {r.choice(("class", "id"))}="{word}">{body}</{t}>'
    if kind == "talk":
        inner = r.choice(("div", "li", "article", "p", "section"))
        each = "".join(f"<{inner}{_attribute(r, 'talk')}>{r.choice(('', '<b>' + _sentence(r, 1, 2) + '</b> '))}<p>{_sentence(r, 3, 60)}</p></{inner}>" for _ in range(r.randint(1, 8)))
        return f'<{(t := r.choice(("div", "section", "ol", "aside")))} {r.choice(("class", "id"))}="{r.choice(MEANINGS["talk"].split())}">{r.choice(("", "<h2>" + _sentence(r, 1, 3) + "</h2>"))}{each}</{t}>'
    if kind == "form":
        return f"<form{_attribute(r, 'form')}><label>{_sentence(r, 1, 5)}</label><input name=q><p>{_sentence(r, 2, 20)}</p><button>{_sentence(r, 1, 2)}</button></form>"
    if kind == "share":
        return f'<div class="{r.choice(MEANINGS["share"].split())}">{_sentence(r, 1, 4)} {_links(r, r.randint(1, 5))}</div>'
    return f'<div{_attribute(r, "side", "menu")}>{_links(r, r.randint(3, 10))}</div>'


def _article(r: random.Random) -> str:
    out = [f"<{(t := r.choice(('h1', 'h1', 'h2')))}>{_MARK}{_sentence(r, 2, 12)}</{t}>"] if r.random() < 0.85 else []
    if out and (how := r.random()) < 0.35:
        named = f' class="{r.choice(("entry", "post", "article", "page", "story"))}-{r.choice(("header", "head", "title"))}"' if how < 0.2 else ""
        meta = f'<{(t := r.choice(("div", "p")))} class="{r.choice(("meta", "byline", "entry-meta", "post-author"))}">{_sentence(r, 1, 4)} <a href=/x>{_sentence(r, 1, 3)}</a></{t}>' if how < 0.1 else ""
        out[0] = f"<header{named}>{out[0]}{meta}</header>"
    for _ in range(r.choice((0, 1, 1, 1, 2, 2, 3, 5, 8, 13, 20))):
        how = r.random()
        body = lambda low, high: " ".join(_sentence(r, low, high) for _ in range(r.choice((1, 1, 2, 4, 8))))
        if how < 0.7:
            text = _MARK + (_sentence(r, 1, 4) if r.random() < 0.15 else body(3, 30))
            if r.random() < 0.2:
                text = f"<b>{text}<br>" if r.random() < 0.5 else f"{text} <a href=/x>{_sentence(r, 1, 4)}</a> {_sentence(r, 2, 9)}"
            out.append(f"<p>{text}" + ("</p>" if r.random() < 0.9 else ""))
        elif how < 0.78:
            out.append(f"<h{(k := r.randint(2, 4))}>{_MARK}{_sentence(r, 1, 8)}</h{k}>")
        elif how < 0.86:
            out.append(_items(r))
        elif how < 0.9:
            out.append("<table>" + "".join("<tr>" + "".join(f"<td>{_MARK}{_sentence(r, 1, 6)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(1, 4))) + "</table>")
        elif how < 0.93:
            out.append(f"<{(t := r.choice(('blockquote', 'pre', 'figcaption', 'div')))}>{_MARK}{body(3, 25)}</{t}>")
        elif r.random() < 0.5:
            out.append(_boilerplate(r))
        else:  # a form of the article's page that says nothing of itself
            out.append(f"<form{_attribute(r, 'form')}><p>{_sentence(r, 2, 20)}</p></form>")
    return "".join(out)


def _items(r: random.Random) -> str:
    """A list of an article: of sentences, or of a few words each, as in a recipe."""
    tag, short = r.choice(("ul", "ol")), r.random() < 0.5
    item = lambda: _sentence(r, 1, 4) if short else " ".join(_sentence(r, 2, 15) for _ in range(r.choice((1, 1, 2, 4, 8))))
    return f"<{tag}>" + "".join(f"<li>{_MARK}{item()}</li>" for _ in range(r.randint(2, 8))) + f"</{tag}>"


def _wrapped(r: random.Random, body: str) -> str:
    """The page or its article in a form, as some sites have it, or in an element that says nothing."""
    if r.random() < 0.4:
        return f'<form{_attribute(r, "form", "good")} method="post"><input type=hidden name=a>{body}</form>'
    return f'<div {r.choice(("class", "id"))}="{r.choice(("layout", "wrap", "outer", "grid", "row", "container"))}">{body}</div>'


def _page(r: random.Random) -> str:
    if (bare := r.random()) < 0.1:
        return _article(r) or f"<p>{_MARK}{_sentence(r, 3, 20)}" if bare < 0.06 else _MARK + " ".join(_sentence(r, 2, 20) for _ in range(3))
    tag = r.choice(("article", "article", "main", "section", "div", "div"))
    named = _attribute(r, "good") if tag in ("article", "main") else f' class="{r.choice(MEANINGS["good"].split())}"' if r.random() < 0.8 else ""
    main = f"<{tag}{named}>{_article(r)}</{tag}>"
    for _ in range(r.choice((0, 0, 1, 2))):
        outer = r.choice(("div", "main", "section"))
        main = f"<{outer}{_attribute(r, 'good')}>{_boilerplate(r) if r.random() < 0.4 else ''}{main}{_boilerplate(r) if r.random() < 0.4 else ''}</{outer}>"
    if r.random() < 0.08:  # nothing but a title and lists
        main = f"<{tag}{named}><h1>{_MARK}{_sentence(r, 1, 6)}</h1>{''.join(_items(r) for _ in range(r.randint(1, 3)))}</{tag}>"
    if r.random() < 0.12:
        main = _wrapped(r, main)
    before, after = ("".join(_boilerplate(r) for _ in range(r.randint(0, 4))) for _ in range(2))
    body = f"{before}{main}{after}"
    return f"<html><head><title>x</title></head><body>{_wrapped(r, body) if r.random() < 0.12 else body}</body></html>"


@functools.lru_cache(4)
def trained(pages: int = TRAIN_PAGES, seed: int = SEED) -> boosting.Forest:
    """The forest, fitted to generated pages; an element is labelled 1 if article text lies below it."""
    r, nodes = random.Random(seed), Nodes()
    for i in range(pages):
        parse(_page(r), i, nodes, _MARK)
    label = np.array(nodes.label)
    for i in range(len(label) - 1, 0, -1):
        if label[i] and nodes.parent[i] >= 0:
            label[nodes.parent[i]] = 1
    return boosting.fit(describe(nodes), label.astype(float))


def main_texts(pages: list[str | None], forest: boosting.Forest) -> list[str]:
    """The main text of each page."""
    out = [""] * len(pages)
    for at in range(0, len(pages), 200):
        nodes = Nodes()
        for i, source in enumerate(pages[at : at + 200]):
            if source:
                parse(source, at + i, nodes)
        if not nodes.parent:
            continue
        kept = decode(nodes, forest.margin(describe(nodes)))
        found: dict[int, list[str]] = {}
        for i in np.flatnonzero(kept):
            if nodes.text[i] is not None:
                found.setdefault(nodes.page[i], []).append(nodes.text[i])
        for i, blocks in found.items():
            out[i] = "\n".join(blocks)
    return out


def extract_text(pages: DataFrame, html_col: str = "html", out: str = "main_text") -> DataFrame:
    """``pages`` with the main text in column ``out``; an input column of that name is replaced.

    A null or empty page gives ''. Blocks are joined by a line break in page order, white space inside a
    block becomes one blank, and character references are decoded. Repeated rows are kept. An empty
    table gives no rows.
    """
    forest = trained()

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(main_texts([x if isinstance(x, str) else None for x in batch], forest), dtype=object)

    return with_output(small_batches(pages), out, texts(pages[html_col]))
