"""Main text of web pages: gradient-boosted trees over DOM nodes with hierarchical decoding.

A page is parsed into a tree.  Every element gets features of its own (tag, class and id tokens), of its subtree (text and link density, paragraphs,
commas, controls), of its depth and of its siblings.  Boosted trees give each element the log odds of belonging to the main text.
Decoding then finds the best assignment of the whole tree in which states on any path only go forward: outside, main, removed.

Trees are trained here: on pages of the corpus, whose structural tags (article, nav, footer, ...) serve as labels, and on page
layouts generated with class names instead of those tags, so that pages without structural tags are covered.
"""

from __future__ import annotations

import html
import math
import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogops.llm.common import map_texts, sigmoid

# Fixed values of the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style template head title iframe select textarea button".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split())
CLOSES_P = BLOCKS - frozenset("body caption dd dt html legend li summary tbody td tfoot th thead tr".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}

#: Attribute tokens by meaning.
TOKEN_GROUPS = {
    "content": "article content post entry story text main body prose maintext post-content entry-content articlebody",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs tabs toc pagination pager skip topnav mainnav",
    "header": "header banner masthead topbar branding logo hero",
    "footer": "footer copyright legal bottom colophon imprint",
    "side": "sidebar side aside related widget recommended recommendations trending popular rail more read",
    "notice": "cookie cookies consent gdpr notice popup modal overlay alert toast notification privacy",
    "advert": "ad ads advert advertisement sponsor sponsored promo promotion banner-ad adsbygoogle affiliate",
    "comment": "comment comments reply replies respond disqus discussion commentlist reader responses",
    "form": "form subscribe newsletter signup search login share social sharing follow",
}
_GROUP_OF = {t: i for i, ts in enumerate(TOKEN_GROUPS.values()) for t in ts.split()}
TAG_FEATURES = ("article", "main", "section", "div", "p", "h1", "h2", "ul", "li", "a", "table", "nav", "header", "footer", "aside", "form", "blockquote", "pre", "figure", "span")
_TAG_AT = {t: i for i, t in enumerate(TAG_FEATURES)}
N_FEATURES = len(TAG_FEATURES) + 2 * len(TOKEN_GROUPS) + 17

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_TO_VALUE = re.compile(r"[^>=]*(=\s*)?")
_BARE = re.compile(r"[^\s>]*")
_ATTRIBUTE = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NAMED = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?|\"[^\"]*\"|'[^']*'")
_NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    depth: int
    groups: frozenset = frozenset()
    hidden: bool = False
    attributes: str = ""
    parts: list = field(default_factory=list)  # texts (str) and children (int) in order
    chars: int = 0  # of its own text


def _is_hidden(attributes: str) -> bool:
    """Hidden by an attribute of that name, by its style or for readers; words inside other values do not count."""
    for name, *values in _NAMED.findall(attributes):
        name, value = name.lower(), "".join(values).strip()
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _NO_DISPLAY.search(value):
            return True
    return False


class Markup:
    """Reads the tags of a page; every character is looked at a bounded number of times, however broken the page is."""

    def __init__(self, page: str):
        self.page = page
        self.last = {c: page.rfind(c) for c in "\"'>"}
        self.quotes = True  # until a tag was found that only ends inside a quoted value

    def tag_end(self, at: int) -> int:
        """Position of the > that ends the tag whose attributes start at `at`; a quote that is never closed is an ordinary character."""
        k = at
        while self.quotes:
            m = _TO_VALUE.match(self.page, k)
            k = m.end()
            if not m[1]:
                if k < len(self.page):
                    return k
                self.quotes = False
                break
            quote = self.page[k:k + 1]
            if quote in ("'", '"') and k < self.last[quote]:
                k = self.page.index(quote, k + 1) + 1
            else:
                k = _BARE.match(self.page, k).end()
        return self.page.index(">", at)

    def skip(self, at: int) -> int | None:
        """End of the comment, declaration or instruction at `at`; None where there is none."""
        for start, close in (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<!", ">"), ("<?", ">")):
            if self.page.startswith(start, at):
                end = self.page.find(close, at + len(start))
                return len(self.page) if end < 0 else end + len(close)
        return None


class Open:
    """The open elements, with the places of each tag name, so that no search walks down the stack."""

    def __init__(self, nodes: list[Node]):
        self.nodes, self.stack, self.places = nodes, [0], {}

    def push(self, i: int) -> None:
        self.places.setdefault(self.nodes[i].tag, []).append(len(self.stack))
        self.stack.append(i)

    def innermost(self, tags) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def close(self, tags, scope=()) -> None:
        """Closes the innermost element of `tags`, and all within it, unless one of `scope` stands between."""
        k = self.innermost(tags)
        if k > self.innermost(scope):
            for i in self.stack[k:]:
                self.places[self.nodes[i].tag].pop()
            del self.stack[k:]


def parse(page: str) -> list[Node]:
    """Elements in document order; element 0 is the page.  Unclosed and stray tags are repaired as browsers do for common cases.

    The time grows with the length of the page alone.  A tag without an end is text; an unclosed comment reaches to the end of the page.
    """
    nodes = [Node("#page", -1, 0)]
    inside, markup = Open(nodes), Markup(page)
    at, end = 0, len(page)
    text = 0  # where the text that is being read began

    def say(upto: int) -> None:
        if upto > text:
            nodes[inside.stack[-1]].parts.append(page[text:upto])

    while (at := page.find("<", at)) >= 0:
        skipped = markup.skip(at)
        if skipped is not None:
            say(at)
            text = at = skipped
            continue
        closing = page.startswith("/", at + 1)
        m = _NAME.match(page, at + 1 + closing)
        if not m or m.end() > markup.last[">"]:
            at += 1
            continue
        say(at)
        stop = markup.tag_end(m.end())
        name, attributes = m[0].lower(), page[m.end():stop]
        text = at = stop + 1
        if closing:
            inside.close((name,))
            continue
        if name in CLOSES_P:
            inside.close({"p"}, {"button", "table", "td", "th", "li", "div", "article", "section"})
        if name in ENDS:
            inside.close(ENDS[name], SCOPES[name])
        groups, hidden = frozenset(), False
        if attributes:
            tokens = [t for a in _ATTRIBUTE.findall(attributes) for v in a if v for w in v.lower().split() for t in (w, *_SPLIT.split(w))]
            groups = frozenset(_GROUP_OF[t] for t in tokens if t in _GROUP_OF)
            hidden = _is_hidden(attributes)
        parent = inside.stack[-1]
        nodes.append(Node(name, parent, len(inside.stack), groups, hidden, attributes))
        nodes[parent].parts.append(len(nodes) - 1)
        if name in RAW and not attributes.endswith("/"):
            close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            nodes[-1].parts.append(page[at:close.start() if close else end])
            text = at = close.end() if close else end
        elif name not in VOID and not attributes.endswith("/"):
            inside.push(len(nodes) - 1)
    say(end)
    return nodes


def features(nodes: list[Node]) -> np.ndarray:
    n = len(nodes)
    base, k = len(TAG_FEATURES), len(TOKEN_GROUPS)
    out = np.zeros((n, N_FEATURES), np.float32)
    # characters, link characters, commas and stops, paragraphs, controls, list items, elements of the subtree
    sub = [[0.0] * 7 for _ in range(n)]
    own, place, siblings = [0.0] * n, [0] * n, [1] * n
    for i in range(n - 1, -1, -1):
        x, s = nodes[i], sub[i]
        tag, children = x.tag, 0
        if tag in _TAG_AT:
            out[i, _TAG_AT[tag]] = 1
        for g in x.groups:
            out[i, base + g] = 1
        silent = tag in SILENT
        for p in x.parts:
            if isinstance(p, str):
                if not silent:
                    x.chars += len(p) - p.count(" ") - p.count("\n")
                    s[2] += p.count(",") + p.count(".")
            else:
                place[p] = children
                children += 1
        for p in x.parts:
            if not isinstance(p, str):
                siblings[p] = children
        own[i] = x.chars
        if not silent:
            s[0] += x.chars
            s[3] += tag == "p"
            s[4] += tag in ("input", "button", "select", "textarea", "form")
            s[5] += tag == "li"
            s[6] += 1
            if tag == "a":
                s[1] = s[0]
            if i:
                up = sub[x.parent]
                for j in range(7):
                    up[j] += s[j]
    apart = [False] * n
    for i in range(1, n):
        apart[i] = nodes[i].tag in ("aside", "nav", "footer") or apart[nodes[i].parent]
        if out[nodes[i].parent, base:base + 2 * k].any():
            above = out[nodes[i].parent]
            out[i, base + k:base + 2 * k] = np.maximum(above[base:base + k], above[base + k:base + 2 * k])
    parent = np.array([max(0, x.parent) for x in nodes])
    depth = np.array([x.depth for x in nodes])
    sub, own, place, siblings = np.array(sub), np.array(own), np.array(place), np.array(siblings)
    rest, chars = out[:, base + 2 * k:], sub[:, 0]
    some = np.maximum(chars, 1)
    rest[:, 0] = np.log1p(chars)
    rest[:, 1] = chars / max(1.0, chars[0])
    rest[:, 2] = sub[:, 1] / some
    rest[:, 3] = sub[:, 2] / some * 100
    rest[:, 4] = np.log1p(sub[:, 3])
    rest[:, 5] = sub[:, 4]
    rest[:, 6] = np.log1p(sub[:, 5])
    rest[:, 7] = np.log1p(chars / np.maximum(sub[:, 6], 1))
    rest[:, 8] = depth
    rest[:, 9] = place / np.maximum(siblings - 1, 1)
    rest[:, 10] = np.log1p(siblings)
    rest[:, 11] = chars / some[parent]
    rest[:, 12] = np.log1p(own)
    rest[:, 13] = np.arange(n) / n
    rest[:, 14] = sub[parent, 1] / some[parent]
    rest[:, 15] = [x.hidden for x in nodes]
    rest[:, 16] = apart
    return out


@dataclass
class Boosted:
    """Trees of equal depth as arrays: at each inner node a feature and a threshold, at each leaf a value."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    start: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start, np.float32)
        inner, rows = self.feature.shape[1], np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            at = np.zeros(len(x), int)
            while at.size and at[0] < inner:
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += v[at - inner]
        return out


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.3, bins: int = 32, ridge: float = 2.0) -> Boosted:
    """Second-order boosting of the logistic loss; splits are searched over quantile bins."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    edges = [e[e < c.max()] if len(e) else e for e, c in zip(edges, x.T, strict=True)]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], 1)
    n_features, inner = x.shape[1], 2**depth - 1
    mean = np.clip((weight * y).sum() / weight.sum(), 0.01, 0.99)
    start = float(np.log(mean / (1 - mean)))
    score, trees = np.full(len(y), start), []
    for _ in range(rounds):
        p = sigmoid(score)
        g, h = weight * (p - y), weight * p * (1 - p)
        feature, threshold, value = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(inner + 1)
        at = np.zeros(len(y), int)
        for k in range(inner):
            rows = np.flatnonzero(at == k)
            best = (1e-6, 0, np.inf, 0)
            if len(rows) > 20:
                gs, hs = g[rows], h[rows]
                gt, ht = gs.sum(), hs.sum()
                for j in range(n_features):
                    if not len(edges[j]):
                        continue
                    b = binned[rows, j]
                    gl = np.cumsum(np.bincount(b, gs, bins))[:len(edges[j])]
                    hl = np.cumsum(np.bincount(b, hs, bins))[:len(edges[j])]
                    gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                    m = int(gain.argmax())
                    if gain[m] > best[0]:
                        best = (gain[m], j, edges[j][m], m)
            feature[k], threshold[k] = best[1], best[2]
            at[rows] = 2 * k + 1 + (x[rows, best[1]] > best[2])
        for leaf in range(inner + 1):
            rows = at - inner == leaf
            value[leaf] = -rate * g[rows].sum() / (h[rows].sum() + ridge)
        score += value[at - inner]
        trees.append((feature, threshold, value))
    f, t, v = (np.array(c) for c in zip(*trees, strict=True))
    return Boosted(f, t.astype(np.float32), v.astype(np.float32), start)


ENTER, LEAVE = 6.0, 6.0  # evidence that a change of state must outweigh
OUTSIDE, MAIN, REMOVED = 0, 1, 2


def decode(nodes: list[Node], log_odds: np.ndarray) -> list[int]:
    """State of every element: outside, main or removed (inside main), the best assignment of the whole tree.

    On the way from the page to a leaf states only move forward: outside, main, removed.  So nothing is kept below something that was
    removed from the main text, and main text is entered once; the best assignment is found exactly, bottom up.
    """
    n = len(nodes)
    best = [[0.0, 0.0, 0.0] for _ in range(n)]
    for i, (x, odds) in reversed(list(enumerate(zip(nodes, log_odds.tolist(), strict=True)))):
        vote = min(6.0, max(-6.0, odds)) * (1 + math.log1p(x.chars)) / 2
        if x.tag in SILENT:
            vote = -1e9
        b = best[i]
        b[0] -= vote
        b[1] += vote
        b[2] -= vote
        if i:
            o, m, r = b
            up = best[x.parent]
            up[0] += o if o >= m - ENTER else m - ENTER
            up[1] += m if m >= r - LEAVE else r - LEAVE
            up[2] += r
    state = [OUTSIDE] * n
    for i in range(1, n):
        o, m, r = best[i]
        above = state[nodes[i].parent]
        state[i] = REMOVED if above == REMOVED else (MAIN if m >= r - LEAVE else REMOVED) if above == MAIN else (MAIN if m - ENTER > o else OUTSIDE)
    return state


def main_text(nodes: list[Node], state: list[int]) -> str:
    """Texts of the main elements, one line per block; white space and line breaks inside a block are one blank."""
    blocks, line = [], []

    def flush():
        if line:
            text = " ".join(html.unescape("".join(line)).split())
            if text:
                blocks.append(text)
            line.clear()

    todo = [(0, 0)]
    while todo:
        i, k = todo.pop()
        x = nodes[i]
        if not k:
            if x.tag in BLOCKS:
                flush()
            elif x.tag == "br":
                line.append(" ")
            if x.tag in SILENT:
                continue
        while k < len(x.parts):
            p = x.parts[k]
            k += 1
            if isinstance(p, str):
                if state[i] == MAIN:
                    line.append(p)
            else:
                todo += [(i, k), (p, 0)]
                break
        else:
            if x.tag in BLOCKS:
                flush()
    flush()
    return "\n".join(blocks)


#: Elements that hold main text or never do; they label the corpus pages that have them.
LABEL_TAGS = {"article": 1, "main": 1} | dict.fromkeys("nav header footer aside form script style head title dialog menu".split(), 0)


def label(nodes: list[Node]) -> np.ndarray:
    """1 inside the main text.  A generated page says so in data-keep; elsewhere structural tags do."""
    y = np.zeros(len(nodes))
    for i, x in enumerate(nodes[1:], 1):
        mark = re.search(r'data-keep="([01])"', x.attributes)
        groups = {list(TOKEN_GROUPS)[g] for g in x.groups}
        if mark:
            y[i] = int(mark[1])
        elif x.tag in LABEL_TAGS and not (x.tag == "header" and y[x.parent]):
            y[i] = LABEL_TAGS[x.tag] if LABEL_TAGS[x.tag] == 0 or not groups & {"comment", "advert", "side"} else 0
        elif groups & {"advert", "comment", "notice", "side"} and not groups & {"content"}:
            y[i] = 0
        else:
            y[i] = y[x.parent]
    return y


def generated_pages(n: int, seed: int = 11) -> list[str]:
    """Page layouts of many kinds around made-up words; data-keep marks what is main text."""
    rng = np.random.default_rng(seed)
    syllables = "ta ri no mel ku sen do vara li po ge thu ".split()

    def words(k):
        return " ".join("".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(max(1, k)))

    def sentence(lo, hi):
        return ", ".join(words(int(rng.integers(3, 9))) for _ in range(int(rng.integers(lo, hi)))).capitalize() + "."

    def pick(*options):
        return options[rng.integers(len(options))]

    def paragraphs(k, tag="p"):
        return "".join(f"<{tag}>{sentence(1, 8)}</{tag}>" for _ in range(k))

    def links(k):
        return "".join(f'<li><a href="/{words(1)}">{words(int(rng.integers(1, 4)))}</a></li>' for _ in range(k))

    def bare(tag, names):
        attribute = pick(f' class="{pick(*names)}"', f' id="{pick(*names)}"', f' class="{pick(*names)} {words(1)}"')
        return pick(tag, "div", "div"), attribute

    def block(tag, names, inside, keep=0):
        t, a = bare(tag, names)
        return f'<{t}{a if keep or t not in LABEL_TAGS or rng.random() < 0.5 else ""} data-keep="{keep}">{inside}</{t}>'

    def junk():
        kind = rng.integers(9)
        if kind == 0:
            return block("nav", ["nav", "menu", "navbar", "breadcrumb"], f"<ul>{links(int(rng.integers(3, 12)))}</ul>")
        if kind == 1:
            return block("header", ["header", "masthead", "banner", "topbar"], f"<a href='/'>{words(2)}</a><span>{words(4)}</span>" + pick("", f"<p>{words(6)}</p>"))
        if kind == 2:
            return block("aside", ["sidebar", "side", "widget", "related"], f"<h3>{words(2)}</h3>" + pick(f"<ul>{links(5)}</ul>", paragraphs(2), paragraphs(1) + f"<ul>{links(4)}</ul>"))
        if kind == 3:
            return block("div", ["cookie-notice", "cookie", "consent", "notice", "popup", "gdpr"], pick(f"<p>{sentence(1, 4)}</p><button>{words(1)}</button>", sentence(1, 4)))
        if kind == 4:
            return block("div", ["ad", "ads", "advert", "sponsored", "promo", "advertisement"], pick(sentence(1, 4), paragraphs(1), f"<a href='/x'>{words(5)}</a>"))
        if kind == 5:
            one = lambda: f'<{pick("div", "li")} class="{pick("comment", "reply", "response")}"><b>{words(1)}</b>{paragraphs(int(rng.integers(1, 3)))}</div>'
            return block("section", ["comments", "comment-list", "discussion", "responses", "disqus"], pick("", f"<h2>{words(2)}</h2>") + "".join(one() for _ in range(int(rng.integers(1, 6)))))
        if kind == 6:
            return block("form", ["subscribe", "newsletter", "search", "login", "form"], f"<label>{words(3)}</label><input><button>{words(1)}</button>" + pick("", f"<p>{sentence(1, 3)}</p>"))
        if kind == 7:
            return block("div", ["share", "social", "related", "recommended", "more"], f"<h4>{words(2)}</h4><ul>{links(int(rng.integers(2, 7)))}</ul>")
        return block("footer", ["footer", "bottom", "copyright", "legal"], pick(f"&copy; {words(3)}", f"<p>&copy; {sentence(1, 4)}</p>", f"<ul>{links(5)}</ul><p>{words(8)}</p>"))

    def plain():
        """Sidebars, forms, menus and footers by their tag alone."""
        inside = {"aside": pick(words(4), sentence(1, 4), paragraphs(1), f"<h3>{words(2)}</h3>{paragraphs(1)}", f"<ul>{links(3)}</ul>"),
                  "form": pick("", f"<p>{sentence(1, 3)}</p>") + pick(f"<label>{words(2)}</label><input>", f"<label>{words(1)} <input></label>", f"{words(3)} <input>") + f"<button>{words(1)}</button>",
                  "nav": pick(f"<ul>{links(4)}</ul>", f"<a href='/'>{words(1)}</a> <a href='/x'>{words(2)}</a>"), "footer": pick(words(4), f"<p>{sentence(1, 3)}</p>")}
        tag = pick(*inside)
        return f'<{tag} data-keep="0">{inside[tag]}</{tag}>'

    def unseen():
        how = pick("hidden", 'style="display:none"', 'aria-hidden="true"')
        return pick(f"<div {how}>{paragraphs(int(rng.integers(1, 3)))}</div>", f"<p {how}>{sentence(1, 4)}</p>", f"<section {how}><h3>{words(2)}</h3>{paragraphs(1)}</section>")

    pages = []
    for _ in range(n):
        body = []
        for _ in range(int(rng.integers(1, 12))):
            body.append(pick(*[lambda: paragraphs(int(rng.integers(1, 4)))] * 4, lambda: f"<h2>{words(3)}</h2>{paragraphs(1)}", lambda: f"<ul>{''.join(f'<li>{sentence(1, 3)}</li>' for _ in range(3))}</ul>",
                             lambda: f"<blockquote>{pick(sentence(1, 4), paragraphs(1))}</blockquote>", lambda: f"<div>{sentence(2, 8)}</div>", lambda: f"<p><b>{sentence(1, 4)}<br>",
                             lambda: f"<table><tr><td>{words(3)}</td><td>{words(2)}</td></tr></table>", lambda: f"<pre>{words(9)}</pre>", lambda: junk() if rng.random() < 0.4 else "", lambda: plain() if rng.random() < 0.7 else "",
                             lambda: unseen() if rng.random() < 0.3 else f"<p>{sentence(1, 3)} <math><mi>{words(1)}</mi></math> {words(3)}.</p>")())
        inside = pick("", f"<h1>{words(5)}</h1>", f"<h1>{words(5)}</h1>", f"<header data-keep='1'><h1>{words(5)}</h1></header>") + "".join(body)
        main = block(pick("article", "main", "section"), ["content", "post", "entry-content", "article", "story", "main", words(1)], inside, 1)
        if rng.random() < 0.3:
            main = f'<div class="{pick("wrapper", "page", "container", "content")}">{"".join(junk() for _ in range(int(rng.integers(0, 2))))}{main}{"".join(junk() for _ in range(int(rng.integers(0, 3))))}</div>'
        before, after = "".join(junk() for _ in range(int(rng.integers(0, 4)))), "".join(junk() for _ in range(int(rng.integers(0, 5))))
        pages.append(f"<html><head><title>{words(4)}</title><style>p{{}}</style></head><body>{before}{main}{after}</body></html>")
    return pages


#: Columns that name structural tags; they are hidden in a second copy of every corpus page.
_STRUCTURE = [_TAG_AT[t] for t in ("article", "main", "nav", "header", "footer", "aside", "form")]
_APART = N_FEATURES - 1  # inside an aside, a nav or a footer


def train(pages: list[str], generated: int = 500, per_page: int = 5000) -> Boosted:
    """Trees fitted on these pages and on generated ones; of a page with more than `per_page` elements, so many at even steps."""
    xs, ys = [], []
    for text in [*pages, *generated_pages(generated)]:
        nodes = parse(text)
        x, y = features(nodes), label(nodes)
        used = [i for i, v in enumerate(nodes) if i and v.tag not in SILENT and v.tag not in ("html", "body")]
        used = used[::-(-len(used) // per_page) or 1]
        xs.append(x[used])
        ys.append(y[used])
    for x, y in zip(xs[:len(pages)], ys[:len(pages)], strict=True):
        plain = x.copy()
        plain[:, _TAG_AT["div"]] = np.maximum(plain[:, _TAG_AT["div"]], plain[:, _STRUCTURE].max(1, initial=0))
        plain[:, [*_STRUCTURE, _APART]] = 0
        xs.append(plain)
        ys.append(y)
    weight = np.concatenate([np.full(len(y), 1 / max(1, len(y)) ** 0.5) for y in ys])
    return boost(np.concatenate(xs), np.concatenate(ys), weight / weight.mean())


def main_texts(pages: DataFrame, sample: int = 120) -> DataFrame:
    """Every row of `pages(page_id, url, html, ...)` with `text` and `n_chars` in place of `html`; other columns stay, clashing ones give way.

    Null or empty html and pages without main text give an empty text.  At most `sample` different pages, chosen by a hash of id and html, and
    generated layouts train the trees; all pages are extracted from their whole html.
    """
    known = pages.filter("html is not null").select("page_id", "html", F.xxhash64("page_id", "html").alias("place"))
    places = [r.place for r in known.select("place").distinct().orderBy("place").limit(sample).collect()]
    rows = known.filter(F.col("place").isin(places)).groupBy("place").agg(F.first("page_id").alias("page_id"), F.first("html").alias("html")).collect()  # at most `sample`
    model = train([r.html for r in sorted(rows, key=lambda r: r.place)])

    def run(part):
        parsed = [parse(t) if t else None for t in part]
        xs = [features(p) for p in parsed if p]
        odds = model.log_odds(np.concatenate(xs)) if xs else None
        out, at = [], 0
        for p in parsed:
            if not p:
                out.append("")
                continue
            out.append(main_text(p, decode(p, odds[at:at + len(p)])))
            at += len(p)
        return {"text": out, "n_chars": [len(t) for t in out]}

    return map_texts(pages, [c for c in pages.columns if c not in ("html", "text", "n_chars")], "html", run, "text string, n_chars long", chunk=1 << 20)
