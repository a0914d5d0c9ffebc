"""Main-text extraction with a tree-structured graphical model (operator 3).

A page is parsed into a tree of block elements and runs of text. Every node has a hidden state: 1 if it is or holds
main text, else 0. A node's own potential comes from a logistic model over its tag, its class and id words, and, for
runs of text, length, link share and punctuation. Potentials between parent and child come from how often the states meet
in the labelled pages, against chance: what lies in a menu is hardly ever main text, what lies in an article mostly is.
Sum-product messages, upward from the leaves and then downward from the root, give each node's marginal, and runs of text with a
marginal of a half or more make up the result.

Both kinds of potentials are trained on labelled pages: ``labelled_pages`` (made by rule, with varied layouts), or any other
list of pages in which attributes ``data-main="1"`` mark what is main text and ``data-main="0"`` what, inside it, is not.

Defined results: null and empty pages, and pages without main text, give an empty text; unclosed and misnested tags are
closed where their parents end; what lies in elements of DROPPED is not text, and one of these without an end tag of its own ends where
the next block begins or its parent ends, so that it never takes the page with it; text outside any element counts as a child of the page; repeated rows are extracted each.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements by how they are parsed.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())  # to the end tag or the page's end, whatever stands there
DROPPED = frozenset("noscript template svg math object select canvas".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section table tbody td tfoot th thead tr ul".split())
ENDS_WITH = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
KEEPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(?:[!?][^>]*>?)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.S)
_WORD = re.compile(r"[A-Za-z]+")
_SPACE = re.compile(r"[\s​﻿]+")


class Node:
    __slots__ = ("tag", "words", "parent", "children", "text", "link", "mark")

    def __init__(self, tag: str, words: tuple[str, ...], parent: Node | None, mark: str | None = None):
        self.tag, self.words, self.parent, self.children, self.text, self.link, self.mark = tag, words, parent, [], None, 0, mark


def _attributes(source: str) -> tuple[tuple[str, ...], str | None, bool]:
    """Words of class, id and role; the training mark; whether the element is hidden."""
    words, mark, hidden = [], None, False
    for m in _ATTRIBUTE.finditer(source):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role", "itemprop", "aria-label"):
            words += [w.lower() for w in _WORD.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value))]
        elif name == "data-main":
            mark = value
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            hidden = True
    return tuple(dict.fromkeys(words)), mark, hidden or bool(re.search(r"\bhidden\b(?!\s*=)", re.sub(r"\"[^\"]*\"|'[^']*'", "", source), re.I))


_SOME_DROPPED = re.compile(rf"<(?:{'|'.join(sorted(DROPPED))})\b", re.I)


def _after_raw(source: str, tag: str, pos: int) -> int:
    end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, pos)
    return end.end() if end else len(source)


def _dropped(source: str) -> dict[int, int]:
    """Where the elements of DROPPED end that have an end tag of their own before their parent's: by place of the start tag."""
    ends: dict[int, int] = {}
    if not _SOME_DROPPED.search(source):
        return ends
    stack, count, pos = [], {}, 0
    while m := _TAG.search(source, pos):
        pos, tag = m.end(), m[2].lower() if m[2] else None
        if tag is None or tag in INLINE or tag in VOID:
            continue
        if m[1]:
            while count.get(tag):
                top, start = stack.pop()
                count[top] -= 1
                if top == tag:
                    if tag in DROPPED:
                        ends[start] = pos
                    break
        elif tag in RAW:
            pos = _after_raw(source, tag, pos)
        elif not (tag in ("svg", "math") and m[3].endswith("/")):
            stack.append((tag, m.start()))
            count[tag] = count.get(tag, 0) + 1
    return ends


def parse(source: str) -> Node:
    """The tree of blocks and runs of text."""
    root = Node("#page", (), None)
    at, run, links, depth_a, pos = root, [], 0, 0, 0
    ends, mute = _dropped(source), False

    def close_run() -> None:
        nonlocal run, links
        text = _SPACE.sub(" ", html.unescape("".join(run))).strip()
        if text:
            leaf = Node("#text", (), at)
            leaf.text, leaf.link = text, min(1.0, links / max(1, len(text)))
            at.children.append(leaf)
        run, links = [], 0

    def said(text: str) -> None:
        nonlocal links
        if text and not mute:
            run.append(text)
            links += len(text) if depth_a else 0

    while True:
        m = _TAG.search(source, pos)
        if m is None:
            rest = source[pos:]
            cut = re.search(r"<[/!?a-zA-Z][^>]*\Z", rest)  # a tag that the page's end cuts off
            said(rest[: cut.start()] if cut else rest)
            break
        said(source[pos : m.start()])
        pos = m.end()
        tag = m[2].lower() if m[2] else None
        if tag is None:
            continue
        if m[1]:
            if tag == "a":
                depth_a = max(0, depth_a - 1)
            if tag in INLINE or tag in VOID:
                if tag == "br":
                    close_run()
                continue
            up = at
            while up is not root and up.tag != tag:
                up = up.parent
            if up is not root:
                close_run()
                at, mute = up.parent, False
            continue
        if tag in RAW:
            pos = _after_raw(source, tag, pos)
            continue
        if tag in DROPPED:
            if not (tag in ("svg", "math") and m[3].endswith("/")):
                pos = ends.get(m.start(), pos)
                mute = mute or m.start() not in ends
            continue
        if tag in INLINE:
            depth_a += tag == "a"
            continue
        close_run()
        if tag in VOID:
            continue
        up = at
        if tag in CLOSES_P:
            mute = False
            while up is not root and up.tag != "p" and up.tag in CLOSES_P and up.tag not in ("td", "th", "li", "div", "article", "section"):
                up = up.parent
            if up is not root and up.tag == "p":
                at = up.parent
        if tag in ENDS_WITH:
            up = at
            while up is not root and up.tag not in ENDS_WITH[tag] and up.tag not in KEEPS[tag]:
                up = up.parent
            if up is not root and up.tag in ENDS_WITH[tag]:
                at = up.parent
                if tag == "tr" and at.tag == "tr":
                    at = at.parent
        words, mark, hidden = _attributes(m[3]) if m[3] and not m[3].isspace() else ((), None, False)
        node = Node(tag, (*words, "hidden") if hidden else words, at, mark)
        at.children.append(node)
        at = node
    close_run()
    return root


def order(root: Node) -> list[Node]:
    """Parents before children, in page order."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(reversed(node.children))
    return out


def signs(node: Node) -> list[str]:
    """Features of a node by name."""
    if node.text is None:
        return ["bias:block", f"tag:{node.tag}", *[f"word:{w}" for w in node.words]]
    t, n = node.text, len(node.text)
    return ["bias:text", f"long:{min(9, n.bit_length())}", f"link:{int(node.link * 4)}", f"ends:{t[-1] in '.!?…:;,' }", f"in:{node.parent.tag}", f"copyright:{t[:2].lower().startswith('©') or '©' in t[:40]}"]


class Model:
    """Weights of the nodes' own potentials (log odds of state 1) and log potentials between parent and child."""

    def __init__(self, weights: dict[str, float], edges: dict[str, list[list[float]]]):
        self.weights, self.edges = weights, edges

    def edge(self, node: Node) -> list[list[float]]:
        """[state of the parent][state of the node]: by the tags of both if the labelled pages had them."""
        if node.parent is None:
            return self.edges["block"]
        return self.edges.get(f"{node.parent.tag}>{node.tag}") or self.edges["#text" if node.text is not None else "block"]

    def own(self, node: Node) -> float:
        return sum(self.weights.get(s, 0.0) for s in signs(node))

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Chance of state 1 for nodes in parent-first order, by sum-product messages up and down the tree."""
        place = {id(n): i for i, n in enumerate(nodes)}
        n = len(nodes)
        parent = [place[id(x.parent)] if x.parent is not None else -1 for x in nodes]
        tables = [self.edge(x) for x in nodes]
        clip = lambda z: 30.0 if z > 30 else -30.0 if z < -30 else z
        from math import exp

        beliefs = [[1.0, exp(clip(self.own(x)))] for x in nodes]
        up: list[tuple[float, float]] = [(1.0, 1.0)] * n
        for i in range(n - 1, 0, -1):  # a child's message: its belief so far, summed over its states
            (b0, b1), t = beliefs[i], tables[i]
            m0, m1 = t[0][0] * b0 + t[0][1] * b1, t[1][0] * b0 + t[1][1] * b1
            share = min(1.0, 3 / len(nodes[parent[i]].children))  # many siblings are alike: together they tell as much as three
            m0, m1 = (m0 / (m0 + m1)) ** share, (m1 / (m0 + m1)) ** share
            up[i] = (m0 / (m0 + m1), m1 / (m0 + m1))
            at = beliefs[parent[i]]
            at[0] *= up[i][0]
            at[1] *= up[i][1]
            z = at[0] + at[1]
            at[0] /= z
            at[1] /= z
        out = [0.0] * n
        for i in range(n):
            if i:  # the parent's belief without this child's own message
                p, t = beliefs[parent[i]], tables[i]
                q0, q1 = p[0] / up[i][0], p[1] / up[i][1]
                b = beliefs[i]
                b[0] *= t[0][0] * q0 + t[1][0] * q1
                b[1] *= t[0][1] * q0 + t[1][1] * q1
                z = b[0] + b[1]
                b[0] /= z
                b[1] /= z
            out[i] = beliefs[i][1] / (beliefs[i][0] + beliefs[i][1])
        return out

    def main_text(self, source: str | None) -> str:
        if not source:
            return ""
        nodes = order(parse(source))
        return " ".join(x.text for x, p in zip(nodes, self.marginals(nodes)) if x.text is not None and p >= 0.5)


def states(nodes: list[Node]) -> list[int]:
    """States of a labelled page: marks hold for all that is below them; an element that holds main text is 1."""
    inner: dict[int, int] = {}
    for x in nodes:
        inner[id(x)] = int(x.mark) if x.mark is not None else inner[id(x.parent)] if x.parent is not None else 0
    held = {id(x): inner[id(x)] if x.text is not None else 0 for x in nodes}
    for x in reversed(nodes):
        if x.parent is not None:
            held[id(x.parent)] |= held[id(x)]
    return [held[id(x)] for x in nodes]


def train(pages: list[str], rounds: int = 500, decay: float = 2e-5) -> Model:
    """Both kinds of potentials from labelled pages."""
    rows, y, edges = [], [], {"#text": np.ones((2, 2)), "block": np.ones((2, 2))}
    for page in pages:
        nodes = order(parse(page))
        s = states(nodes)
        of = {id(x): v for x, v in zip(nodes, s)}
        for x, v in zip(nodes, s):
            rows.append(signs(x))
            y.append(v)
            if x.parent is not None:
                for kind in ("#text" if x.text is not None else "block", f"{x.parent.tag}>{x.tag}"):
                    edges.setdefault(kind, np.zeros((2, 2)))[of[id(x.parent)], v] += 1
    names = {k: i for i, k in enumerate(sorted({k for r in rows for k in r}))}
    at = np.array([i for i, r in enumerate(rows) for _ in r])
    to = np.array([names[k] for r in rows for k in r])
    w, g2, y = np.zeros(len(names)), np.full(len(names), 1e-8), np.array(y, float)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(at, w[to], len(rows)), -30, 30)))
        g = np.bincount(to, (p - y)[at], len(names)) / len(rows) + decay * w
        g2 += g * g
        w -= 1.0 * g / np.sqrt(g2)
    # the node's state given its parent's, against chance; pairs of tags lean on the table of all
    given = {k: edges[k] / edges[k].sum(1, keepdims=True) for k in ("#text", "block")}
    tables = {}
    for kind, e in edges.items():
        base = "#text" if kind.endswith("#text") else "block"
        e = e if kind == base else e + 4 * given[base]
        tables[kind] = (e / e.sum(1, keepdims=True) / (edges[base].sum(0) / edges[base].sum())).tolist()
    return Model({k: float(w[i]) for k, i in names.items()}, tables)


def labelled_pages(count: int = 1500, seed: int = 7) -> list[str]:
    """Pages made by rule, whose layouts, names of classes and clutter vary; the marks say what is main text."""
    r = random.Random(seed)
    syllables = "an be chi da en fo gu hin il ko la mer no os par que ri sta tu ver wo zen".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 3)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    prose = lambda: " ".join(words(3, 14).capitalize() + r.choice(".....?!") for _ in range(r.choice([1, 1, 2, 3, 5, 8])))
    name = lambda *some: f' {r.choice(["class", "class", "id"])}="{r.choice(some)}{r.choice(["", "", "-" + word(), " " + word()])}"'
    link = lambda: f'<a href="/{word()}">{words(1, 4)}</a>'
    links = lambda: r.choice(["<ul>" + "".join(f"<li>{link()}</li>" for _ in range(r.randint(2, 7))) + "</ul>", " | ".join(link() for _ in range(r.randint(2, 6)))])

    def paragraph() -> str:
        text = prose() if r.random() < 0.8 else words(1, r.choice([3, 30, 300])) + r.choice(["", ",", "!!", " |"])
        if r.random() < 0.2:
            text = f"<b>{text}<br>" if r.random() < 0.5 else f"<b>{text}</b>"
        if r.random() < 0.2:
            text += f" {link()} {words(2, 8)}."
        return f"<p>{text}" + ("</p>" if r.random() < 0.8 else "")

    def body() -> str:
        kinds = [paragraph] * 6 + [lambda: f"<h{(n := r.randint(2, 4))}>{words(1, 6)}</h{n}>", lambda: f"<blockquote><p>{prose()}</p></blockquote>", lambda: "<ul>" + "".join(f"<li>{words(3, 12)}</li>" for _ in range(r.randint(2, 4))) + "</ul>", lambda: f"<pre>{words(3, 9)}</pre>", lambda: f"<figure><img src='x'><figcaption>{words(3, 9)}</figcaption></figure>", lambda: f"<table><tr><td>{words(1, 4)}</td><td>{words(1, 4)}</td></tr></table>", lambda: f"<div>{prose()}</div>", lambda: f"<section><h3>{words(1, 4)}</h3><p>{prose()}</p></section>"]
        out = [f"<h1>{words(1, 9)}</h1>"] if r.random() < 0.8 else []
        for _ in range(r.choice([1, 2, 4, 7, 12])):
            out.append(r.choice(kinds)())
            if r.random() < 0.08:
                out.append(r.choice(clutter)().replace(">", ' data-main="0">', 1))
        return "".join(out)

    def block(tags: str, names: tuple[str, ...], inside) -> str:
        tag = r.choice(tags.split())
        return f"<{tag}{name(*names) if tag in ('div', 'section', 'p', 'span', 'ul') or r.random() < 0.4 else ''}>{inside()}</{tag}>"

    some = lambda: r.choice([f"<p>{prose()}</p>", prose(), f"<h3>{words(1, 3)}</h3>{links()}", f"<p>{words(2, 9)}</p>{link()}"])
    clutter = [
        lambda: block("div div aside section", ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner"), some),
        lambda: block("aside aside div", ("sidebar", "related", "widget", "recommended", "trending", "more-stories"), some),
        lambda: block("div div section", ("cookie", "cookie-notice", "consent", "gdpr", "notice", "alert", "popup", "modal", "newsletter", "subscribe", "paywall"), lambda: f"<p>{prose()}</p><button>{words(1, 2)}</button>"),
        lambda: block("form form div", ("search", "login", "signup", "newsletter", "contact-form", "subscribe-form"), lambda: f"<label>{words(1, 3)}</label><input><button>{words(1, 2)}</button><p>{words(2, 8)}.</p>"),
        lambda: block("div div ul", ("share", "social", "sharing", "breadcrumb", "breadcrumbs", "pagination", "pager", "tags", "meta", "byline"), links),
        lambda: block("section div div ol", ("comments", "comment", "responses", "replies", "discussion", "comment-list"), lambda: "".join(f'<{(t := r.choice(["div", "li", "article"]))} class="comment"><p>{prose()}</p></{t}>' for _ in range(r.randint(1, 4)))),
    ]
    menu = lambda: block("nav nav div", ("nav", "menu", "navbar", "navigation", "topbar", "main-menu"), links)
    head = lambda: block("header header div", ("header", "site-header", "masthead", "logo", "top"), lambda: r.choice([f"<h1>{words(1, 3)}</h1>", f"<p>{words(2, 6)}</p>", "", f"<div>{words(1, 3)}</div>"]) + (menu() if r.random() < 0.6 else ""))
    foot = lambda: block("footer footer div", ("footer", "site-footer", "copyright", "bottom", "legal"), lambda: r.choice([f"&copy; {word()}.example.com &middot; {prose()}\n{prose()}", f"<p>{prose()}</p>{links()}", f"&copy; {words(1, 4)}", links()]))
    pages = []
    for _ in range(count):
        tag = r.choice(["article", "article", "article", "main", "div", "section", "td"])
        naming = name("content", "article", "post", "entry", "story", "main", "post-body", "article-content", "entry-content", "body-text") if tag in ("div", "section", "td") or r.random() < 0.3 else ""
        main = f'<{tag}{naming} data-main="1">{body()}</{tag}>'
        if tag == "td":
            main = f"<table><tr>{'<td' + name('sidebar', 'menu', 'nav') + '>' + links() + '</td>' if r.random() < 0.6 else ''}{main}</tr></table>"
        if r.random() < 0.05:
            main = ""
        if r.random() < 0.4:
            main = f"<div{name('wrapper', 'container', 'page', 'layout', 'row', 'site')}>{main}{r.choice(clutter)() if r.random() < 0.5 else ''}</div>"
        before = "".join(f() for f in (head, menu, *r.sample(clutter[:4], r.choice([0, 1, 1, 2]))) if r.random() < 0.7)
        after = "".join(f() for f in (*r.sample(clutter, r.choice([0, 1, 2, 3])), foot) if r.random() < 0.8)
        pages.append(f"<!DOCTYPE html><html><head><title>{words(1, 6)}</title><style>p{{margin:0}}</style></head><body>{before}{main}{after}</body></html>")
    return pages


@lru_cache(maxsize=1)
def default_model() -> Model:
    return train(labelled_pages())


def extract(pages: DataFrame, model: Model | None = None, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page, each from its whole source."""
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [model.main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(source).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
