"""Main-text extraction with a tree-structured graphical model over DOM nodes.

A page's block elements form a tree. Each node is content or not; its own evidence (tag, class and id words, link density,
length, punctuation, place) makes its potential and each parent and child share another, so an article lends its paragraphs
belief and a footer takes it. Sum-product messages, upward then downward, give every node's exact marginal. Both kinds of
potentials are trained by gradient ascent on the exact likelihood of labelled pages, made from a fixed seed with layouts from
semantic to div-only. Text runs whose node is more likely content than not are the main text.

Inline elements belong to the block around them; white space inside a block becomes one space; blocks follow in page
order, two line feeds apart. Scripts, styles, comments, controls and other elements without readable text are never text.

Defined results: null, empty or markup-less html is one block of body text if it has words, else an empty text; unclosed and
stray tags are repaired; repeated rows are extracted each; an empty table gives an empty result; nothing is capped.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.common import lots

BLOCKS = frozenset("html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd nav header footer aside form fieldset table thead tbody tfoot tr td th caption blockquote pre figure figcaption address details summary center hgroup search dialog".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is raw characters up to their own end tag.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements whose content is no text of the page.
SILENT = frozenset("script style textarea title iframe noembed noframes head template noscript svg math object canvas audio video select option button map".split())
CLOSES_P = BLOCKS - {"html", "body"}
#: An opening tag ends an open element of these names, within the given scope.
ENDS = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Open elements beyond this depth are not nested any deeper, as in browsers; their text stays.
DEPTH = 512
NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
#: Attributes up to the tag's end or an opening quotation mark without its partner; every character is passed once.
ATTRS = re.compile(r"""[^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+)*+""")
ATTR = re.compile(r"""(class|id|role|data-y)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
WORD = re.compile(r"[a-z]+")

# Words in class, id and role that tell about a node.
CUES = "nav menu foot header head side bar ad ads advert sponsor banner cookie consent notice comment comments reply share social related promo newsletter subscribe signup breadcrumb pagination login search widget popup modal content article post entry main story body text page wrapper container column row title byline author disclaimer legal copyright tags meta".split()
_CUE = {c: i for i, c in enumerate(CUES)}


class Node:
    __slots__ = ("tag", "cues", "parent", "chars", "links", "stops", "label", "order")

    def __init__(self, tag, cues, parent, label, order):
        self.tag, self.cues, self.parent, self.label, self.order = tag, cues, parent, label, order
        self.chars = self.links = self.stops = 0


def tags(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, "/" or "", name, attributes) of tags, comments and the like (with an empty name) in page order.

    Every step goes on where the last one ended, so the time is linear in the page; a tag, comment or section without an
    end is text from there on or lasts to the page's end.
    """
    at, n = 0, len(page)
    while (start := page.find("<", at)) >= 0:
        at = start + 1
        if page.startswith("!--", at):
            end = page.find("-->", at + 3)
            at = n if end < 0 else end + 3
            yield start, at, "", "", ""
        elif page.startswith("![CDATA[", at):
            end = page.find("]]>", at)
            at = n if end < 0 else end + 3
            yield start, at, "", "", ""
        elif page[at : at + 1] in ("!", "?"):
            end = page.find(">", at)
            at = n if end < 0 else end + 1
            yield start, at, "", "", ""
        elif m := NAME.match(page, at):
            end = ATTRS.match(page, m.end()).end()
            if page[end : end + 1] != ">":
                end = page.find(">", end)
                if end < 0:
                    return
            at = end + 1
            name = m[2].lower()
            if name in RAW and not m[1] and page[end - 1] != "/":
                close = re.compile(rf"</{re.escape(name)}\b[^>]*+(?:>|\Z)", re.I).search(page, at)
                at = close.end() if close else n
                yield start, at, "", "", ""
            else:
                yield start, at, m[1], name, page[m.end() : end]


class _Open:
    """The open elements: names with the block they belong to, how many of each name, and the blocks among them."""

    def __init__(self):
        self.stack: list[tuple[str, int]] = [("html", 0)]
        self.blocks = [0]
        self.count = Counter(["html"])
        #: Per table, article and body that is open: its place and the inline names opened since.
        self.scopes: list[tuple[int, Counter]] = [(0, Counter())]

    def push(self, name: str, block: int) -> None:
        if name in BLOCKS:
            self.blocks.append(len(self.stack))
        if name in ("table", "article", "body"):
            self.scopes.append((len(self.stack), Counter()))
        self.scopes[-1][1][name] += 1
        self.count[name] += 1
        self.stack.append((name, block))

    def pop_from(self, k: int) -> list[str]:
        """Ends the elements from number k on; their names."""
        names = [name for name, _ in self.stack[k:]]
        del self.stack[k:]
        while self.blocks[-1] >= k:
            self.blocks.pop()
        while self.scopes[-1][0] >= k:
            self.scopes.pop()
        count, scope = self.count, self.scopes[-1][1]
        for name in names:
            count[name] -= 1
            scope[name] -= 1
        return names

    def last(self, names: frozenset[str] | set[str], stop: frozenset[str] | set[str] = frozenset()) -> int:
        """Number of the innermost element of these names, 0 if there is none or one of `stop` comes first."""
        if any(self.count[x] > 0 for x in names):
            for k in range(len(self.stack) - 1, 0, -1):
                if self.stack[k][0] in names:
                    return k
                if self.stack[k][0] in stop:
                    break
        return 0


def parse(page: str | None) -> tuple[list[Node], list[tuple[int, list[str]]]]:
    """Block nodes, parents first, and text runs (node, pieces) in page order. Node 0 is the page."""
    page = page or ""
    nodes = [Node("html", (), -1, None, 0)]
    runs: list[tuple[int, list[str]]] = []
    opened = _Open()
    silent = links = 0
    fresh = True  # a block boundary was passed since the last text

    def say(raw: str) -> None:
        nonlocal fresh
        if silent or not raw:
            return
        at = opened.stack[-1][1]
        text = _html.unescape(raw) if "&" in raw else raw
        if fresh or not runs or runs[-1][0] != at:
            if text.isspace():
                return
            runs.append((at, []))
            fresh = False
        runs[-1][1].append(text)
        node, n = nodes[at], len(text)
        node.chars += n
        node.stops += text.count(".") + text.count(",")
        if links:
            node.links += n

    def close(k: int) -> None:
        """Ends the open elements from number k on."""
        nonlocal silent, links, fresh
        for name in opened.pop_from(k):
            silent -= name in SILENT
            links -= name == "a"
            fresh |= name in BLOCKS

    def block(name: str, attrs: str) -> None:
        nonlocal fresh
        fresh = True
        if len(opened.stack) < DEPTH:
            nodes.append(_node(name, attrs, opened.stack[-1][1], len(nodes)))
            opened.push(name, len(nodes) - 1)

    done = 0
    for start, end, slash, name, attrs in tags(page):
        if start > done:
            say(page[done:start])
        done = end
        if slash:
            if name in BLOCKS:
                k = opened.last({name})
            else:  # an inline end tag does not reach out of a table, article or body
                k = opened.last({name}) if opened.scopes[-1][1][name] > 0 else 0
            if k:
                close(k)
        elif name == "hr":
            fresh = True
        elif name == "br":
            if not fresh:
                say(" ")
        elif name == "html":
            if attrs:
                nodes[0].cues = _node("html", attrs, -1, 0).cues
        elif name == "body":
            if k := opened.last({"head"}):
                close(k)
            if opened.count["body"] <= 0:
                block("body", attrs)
        elif name and name not in VOID:
            if name in CLOSES_P and opened.stack[opened.blocks[-1]][0] == "p":
                close(opened.blocks[-1])
            if name in ENDS:
                ends, scope = ENDS[name]
                while k := opened.last(ends, scope):
                    close(k)
            if name in BLOCKS:
                block(name, attrs)
            elif not attrs.endswith("/") and (name in SILENT or name == "a" or len(opened.stack) < DEPTH):
                opened.push(name, opened.stack[-1][1])
                silent += name in SILENT
                links += name == "a"
    say(page[done:])
    return nodes, runs


def _node(tag: str, attrs: str, parent: int, order: int) -> Node:
    cues, label = (), None
    if attrs and "=" in attrs:
        found: list[str] = []
        for k, v in ATTR.findall(attrs):
            if k.lower() == "data-y":
                label = v.strip("\"'") == "1"
            else:
                found += WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", v).lower())
        cues = tuple(_CUE[w] for w in dict.fromkeys(found) if w in _CUE)
    return Node(tag, cues, parent, label, order)


# --- the model ---------------------------------------------------------------------------------------------------------

_TAGS = {t: i for i, t in enumerate(sorted(BLOCKS))}
_N_TAG, _N_CUE = len(_TAGS), len(CUES)
_BINS = 6
N_FEATURES = _N_TAG + _N_CUE + 4 * _BINS + 1


def features(nodes: list[Node]) -> list[list[int]]:
    """Numbers of the binary features of each node; amounts of a node count all below it."""
    n = len(nodes)
    chars, links, stops = [x.chars for x in nodes], [x.links for x in nodes], [x.stops for x in nodes]
    for i in range(n - 1, 0, -1):
        p = nodes[i].parent
        chars[p] += chars[i]
        links[p] += links[i]
        stops[p] += stops[i]
    out = []
    base = _N_TAG + _N_CUE
    total = max(1, chars[0])
    for i, x in enumerate(nodes):
        c = chars[i]
        f = [_TAGS[x.tag]]
        f += [_N_TAG + k for k in x.cues]
        f.append(base + min(_BINS - 1, int(math.log2(1 + c) / 2)))
        f.append(base + _BINS + min(_BINS - 1, int(_BINS * links[i] / max(1, c))))
        f.append(base + 2 * _BINS + min(_BINS - 1, int(100 * stops[i] / max(1, c))))
        f.append(base + 3 * _BINS + min(_BINS - 1, int(_BINS * c / total)))
        f.append(N_FEATURES - 1)
        out.append(f)
    return out


class Model:
    """unary: weight of each feature for content; pair: log potential by (parent, child)."""

    def __init__(self):
        self.unary = [0.0] * N_FEATURES
        self.pair = [[0.0, 0.0], [0.0, 0.0]]

    def marginals(self, parents: list[int], feats: list[list[int]]) -> tuple[list[float], list[list[float]]]:
        """Content marginal of each node and, for each node but the first, the joint marginals (parent, node) as 00, 01, 10, 11."""
        n, w, t = len(parents), self.unary, self.pair
        e00, e01, e10, e11 = (math.exp(t[a][b]) for a in (0, 1) for b in (0, 1))
        own = [sum([w[k] for k in f]) for f in feats]
        up0, up1 = [1.0] * n, [1.0] * n  # product of the children's messages and the own potential, scaled
        msg0, msg1 = [1.0] * n, [1.0] * n
        for i in range(n - 1, -1, -1):
            s = own[i]
            a, b = (1.0, math.exp(s)) if s < 0 else (math.exp(-s), 1.0)
            a, b = a * up0[i], b * up1[i]
            z = a + b
            up0[i], up1[i] = a / z, b / z
            p = parents[i]
            if p >= 0:
                m0, m1 = e00 * up0[i] + e01 * up1[i], e10 * up0[i] + e11 * up1[i]
                z = m0 + m1
                msg0[i], msg1[i] = m0 / z, m1 / z
                a, b = up0[p] * msg0[i], up1[p] * msg1[i]
                z = a + b
                up0[p], up1[p] = a / z, b / z
        out = [0.0] * n
        down0, down1 = [1.0] * n, [1.0] * n  # belief of each node
        joint: list[list[float]] = [[]] * n
        down0[0], down1[0] = up0[0], up1[0]
        out[0] = up1[0]
        for i in range(1, n):
            p = parents[i]
            c0, c1 = down0[p] / max(msg0[i], 1e-300), down1[p] / max(msg1[i], 1e-300)  # the parent without this child
            j = [c0 * e00 * up0[i], c0 * e01 * up1[i], c1 * e10 * up0[i], c1 * e11 * up1[i]]
            z = sum(j)
            j = [x / z for x in j]
            joint[i] = j
            down0[i], down1[i] = j[0] + j[2], j[1] + j[3]
            out[i] = down1[i]
        return out, joint

    def fit(self, pages: list[str], epochs: int = 25, rate: float = 0.15, decay: float = 1e-4) -> "Model":
        """Pages whose blocks carry data-y; a block without one has its parent's label."""
        data = []
        for page in pages:
            nodes, _ = parse(page)
            y: list[int] = []
            for x in nodes:
                y.append(int(x.label) if x.label is not None else (y[x.parent] if x.parent >= 0 else 1))
            data.append(([x.parent for x in nodes], features(nodes), y))
        w, t = np.zeros(N_FEATURES), np.zeros(4)
        gw2, gt2 = np.full(N_FEATURES, 1e-3), np.full(4, 1e-3)
        for _ in range(epochs):
            for k in range(0, len(data), 20):
                gw, gt = -decay * w, -decay * t
                for parents, feats, y in data[k : k + 20]:
                    m, joint = self.marginals(parents, feats)
                    for i, f in enumerate(feats):
                        d = y[i] - m[i]
                        for j in f:
                            gw[j] += d / 20
                        if i:
                            gt -= np.array(joint[i]) / 20
                            gt[2 * y[parents[i]] + y[i]] += 1 / 20
                gw2 += gw * gw
                gt2 += gt * gt
                w += rate * gw / np.sqrt(gw2)
                t += rate * gt / np.sqrt(gt2)
                self.unary = w.tolist()
                self.pair = [[float(t[0]), float(t[1])], [float(t[2]), float(t[3])]]
        return self


def labelled_page(r: np.random.Generator) -> str:
    """A made-up page whose blocks carry data-y: 1 for content."""
    syl = ["ra", "ten", "lo", "mi", "ver", "con", "da", "est", "pro", "ung", "ci", "tre", "the", "ing", "er", "on"]
    word = lambda: "".join(syl[i] for i in r.integers(0, len(syl), int(r.integers(1, 4))))
    some = lambda a, b: " ".join(word() for _ in range(int(r.integers(a, b))))
    one = lambda *x: x[int(r.integers(0, len(x)))]
    sentence = lambda: some(3, 18).capitalize() + "."
    prose = lambda a, b: " ".join(sentence() for _ in range(int(r.integers(a, b))))
    yes = lambda p: r.random() < p
    soup = yes(0.4)

    def links(k: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{word()}">{some(1, 4)}</a></li>' for _ in range(k)) + "</ul>"

    def junk(kind: str) -> str:
        if kind == "nav":
            return f'<div class="{one("menu", "nav", "navbar", "topnav")}" data-y="0">{links(int(r.integers(3, 9)))}</div>' if soup else f'<nav data-y="0">{links(int(r.integers(3, 9)))}</nav>'
        if kind == "header":
            return f'<div id="header" data-y="0"><h2>{some(1, 4)}</h2>{links(3)}</div>' if soup else f'<header data-y="0"><p>{some(1, 5)}</p>{links(3)}</header>'
        if kind == "footer":
            inner = one(f"&copy; {word()} {sentence()}", f"<p>{sentence()}</p>", links(4), f"{prose(1, 4)}")
            return f'<div class="{one("footer", "page-foot")}" data-y="0">{inner}</div>' if soup else f'<footer data-y="0">{inner}</footer>'
        if kind == "side":
            inner = f"<h3>{some(1, 4)}</h3>" + one(links(5), f"<p>{prose(1, 5)}</p>")
            return f'<div class="{one("sidebar", "side", "widget", "related", "promo")}" data-y="0">{inner}</div>' if soup or yes(0.3) else f'<aside data-y="0">{inner}</aside>'
        if kind == "ad":
            return f'<div class="{one("ad", "ads", "advert", "sponsor", "banner", "promo")}" data-y="0">{one(prose(1, 4), f"<p>{prose(1, 5)}</p>", f"<a href=x>{some(2, 6)}</a>")}</div>'
        if kind == "notice":
            return f'<div class="{one("cookie", "consent", "cookie-notice", "notice", "popup", "disclaimer")}" data-y="0"><p>{prose(1, 4)}</p><button>ok</button></div>'
        if kind == "form":
            return f'<form class="{one("search", "newsletter", "login", "signup", "")}" data-y="0"><p>{some(1, 6)}</p><label>{some(1, 3)}</label><input><button>{word()}</button></form>'
        if kind == "share":
            return f'<div class="{one("share", "social", "tags", "breadcrumb", "pagination")}" data-y="0">{links(3)}</div>'
        said = "".join(one(f'<div class="comment" data-y="0"><p>{prose(1, 4)}</p></div>', f'<li class="comment" data-y="0">{word()}: {prose(1, 3)}</li>') for _ in range(int(r.integers(1, 5))))
        return one(f'<div class="{one("comments", "comment-list", "replies comments")}" data-y="0"><h3>{some(1, 3)}</h3>{said}</div>', f'<section id="comments" data-y="0">{said}</section>')

    def paragraph() -> str:
        text = prose(1, 7)
        if yes(0.2):
            text = f'{text} <a href="/{word()}">{some(1, 5)}</a> {sentence()}'
        kind = r.random()
        if kind < 0.68:
            return f"<p>{text}</p>" if yes(0.85) else f"<p><b>{sentence()}<br>"
        if kind < 0.78:
            return f"<{one('h2', 'h3')}>{some(1, 8)}</{one('h2', 'h3')}>"
        if kind < 0.86:
            return "<ul>" + "".join(f"<li>{sentence()}</li>" for _ in range(int(r.integers(2, 6)))) + "</ul>"
        if kind < 0.91:
            return f"<blockquote>{one(text, f'<p>{text}</p>')}</blockquote>"
        if kind < 0.95:
            return f"<pre>{some(3, 15)}</pre>"
        if kind < 0.975:
            return f"<table><tr><td>{some(1, 4)}</td><td>{some(1, 4)}</td></tr><tr><td>{some(1, 3)}</td><td>{some(1, 9)}</td></tr></table>"
        return f"<div>{text}</div>" if soup else f"<figure><figcaption>{sentence()}</figcaption></figure>"

    body = [f"<h1>{some(1, 12)}</h1>"] * int(yes(0.9)) + [paragraph() for _ in range(int(r.integers(1, 14)))]
    for kind in ("ad", "share", "side", "form", "notice", "comments"):
        if yes(0.12):
            body.insert(int(r.integers(0, len(body) + 1)), junk(kind))
    inner = "".join(body)
    if soup:
        main = f'<div class="{one("content", "post", "entry-content", "article-body", "story", "main", "text", "post content")}" data-y="1">{inner}</div>'
        if yes(0.5):
            main = f'<div class="{one("wrapper", "container", "page", "row")}" data-y="1">{main}{junk("side") if yes(0.4) else ""}</div>'
    else:
        main = one(f'<article data-y="1">{inner}</article>', f'<article data-y="1">{inner}</article>', f'<main data-y="1">{inner}</main>', f'<main data-y="1"><article data-y="1">{inner}</article></main>', f'<section class="content" data-y="1">{inner}</section>')
    before = "".join(junk(k) for k in ("header", "nav", "ad", "notice", "form", "share") if yes(0.5))
    after = "".join(junk(k) for k in ("comments", "side", "share", "ad", "form", "notice") if yes(0.35)) + (junk("footer") if yes(0.85) else "")
    return f'<!DOCTYPE html><html><head><title>x</title></head><body data-y="1">{before}{main}{after}</body></html>'


@lru_cache(maxsize=2)
def trained(pages: int = 400, seed: int = 3) -> Model:
    """Trained on `pages` labelled pages (the bound)."""
    r = np.random.default_rng(seed)
    return Model().fit([labelled_page(r) for _ in range(pages)])


def extract_text(page: str | None, model: Model) -> str:
    nodes, runs = parse(page)
    if not runs:
        return ""
    m, _ = model.marginals([x.parent for x in nodes], features(nodes))
    blocks = (" ".join("".join(pieces).split()) for at, pieces in runs if m[at] >= 0.5)
    return "\n\n".join(b for b in blocks if b)


def extract(pages: DataFrame, html: str = "html", id_column: str = "page_id", url: str = "url", model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars."""
    known = model or trained()

    def run(batches):
        for b in lots(batches):
            texts = [extract_text(x, known) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    return pages.select(F.col(id_column).cast("long").alias("id"), F.col(url).alias("url"), F.col(html)).mapInArrow(run, "id long, url string, text string, n_chars long").withColumnRenamed("id", id_column)
