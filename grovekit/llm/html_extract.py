"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: text between block-level boundaries, with its open ancestors. Features are the ancestor
tags, their class and id words, and the text's shape. The field is trained on labelled pages by gradient ascent on its
log-likelihood and decoded by Viterbi. labelled_pages() makes varied pages with known labels to train on.
"""

from __future__ import annotations

import functools
import html
import random
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

# Kinds of elements.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp".split())
HIDDEN = frozenset("button select svg math object iframe template noscript".split())
FLAT = frozenset("button select iframe".split())  # these hold none of their own kind
CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SELF_CLOSING = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}

#: A quoted value ends at its quote only where a tag may go on after it; else the quote is a character like others.
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"(?=[\s/>])|'[^']*+'(?=[\s/>])|[\"'])*+)>", re.S)
ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN_TAG = re.compile(rf"<(/?)({'|'.join(sorted(HIDDEN))})(?=[\s/>])[^>]*+>", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Element:
    """An open block-level element: its tag, and the features of itself and all its ancestors. Features that the field
    doesn't know aren't kept, so that their number doesn't follow the depth."""

    __slots__ = ("tag", "features", "children", "score")

    def __init__(self, tag: str, features: dict[str, None]):
        self.tag, self.features, self.children, self.score = tag, features, {}, None

    def child(self, tag: str, attributes: str, known) -> Element:
        found = self.children.get((tag, attributes))
        if found is None:
            new = [f"tag={tag}", *(f"word={w.lower()}" for w in WORD.findall(attributes))]
            if self.tag and tag in PAIRED:
                new.append(f"pair={self.tag}>{tag}")
            new = [f for f in new if f not in self.features and (known is None or f in known)]
            found = self.children[tag, attributes] = Element(tag, {**self.features, **dict.fromkeys(new)} if new else self.features)
        return found


PAIRED = frozenset("ul p div li header footer".split())


@dataclass
class Block:
    text: str
    linked: int
    element: Element


def hidden_ends(page: str) -> set[int]:
    """Places of the start tags of hidden elements that have their end tag."""
    out, opened = set(), defaultdict(list)
    for m in HIDDEN_TAG.finditer(page):
        name, stack = m[2].lower(), opened[m[2].lower()]
        if not m[1]:
            if name in FLAT:
                stack.clear()
            if not m[0].endswith("/>"):
                stack.append(m.start())
        elif stack:
            out.add(stack.pop())
    return out


def blocks(page: str, known=None) -> list[Block]:
    """Leaf blocks of a page in its order, white space as single spaces, empty ones left out. Elements end with their own
    end tag or with an ancestor's. Text in hidden elements is no block; one without an end tag ends at the next block-level
    tag, so that it hides nothing of the page. A textarea or title without an end tag hides nothing either."""
    out, pieces, linked, end, anchors, hidden = [], [], 0, 0, 0, 0
    root = Element("", {"bias": None})
    stack: list[tuple[str, Element, str]] = []  # name, nearest block-level element, "" or how it hides: closed or loose
    opened: defaultdict[str, int] = defaultdict(int)
    ends = None
    endless: set[str] = set()
    loose: list[int] = []  # places in the stack

    def close():
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append(Block(text, linked, stack[-1][1] if stack else root))
            pieces.clear()
        linked = 0

    def add(raw: str):
        nonlocal linked
        if hidden or loose:
            return
        text = html.unescape(raw) if "&" in raw else raw
        pieces.append(text)
        if anchors:
            linked += len(text)

    def pop(k: int):
        nonlocal anchors, hidden
        for name, _, hides in stack[k:]:
            opened[name] -= 1
            anchors -= name == "a"
            hidden -= hides == "closed"
        del stack[k:]
        while loose and loose[-1] >= k:
            loose.pop()

    def imply(name: str, stops) -> None:
        """Closes an open element of this name unless a boundary stands between."""
        if opened[name]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    return pop(k)
                if stack[k][0] in stops or stack[k][2]:
                    return None

    m = MARKUP.search(page)
    while m:
        if m.start() > end:
            add(page[end : m.start()])
        end = m.end()
        name = m[2]
        if name:
            name = name.lower()
            whole = not m[3].endswith("/")
            if m[1]:
                if opened[name]:
                    k = len(stack) - 1
                    while stack[k][0] != name:
                        k -= 1
                    if any(t not in INLINE for t, _, _ in stack[k:]):
                        close()
                    pop(k)
                elif name not in INLINE and name not in HIDDEN:
                    close()
            elif name in RAW and whole:
                found = None if name in endless else re.compile(rf"</{name}\s*>", re.I).search(page, end)
                if found:
                    end = found.end()
                elif name in ("script", "style"):
                    end = len(page)
                else:
                    endless.add(name)
                if name in ("textarea", "xmp"):
                    pieces.append(" ")
            elif name in VOID:
                if name == "br":
                    pieces.append(" ")
                elif name == "hr":
                    close()
            elif name in HIDDEN:
                if whole:
                    if ends is None:
                        ends = hidden_ends(page)
                    pieces.append(" ")
                    if m.start() in ends:
                        hidden += 1
                    else:
                        loose.append(len(stack))
                    stack.append((name, stack[-1][1] if stack else root, "closed" if m.start() in ends else "loose"))
                    opened[name] += 1
            else:
                if name not in INLINE:
                    if loose and not hidden:
                        pop(loose[0])
                    close()
                    if name in CLOSES_P:
                        imply("p", CLOSES_P - {"p"})
                    elif name in SELF_CLOSING:
                        imply(name, SELF_CLOSING[name])
                if whole or name in INLINE:
                    element = stack[-1][1] if stack else root
                    if name not in INLINE:
                        attributes = " ".join(x or y or z for x, y, z in ATTRIBUTE.findall(m[3])) if m[3] else ""
                        element = element.child(name, attributes, known)
                    stack.append((name, element, ""))
                    opened[name] += 1
                    anchors += name == "a"
        m = MARKUP.search(page, end)
    add(page[end:])
    close()
    return out


def block_features(b: Block, place: float) -> tuple[str, ...]:
    """Features of a block beside those of its element."""
    n = len(b.text)
    words = b.text.count(" ") + 1
    share = b.linked / n
    return (
        f"own={b.element.tag}",
        f"words={min(words.bit_length(), 7)}",
        f"linked={'all' if share > 0.8 else 'some' if share > 0.3 else 'none'}",
        f"stop={b.text[-1] in '.!?:;…»”\"'}",
        f"first={'copy' if b.text[0] in '©' else 'upper' if b.text[0].isupper() else 'other'}",
        f"place={int(min(place, 0.999) * 5)}",
    )


@dataclass
class Field:
    """Weights of a two-label linear chain: per feature and label, and between neighbouring labels."""

    index: dict[str, int]
    weights: np.ndarray
    moves: np.ndarray

    def emissions(self, found: list[Block]) -> np.ndarray:
        out = np.zeros((len(found), 2))
        n = len(found)
        for i, b in enumerate(found):
            if b.element.score is None:
                b.element.score = self._sum(b.element.features)
            out[i] = b.element.score + self._sum(block_features(b, i / n))
        return out

    def _sum(self, features: Iterable[str]) -> np.ndarray:
        get = self.index.get
        return self.weights[[k for f in features if (k := get(f)) is not None]].sum(0)

    def decode(self, found: list[Block]) -> list[bool]:
        """Viterbi: whether each block is of the main text."""
        if not found:
            return []
        e, back = self.emissions(found).tolist(), []
        (a, b), ((aa, ab), (ba, bb)) = e[0], self.moves.tolist()
        for x, y in e[1:]:
            from_a, from_b = (a + aa, b + ba), (a + ab, b + bb)
            back.append((from_a[1] > from_a[0], from_b[1] > from_b[0]))
            a, b = max(from_a) + x, max(from_b) + y
        label = b > a
        labels = [label]
        for step in reversed(back):
            label = step[label]
            labels.append(label)
        return labels[::-1]


def train_field(pages: list[tuple[list[Block], list[int]]], rounds: int = 12, rate: float = 0.3, ridge: float = 1e-4) -> Field:
    """Adaptive gradient ascent on the log-likelihood; expectations by forward-backward."""
    index: dict[str, int] = defaultdict(lambda: len(index))
    coded = [([[index[f] for f in (*b.element.features, *block_features(b, i / len(bs)))] for i, b in enumerate(bs)], np.array(ys)) for bs, ys in pages if bs]
    w, moves = np.zeros((len(index), 2)), np.zeros((2, 2))
    seen_w, seen_m = np.full(w.shape, 1e-8), np.full((2, 2), 1e-8)
    order = random.Random(11)
    for _ in range(rounds):
        order.shuffle(coded)
        for rows, y in coded:
            flat = np.array([i for r in rows for i in r])
            row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
            e = np.zeros((len(rows), 2))
            np.add.at(e, row, w[flat])
            alpha, beta = e.copy(), np.zeros_like(e)
            for i in range(1, len(e)):
                alpha[i] += np.logaddexp(alpha[i - 1, 0] + moves[0], alpha[i - 1, 1] + moves[1])
            for i in range(len(e) - 2, -1, -1):
                beta[i] = np.logaddexp(moves[:, 0] + e[i + 1, 0] + beta[i + 1, 0], moves[:, 1] + e[i + 1, 1] + beta[i + 1, 1])
            total = np.logaddexp(*alpha[-1])
            g = -np.exp(alpha + beta - total)
            g[np.arange(len(y)), y] += 1
            gw = np.zeros_like(w)
            np.add.at(gw, flat, g[row])
            gm = np.zeros((2, 2))
            if len(y) > 1:
                gm -= np.exp(alpha[:-1, :, None] + moves[None] + (e + beta)[1:, None, :] - total).sum(0)
                np.add.at(gm, (y[:-1], y[1:]), 1)
            touched = np.unique(flat)
            gw[touched] -= ridge * w[touched]
            seen_w[touched] += gw[touched] ** 2
            w[touched] += rate * gw[touched] / np.sqrt(seen_w[touched])
            seen_m += gm**2
            moves += rate * gm / np.sqrt(seen_m)
    return Field(dict(index), w, moves)


# Names that training pages give to their parts.
MAIN_NAMES = ("content", "main", "article", "post", "entry", "body", "story", "text", "article-body", "post-content", "entry-content", "main-content", "page-content", "articleBody", "richtext", "prose")
WRAPPERS = ("wrapper", "container", "page", "row", "inner", "layout", "site", "root", "app", "grid", "")
SIDE_NAMES = {
    "menu": ("nav", "menu", "navbar", "navigation", "main-menu", "breadcrumb", "breadcrumbs", "toc", "pagination", "tabs", "links", "skip"),
    "header": ("header", "masthead", "top", "topbar", "site-header", "logo", "branding", "hero-banner"),
    "footer": ("footer", "site-footer", "bottom", "copyright", "legal", "colophon", "imprint"),
    "side": ("sidebar", "aside", "widget", "related", "recommended", "popular", "trending", "more", "rail", "secondary", "tags", "share", "social", "author-bio", "sidebar-right"),
    "notice": ("notice", "cookie", "cookie-banner", "consent", "gdpr", "alert", "banner", "popup", "modal", "overlay", "message", "warning", "paywall", "disclaimer", "toast"),
    "advert": ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "promotion", "sponsor", "adsbox", "banner-ad", "partner"),
    "form": ("form", "search", "newsletter", "subscribe", "signup", "login", "contact-form", "subscription"),
    "comments": ("comments", "comment", "comment-list", "discussion", "replies", "reply", "responses", "disqus", "respond", "reader-comments", "user-comments"),
}
SIDE_TAGS = {"menu": ("nav", "div", "ul", "menu"), "header": ("header", "div"), "footer": ("footer", "div"), "side": ("aside", "div", "section"), "notice": ("div", "aside", "section", "p", "dialog"), "advert": ("div", "aside", "ins", "section"), "form": ("form", "div"), "comments": ("section", "div", "ol", "aside")}


def labelled_pages(n: int, seed: int = 5) -> list[tuple[str, list[str]]]:
    """Pages in varied layouts, each with the texts of its main blocks."""
    r = random.Random(seed)
    syllables = [a + b for a in "bcdfglmnprstv" for b in ("a", "e", "i", "o", "u", "an", "er")]
    word = lambda: "".join(r.choices(syllables, k=r.randint(1, 4)))

    def phrase(low, high, stop=True):
        t = " ".join(word() for _ in range(r.randint(low, high)))
        return t.capitalize() + (r.choice(".....!?") if stop else "")

    def prose(low=1, high=7):
        return " ".join(phrase(2, 22) for _ in range(r.randint(low, high)))

    def attr(names):
        name = r.choice(names)
        if not name:
            return ""
        name += r.choice(("", "", "", f" {word()}", f"-{r.randint(1, 9)}"))
        return r.choice((f' class="{name}"', f' class="{name}"', f' id="{name}"', f" class='{name}'"))

    def side(kind):
        tag = r.choice(SIDE_TAGS[kind])
        a = attr(SIDE_NAMES[kind]) if tag in ("div", "section", "p", "ul", "ol", "ins") or r.random() < 0.5 else ""
        link = lambda low=1, high=3: f'<a href="/{word()}">{phrase(low, high, False)}</a>'
        if kind == "menu" or kind in ("side", "footer") and r.random() < 0.4:
            inner = "".join(f"<li>{link()}</li>" for _ in range(r.randint(2, 9)))
            inner = inner if tag in ("ul", "menu", "ol") else f"<ul>{inner}</ul>" if r.random() < 0.7 else inner.replace("li>", "span> ")
        elif kind == "header":
            inner = r.choice((f"<h1>{link(1, 3)}</h1>", f'<div class="logo">{phrase(1, 3, False)}</div>', f"<p>{phrase(2, 8)}</p>", phrase(1, 4, False))) + (f"<nav>{''.join(link() for _ in range(4))}</nav>" if r.random() < 0.3 else "")
        elif kind == "footer":
            inner = r.choice((f"&copy; {r.randint(1999, 2026)} {phrase(1, 3, False)}", f"&copy; {word()}.example.com &middot; {phrase(2, 8)}", f"<p>{phrase(3, 14)}</p>", f"<p>{prose(1, 3)}</p>"))
        elif kind == "form":
            inner = f"<label>{phrase(1, 3, False)}</label><input name='q'><button>{phrase(1, 2, False)}</button>" + r.choice(("", f"<p>{phrase(3, 12)}</p>", f"<h3>{phrase(2, 5, False)}</h3>"))
        elif kind == "comments":
            one = lambda: r.choice((f'<div class="comment"><b>{word()}</b> <p>{prose(1, 3)}</p></div>', f"<li><cite>{word()}</cite> <p>{prose(1, 3)}</p></li>", f"<p>{prose(1, 2)}</p>"))
            inner = r.choice(("", f"<h3>{r.randint(1, 40)} {phrase(1, 2, False)}</h3>")) + "".join(one() for _ in range(r.randint(1, 5)))
        else:
            inner = r.choice((phrase(3, 14), f"<p>{prose(1, 3)}</p>", f"<h4>{phrase(1, 4, False)}</h4><p>{phrase(3, 12)}</p>", f"{phrase(3, 10)} {link()}"))
        return f"<{tag}{a}>{inner}</{tag}>"

    out = []
    for _ in range(n):
        truth: list[str] = []

        def say(text):
            truth.append(text)
            return html.escape(text, quote=False) if r.random() < 0.9 else text

        def body():
            kind = r.random()
            if kind < 0.72:
                text = prose(1, 8) if r.random() < 0.8 else phrase(1, 3) if r.random() < 0.5 else f"{word()} = {r.randint(10, 10**12)} {phrase(1, 6, False)}".lower()
                return f"<p>{say(text)}" + r.choice(("</p>", "</p>", "</p>", ""))
            if kind < 0.82:
                return f"<h{(k := r.randint(2, 4))}>{say(phrase(1, 7, False))}</h{k}>"
            if kind < 0.9:
                return "<ul>" + "".join(f"<li>{say(phrase(2, 14, r.random() < 0.5))}</li>" for _ in range(r.randint(2, 5))) + "</ul>"
            if kind < 0.95:
                return f"<blockquote>{say(prose(1, 3))}</blockquote>"
            return r.choice((f"<pre>{say(phrase(3, 9, False))}</pre>", f"<table><tr><td>{say(phrase(1, 4, False))}</td><td>{say(phrase(1, 4, False))}</td></tr></table>", f"<div>{say(prose(1, 4))}</div>"))

        title = phrase(3, 10, r.random() < 0.4)
        above = [side(r.choice(("menu", "menu", "header", "advert", "notice", "form"))) for _ in range(r.randint(0, 4))]
        below = [side(r.choice(("footer", "footer", "comments", "side", "menu", "advert", "form", "notice"))) for _ in range(r.randint(0, 5))]
        heading = f"<h1>{say(title)}</h1>" if r.random() < 0.85 else ""
        middle = [body() for _ in range(r.randint(1, 14))]
        for _ in range(r.choice((0, 0, 0, 1, 2))):
            middle.insert(r.randint(0, len(middle)), side(r.choice(("advert", "notice", "side", "form", "menu"))))
        if r.random() < 0.15:
            middle.append(side("comments"))
        tag = r.choice(("article", "article", "article", "main", "div", "div", "section"))
        a = attr(MAIN_NAMES) if tag in ("div", "section") or r.random() < 0.3 else ""
        core = f"<{tag}{a}>{heading}{''.join(middle)}" + (f"</{tag}>" if r.random() < 0.9 else "")
        if r.random() < 0.4:
            core = f"<main>{core}</main>" if r.random() < 0.5 else f"<div{attr(MAIN_NAMES)}>{core}</div>"
        page = "".join(above) + core + "".join(below)
        for _ in range(r.randint(0, 2)):
            page = f"<div{attr(WRAPPERS)}>{page}</div>"
        out.append((f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style></head><body>{page}</body></html>", truth))
    return out


@functools.lru_cache(2)
def trained_field(pages: int = 700) -> Field:
    """The field of labelled_pages(): a block is of the main text if the page's labels list it."""
    rows = []
    for page, truth in labelled_pages(pages):
        found, rest, labels = blocks(page), [" ".join(t.split()) for t in truth], []
        for b in found:
            hit = bool(rest) and b.text == rest[0]
            labels.append(int(hit))
            if hit:
                rest.pop(0)
        if not rest:
            rows.append((found, labels))
    return train_field(rows)


def main_text(page: str | None, field: Field) -> str:
    found = blocks(page, field.index) if page else []
    return " ".join(b.text for b, main in zip(found, field.decode(found), strict=True) if main)


def extract_main_text(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """One row for each input row: page_id, url, text, n_chars (code points).

    Null and empty pages, and pages without main text, give an empty text. Null ids and urls stay null. Each row is taken
    by itself: repeated rows have repeated results. An empty table gives no rows. Other columns are not read.
    """
    spark = pages.sparkSession
    prepare(spark)
    model = spark.sparkContext.broadcast(field or trained_field())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [main_text(p, model.value) for p in batch.column(2).to_pylist()]
            columns = [batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
