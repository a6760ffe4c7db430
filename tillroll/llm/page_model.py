"""Operator 10, main text of web pages by a tree-structured graphical model.

A page is parsed into its tree of block elements.  Each element has a hidden label, content or not.
Unary potentials weigh the element's own tag, class and id words, text length, link share and
sentence marks; pairwise potentials join each element to its parent, by the kind of the child's tag.
Sum-product messages go from the leaves to the root and back, which gives exact marginals on a
tree; an element's own text belongs to the main text if its marginal is at least one half.  All pages of
a batch pass their messages together, one tree level at a time.  Weights are trained by the exact likelihood
gradient on labelled pages: pages whose elements bear ``data-content="1"`` or ``"0"`` (inherited);
``labelled_pages`` makes the default ones by rule from common layouts.

Text: character references are decoded, a ``br`` is white space, white space in a block becomes one space,
blocks are joined in page order by a newline; text on either side of an inner block is two blocks.
Scripts, styles, comments, templates and form fields hold no text.

Defined results: null or empty html, and pages without content, give an empty text; unclosed tags
end where HTML ends them or at the end of the page; a ``<`` with no ``>`` behind it is text, and pages take linear time; extra columns are ignored; rows with null
ids are extracted all the same; an empty table gives no rows.  Nothing is cut off.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .words import slices

_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>")
_DECLARATION = re.compile(r"<[!?/][^>]*>")
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|data-content)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPLIT = re.compile(r"[^a-z]+")
_SPACES = re.compile(r"\s+")
# fixed values of HTML: elements without text, without an end tag, and those that form no block
NO_TEXT = frozenset("script style noscript template iframe svg textarea select object title canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike "
                   "strong sub sup time tt u var".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu "
                     "nav ol p pre section table ul".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
        "option": ("option",), "body": ("head",)}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}
GROUPS = {t: i + 1 for i, ts in enumerate((("nav", "menu"), ("header",), ("footer",), ("aside",), ("form", "fieldset", "button"), ("article", "main"),
                                            ("p", "blockquote", "pre", "figure", "figcaption", "td", "th", "tr", "table", "tbody"),
                                            ("li", "ul", "ol", "dl", "dt", "dd"), ("h1", "h2", "h3", "h4", "h5", "h6"), ("div", "section"))) for t in ts}
SLOTS = 1 << 12
KINDS = 11


class Page:
    """Block elements (tag, attribute words, parent, depth) and the runs of text in page order."""

    __slots__ = ("tags", "names", "parents", "depths", "labels", "runs", "linked", "own")

    def __init__(self, source: str):
        self.tags, self.names, self.parents, self.depths, self.labels = ["#root"], [()], [-1], [0], [0]
        self.runs: list[tuple[int, list[str]]] = []
        self.own, self.linked = [0], [0]
        self._parse(source)

    def _parse(self, source: str) -> None:
        stack, link, at, end, last = [0], False, 0, len(source), -1
        places: dict[str, list[int]] = {}  # where each tag stands in the stack
        final = source.rfind(">")  # no tag begins behind it
        while at < end:
            lt = source.find("<", at)
            if lt != at:
                piece = source[at:lt if lt >= 0 else end]
                self._text(stack[-1], piece, link, last)
                last = stack[-1]
                if lt < 0:
                    break
            if source.startswith("<!--", lt):
                stop = source.find("-->", lt + 4)
                at = end if stop < 0 else stop + 3
                continue
            m = (_TAG.match(source, lt) or _LOOSE.match(source, lt)) if lt < final else None
            if m is None:
                m = _DECLARATION.match(source, lt) if lt < final else None
                if m is None:
                    self._text(stack[-1], "<", link, last)
                    last, at = stack[-1], lt + 1
                else:
                    at = m.end()
                continue
            at, tag, closing = m.end(), m.group(2).lower(), bool(m.group(1))
            if tag in NO_TEXT:
                if not closing and not m.group(3).endswith("/"):
                    stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(source, at)
                    at = end if stop is None else stop.end()
            elif tag == "a":
                link = not closing
            elif tag == "br":
                self._text(stack[-1], " ", link, last)
            elif tag == "hr":
                last = -1
            elif tag in INLINE or tag in VOID:
                continue
            elif closing:
                if places.get(tag):
                    self._close(stack, places, places[tag][-1])
                    link = False
                last = -1
            else:
                link, last = False, -1
                if tag in CLOSES_P:
                    self._pop(stack, places, ("p",), ())
                if tag in SAME:
                    self._pop(stack, places, SAME[tag], SCOPE.get(tag, ()))
                if len(tag) == 2 and tag[0] == "h" and self.tags[stack[-1]] in ("h1", "h2", "h3", "h4", "h5", "h6"):
                    self._close(stack, places, len(stack) - 1)
                words, label = [], self.labels[stack[-1]]
                for a in _ATTRIBUTE.finditer(m.group(3)) if m.group(3) else ():
                    value = a.group(2) or a.group(3) or a.group(4) or ""
                    if a.group(1).lower() == "data-content":
                        label = int(value == "1")
                    else:
                        words += [w for w in _SPLIT.split(value.lower()) if w]
                self.tags.append(tag)
                self.names.append(tuple(dict.fromkeys(words)))
                self.parents.append(stack[-1])
                self.depths.append(self.depths[stack[-1]] + 1)
                self.labels.append(label)
                self.own.append(0)
                self.linked.append(0)
                if not m.group(3).endswith("/"):
                    places.setdefault(tag, []).append(len(stack))
                    stack.append(len(self.tags) - 1)

    def _close(self, stack: list[int], places: dict[str, list[int]], depth: int) -> None:
        for node in stack[depth:]:
            places[self.tags[node]].pop()
        del stack[depth:]

    def _pop(self, stack: list[int], places: dict[str, list[int]], which: tuple, scope: tuple) -> None:
        """Close the innermost open element of ``which``, unless one of ``scope`` is nearer (without a scope, unless any but
        paragraphs and items is)."""
        nearest = lambda tags: max((places[t][-1] for t in tags if places.get(t)), default=0)
        depth = nearest(which)
        if not depth or depth < nearest(scope):
            return
        if scope or all(self.tags[i] in ("p", "li", "dt", "dd", "head") for i in stack[:depth:-1]):
            self._close(stack, places, depth)

    def _text(self, node: int, piece: str, link: bool, last: int) -> None:
        if last == node and self.runs:
            self.runs[-1][1].append(piece)
        else:
            self.runs.append((node, [piece]))
        n = len(piece.strip())
        self.own[node] += n
        if link:
            self.linked[node] += n

    def blocks(self) -> list[tuple[int, str]]:
        out = []
        for node, pieces in self.runs:
            text = "".join(pieces)
            if "&" in text:
                text = entities.unescape(text)
            text = _SPACES.sub(" ", text).strip()
            if text:
                out.append((node, text))
        return out


_SLOT_OF: dict[str, int] = {}


def _slot(name: str) -> int:
    slot = _SLOT_OF.get(name)
    if slot is None:
        slot = zlib.crc32(name.encode()) % SLOTS
        if len(_SLOT_OF) < 20_000:
            _SLOT_OF[name] = slot
    return slot


def page_features(page: Page, blocks: list[tuple[int, str]]) -> tuple[list[int], list[int]]:
    """(element, slot) pairs of all features of a page."""
    n = len(page.tags)
    size, linked, marks = page.own[:], page.linked[:], [0] * n
    for node, text in blocks:
        marks[node] += text.count(". ") + text.endswith((".", "!", "?"))
    own_marks = marks[:]
    for i in range(n - 1, 0, -1):  # children come after their parents
        p = page.parents[i]
        size[p] += size[i]
        linked[p] += linked[i]
    nodes, slots = [], []
    for i in range(n):
        tag, up = page.tags[i], page.tags[page.parents[i]] if i else ""
        own = page.own[i]
        mine = ["t" + tag, f"tp{tag}>{up}", f"o{min(own.bit_length(), 9)}", f"l{4 * page.linked[i] // own if own else 9}",
                f"s{min(size[i].bit_length(), 12)}", f"x{4 * linked[i] // size[i] if size[i] else 9}", f"m{min(own_marks[i], 3)}",
                f"d{min(page.depths[i], 6)}"]
        mine += ["c" + w for w in page.names[i]]
        nodes += [i] * len(mine)
        slots += map(_slot, mine)
    return nodes, slots


class Forest:
    """The trees of several pages as arrays, in levels."""

    def __init__(self, pages: list[tuple[Page, list[tuple[int, str]]]]):
        first = np.cumsum([0] + [len(p.tags) for p, _ in pages])
        self.first = first
        self.parent = np.concatenate([np.array(p.parents) + f for (p, _), f in zip(pages, first, strict=False)] or [np.zeros(0, int)]).astype(np.int64)
        self.depth = np.concatenate([p.depths for p, _ in pages] or [np.zeros(0, int)]).astype(np.int64)
        self.kind = np.concatenate([[GROUPS.get(t, 0) for t in p.tags] for p, _ in pages] or [np.zeros(0, int)]).astype(np.int64)
        self.truth = np.concatenate([p.labels for p, _ in pages] or [np.zeros(0, int)]).astype(np.int64)
        both = [page_features(p, b) for p, b in pages]
        self.node = np.concatenate([np.array(n) + f for (n, _), f in zip(both, first, strict=False)] or [np.zeros(0, int)]).astype(np.int64)
        self.slot = np.concatenate([s for _, s in both] or [np.zeros(0, int)]).astype(np.int64)
        order = np.argsort(self.depth, kind="stable")
        cuts = np.searchsorted(self.depth[order], np.arange(self.depth.max(initial=-1) + 2))
        self.levels = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


@dataclass
class TreeModel:
    unary: np.ndarray  # SLOTS: log-odds of content
    pair: np.ndarray   # KINDS x parent label x child label

    def marginals(self, f: Forest) -> tuple[np.ndarray, np.ndarray]:
        """(P(content) of each element, joint of each element's parent and own label), by sum-product."""
        n = len(f.depth)
        potential = np.zeros((n, 2))
        potential[:, 1] = np.bincount(f.node, weights=self.unary[f.slot], minlength=n)
        up, below = np.zeros((n, 2)), potential.copy()
        for level in f.levels[:0:-1]:
            through = below[level][:, None, :] + self.pair[f.kind[level]]
            message = np.logaddexp(through[:, :, 0], through[:, :, 1])
            message -= message.max(axis=1, keepdims=True)
            up[level] = message
            np.add.at(below, f.parent[level], message)
        above = np.zeros((n, 2))
        joint = np.zeros((n, 2, 2))
        for level in f.levels[1:]:
            p = f.parent[level]
            outside = above[p] + below[p] - up[level]  # all of the parent but this child
            through = outside[:, :, None] + self.pair[f.kind[level]]
            message = np.logaddexp(through[:, 0], through[:, 1])
            above[level] = message - message.max(axis=1, keepdims=True)
            both = through + below[level][:, None, :]
            both = np.exp(both - both.max(axis=(1, 2), keepdims=True))
            joint[level] = both / both.sum(axis=(1, 2), keepdims=True)
        belief = above + below
        return 1.0 / (1.0 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -700, 700))), joint


def train(sources: list[str], steps: int = 200, rate: float = 0.1, decay: float = 2e-3) -> TreeModel:
    pages = [(p, p.blocks()) for p in map(Page, sources)]
    f = Forest(pages)
    model = TreeModel(np.zeros(SLOTS), np.zeros((KINDS, 2, 2)))
    inner = np.flatnonzero(f.depth > 0)
    seen = np.zeros((KINDS, 2, 2))
    np.add.at(seen, (f.kind[inner], f.truth[f.parent[inner]], f.truth[inner]), 1)
    moments = [[np.zeros(SLOTS), np.zeros(SLOTS)], [np.zeros((KINDS, 2, 2)), np.zeros((KINDS, 2, 2))]]
    n = max(1, len(pages))
    for step in range(1, steps + 1):
        content, joint = model.marginals(f)
        expected = np.zeros((KINDS, 2, 2))
        np.add.at(expected, f.kind[inner], joint[inner])
        grads = (np.bincount(f.slot, weights=(f.truth - content)[f.node], minlength=SLOTS) / n - decay * model.unary,
                 (seen - expected) / n - decay * model.pair)
        for weights, g, m in zip((model.unary, model.pair), grads, moments, strict=True):  # Adam
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.99 * m[1] + 0.01 * g * g
            weights += rate * (m[0] / (1 - 0.9 ** step)) / (np.sqrt(m[1] / (1 - 0.99 ** step)) + 1e-8)
    return model


def main_texts(model: TreeModel, sources: list[str | None]) -> list[str]:
    pages = [(p, p.blocks()) for p in (Page(s or "") for s in sources)]
    f = Forest(pages)
    content, _ = model.marginals(f)
    return ["\n".join(text for node, text in blocks if content[start + node] >= 0.5)
            for (_, blocks), start in zip(pages, f.first, strict=False)]


def labelled_pages(count: int = 700, seed: int = 21) -> list[str]:
    """Pages of common layouts with labelled elements; words are random, so that only form counts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 9)))
    sentence = lambda a=4, b=16: " ".join(word() for _ in range(rng.randint(a, b))).capitalize() + "."
    prose = lambda a=1, b=6: " ".join(sentence() for _ in range(rng.randint(a, b)))
    links = lambda n: "".join(f"<li><a href=\"/{word()}\">{word()}</a></li>" for _ in range(rng.randint(2, n)))
    attr = lambda *names: rng.choice([f" class=\"{rng.choice(names)}\"", f" id=\"{rng.choice(names)}\"", f" class=\"{rng.choice(names)} {word()}\""])
    junk = (
        lambda: f"<nav data-content=0><ul>{links(8)}</ul></nav>",
        lambda: f"<div{attr('menu', 'navbar', 'breadcrumbs', 'nav')} data-content=0><ul>{links(6)}</ul></div>",
        lambda: f"<header data-content=0><h1>{word()}</h1><p>{sentence()}</p></header>",
        lambda: f"<div{attr('header', 'masthead', 'top', 'logo')} data-content=0><p>{sentence(1, 6)}</p></div>",
        lambda: f"<footer data-content=0>&copy; {word()}.org &middot; {prose(1, 2)}</footer>",
        lambda: f"<footer data-content=0><p>{prose(1, 3)}</p><ul>{links(4)}</ul></footer>",
        lambda: f"<div{attr('footer', 'copyright', 'legal')} data-content=0><p>{sentence()}</p></div>",
        lambda: f"<aside data-content=0><h3>{word()}</h3><p>{prose(1, 4)}</p></aside>",
        lambda: f"<div{attr('sidebar', 'widget', 'related', 'recommended', 'popular')} data-content=0><h3>{word()}</h3><p>{prose(1, 3)}</p><ul>{links(5)}</ul></div>",
        lambda: f"<div{attr('ad', 'ads', 'advert', 'advertisement', 'sponsored', 'promo', 'banner')} data-content=0>{prose(1, 4)}</div>",
        lambda: f"<div{attr('ad', 'advert', 'promo', 'sponsor')} data-content=0><p>{prose(1, 3)}</p></div>",
        lambda: f"<div{attr('cookie', 'cookies', 'notice', 'consent', 'gdpr', 'alert', 'banner', 'popup', 'modal')} data-content=0><p>{prose(1, 3)}</p><button>{word()}</button></div>",
        lambda: f"<div role=\"{rng.choice(['alert', 'dialog', 'banner', 'navigation', 'complementary', 'contentinfo'])}\" data-content=0><p>{prose(1, 2)}</p></div>",
        lambda: f"<form{rng.choice(['', attr('search', 'newsletter', 'login', 'subscribe')])} data-content=0><p>{sentence()}</p><label>{word()}</label><input name=q><button>{word()}</button></form>",
        lambda: f"<div{attr('share', 'social', 'tags', 'meta', 'byline', 'pagination')} data-content=0><a href=#>{word()}</a> <a href=#>{word()}</a></div>",
        lambda: "<section" + attr("comments", "comment", "replies", "discussion", "responses") + " data-content=0>" + f"<h2>{word()}</h2>"
        + "".join(f"<div{attr('comment', 'reply')}><p>{prose(1, 4)}</p></div>" for _ in range(rng.randint(1, 4))) + "</section>",
        lambda: "<div" + attr("comments", "comment-list", "respond") + " data-content=0><ul>" + "".join(f"<li>{rng.choice(['', '<p>'])}{prose(1, 3)}</li>" for _ in range(rng.randint(1, 4))) + "</ul></div>",
    )
    body = (lambda: f"<p>{prose()}</p>", lambda: f"<p>{prose()}</p>", lambda: f"<p>{prose()}", lambda: f"<p><b>{prose()}<br>", lambda: f"<h2>{sentence(1, 5)}</h2>",
            lambda: f"<p>{word()}.</p>", lambda: f"<p>{sentence(1, 3)}</p>", lambda: f"<ul>{''.join(f'<li>{sentence()}</li>' for _ in range(rng.randint(1, 4)))}</ul>",
            lambda: f"<ol>{''.join(f'<li>{prose(1, 2)}</li>' for _ in range(rng.randint(1, 4)))}</ol>", lambda: f"<blockquote><p>{prose(1, 2)}</p></blockquote>",
            lambda: f"<p>{sentence()} <a href=/{word()}>{word()} {word()}</a> {prose(1, 2)}</p>", lambda: f"<pre>{prose(1, 2)}</pre>",
            lambda: f"<table><tr><td>{word()}</td><td>{sentence()}</td></tr></table>", lambda: f"<div>{prose(1, 3)}</div>", lambda: f"<figure><figcaption>{sentence()}</figcaption></figure>")
    frames = (("<article{}>", "</article>", ""), ("<article{}>", "</article>", ""), ("<main{}>", "</main>", ""), ("<div{}>", "</div>", attr("content", "article", "main", "story")),
              ("<div{}>", "</div>", attr("post", "entry", "body", "text")), ("<section{}>", "</section>", attr("content", "article", "post")))
    out = []
    for _ in range(count):
        start, stop, name = rng.choice(frames)
        if name:
            name = attr("content", "article", "main", "story", "post", "entry", "body", "text")
        inner = [f"<h1>{sentence(2, 9)}</h1>"] if rng.random() < 0.8 else []
        for _ in range(rng.randint(1, 9)):
            inner.append(rng.choice(junk[7:])() if rng.random() < 0.25 else rng.choice(body)())
        main = start.format(name + " data-content=1") + "".join(inner) + stop
        if rng.random() < 0.2:
            main = f"<div{attr('wrapper', 'container', 'page', 'layout')}>{main}</div>"
        before = [rng.choice(junk[:16])() for _ in range(rng.randint(0, 4))]
        after = [rng.choice(junk[4:])() for _ in range(rng.randint(0, 4))]
        out.append(f"<!DOCTYPE html><html><head><meta charset=utf-8><title>{sentence(2, 8)}</title></head><body>{''.join(before)}{main}{''.join(after)}"
                   + rng.choice(["</body></html>", ""]))
    return out


def extract(pages: DataFrame, model: TreeModel, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The ``keep`` columns and the main text."""
    rows = pages.select(*(pages[c] for c in keep), pages[html].alias("_html"))
    head = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, len(keep), max_bytes=1 << 20):
            yield pa.RecordBatch.from_arrays(
                [*(piece.column(i) for i in range(len(keep))), pa.array(main_texts(model, piece.column(len(keep)).to_pylist()), pa.string())],
                names=[*keep, "text"])

    return rows.mapInArrow(run, f"{head}text string")
