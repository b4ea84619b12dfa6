"""Main text of web pages by the maximum-scoring subsequence.

A page is a sequence of words and tags. Words score by the log odds that they are main text, tags cost
what the labels make of them, and a linear scan finds the contiguous stretch of the highest sum; of it,
words that are likelier no main text (an advert in the middle) are left out. The odds are those of a
logistic regression over the structure of a block: its element and those around it, their names, its
words and signs, and how much of it and of the boxes around it is links and tags. Costs and scales
are chosen by how well they do on the labelled pages, which `labelled_pages` makes of a bounded number
of templates (`TEMPLATES`, two pages each).

What a browser doesn't show is never text: scripts, styles, titles, elements that are hidden by the
attribute `hidden`, by aria-hidden or by display or visibility in their style.

Blocks: character references are decoded, white space inside a block becomes one space, blocks are
joined in page order by one space.

Defined results: null and empty pages, and pages without words, give an empty text; unclosed and
stray tags are borne; a page cut off in a tag or comment ends there; other columns pass through, an
own column named like a result gives way; an empty table has no rows.
"""

from __future__ import annotations

import html as references
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewise.llm.common import logistic, with_result
from clausewise.llm.labelled_pages import pages as labelled

NAMES = ("text", "n_chars")
#: Templates of labelled pages that weights are learned from.
TEMPLATES = 200
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>(?:[\s/]+|=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]*)|[^\s=>/]+)*))(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=>/]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
NAME = re.compile(r"[a-z]+")
#: Elements whose content is never text, nor markup.
RAW = {"script", "style", "title", "noscript", "template", "textarea", "iframe", "svg", "math", "object"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
#: Elements that a new block closes.
OPEN_ENDED = {"p", "h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that another of their kind closes, unless one of these stands between.
ITEMS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
#: Elements that say what their content is.
TELLING = {"nav", "header", "footer", "aside", "form", "article", "main", "figure", "dialog", "label", "button", "select", "table", "blockquote", "pre"}
MAIN = {"article", "main"}
HIDING = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
END = ".!?:;…\"'»”)"


class Element:
    """An open element with what it says of itself, and what its content adds up to."""

    __slots__ = ("children", "hidden", "label", "linked", "links", "main", "makes", "names", "parent", "tag", "tags", "words")

    def __init__(self, tag: str, attributes: str, parent: Element | None) -> None:
        self.tag, self.parent = tag, parent
        self.names: tuple[str, ...] = ()
        self.hidden = bool(parent and parent.hidden)
        self.label = parent.label if parent else None
        self.linked = tag == "a" or bool(parent and parent.linked)
        self.children: list[Element] = []
        self.makes: Counter | None = None  # of its children, when they are asked for
        if parent is not None:
            parent.children.append(self)
        self.main = tag in MAIN or bool(parent and parent.main)
        self.words = self.links = self.tags = 0
        if attributes and not attributes.isspace():
            for m in ATTRIBUTE.finditer(attributes):
                key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
                if key in ("class", "id", "role"):
                    self.names += tuple(NAME.findall(value.lower()))
                elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and HIDING.search(value):
                    self.hidden = True
                elif key in ("data-main", "data-rest"):
                    self.label = key == "data-main"


@dataclass
class Atom:
    kind: str  # word, space, tag
    what: str
    element: Element
    block: int
    words: int = 0


def atoms(page: str) -> list[Atom]:
    """The page's sequence, without what isn't shown; elements know their words, links and tags."""
    root = Element("", "", None)
    stack = [root]
    out: list[Atom] = []
    block = at = 0
    while True:
        m = TAG.search(page, at)
        run = page[at : m.start() if m else len(page)]
        top = stack[-1]
        if run and not top.hidden:
            n = len(run.split())
            out.append(Atom("word" if n else "space", run, top, block, n))
            e = top
            while n and e is not None:
                e.words += n
                e.links += n * top.linked
                e = e.parent
        if not m:
            return out
        at = m.end()
        closing, name, attributes = m[1], (m[2] or "").lower(), m[3]
        if not name:
            continue
        inline = name in INLINE
        block += not inline
        if name in RAW:
            if not closing and not (name in ("svg", "math") and attributes.endswith("/")):  # self-closed, they hold nothing
                end = re.compile(rf"</{re.escape(name)}\s*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == name:
                    del stack[i:]
                    break
                if inline and stack[i].tag not in INLINE:
                    break
        else:
            if not inline:  # a block ends the paragraph before it, and inline elements that the paragraph holds
                k = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag not in INLINE), 0)
                if k and stack[k].tag in OPEN_ENDED:
                    del stack[k:]
            if name in ITEMS:
                k = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == name or stack[i].tag in ITEMS[name]), 0)
                if k and stack[k].tag == name:
                    del stack[k:]
            if name not in VOID and not attributes.endswith("/"):
                stack.append(Element(name, attributes, stack[-1]))
        if not stack[-1].hidden:
            out.append(Atom("tag", name, stack[-1], block))
            e = stack[-1]
            while e is not None:
                e.tags += 1
                e = e.parent


def grade(x: float, steps: tuple[float, ...]) -> int:
    return sum(x >= s for s in steps)


SHARES, COUNTS = (0.001, 0.25, 0.5, 0.8), (3, 6, 10, 16, 30, 60)


def make(e: Element) -> tuple[str, ...]:
    return (e.tag, *[c.tag for c in e.children])


def alike(e: Element) -> int:
    """How many of the elements beside it are of the same make: several children, of the same tags."""
    if len({c.tag for c in e.children}) < 2 or e.parent is None:
        return 0
    if e.parent.makes is None:
        e.parent.makes = Counter(map(make, e.parent.children))
    return e.parent.makes[make(e)]


def around(e: Element) -> Iterator[Element]:
    while e is not None:
        yield e
        e = e.parent


def features(e: Element, text: str, words: int, links: int, total: int, main: int) -> list[str]:
    """What is known of a block of an element (not inline): `words` in it, `links` of them in links; `total` on the page, `main` of them in its articles."""
    chain = list(around(e))
    parents = [x for x in chain[1:] if x.tag not in INLINE and x.tag not in ("", "html")]
    out = [f"tag={e.tag or 'body'}", f"words={grade(words, COUNTS)}", f"linked={grade(links / words, SHARES)}", f"ends={text.rstrip()[-1:] in END}", f"comma={',' in text}", f"right={'©' in text or '&copy;' in text}"]
    for i, x in enumerate(parents[:3]):
        out += [f"up{i}:linked={grade(x.links / max(1, x.words), SHARES)}", f"up{i}:share={grade(x.words / total, (0.05, 0.2, 0.4, 0.7))}", f"up{i}:tags={grade(x.tags / max(1, x.words), (0.05, 0.1, 0.2, 0.5))}"]
    for i, x in enumerate(parents[:2]):
        out.append(f"up{i}:alike={grade(alike(x), (2, 4))}")
    tags = {x.tag for x in chain}
    out += [f"in={t}" for t in tags & TELLING]
    if not tags & MAIN:
        out.append(f"out-main={grade(main / total, (0.001, 0.3, 0.6))}")
    else:
        out += [f"in-main={t}" for t in tags & TELLING - MAIN]
        out.append(f"in-main={grade(main / total, (0.3, 0.6))}")
    out += [f"is={n}" for x in chain for n in set(x.names)]
    return list(dict.fromkeys(out))


def blocks(page: str) -> tuple[list[Atom], list[tuple[list[Atom], list[str]]]]:
    """The atoms, and each block's words with its features."""
    parts = atoms(page)
    total = max(1, sum(a.words for a in parts))
    main = sum(a.words for a in parts if a.element.main)
    own: dict[int, list[Atom]] = {}
    for a in parts:
        if a.kind == "word":
            own.setdefault(a.block, []).append(a)
    out = []
    for runs in own.values():
        holder = runs[0].element
        while holder.tag in INLINE and holder.parent is not None:
            holder = holder.parent
        text = "".join(a.what for a in runs)
        n = sum(a.words for a in runs)
        out.append((runs, features(holder, text, n, sum(a.words for a in runs if a.element.linked), total, main)))
    return parts, out


@dataclass
class Weights:
    odds: dict[str, float]
    base: float
    costs: dict[str, float]
    rest: float = 1.0  # scale of words that are likelier no main text
    tag: float = 1.0  # scale of tags

    def scores(self, page: str) -> tuple[list[Atom], list[float]]:
        """The sequence, and for each word the log odds that it is main text (0 for others)."""
        parts, found = blocks(page)
        of: dict[int, float] = {}
        for runs, known in found:
            s = self.base + sum(self.odds.get(f, 0.0) for f in known)
            for a in runs:
                of[id(a)] = max(-4.0, min(4.0, s))
        return parts, [of.get(id(a), 0.0) for a in parts]

    def region(self, parts: list[Atom], odds: list[float]) -> tuple[int, int]:
        """The stretch of the highest sum."""
        best, span, total, start = 0.0, (0, 0), 0.0, 0
        for i, (a, s) in enumerate(zip(parts, odds, strict=True)):
            if total <= 0:
                total, start = 0.0, i
            total += -self.tag * self.costs.get(a.what, 1.0) if a.kind == "tag" else a.words * s * (1.0 if s > 0 else self.rest)
            if total > best:
                best, span = total, (start, i + 1)
        return span


@lru_cache(2)
def weights(templates: int = TEMPLATES, half: int | None = None) -> Weights:
    """Learned from labelled pages: block odds by logistic regression, tag costs by their frequency, scales by the words they get right."""
    pages = labelled(templates, half=half)
    read = [blocks(p) for p in pages]
    rows = [(known, sum(a.words for a in runs), bool(runs[0].element.label)) for _, found in read for runs, known in found]
    often = Counter(f for known, _, _ in rows for f in known)
    place = {f: i for i, f in enumerate(sorted(f for f, n in often.items() if n >= 8))}
    x = np.zeros((len(rows), len(place)))
    for i, (known, _, _) in enumerate(rows):
        x[i, [place[f] for f in known if f in place]] = 1
    w = logistic(x, np.array([y for *_, y in rows], dtype=float), np.sqrt([n for _, n, _ in rows]), ridge=1.0, steps=30)
    tags = {True: Counter(), False: Counter()}
    for parts, _ in read:
        for a in parts:
            if a.kind == "tag":
                tags[bool(a.element.label)][a.what] += 1
    total = {k: sum(t.values()) for k, t in tags.items()}
    costs = {t: min(3.0, max(0.2, 1 + math.log((tags[False][t] + 0.5) / total[False] * total[True] / (tags[True][t] + 0.5)))) for t in tags[True].keys() | tags[False].keys()}
    out = Weights({f: float(w[i]) for f, i in place.items()}, float(w[-1]), costs)
    scored = [out.scores(p) for p in pages[::3]]

    def right(rest: float, tag: float) -> float:
        tried, total = Weights(out.odds, out.base, out.costs, rest, tag), 0.0
        for parts, odds in scored:
            total += measure(parts, odds, tried.region(parts, odds))[2]
        return total

    out.rest, out.tag = max(((rest, tag) for rest in (1.0, 0.3, 0.1, 0.03) for tag in (1.0, 0.3, 0.1)), key=lambda k: right(*k))
    return out


def measure(parts: list[Atom], odds: list[float], span: tuple[int, int]) -> tuple[float, float, float]:
    """Precision, recall and F1 of the words that are kept, on a labelled page."""
    kept = true = both = 0
    for i, a in enumerate(parts):
        if a.kind == "word":
            keep, want = span[0] <= i < span[1] and odds[i] > 0, bool(a.element.label)
            kept, true, both = kept + keep * a.words, true + want * a.words, both + (keep and want) * a.words
    p, r = both / kept if kept else 1.0, both / true if true else 1.0
    return p, r, 2 * p * r / (p + r) if p + r else 0.0


def extract(page: str | None, known: Weights | None = None) -> str:
    if not page:
        return ""
    known = known or weights()
    parts, odds = known.scores(page)
    first, last = known.region(parts, odds)
    kept: dict[int, list[str]] = {}
    for a, s in zip(parts[first:last], odds[first:last], strict=True):
        if a.kind == "space" or a.kind == "word" and s > 0:
            kept.setdefault(a.block, []).append(a.what)
    joined = (" ".join(references.unescape("".join(runs)).split()) for _, runs in sorted(kept.items()))
    return " ".join(t for t in joined if t)


def main_text(pages: DataFrame) -> DataFrame:
    """pages with text and n_chars."""
    known = weights()  # learned once, on the driver; a few hundred numbers

    @F.pandas_udf("text string, n_chars long")
    def of(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in it:
            texts = [extract(p, known) for p in batch]
            yield pd.DataFrame({"text": pd.Series(texts, dtype=object), "n_chars": pd.Series([len(t) for t in texts], dtype="int64")})

    return with_result(pages, of("html"), NAMES)
