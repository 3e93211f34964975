"""Main text of web pages by maximum-scoring subsequence.

A page is read as words and tags in order. A word scores -log P(outside | word), which is positive; a tag, and a word of a link, scores
log P(inside | tag), which is negative; the shares of words and tags inside and outside main texts are counted on labelled pages. One linear
scan finds the contiguous region with the best sum. Where a page marks its content itself (main, article), the sequence is what the outermost of those hold, one after
another, and words of links count as words; else it is the body. An element that the labelled pages speak against (menu, header, footer, sidebar, notice, advert, form, comments) counts
as one tag and is left out of the text: its evidence is summed over its own name and all the names in its class, id and role, so that no single word
decides; an article's own plain header stays. The words of one text node score alike, so a region's ends always fall between nodes and whole nodes are scored at once.

Character references are decoded; white space becomes one space; block elements and line breaks separate, inline tags do not.

Defined cases: null, empty and wordless pages give an empty text; text without any tag is its own main text; unclosed elements end with the page,
unclosed comments, scripts and tags take the rest; a quote that is never closed is an ordinary character of its tag; repeated rows are read each; an
empty table gives an empty result. Time grows in proportion to the page, whatever its markup.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._common import map_rows
from .html_labels import PAGES

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile("[>\"']")
_ATTR = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_PART = re.compile(r"[^\W_]+")
#: A number that no character has; html.unescape cannot read very long ones.
_TOO_LONG = re.compile(r"&#[0-9]{9,};?")

#: Fixed values of HTML: elements whose content is no text, inline elements, elements without content, and those that end where the next begins.
RAW = {n: re.compile(rf"</{n}[\s/>]", re.IGNORECASE) for n in "script style noscript template iframe svg textarea title".split()}
INLINE = set("a abbr acronym b bdi bdo big cite code data dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr del".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SELF_CLOSED = set("p li td th tr dt dd option".split())
ROOTS, MARKED = {"html", "body", "main"}, {"main", "article"}
_MARKED = re.compile(r"<(?:main|article)[\s/>]", re.IGNORECASE)
ANCHORS = {"h1", "h2", "h3", "h4", "h5", "h6", "section"}  # their ids are made from headings
#: An element is no part of an article where its evidence falls below this (natural logarithm).
OUT = -2.5
#: A name seen so often, a tag seen so often, counts half.
FEW, FEW_TAGS = 4, 20


def _tag_end(page: str, at: int, last: dict[str, int]) -> int:
    """Where the tag's closing bracket stands; brackets inside quotes do not count."""
    while m := _STOP.search(page, at):
        c = m[0]
        if c == ">":
            return m.start()
        at = page.index(c, m.end()) + 1 if last[c] >= m.end() else m.end()
    return len(page)


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("open", name, attributes), ("close", name, "") and ("note", comment, "") in page order."""
    last = {q: page.rfind(q) for q in "\"'"}
    n, at, begun = len(page), 0, 0
    while (lt := page.find("<", at)) >= 0:
        named, mark = _NAME.match(page, lt), page[lt + 1 : lt + 2]
        if not named and mark not in ("!", "?", "/"):
            at = lt + 1  # an ordinary character
            continue
        if lt > begun:
            yield "text", page[begun:lt], ""
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            yield "note", page[lt + 4 : end if end >= 0 else n], ""
            at = begun = end + 3 if end >= 0 else n
            continue
        if not named:
            end = page.find(">", lt)
            at = begun = end + 1 if end >= 0 else n
            continue
        end, name = _tag_end(page, named.end(), last), named[2].lower()
        at = begun = end + 1
        if named[1]:
            yield "close", name, ""
        elif name in RAW:
            closing = RAW[name].search(page, at)
            end = page.find(">", closing.start()) if closing else -1
            at = begun = end + 1 if end >= 0 else n
        else:
            yield "open", name, page[named.end() : end]
    if begun < n:
        yield "text", page[begun:], ""


@cache
def _parts(name: str, attrs: str) -> frozenset[str]:
    """The values of an element's class, id and role (after a =), and the words that they are made of."""
    found: set[str] = set()
    for m in _ATTR.finditer(attrs):
        key = m[1].lower()
        if key in ("class", "id", "role") and not (key == "id" and name in ANCHORS):
            value = (m[2] or m[3] or m[4] or "").lower().strip()
            found.update([f"={value}", *_PART.findall(value)])
    return frozenset(found)


def parts(name: str, attrs: str) -> frozenset[str]:
    if len(attrs) < 4 or "=" not in attrs:
        return frozenset()
    if _parts.cache_info().currsize > 50_000:
        _parts.cache_clear()
    return _parts(name, attrs)


class Weights:
    """Counted on labelled pages. ``element``: log-likelihood ratio of an element's name, and of the parts of its names, to hold or be in
    a main text, against being the root of something else. ``scan``: scores of a word, a word of a link, and each tag."""

    def __init__(self, pages: list[str]):
        keep, out = Counter(), Counter()
        inside, outside = Counter(), Counter()
        for page in pages:
            stack: list[list] = []  # open elements: features, whether they hold main text, elements below that do not, name
            main = False
            for kind, value, attrs in tokens(page):
                counts = inside if main else outside
                if kind == "note":
                    main = {"main": True, "/main": False}.get(value.strip(), main)
                elif kind == "text":
                    if main and value.strip():
                        for e in stack:
                            e[1] = True
                    counts["link" if any(e[3] == "a" for e in stack) else "word"] += len(value.split())
                else:
                    if kind == "open":
                        counts[f"<{value}>"] += 1
                    if kind == "open" and value not in VOID:
                        stack.append([parts(value, attrs) | {f"<{value}>"}, False, [], value])
                    elif kind == "close" and stack:
                        features, holds, below, _ = stack.pop()
                        if holds:
                            keep.update([*features, ""])
                            for f in below:
                                out.update([*f, ""])
                        elif stack:
                            stack[-1][2].append(features)
        # what was seen a few times says less: names shrink to no evidence, tags to the mean tag
        ratio = lambda k: math.log((keep[k] + 0.5) / (keep[""] + 1)) - math.log((out[k] + 0.5) / (out[""] + 1))
        self.element = {k: ratio(k) * (keep[k] + out[k]) / (keep[k] + out[k] + FEW) for k in {*keep, *out} - {""}}
        tags = lambda c: sum(v for k, v in c.items() if k.startswith("<"))
        mean = tags(inside) / (tags(inside) + tags(outside))
        share = lambda k: (inside[k] + FEW_TAGS * mean) / (inside[k] + outside[k] + FEW_TAGS)
        self.scan = {k: math.log(share(k)) for k in {*inside, *outside}}
        self.scan["word"] = -math.log1p(-share("word"))
        self.other = math.log(mean)

    def standing(self, name: str, attrs: str) -> tuple[bool, float]:
        """Whether the element is no part of an article, and what its names add to its tag's score (never above zero)."""
        get = self.element.get
        named = sum(get(p, 0.0) for p in parts(name, attrs))
        return name not in ROOTS and get(f"<{name}>", 0.0) + named < OUT, min(named, 0.0)


@cache
def weights() -> Weights:
    return Weights(PAGES)


def nodes(page: str, w: Weights) -> list[tuple[str, str, float]]:
    """(kind, value, score) in page order: "word" and "link" text, "tag", and "out" where an element begins that is no part of an article (what it
    holds is passed over). Where the page marks its content with main or article, only what those hold is given."""
    found, marked = _nodes(page, w, False)
    if not marked and _MARKED.search(page):  # all within elements that look like no part of an article
        found, marked = _nodes(page, w, True)
    return found


def _nodes(page: str, w: Weights, rescue: bool) -> tuple[list[tuple[str, str, float]], bool]:
    """``rescue``: content that is marked as such counts within any element. Second: whether any was seen."""
    scan, other = w.scan, w.other
    word, link = scan.get("word", 0.0), scan.get("link", 0.0)
    all_of: list[tuple[str, str, float]] = []
    inside: list[tuple[str, str, float]] = []
    skip, depth, linked, room, marked = "", 0, False, 0, False
    for kind, value, attrs in tokens(page):
        if kind == "note":
            continue
        if kind == "text":
            if not depth:
                n = len(value.split())
                if room:
                    inside.append(("word", value, word * n))  # marked content: its links are part of it
                all_of.append(("link", value, link * n) if linked else ("word", value, word * n))
            continue
        closes = kind == "close"
        if depth:
            if value == skip:
                if closes:
                    depth -= 1
                    continue
                if value not in SELF_CLOSED:
                    depth += 1
                    continue
                depth = 0  # the next of its kind ends it
            elif not closes and (value == "body" or rescue and value in MARKED):
                depth = 0
            elif closes and value in MARKED and room:
                depth = 0  # an element that was never closed ends with the content that it stands in
            else:
                continue
        score, node = 0.0, "tag"  # a closing tag follows from the opening one
        if not closes:
            score = scan.get(f"<{value}>", other)
            out, named = w.standing(value, attrs)
            if out and not (value == "header" and room and not parts(value, attrs)) and not (rescue and value in MARKED):  # a plain header within content is that of the content
                node = "out"
                if value not in VOID:
                    skip, depth = value, 1
            else:
                score += named
        if value in MARKED and node == "tag":
            marked = True
            room = room + 1 if not closes else max(room - 1, 0)
            inside.append(("tag", value, score))
        elif room:
            inside.append((node, value, score if node == "tag" else 0.0))  # marked content goes on after what is left out of it
        if value == "a":
            linked = not closes
        elif value not in INLINE:
            linked = False  # a link does not reach over blocks
        all_of.append((node, value, -math.inf if value == "body" and node == "tag" else score))
    return (inside, True) if marked else (all_of, False)


def best_region(scores: list[float]) -> tuple[int, int]:
    """The contiguous region with the greatest sum, (first, after its last); (0, 0) if no region has a positive one."""
    best = total = 0.0
    start = first = last = 0
    for i, s in enumerate(scores):
        total += s
        if total < 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, first, last = total, start, i + 1
    return first, last


def _decoded(text: str) -> str:
    return html.unescape(_TOO_LONG.sub("\ufffd", text)) if "&" in text else text


def main_text(page: str | None) -> str:
    if not page:
        return ""
    seq = nodes(page, weights())
    first, last = best_region([s for _, _, s in seq])
    if not last:
        return ""
    joins = lambda n: n[0] in ("word", "link") or n[0] == "tag" and n[1] in INLINE
    # the first and the last block are taken whole
    while first and joins(seq[first - 1]):
        first -= 1
    while last < len(seq) and joins(seq[last]):
        last += 1
    return " ".join("".join([_decoded(v) if k in ("word", "link") else " " if k == "out" or v not in INLINE else "" for k, v, _ in seq[first:last]]).split())


def _extract(pages: pa.Array) -> list[pa.Array]:
    texts = [main_text(p) for p in pages.to_pylist()]
    return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]


def extract(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``row``, ``text`` and ``n_chars`` (its code points) of every page."""
    return map_rows(pages, html_col, [("text", T.StringType()), ("n_chars", T.LongType())], _extract, keep)
