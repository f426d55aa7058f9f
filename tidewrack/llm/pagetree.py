"""Text blocks of a page with the containers they are in."""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field
from itertools import accumulate

from tidewrack.llm.encoding import mend

TOKEN = re.compile(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|([^<]+|<)", re.S)
CLASS = re.compile(r"""\bclass\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big button cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
UNSEEN = frozenset("script style template head title".split())


@dataclass(slots=True)
class Element:
    tag: str
    parent: int
    name: str = ""


@dataclass(slots=True)
class Line:
    """One line of the page's text: the element it is in, its inline wrapper, and characters in links."""

    text: str
    block: int = -1
    inline: int = -1
    linked: int = 0
    size: int = 0
    hidden: bool = False


@dataclass(slots=True)
class Page:
    elements: list[Element] = field(default_factory=list)
    lines: list[Line] = field(default_factory=list)
    aligned: bool = True
    spaces: dict[int, Area] | None = None


def _chunks(source: str, elements: list[Element]) -> list[tuple[str, int, bool]]:
    """(text, element, in a link) of all visible text nodes; fills elements."""
    elements.append(Element("#root", -1))
    out: list[tuple[str, int, bool]] = []
    stack = [0]
    unseen = links = 0
    for m in TOKEN.finditer(source):
        tag = m.group(2)
        if tag:
            tag = tag.lower()
            if m.group(1):
                if any(elements[e].tag == tag for e in stack[1:]):
                    while True:
                        top = elements[stack.pop()]
                        unseen -= top.tag in UNSEEN
                        links -= top.tag == "a"
                        if top.tag == tag:
                            break
            elif tag not in VOID:
                rest = m.group(3)
                c = CLASS.search(rest) if "class" in rest else None
                elements.append(Element(tag, stack[-1], (c.group(1) or c.group(2) or c.group(3) or "") if c else ""))
                if not rest.endswith("/"):
                    stack.append(len(elements) - 1)
                    unseen += tag in UNSEEN
                    links += tag == "a"
        elif m.group(4) and not unseen:
            text = m.group(4)
            if not text.isspace():
                out.append((html.unescape(text) if "&" in text else text, stack[-1], links > 0))
    return out


def mend_lines(page: Page) -> Page:
    """The page with the texts of garbled lines restored; their places and sizes stay."""
    for line in page.lines:
        if not line.text.isascii():
            line.text = mend(line.text)[1] or ""
    return page


def _bare(text: str) -> str:
    return "".join(text.split())


def _find_nodes(whole: str, starts: list[int], want: str, first: int) -> tuple[int, int] | None:
    """The first run of whole nodes, from the node `first` on, whose texts together are `want`. A node
    starts at starts[i] of whole, the texts of all nodes."""
    at = whole.find(want, starts[first])
    while at >= 0:
        i, j = bisect_right(starts, at) - 1, bisect_left(starts, at + len(want))
        if starts[i] == at and starts[j] == at + len(want):
            return i, j
        at = whole.find(want, at + 1)
    return None


def read_page(source: str, text: str) -> Page:
    """The lines of text, each placed in the tree of source. Text nodes are dealt out to the lines in
    order; where the two disagree the page is not aligned, and a line is looked up further on, else
    anywhere; one that is nowhere is left unplaced (block -1)."""
    page = Page()
    chunks = _chunks(source, page.elements)
    el = page.elements
    k = 0
    whole, starts = "", []
    for line in text.split("\n"):
        want = _bare(line)
        out = Line(line, size=len(want))
        page.lines.append(out)
        if not want:
            continue
        done, start = 0, k
        while k < len(chunks) and done < len(want):
            part = _bare(chunks[k][0])
            if not want.startswith(part, done):
                break
            done += len(part)
            if chunks[k][2]:
                out.linked += len(part)
            k += 1
        if done < len(want):
            # not where it should be: look for the nodes that hold the line further on, else anywhere
            if page.aligned:
                parts = [_bare(c[0]) for c in chunks]
                whole, starts = "".join(parts), [0, *accumulate(map(len, parts))]
                page.aligned = False
            k = start
            found = _find_nodes(whole, starts, want, start)
            if found is None:
                found = _find_nodes(whole, starts, want, 0)
            if found is None:
                out.linked = 0
                continue
            start, k = found
            out.linked = sum(starts[j + 1] - starts[j] for j in range(start, k) if chunks[j][2])
        # the nearest element around all nodes of the line
        at = chunks[start][1]
        if k - start > 1:
            up = set()
            e = at
            while e >= 0:
                up.add(e)
                e = el[e].parent
            for j in range(start + 1, k):
                e = chunks[j][1]
                way = set()
                while e >= 0:
                    way.add(e)
                    e = el[e].parent
                up &= way
            at = max(up)
        out.inline = at
        e = at
        while e > 0 and el[e].tag in INLINE:
            e = el[e].parent
        out.block = e
        while e > 0:
            if el[e].tag == "noscript":
                out.hidden = True
            e = el[e].parent
    return page


HEADING = re.compile(r"^h[1-6]$")
#: Containers that never hold a page's own text.
ASIDE = frozenset("nav aside footer noscript form header menu dialog".split())


@dataclass(slots=True)
class Area:
    """A container with the lines that are directly its own."""

    element: int
    lines: list[int] = field(default_factory=list)
    size: int = 0
    linked: int = 0
    headline: bool = False
    aside: bool = False


def is_heading(page: Page, line: Line, level: str = "") -> bool:
    """Is a line a heading (of one level), by its tag or by a class of that name?"""
    e = page.elements[line.block]
    found = [t for t in (e.tag, *e.name.lower().split()) if HEADING.match(t)]
    return level in found if level else bool(found)


def areas(page: Page) -> dict[int, Area]:
    """The containers that have lines of their own; made once a page."""
    if page.spaces is None:
        page.spaces = _areas(page)
    return page.spaces


def _areas(page: Page) -> dict[int, Area]:
    held: dict[int, int] = {}
    for line in page.lines:
        if line.block >= 0:
            held[line.block] = held.get(line.block, 0) + 1
    out: dict[int, Area] = {}
    for i, line in enumerate(page.lines):
        if line.block < 0 or not line.size:
            continue
        # a block with several lines is their container; a list is part of what it stands in
        e = line.block if held[line.block] > 1 or page.elements[line.block].tag in ("td", "main", "article", "section", "center") else page.elements[line.block].parent
        while page.elements[e].tag in ("ul", "ol", "dl", "blockquote", "table") and page.elements[e].parent > 0 and page.elements[page.elements[e].parent].tag not in ("body", "html"):
            e = page.elements[e].parent
        a = out.get(e)
        if a is None:
            a = out[e] = Area(e)
            k = e
            while k >= 0:
                a.aside |= page.elements[k].tag in ASIDE
                k = page.elements[k].parent
        a.lines.append(i)
        a.size += line.size
        a.linked += line.linked
        a.headline |= is_heading(page, line, "h1")
    return out


def main_area(page: Page) -> Area | None:
    """The container of the headline, or else the largest that isn't an aside."""
    best = None
    for a in areas(page).values():
        if not a.aside and (best is None or (a.headline, a.size) > (best.headline, best.size)):
            best = a
    return best
