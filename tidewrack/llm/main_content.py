"""The main body of a page, by tree scoring.

Every paragraph gives points for length and commas to its container and half of them to the one
around it; a container's points are discounted by its link density. The best container and those of
its siblings that look like its continuation are the body; of a page that is no container but its
<body>, the lines that stand in that directly. Within the body, lines that are neither
headings, list entries nor sentences (bylines, share prompts, marks of advertisements, counters) are
left out.
"""

from __future__ import annotations

import re
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.llm import spam, templates
from tidewrack.llm.pagetree import ASIDE, Line, Page, areas, is_heading
from tidewrack.llm.signs import SENTENCE, STOP, width
from tidewrack.session import store

#: Shortest paragraph that gives points, characters; ideographs and kana count three times.
LEAST = 20
#: Points for the page's headline; containers with fewer points than FLOOR hold no article (<body>
#: needs three times as many); a sibling needs this share of the best one's points.
HEADLINE, FLOOR, SIBLING = 6.0, 1.0, 0.35
#: Mean width of the lines of a sibling without a class.
PROSE = 100

#: Elements around everything; of them only what they hold directly counts.
WHOLE = frozenset({"body", "html", "#root"})
COMMA = re.compile("[,،、，;；]")


def score(page: Page) -> dict[int, float]:
    """Points of the containers, discounted by link density."""
    points: dict[int, float] = defaultdict(float)
    size: dict[int, int] = defaultdict(int)
    linked: dict[int, int] = defaultdict(int)
    el = page.elements
    found = areas(page)
    for a in found.values():
        e = a.element
        while e >= 0:
            size[e] += a.size
            linked[e] += a.linked
            e = el[e].parent
        if a.aside:
            continue
        for i in a.lines:
            line = page.lines[i]
            n = width(line.text)
            if n < LEAST or line.linked > 0.7 * line.size or not SENTENCE.search(line.text):
                continue
            p = 1 + len(COMMA.findall(line.text)) + min(n / 100, 4)
            if el[line.block].tag == "li" or is_heading(page, line):
                p *= 0.3
            points[a.element] += p
            up = el[a.element].parent
            if up > 0 and el[up].tag not in WHOLE:
                points[up] += p / 2
        if a.headline and points[a.element] > 0:
            points[a.element] += HEADLINE
    # links all over the page say nothing about what stands in <body> directly
    own = lambda e: (found[e].linked, found[e].size) if el[e].tag in WHOLE else (linked[e], size[e])
    return {e: p * (1 - x / max(n, 1)) for e, p in points.items() for x, n in (own(e),)}


def main_lines(page: Page) -> list[int]:
    """Numbers of the lines that belong to the page's own body."""
    points = score(page)
    if not points:
        return []
    best = max(points, key=lambda e: (points[e], -e))
    el = page.elements
    if points[best] < FLOOR * (3 if el[best].tag in WHOLE else 1):
        return []
    if el[best].tag in WHOLE:
        direct = sorted(areas(page)[best].lines)
        return [i for i in direct if not page.lines[i].hidden and keeps(page, page.lines[i])]
    chosen = {best} | {
        e for e in points
        if el[e].parent == el[best].parent and (el[e].tag, el[e].name) == (el[best].tag, el[best].name) and points[e] >= SIBLING * points[best] and (el[e].name or is_prose(page, e))
    }
    out = []
    for i, line in enumerate(page.lines):
        if line.block < 0 or line.hidden or not line.size:
            continue
        e = line.block
        while e >= 0 and e not in chosen and el[e].tag not in ASIDE:
            e = el[e].parent
        if e in chosen and keeps(page, line):
            out.append(i)
    return out


def is_prose(page: Page, e: int) -> bool:
    """Are the lines of a container long on average? Asked of siblings without a class of their own, to
    tell the article's next part from a footer."""
    a = areas(page).get(e)
    return a is not None and sum(width(page.lines[i].text) for i in a.lines) >= PROSE * len(a.lines)


def keeps(page: Page, line: Line) -> bool:
    """Is a line of the body a heading, a list entry or a sentence?"""
    return is_heading(page, line) or page.elements[line.block].tag == "li" or bool(STOP.search(line.text))


def find_main_lines(fetches: DataFrame, common_words: DataFrame, id_col: str = "fetch_id") -> DataFrame:
    """(id_col, line_no): the lines of text_content that belong to the page's own article.

    fetches needs id_col (unique), url, content, parsed_data (title, html, text_content). Pages whose
    text is stuffed, filler, unfilled or a whole-page notice have no such lines, nor have pages with
    null or empty html or text. Line numbers count from 0.
    """
    from tidewrack.llm.pages import BODY, SPAM, TEMPLATE, read_pages  # which uses main_lines()

    return main_lines_of(store(read_pages(fetches, common_words, id_col, BODY | TEMPLATE | SPAM)), id_col)


def main_lines_of(pages: DataFrame, id_col: str) -> DataFrame:
    """find_main_lines() on stored pages of read_pages()."""
    own = spam.calibrated(pages.where("has_text AND has_html")).where(~spam.stuffed() & ~F.col("text_flag")).select("id", "body")
    barred = templates.template_pages(pages).unionAll(templates.unfilled_slots(pages))
    return own.join(barred, "id", "left_anti").select(F.col("id").alias(id_col), F.explode("body").alias("line_no"))
