"""Full parsing of pages: content to title, links, styles, meta data, markup and text, and to DOM nodes.

The standard library's tokenizer feeds a tree builder with one rule for end tags: pop to the nearest
open element of that name, ignore the tag if there is none. An explicit stack, so any depth works.
"""

from __future__ import annotations

import hashlib
import html
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.session import spread

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

PARSED = "title string, links array<string>, css_links array<string>, inline_css array<string>, meta_data map<string,string>, html string, text_content string"
NODE = (
    "node_id int, parent_id int, position int, depth int, tag_name string, element_id string, class_names array<string>, "
    "attributes map<string,string>, text_content string, xpath string, css_selector string, node_hash string"
)


def usable(pages: DataFrame, content_col: str = "content") -> DataFrame:
    """Pages that the stages after the fetch work on: without an error and with content."""
    return pages.where(F.col("error").isNull() & (F.coalesce(F.col(content_col), F.lit("")) != ""))


class Tree(HTMLParser):
    """Nodes as lists [kind, tag or text, attributes, children]; kind is e, t or c."""

    def __init__(self, source: str):
        super().__init__(convert_charrefs=True)
        self.root = ["e", "#document", [], []]
        self.stack = [self.root]
        self.feed(source)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = ["e", tag, [(k, v or "") for k, v in attrs], []]
        self.stack[-1][3].append(node)
        if tag not in VOID:
            self.stack.append(node)

    def handle_startendtag(self, tag, attrs):
        self.stack[-1][3].append(["e", tag, [(k, v or "") for k, v in attrs], []])

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][1] == tag:
                del self.stack[i:]
                return

    def handle_data(self, data):
        self.stack[-1][3].append(["t", data])

    def handle_comment(self, data):
        self.stack[-1][3].append(["c", data])


def walk(node: list) -> Iterator[tuple[list, str]]:
    """All nodes in document order with the tag around them."""
    todo: list[tuple[list, str]] = [(node, "")]
    while todo:
        n, up = todo.pop()
        yield n, up
        if n[0] == "e":
            todo.extend((c, n[1]) for c in reversed(n[3]))


def serialize(node: list) -> str:
    out: list[str] = []
    todo: list = [node]
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            out.append(n)
        elif n[0] == "t":
            out.append(html.escape(n[1], quote=False))
        elif n[0] == "c":
            out.append(f"<!--{n[1]}-->")
        else:
            attrs = "".join(f' {k}="{html.escape(v)}"' for k, v in n[2])
            if n[1] in VOID:
                out.append(f"<{n[1]}{attrs}/>")
            else:
                if n[1] != "#document":
                    out.append(f"<{n[1]}{attrs}>")
                    todo.append(f"</{n[1]}>")
                todo.extend(reversed(n[3]))
    return "".join(out)


def _distinct(xs: list[str]) -> list[str]:
    return list(dict.fromkeys(xs))


def _join(base: str, ref: str) -> str:
    try:
        return urljoin(base, ref)
    except ValueError:
        return ref


def parse(source: str | None, base: str | None) -> tuple | None:
    """The values of PARSED; None for a null source."""
    if source is None:
        return None
    tree, base = Tree(source).root, base or ""
    title, links, css, styles, meta, text = None, [], [], [], {}, []
    for n, up in walk(tree):
        if n[0] == "t":
            if n[1].strip() and up not in ("script", "style"):
                text.append(n[1].strip())
            continue
        if n[0] == "c":
            continue
        a = dict(reversed(n[2]))
        only = n[3][0][1] if len(n[3]) == 1 and n[3][0][0] == "t" else None
        if n[1] == "title" and title is None:
            title = (only or "").strip()
        elif n[1] == "a" and "href" in a:
            full = _join(base, a["href"])
            if full.startswith(("http://", "https://")):
                links.append(full)
        elif n[1] == "link" and "stylesheet" in a.get("rel", "").lower().split() and a.get("href"):
            css.append(_join(base, a["href"]))
        elif n[1] == "style" and only:
            styles.append(only)
        elif n[1] == "meta":
            key = a.get("name") or a.get("property")
            if key and a.get("content"):
                meta[key] = a["content"]
    return title or "", _distinct(links), _distinct(css), styles, meta, serialize(tree), "".join(text)


def parse_pages(pages: DataFrame, id_col: str, url_col: str = "url", content_col: str = "content") -> DataFrame:
    """(id_col, parsed): one parse per page into the struct PARSED. Null content gives null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in PARSED.split(", ")]
        for b in batches:
            got = [parse(c, u) for c, u in zip(b["c"], b["u"])]
            yield pd.DataFrame({"id": b["id"], "parsed": [None if g is None else dict(zip(names, g)) for g in got]})

    kind = pages.schema[id_col].dataType.simpleString()
    out = spread(pages.select(F.col(id_col).alias("id"), F.col(content_col).alias("c"), F.col(url_col).alias("u"))).mapInPandas(run, f"id {kind}, parsed struct<{_spec(PARSED)}>")
    return out.withColumnRenamed("id", id_col)


def _spec(fields: str) -> str:
    """`name type, ...` as the fields of a struct type."""
    out = []
    for f in fields.split(", "):
        name, kind = f.split(" ", 1)
        out.append(f"{name}: {kind}")
    return ", ".join(out)


def css_selector(tag: str | None, element_id: str | None, classes: list[str]) -> str | None:
    if tag is None:
        return None
    return f"#{element_id}" if element_id else tag + "".join(f".{c}" for c in classes)


def dom_nodes(source: str, max_depth: int = 8) -> list[tuple]:
    """The rows of NODE: from <html>, or the document without one. Text nodes have no tag and their
    parent's path; blank text and comments are left out, as is what is deeper than max_depth."""
    root = next((n for n, _ in walk(Tree(source).root) if n[0] == "e" and n[1] == "html"), None) or Tree(source).root
    out: list[tuple] = []
    todo = [(root, -1, 0, 0, "/" + root[1])]
    while todo:
        n, parent, pos, depth, path = todo.pop()
        i = len(out)
        if n[0] == "t":
            text = n[1].strip()
            h = hashlib.md5(f"None_None_[]_{text}".encode()).hexdigest()[:12]
            out.append((i, parent, pos, depth, None, None, [], {}, text, path, None, h))
            continue
        a = dict(reversed(n[2]))
        classes = a.get("class", "").split()
        own = " ".join(c[1].strip() for c in n[3] if c[0] == "t" and c[1].strip()) or None
        h = hashlib.md5(f"{n[1]}_{a.get('id')}_{classes}_{own}".encode()).hexdigest()[:12]
        out.append((i, parent, pos, depth, n[1], a.get("id"), classes, a, own, path, css_selector(n[1], a.get("id"), classes), h))
        if depth >= max_depth:
            continue
        same: dict[str, int] = {}
        for c in n[3]:
            if c[0] == "e":
                same[c[1]] = same.get(c[1], 0) + 1
        seen: dict[str, int] = {}
        kids = []
        for c in n[3]:
            if c[0] == "c" or c[0] == "t" and not c[1].strip():
                continue
            step = path
            if c[0] == "e":
                seen[c[1]] = seen.get(c[1], 0) + 1
                step = f"{path}/{c[1]}" + (f"[{seen[c[1]]}]" if same[c[1]] > 1 else "")
            kids.append((c, i, len(kids), depth + 1, step))
        todo.extend(reversed(kids))
    return out


def dom_table(pages: DataFrame, id_col: str, content_col: str = "content", max_depth: int = 8) -> DataFrame:
    """(id_col, NODE): the nodes of every page, in document order. Null content gives no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in NODE.split(", ")]
        for b in batches:
            rows = [(i, *r) for i, c in zip(b["id"], b["c"]) if c for r in dom_nodes(c, max_depth)]
            yield pd.DataFrame(rows, columns=["id", *names])

    kind = pages.schema[id_col].dataType.simpleString()
    return spread(pages.select(F.col(id_col).alias("id"), F.col(content_col).alias("c")).where("c IS NOT NULL")).mapInPandas(run, f"id {kind}, {NODE}").withColumnRenamed("id", id_col)
