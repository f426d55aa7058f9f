"""Relational operators over DOM node tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Selectors of the components that are captured by default.
COMPONENTS = [
    "header", "nav", "main", "article", "section", "aside", "footer",
    ".container", ".content", ".card", ".navbar", ".hero", ".banner",
    "#header", "#navigation", "#main", "#sidebar", "#footer",
    "h1", "h2", "h3", "div", "body", "a", "p", "span", "img",
]
#: What a safe file name has in place of a selector's signs.
SAFE = [("#", "id_"), (".", "class_"), (" ", "_"), (">", "_gt_"), ("+", "_plus_"), ("~", "_tilde_"), ("[", "_"), ("]", "_"), ("=", "_eq_"), ('"', ""), ("'", ""), (":", "_")]


def safe_name(selector: Column) -> Column:
    """A selector as a file name."""
    for a, b in SAFE:
        selector = F.replace(selector, F.lit(a), F.lit(b))
    return F.regexp_replace(F.regexp_replace(selector, "_+", "_"), "^_|_$", "")


def selector(tag: Column, element_id: Column, classes: Column) -> Column:
    """#id, or else tag.class..., null for text nodes."""
    dotted = F.concat(tag, F.array_join(F.transform(classes, lambda c: F.concat(F.lit("."), c)), ""))
    return F.when(tag.isNull(), None).when(F.coalesce(element_id, F.lit("")) != "", F.concat(F.lit("#"), element_id)).otherwise(dotted)


def tree_stats(nodes: DataFrame, id_col: str) -> DataFrame:
    return nodes.groupBy(id_col).agg(F.count(F.lit(1)).alias("total_nodes"), F.max("depth").alias("max_depth"))


def match_components(nodes: DataFrame, id_col: str, selectors: list[str] = COMPONENTS, classes: str = "class_names") -> DataFrame:
    """(id_col, selector, node_id): nodes that each simple selector matches."""
    hits = F.array(*(
        F.when(F.array_contains(classes, s[1:]) if s[0] == "." else F.col("element_id") == s[1:] if s[0] == "#" else F.col("tag_name") == s, F.lit(s)) for s in selectors
    ))
    return nodes.select(id_col, "node_id", F.explode(F.array_compact(hits)).alias("selector"))


def link_by_position(nodes: DataFrame, shots: DataFrame, id_col: str) -> DataFrame:
    """nodes(id_col, x, y, ...) with the path of the shot(id_col, x, y, seq, path) at the same whole
    position; of several the last by seq."""
    key = lambda d: {"_x": d["x"].cast("int"), "_y": d["y"].cast("int")}
    last = shots.withColumns(key(shots)).groupBy(id_col, "_x", "_y").agg(F.max_by("path", "seq").alias("screenshot_path"))
    return nodes.withColumns(key(nodes)).join(last, [id_col, "_x", "_y"], "left").drop("_x", "_y")


def has_consent_button(html: Column) -> Column:
    """Does a page hold a consent button: one with accept or cookie in its id or class, or inside
    something whose id holds cookieConsent or whose class is cookie-banner?"""
    return html.rlike(r'(?i)<button\b[^>]*\b(?:id|class)\s*=\s*"[^"]*(?:accept|cookie)|id\s*=\s*"[^"]*cookieConsent|class\s*=\s*"[^"]*\bcookie-banner\b')


def trees_as_json(nodes: DataFrame, id_col: str) -> DataFrame:
    """(id_col, dom_tree, total_nodes, max_depth): node rows (node_id, parent_id, position, depth and
    fields) of each tree as one nested JSON text. A tree is one page's, so it fits a task."""
    import json

    import pandas as pd

    fields = [c for c in nodes.columns if c not in (id_col, "node_id", "parent_id", "position")]

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        clean = lambda v: v.tolist() if hasattr(v, "tolist") and not isinstance(v, str) else dict(v) if isinstance(v, list) and v and isinstance(v[0], tuple) else None if isinstance(v, float) and v != v else v
        built: dict[int, dict] = {}
        top = None
        for r in pdf.sort_values(["node_id"]).to_dict("records"):
            node = {f: clean(r[f]) for f in fields} | {"children": []}
            built[r["node_id"]] = node
            if r["parent_id"] in built:
                built[r["parent_id"]]["children"].append(node)
            else:
                top = node
        return pd.DataFrame([(key[0], json.dumps(top, ensure_ascii=False), len(pdf), int(pdf["depth"].max()))], columns=[id_col, "dom_tree", "total_nodes", "max_depth"])

    kind = nodes.schema[id_col].dataType.simpleString()
    return nodes.groupBy(id_col).applyInPandas(one, f"{id_col} {kind}, dom_tree string, total_nodes int, max_depth int")
