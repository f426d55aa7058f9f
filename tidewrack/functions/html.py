"""What a page holds, by regular expressions on well-formed markup, inside whole-stage code.

For markup that isn't well-formed use operators.pages, which builds the tree.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewrack.functions import urls

A_HREF = r"(?i)<a\s(?:[^>]*?\s)?href\s*=\s*\"([^\"]*)\""
IMG_SRC = r"(?i)<img\s(?:[^>]*?\s)?src\s*=\s*\"([^\"]+)\""
LINK = r"(?i)<link\s[^>]*>"
META = r"(?i)<meta\s[^>]*>"
STYLE = r"(?is)<style[^>]*>(.*?)</style>"
TITLE = r"(?is)<title[^>]*>(.*?)</title>"
SCRIPT = r"(?is)<script\b.*?</script>"
COMMENT = r"(?s)<!--.*?-->"
#: Parts of a page that differ from fetch to fetch.
DYNAMIC = [
    r"(?i)timestamp[\"']?\s*:\s*[\"']?\d+[\"']?",
    r"(?i)_token[\"']?\s*:\s*[\"'][^\"']+[\"']",
    r"(?i)csrfToken[\"']?\s*:\s*[\"'][^\"']+[\"']",
    r"(?i)sessionId[\"']?\s*:\s*[\"'][^\"']+[\"']",
]
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def _all(html: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(html, F.lit(pattern), F.lit(group))


def unescape(x: Column) -> Column:
    """The five predefined references and the no-break space."""
    for a, b in ENTITIES:
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def title(html: Column) -> Column:
    return F.trim(unescape(F.regexp_extract(html, TITLE, 1)))


def links(html: Column, base: Column) -> Column:
    """Distinct http(s) targets of anchors, resolved, in document order."""
    found = urls.resolve_all(base, F.transform(_all(html, A_HREF), unescape))
    return F.array_distinct(F.filter(found, lambda x: x.startswith("http://") | x.startswith("https://")))


def stylesheets(html: Column, base: Column) -> Column:
    """Distinct targets of <link rel=stylesheet> in document order."""
    tags = F.filter(_all(html, LINK, 0), lambda t: t.rlike(r"(?i)\brel\s*=\s*\"(?:[^\"]*\s)?stylesheet(?:\s[^\"]*)?\""))
    href = F.filter(F.transform(tags, lambda t: F.regexp_extract(t, r"(?i)\bhref\s*=\s*\"([^\"]*)\"", 1)), lambda x: x != "")
    return F.array_distinct(urls.resolve_all(base, F.transform(href, unescape)))


def images(html: Column, base: Column) -> Column:
    return F.array_distinct(urls.resolve_all(base, F.transform(_all(html, IMG_SRC), unescape)))


def inline_css(html: Column) -> Column:
    return F.filter(_all(html, STYLE), lambda x: x != "")


def meta(html: Column) -> Column:
    """name (or else property) to content; both must be non-empty; the last of a key wins."""
    at = lambda t, k: F.regexp_extract(t, rf"(?i)\b{k}\s*=\s*\"([^\"]*)\"", 1)
    pairs = F.transform(_all(html, META, 0), lambda t: F.struct(F.when(at(t, "name") != "", at(t, "name")).otherwise(at(t, "property")).alias("k"), unescape(at(t, "content")).alias("v")))
    kept = F.filter(pairs, lambda p: (p["k"] != "") & (p["v"] != ""))
    return F.aggregate(kept, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["k"]), F.create_map(p["k"], p["v"])))


def text(html: Column) -> Column:
    """Visible text without separators between nodes."""
    t = F.regexp_replace(html, COMMENT, "")
    for p in (SCRIPT, r"(?is)<style\b.*?</style>"):
        t = F.regexp_replace(t, p, "")
    nodes = F.transform(F.split(t, r"<[^>]*>"), lambda x: F.regexp_replace(unescape(x), r"(?U)^\s+|\s+$", ""))
    return F.array_join(nodes, "")


def normalized(html: Column) -> Column:
    """Markup without comments, scripts and parts that differ between fetches; runs of white space as
    one space."""
    t = F.regexp_replace(F.regexp_replace(html, COMMENT, ""), SCRIPT, "")
    for p in DYNAMIC:
        t = F.regexp_replace(t, p, "")
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def content_hash(content: Column, is_html: bool = True) -> Column:
    """SHA-256 of the normalised markup, or of other content as it is."""
    return F.sha2(normalized(content) if is_html else content, 256)
