"""Queries over urls, markup and duplicates, with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.functions import html, urls
from tidewrack.operators import dedup, dom, nested, pages
from tidewrack.plans.general import TREE
from tidewrack.sources import replay, storage
from tidewrack.session import checkpoint_dir, spread, table

RFC = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
#: Items of one Bloom filter.
CAPACITY = 100_000


def _part(x: str, n: int) -> str:
    return f"regexp_extract({x}, '{RFC}', {n})"


TRACK = ", ".join(f"'{t}'" for t in urls.TRACKING)
_Q = f"""array_to_string(list_transform(list_sort(list_filter(list_transform(string_split({_part("whole", 4)}, '&'),
  lambda x, i: struct_pack(k := url_decode(replace(split_part(x, '=', 1), '+', ' ')), i := i, v := CASE WHEN contains(x, '=') THEN url_decode(replace(regexp_extract(x, '^[^=]*=(.*)$', 1), '+', ' ')) END)),
  lambda p: coalesce(p.v, '') <> '' AND lower(p.k) NOT IN ({TRACK}))),
  lambda p: replace(url_encode(p.k), '%20', '+') || '=' || replace(url_encode(p.v), '%20', '+')), '&')"""
#: canon(id, url, c): fetches with their canonical url.
CANON = f"""
w AS (SELECT fetch_id, url, fetched_at, content, CASE WHEN regexp_matches(lower(trim(url)), '^[a-z][a-z0-9+.-]*:') THEN lower(trim(url)) ELSE 'https://' || url END AS whole FROM fetches),
q AS (SELECT *, {_Q} AS query, regexp_replace(lower({_part("whole", 2)}), '^www\\.', '') AS net, regexp_replace(regexp_replace({_part("whole", 3)}, ';[^/]*$', ''), '/+$', '') AS p FROM w),
canon AS (SELECT fetch_id, url, fetched_at, content, lower({_part("whole", 1)}) || '://' || net || CASE WHEN p = '' THEN '/' ELSE p END || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS c FROM q)"""


def _fetches(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "fetches")


def url_parts(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return _fetches(spark, d).select(
        "fetch_id", urls.domain(u).alias("domain"), urls.extension(u).alias("extension"), urls.url_hash(u).alias("url_hash"), urls.clean_domain(u).alias("clean_domain"),
        urls.retry_domain(u).alias("retry_domain"), storage.file_path(u, "html").alias("path"),
    )


def url_canonical(spark: SparkSession, d: str) -> DataFrame:
    return _fetches(spark, d).select("fetch_id", urls.canonical("url").alias("canonical"))


def url_equivalent_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Different spellings of one page: each against the least spelling of its class."""
    u = _fetches(spark, d).select("url").distinct().withColumn("canonical", urls.canonical("url"))
    first = u.groupBy("canonical").agg(F.min("url").alias("representative"))
    return u.join(first, "canonical").where("url <> representative").select("representative", "url")


def url_dedup(spark: SparkSession, d: str) -> DataFrame:
    g = dedup.crawl_gate(_fetches(spark, d).select("fetch_id", "url", "fetched_at"), urls.canonical("url"), ["fetched_at", "fetch_id"])
    return g.select("fetch_id", "is_duplicate", F.col("original").alias("original_url"), "reason")


def dedup_stats(spark: SparkSession, d: str) -> DataFrame:
    return dedup.dedup_stats(_fetches(spark, d), urls.canonical("url"), html.content_hash(F.col("content")))


def html_hash(spark: SparkSession, d: str) -> DataFrame:
    f = spread(_fetches(spark, d).where("content IS NOT NULL").select("fetch_id", "content"))
    return f.select("fetch_id", html.content_hash(F.col("content")).alias("hash"))


def content_dedup(spark: SparkSession, d: str) -> DataFrame:
    g = dedup.first_by(table(spark, d, "documents").select("doc_id", "text"), F.sha2("text", 256), ["doc_id"], "doc_id")
    return g.select("doc_id", "is_duplicate", F.col("original").alias("original_doc"))


def bloom_membership(spark: SparkSession, d: str) -> DataFrame:
    """Link targets that may have been fetched, by filters that grow with the pages, and those that were:
    only the former are looked up."""
    f = _fetches(spark, d).where("url IS NOT NULL").select("url").distinct()
    n = dedup.shards(f.count(), CAPACITY)
    bloom = dedup.bloom_filter(f, F.col("url"), CAPACITY, n)
    l = table(spark, d, "links").where("url IS NOT NULL").select("link_id", "url").distinct()
    maybe = dedup.bloom_contains(l, bloom, "link_id", F.col("url"), CAPACITY, n)
    sure = l.join(maybe.where("maybe"), "link_id", "left_semi").join(f, "url", "left_semi").select("link_id", F.lit(True).alias("fetched"))
    return maybe.join(sure, "link_id", "left").select("link_id", "maybe", F.coalesce("fetched", F.lit(False)).alias("fetched"))


def _html(spark: SparkSession, d: str) -> DataFrame:
    return spread(_fetches(spark, d).where("parsed_data.html IS NOT NULL").select("fetch_id", "url", F.col("parsed_data.html").alias("html")))


def page_title(spark: SparkSession, d: str) -> DataFrame:
    return _html(spark, d).select("fetch_id", html.title(F.col("html")).alias("title"))


def page_links(spark: SparkSession, d: str) -> DataFrame:
    return _html(spark, d).select("fetch_id", F.posexplode(html.links(F.col("html"), F.col("url"))).alias("position", "link"))


def page_stylesheets(spark: SparkSession, d: str) -> DataFrame:
    p = _html(spark, d).select("fetch_id", "url", html.stylesheets(F.col("html"), F.col("url")).alias("css_links"))
    r = replay.css_requests(p)
    return r.select("url", "position", "css_url", urls.css_filename("css_url").alias("filename")).distinct()


def page_inline_css(spark: SparkSession, d: str) -> DataFrame:
    return _html(spark, d).select("fetch_id", F.posexplode(html.inline_css(F.col("html"))).alias("position", "css"))


def page_meta(spark: SparkSession, d: str) -> DataFrame:
    return _html(spark, d).select("fetch_id", F.explode(html.meta(F.col("html"))).alias("name", "content"))


def page_images(spark: SparkSession, d: str) -> DataFrame:
    return _html(spark, d).select("fetch_id", F.explode(html.images(F.col("html"), F.col("url"))).alias("image"))


def page_text_hash(spark: SparkSession, d: str) -> DataFrame:
    return _html(spark, d).select("fetch_id", F.md5(F.regexp_replace(html.text(F.col("html")), r"\s+", "")).alias("text_hash"))


def page_parsed(spark: SparkSession, d: str) -> DataFrame:
    p = pages.parse_pages(_fetches(spark, d).where("content IS NOT NULL"), "fetch_id")
    return p.select("fetch_id", "parsed.title", F.size("parsed.links").alias("n_links"), F.size("parsed.css_links").alias("n_css"), F.size("parsed.meta_data").alias("n_meta"), F.length("parsed.text_content").alias("text_length"))


def dom_stats(spark: SparkSession, d: str) -> DataFrame:
    return dom.tree_stats(pages.dom_table(_fetches(spark, d), "fetch_id"), "fetch_id")


def dom_components(spark: SparkSession, d: str) -> DataFrame:
    m = dom.match_components(pages.dom_table(_fetches(spark, d), "fetch_id"), "fetch_id")
    return m.groupBy("selector").agg(F.count(F.lit(1)).alias("n"), dom.safe_name(F.first("selector")).alias("file"))


def dom_json(spark: SparkSession, d: str) -> DataFrame:
    return dom.trees_as_json(pages.dom_table(_fetches(spark, d), "fetch_id"), "fetch_id").select("fetch_id", F.length("dom_tree").alias("size"), "total_nodes", "max_depth")


def dom_export_stats(spark: SparkSession, d: str) -> DataFrame:
    """Nodes and depth of the exported trees, beside what their metadata says."""
    flat = nested.flatten_records(table(spark, d, "dom_trees"), "dom_id", "dom_tree", values=True).where("record_kind = 'node'")
    s = dom.tree_stats(flat.select("dom_id", (F.size(F.split("record_key", r"\.")) - 1).alias("depth")), "dom_id")
    told = table(spark, d, "dom_trees").select("dom_id", F.col("metadata.total_nodes").alias("told_nodes"), F.col("metadata.max_depth").alias("told_depth"))
    return s.join(told, "dom_id")


def dom_screenshots(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of all exported trees joined by whole position to the component shots of their page, which
    were taken when the page was exported first."""
    t = table(spark, d, "dom_trees").where("url IS NOT NULL").select("dom_id", "url")
    v = nested.flatten_records(table(spark, d, "dom_trees"), "dom_id", "dom_tree", values=True).where("record_kind = 'box'")
    box = v.select("dom_id", F.col("parent_key").alias("node"), *(F.expr(f"try_cast(get_json_object(value, '$.{c}') AS DOUBLE)").alias(c) for c in ("x", "y")))
    box = box.where("x IS NOT NULL AND y IS NOT NULL").join(t, "dom_id")
    first = t.groupBy("url").agg(F.min("dom_id").alias("dom_id"))
    shots = box.join(first, ["dom_id", "url"], "left_semi")
    shots = shots.select("url", "x", "y", F.col("node").alias("seq"), F.concat(F.lit("component_"), F.replace("node", F.lit("."), F.lit("_")), F.lit("_x"), F.col("x").cast("int"), F.lit("_y"), F.col("y").cast("int")).alias("path"))
    return dom.link_by_position(box, shots, "url").select("dom_id", "node", "screenshot_path")


def consent_pages(spark: SparkSession, d: str) -> DataFrame:
    return _html(spark, d).where(dom.has_consent_button(F.col("html"))).select("fetch_id")


def page_metadata(spark: SparkSession, d: str) -> DataFrame:
    p = _fetches(spark, d).where("content IS NOT NULL")
    m = storage.page_metadata(p, F.col("fetched_at"))
    return m.groupBy("path").agg(F.max("metadata").alias("metadata"))


def fetch_replay(spark: SparkSession, d: str) -> DataFrame:
    """Fetch results of all fetched urls and of the link targets, from the last stored answer of each."""
    want = table(spark, d, "fetches").select("url").union(table(spark, d, "links").select("url")).where("url IS NOT NULL").distinct()
    last = _fetches(spark, d).groupBy("url").agg(F.max_by(F.struct("content", "response_time", "status_code", "error"), "fetch_id").alias("f")).select("url", "f.*")
    r = replay.fetch_stored(want, last)
    return r.select("url", F.length("content").alias("size"), "error", "status_code")


def saved_pages(spark: SparkSession, d: str) -> DataFrame:
    """Contents and texts written by the page sink, split by kind and domain, and read back."""
    f = _fetches(spark, d).where("url IS NOT NULL")
    kinds = F.explode(F.array(F.struct(F.lit("html").alias("kind"), F.col("content").alias("content")), F.struct(F.lit("text").alias("kind"), F.col("parsed_data.text_content").alias("content"))))
    out = f"{checkpoint_dir(spark)}/saved-{uuid.uuid4().hex}"
    storage.save_pages(f.select("url", kinds.alias("k")).select("k.kind", "url", "k.content").where("content IS NOT NULL"), out, compress=True)
    back = spark.read.schema("url string, content string, page string, kind string, domain string").json(out)
    return back.groupBy("kind", "domain").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("characters"), F.countDistinct("page").alias("pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        url_parts, url_canonical, url_equivalent_pairs, url_dedup, dedup_stats, html_hash, content_dedup, bloom_membership, page_title, page_links, page_stylesheets,
        page_inline_css, page_meta, page_images, page_text_hash, page_parsed, dom_stats, dom_components, dom_json, dom_export_stats, dom_screenshots, consent_pages,
        page_metadata, fetch_replay, saved_pages,
    )
}

_H = "(SELECT fetch_id, url, parsed_data.html AS html FROM fetches WHERE parsed_data.html IS NOT NULL)"
_UN = lambda x: f"replace(replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&')"
RESOLVE = lambda x, base="url": f"CASE WHEN {x} = '' THEN {base} WHEN regexp_matches({x}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {x} WHEN {x} LIKE '//%' THEN {_part(base, 1)} || ':' || {x} WHEN {x} LIKE '/%' THEN {_part(base, 1)} || '://' || {_part(base, 2)} || {x} ELSE 'x' END"
_NORM = "regexp_replace(regexp_replace(content, '(?s)<!--.*?-->', '', 'g'), '(?is)<script\\b.*?</script>', '', 'g')"
for _p in html.DYNAMIC:
    _NORM = f"regexp_replace({_NORM}, '{_p.replace(chr(39), chr(39) * 2)}', '', 'g')"
_WS = "[\\s\\x0b\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"
_HASH = f"sha256(trim(regexp_replace({_NORM}, '{_WS}', ' ', 'g'), ' '))"

PAGE_LINKS = f"""
        WITH a AS (SELECT fetch_id, url, unnest(regexp_extract_all(html, '(?i)<a\\s(?:[^>]*?\\s)?href\\s*=\\s*"([^"]*)"', 1)) AS href, generate_subscripts(regexp_extract_all(html, '(?i)<a\\s(?:[^>]*?\\s)?href\\s*=\\s*"([^"]*)"', 1), 1) AS i FROM {_H}),
             b AS (SELECT fetch_id, url, i, {_UN('href')} AS h FROM a), c AS (SELECT fetch_id, i, {RESOLVE('h')} AS link FROM b),
             e AS (SELECT fetch_id, link, min(i) AS i FROM c WHERE link LIKE 'http://%' OR link LIKE 'https://%' GROUP BY fetch_id, link)
        SELECT fetch_id, CAST(row_number() OVER (PARTITION BY fetch_id ORDER BY i) - 1 AS INTEGER) AS position, link FROM e"""
_AT = lambda t, k: f"regexp_extract({t}, '(?i)\\b{k}\\s*=\\s*\"([^\"]*)\"', 1)"
_BITS = "list_transform([0, 1, 2], lambda s: ((('0x' || substr(md5(url || s), 1, 16))::UBIGINT::HUGEINT % 1000000) * (18446744073709551616 % 1000000) + ('0x' || substr(md5(url || s), 17, 16))::UBIGINT::HUGEINT % 1000000) % 1000000)"
_FOLDER = f"'crawl_data/' || replace(replace({_part('url', 2)}, 'www.', ''), ':', '_') || '/' || substr(md5(url), 1, 12)"

SQL: dict[str, str] = {
    "url_parts": f"""
        SELECT fetch_id, lower({_part('url', 2)}) AS domain, CASE WHEN contains({_part('url', 3)}, '.') THEN lower(list_last(string_split({_part('url', 3)}, '.'))) ELSE '' END AS extension,
          substr(md5(url), 1, 12) AS url_hash, replace(replace({_part('url', 2)}, 'www.', ''), ':', '_') AS clean_domain,
          CASE WHEN contains(url, '//') THEN split_part(split_part(url, '//', 2), '/', 1) ELSE 'unknown' END AS retry_domain,
          'crawl_data/' || replace(replace({_part('url', 2)}, 'www.', ''), ':', '_') || '/' || substr(md5(url), 1, 12) || '/html.html' AS path FROM fetches""",
    "url_canonical": f"WITH {CANON} SELECT fetch_id, c AS canonical FROM canon",
    "url_equivalent_pairs": f"WITH {CANON}, u AS (SELECT DISTINCT url, c FROM canon), m AS (SELECT c, min(url) AS representative FROM u GROUP BY c) SELECT representative, url FROM u JOIN m USING (c) WHERE url <> representative",
    "url_dedup": f"""
        WITH {CANON}, r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY fetched_at NULLS FIRST, fetch_id) AS n, first_value(url) OVER (PARTITION BY c ORDER BY fetched_at NULLS FIRST, fetch_id) AS original_url FROM canon)
        SELECT fetch_id, n > 1 AS is_duplicate, original_url, CASE WHEN n > 1 THEN 'Duplicate of ' || original_url || ' (canonical: ' || c || ')' ELSE 'OK' END AS reason FROM r""",
    "dedup_stats": f"""
        WITH {CANON}, a AS (SELECT count(c) AS uc, count(DISTINCT c) AS uu FROM canon), b AS (SELECT count(h) AS cc, count(DISTINCT h) AS cu FROM (SELECT {_HASH} AS h FROM fetches))
        SELECT uc AS urls_checked, uu AS unique_urls, cc AS contents_checked, cu AS unique_contents, uc - uu AS duplicate_urls, round((uc - uu) / greatest(uc, 1) * 100, 6) AS url_duplicate_rate,
          cc - cu AS duplicate_contents, round((cc - cu) / greatest(cu, 1) * 100, 6) AS content_duplicate_rate FROM a, b""",
    "html_hash": f"SELECT fetch_id, {_HASH} AS hash FROM fetches WHERE content IS NOT NULL",
    "content_dedup": """
        SELECT doc_id, text IS NOT NULL AND row_number() OVER w > 1 AS is_duplicate, CASE WHEN text IS NOT NULL THEN first_value(doc_id) OVER w END AS original_doc
        FROM documents WINDOW w AS (PARTITION BY text ORDER BY doc_id)""",
    "page_title": f"SELECT fetch_id, trim({_UN('regexp_extract(html, ' + chr(39) + '(?is)<title[^>]*>(.*?)</title>' + chr(39) + ', 1)')}, ' ') AS title FROM {_H}",
    "page_links": PAGE_LINKS,
    "page_inline_css": f"""
        WITH a AS (SELECT fetch_id, list_filter(regexp_extract_all(html, '(?is)<style[^>]*>(.*?)</style>', 1), lambda x: x <> '') AS s FROM {_H})
        SELECT fetch_id, CAST(generate_subscripts(s, 1) - 1 AS INTEGER) AS position, unnest(s) AS css FROM a""",
    "page_images": f"SELECT fetch_id, unnest(list_distinct(regexp_extract_all(html, '(?i)<img\\s(?:[^>]*?\\s)?src\\s*=\\s*\"([^\"]+)\"', 1))) AS image FROM {_H}",
    "bloom_membership": f"""
        WITH bits AS (SELECT DISTINCT unnest({_BITS}) AS b FROM (SELECT DISTINCT url FROM fetches WHERE url IS NOT NULL)), l AS (SELECT DISTINCT link_id, url FROM links WHERE url IS NOT NULL), p AS (SELECT link_id, url, unnest({_BITS}) AS b FROM l)
        SELECT link_id, bool_and(b IN (FROM bits)) AS maybe, any_value(url) IN (SELECT url FROM fetches WHERE url IS NOT NULL) AS fetched FROM p GROUP BY link_id""",
    "page_stylesheets": f"""
        WITH a AS (SELECT fetch_id, url, unnest(regexp_extract_all(html, '(?i)<link\\s[^>]*>')) AS tag, generate_subscripts(regexp_extract_all(html, '(?i)<link\\s[^>]*>'), 1) AS i FROM {_H}),
        b AS (SELECT fetch_id, url, i, {_UN(_AT("tag", "href"))} AS h FROM a WHERE regexp_matches(tag, '(?i)\\brel\\s*=\\s*"(?:[^"]*\\s)?stylesheet(?:\\s[^"]*)?"') AND {_AT("tag", "href")} <> ''),
        c AS (SELECT fetch_id, url, {RESOLVE("h")} AS css_url, min(i) AS i FROM b GROUP BY ALL), e AS (SELECT url, css_url, CAST(row_number() OVER (PARTITION BY fetch_id ORDER BY i) - 1 AS INTEGER) AS position FROM c)
        SELECT DISTINCT url, position, css_url, translate(CASE WHEN {_part("css_url", 3)} = '' THEN substr(md5(css_url), 1, 12) ELSE regexp_replace(list_last(string_split(rtrim({_part("css_url", 3)}, '/'), '/')), '\\.css$', '') END, './\\ :', '_____') AS filename FROM e WHERE position < 50""",
    "page_meta": f"""
        WITH a AS (SELECT fetch_id, unnest(regexp_extract_all(html, '(?i)<meta\\s[^>]*>')) AS tag, generate_subscripts(regexp_extract_all(html, '(?i)<meta\\s[^>]*>'), 1) AS i FROM {_H}),
        b AS (SELECT fetch_id, i, CASE WHEN {_AT("tag", "name")} <> '' THEN {_AT("tag", "name")} ELSE {_AT("tag", "property")} END AS name, {_UN(_AT("tag", "content"))} AS content FROM a)
        SELECT fetch_id, name, arg_max(content, i) AS content FROM b WHERE name <> '' AND content <> '' GROUP BY fetch_id, name""",
    "page_text_hash": f"""
        WITH a AS (SELECT fetch_id, regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<script\\b.*?</script>', '', 'g'), '(?is)<style\\b.*?</style>', '', 'g') AS t FROM {_H})
        SELECT fetch_id, md5(regexp_replace(array_to_string(list_transform(regexp_split_to_array(t, '<[^>]*>'), lambda x: regexp_replace({_UN("x")}, '^{_WS}|{_WS}$', '', 'g')), ''), '\\s+', '', 'g')) AS text_hash FROM a""",
    "dom_export_stats": f"""{TREE}
        SELECT n.dom_id, count(*) AS total_nodes, CAST(max(len(string_split(path, '.')) - 1) AS INTEGER) AS max_depth, any_value(d.metadata.total_nodes) AS told_nodes, any_value(d.metadata.max_depth) AS told_depth FROM n JOIN dom_trees d USING (dom_id) GROUP BY n.dom_id""",
    "dom_screenshots": f"""{TREE}, bx AS (SELECT dom_id, url, path AS node, TRY_CAST(json_extract_string(o, '$.x') AS DOUBLE) AS x, TRY_CAST(json_extract_string(o, '$.y') AS DOUBLE) AS y FROM b JOIN dom_trees USING (dom_id) WHERE url IS NOT NULL),
        sh AS (SELECT url, CAST(trunc(x) AS INTEGER) AS xi, CAST(trunc(y) AS INTEGER) AS yi, arg_max('component_' || replace(node, '.', '_') || '_x' || CAST(trunc(x) AS INTEGER) || '_y' || CAST(trunc(y) AS INTEGER), node) AS screenshot_path
          FROM bx WHERE x IS NOT NULL AND y IS NOT NULL AND dom_id IN (SELECT min(dom_id) FROM dom_trees WHERE url IS NOT NULL GROUP BY url) GROUP BY ALL)
        SELECT dom_id, node, screenshot_path FROM bx LEFT JOIN sh ON sh.url = bx.url AND xi = CAST(trunc(x) AS INTEGER) AND yi = CAST(trunc(y) AS INTEGER) WHERE x IS NOT NULL AND y IS NOT NULL""",
    "page_metadata": f"""
        SELECT {_FOLDER} || '/metadata.json' AS path, max('{{"url":' || to_json(url) || ',"url_hash":"' || substr(md5(url), 1, 12) || '","domain":' || to_json(replace(replace({_part('url', 2)}, 'www.', ''), ':', '_'))
          || CASE WHEN fetched_at IS NULL THEN '' ELSE ',"crawled_at":"' || strftime(fetched_at, '%Y-%m-%dT%H:%M:%S') || '"' END || '}}') AS metadata FROM fetches WHERE content IS NOT NULL GROUP BY 1""",
    "fetch_replay": """
        WITH w AS (SELECT url FROM fetches WHERE url IS NOT NULL UNION SELECT url FROM links WHERE url IS NOT NULL), l AS (SELECT url, arg_max(struct_pack(content, status_code, error), fetch_id) AS f FROM fetches WHERE url IS NOT NULL GROUP BY url)
        SELECT w.url, CASE WHEN f.status_code = 200 THEN length(f.content) END AS size, CASE WHEN f.status_code = 200 THEN NULL WHEN f.status_code IS NOT NULL THEN 'HTTP ' || f.status_code ELSE coalesce(f.error, 'not stored') END AS error, f.status_code AS status_code FROM w LEFT JOIN l USING (url)""",
    "saved_pages": f"""
        WITH a AS (SELECT url, 'html' AS kind, content AS c FROM fetches UNION ALL SELECT url, 'text', parsed_data.text_content FROM fetches)
        SELECT kind, replace(replace({_part('url', 2)}, 'www.', ''), ':', '_') AS domain, count(*) AS n, CAST(sum(length(c)) AS BIGINT) AS characters, count(DISTINCT md5(url)) AS pages FROM a WHERE url IS NOT NULL AND c IS NOT NULL GROUP BY ALL""",
    "consent_pages": f"SELECT fetch_id FROM {_H} WHERE regexp_matches(html, '(?i)<button\\b[^>]*\\b(?:id|class)\\s*=\\s*\"[^\"]*(?:accept|cookie)|id\\s*=\\s*\"[^\"]*cookieConsent|class\\s*=\\s*\"[^\"]*\\bcookie-banner\\b')",
}
