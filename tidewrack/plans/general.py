"""Queries of the general operators: skewed keys (p2) and nested records (p6)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.operators import nested, skew
from tidewrack.session import table


def p2_domain_rollup(spark: SparkSession, d: str) -> DataFrame:
    r = skew.domain_rollup(table(spark, d, "links"), table(spark, d, "domain_metrics"))
    return r.select(
        "domain", F.col("l_n").alias("n_links"), F.col("r_n").alias("n_snapshots"), F.col("pairs").cast("long").alias("pairs"),
        F.col("l_sum_priority").alias("priority"), F.col("r_sum_pages_crawled").alias("pages"),
        F.col("join_sum_l_priority").cast("long").alias("joined_priority"), F.col("join_sum_r_pages_crawled").cast("long").alias("joined_pages"),
    )


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    links, metrics = table(spark, d, "links"), table(spark, d, "domain_metrics")
    return skew.dominating(skew.domain_rollup(links, metrics), links, metrics)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.flatten_records(table(spark, d, "dom_trees"), "dom_id", "dom_tree")


def _values(spark: SparkSession, d: str) -> DataFrame:
    return nested.flatten_records(table(spark, d, "dom_trees"), "dom_id", "dom_tree", values=True)


def p6_nodes(spark: SparkSession, d: str) -> DataFrame:
    v = _values(spark, d).where("record_kind = 'node'")
    return v.select("dom_id", F.col("record_key").alias("node"), F.col("parent_key").alias("parent"), "tag_name", "element_id", "text_content", "depth")


def p6_attributes(spark: SparkSession, d: str) -> DataFrame:
    v = _values(spark, d).where("record_kind = 'attribute'")
    text = F.when(F.col("value").startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), "value", F.lit("}")), "$.v")).otherwise(F.col("value"))
    return v.select("dom_id", F.col("parent_key").alias("node"), "name", text.alias("value"))


def p6_boxes(spark: SparkSession, d: str) -> DataFrame:
    v = _values(spark, d).where("record_kind = 'box'")
    side = lambda c: F.expr(f"try_cast(get_json_object(value, '$.{c}') AS DOUBLE)")
    return v.select("dom_id", F.col("parent_key").alias("node"), *(side(c).alias(c) for c in ("x", "y", "width", "height")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p2_found": p2_found,
    "p2_domain_rollup": p2_domain_rollup,
    "p6_found": p6_found,
    "p6_nodes": p6_nodes,
    "p6_attributes": p6_attributes,
    "p6_boxes": p6_boxes,
}

_DOMAIN = "coalesce(lower(domain), lower(regexp_extract(url, '^(?:[^:/?#]+:)?//(?:[^/?#@]*@)?([^/?#:]*)', 1)))"

TREE = """
WITH RECURSIVE t AS (SELECT dom_id, CAST(dom_tree AS JSON) AS j FROM dom_trees WHERE json_valid(dom_tree)),
n AS (SELECT dom_id, '0' AS path, '' AS parent, j FROM t WHERE json_type(j) = 'OBJECT'
  UNION ALL SELECT dom_id, path || '.' || (u.i - 1), path, c[u.i]
  FROM (SELECT dom_id, path, CASE json_type(j, '$.children') WHEN 'OBJECT' THEN [json_extract(j, '$.children')] WHEN 'ARRAY' THEN json_extract(j, '$.children[*]') ELSE [] END AS c FROM n) x,
    unnest(range(1, len(c) + 1)) AS u(i) WHERE json_type(c[u.i]) = 'OBJECT'),
a AS (SELECT dom_id, path, json_extract(j, '$.attributes') AS o, unnest(json_keys(j, '$.attributes')) AS k FROM n WHERE json_type(j, '$.attributes') = 'OBJECT'),
b AS (SELECT dom_id, path, json_extract(j, '$.bounding_box') AS o FROM n WHERE json_type(j, '$.bounding_box') <> 'NULL')
"""

SQL: dict[str, str] = {
    "p6_found": f"""{TREE} SELECT dom_id, 'node' AS record_kind, path AS record_key, parent AS parent_key FROM n
        UNION ALL SELECT dom_id, 'box', path || '#box', path FROM b
        UNION ALL SELECT dom_id, 'attribute', path || '@' || k, path FROM a WHERE json_type(o, '$."' || k || '"') <> 'NULL'""",
    "p6_nodes": f"""{TREE} SELECT dom_id, path AS node, parent, json_extract_string(j, '$.tag_name') AS tag_name, json_extract_string(j, '$.element_id') AS element_id,
        json_extract_string(j, '$.text_content') AS text_content, CAST(json_extract(j, '$.depth') AS INTEGER) AS depth FROM n""",
    "p6_attributes": f"""{TREE} SELECT dom_id, path AS node, k AS name, json_extract_string(o, '$."' || k || '"') AS value FROM a WHERE json_type(o, '$."' || k || '"') <> 'NULL'""",
    "p6_boxes": f"""{TREE} SELECT dom_id, path AS node, TRY_CAST(json_extract_string(o, '$.x') AS DOUBLE) AS x, TRY_CAST(json_extract_string(o, '$.y') AS DOUBLE) AS y,
        TRY_CAST(json_extract_string(o, '$.width') AS DOUBLE) AS width, TRY_CAST(json_extract_string(o, '$.height') AS DOUBLE) AS height FROM b""",
    "p2_found": f"""
        WITH l AS (SELECT {_DOMAIN} AS domain, count(*) AS n FROM links GROUP BY 1),
             m AS (SELECT lower(domain) AS domain, sum(pages_crawled) AS n FROM domain_metrics GROUP BY 1)
        SELECT 'links' AS table_name, domain FROM l WHERE domain IS NOT NULL AND n * 100 >= 3 * (SELECT count(*) FROM links)
        UNION ALL
        SELECT 'domain_metrics', domain FROM m WHERE domain IS NOT NULL AND n > 0 AND n * 100 >= 3 * (SELECT sum(pages_crawled) FROM domain_metrics)""",
    "p2_domain_rollup": f"""
        WITH l AS (SELECT {_DOMAIN} AS domain, count(*) AS n, sum(priority) AS priority FROM links GROUP BY 1),
             m AS (SELECT lower(domain) AS domain, count(*) AS n, sum(pages_crawled) AS pages FROM domain_metrics GROUP BY 1)
        SELECT domain, coalesce(l.n, 0) AS n_links, coalesce(m.n, 0) AS n_snapshots, coalesce(l.n, 0) * coalesce(m.n, 0) AS pairs,
               CAST(priority AS BIGINT) AS priority, CAST(pages AS BIGINT) AS pages,
               CAST(priority * coalesce(m.n, 0) AS BIGINT) AS joined_priority, CAST(pages * coalesce(l.n, 0) AS BIGINT) AS joined_pages
        FROM l FULL JOIN m USING (domain)""",
}
