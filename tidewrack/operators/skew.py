"""Per-key results over inputs in which a few keys hold most rows.

Eager aggregation: each input is reduced to one compact state per key before the join. The
reduction runs as map-side partial aggregates, so a key with a third of all rows sends one row
per input partition instead of its records, and the join sees at most one row per key and side.
What the join of the records would have given follows from the states: pair counts multiply,
and a sum over one side is scaled by the other side's count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack.functions import urls


def key_states(df: DataFrame, key: Column, name: str, sums: Sequence[str] = (), prefix: str = "") -> DataFrame:
    """One row per key: {prefix}n, and for each column c of sums {prefix}sum_c (null if c is
    null in all rows) and {prefix}cnt_c. Rows whose key is null form the state of the null key."""
    aggs = [F.count(F.lit(1)).alias(f"{prefix}n")]
    for c in sums:
        aggs += [F.sum(df[c]).alias(f"{prefix}sum_{c}"), F.count(df[c]).alias(f"{prefix}cnt_{c}")]
    return df.groupBy(key.alias(name)).agg(*aggs)


def eager_join_aggregate(
    left: DataFrame,
    right: DataFrame,
    left_key: Column,
    right_key: Column,
    left_sums: Sequence[str] = (),
    right_sums: Sequence[str] = (),
    name: str = "key",
    how: str = "inner",
) -> DataFrame:
    """Per key, the aggregates of `left JOIN right ON left_key = right_key` without that join.

    Columns: name, l_n, r_n (records of each side), pairs (rows of the join), and for each summed
    column c its sum over the rows of the join (join_sum_l_c, join_sum_r_c) and its sum over its
    own side (l_sum_c, r_sum_c). Null keys join nothing; with how="full" they and keys of one side
    come out with 0 for the other side's counts. Empty inputs give an empty result. Sums of
    integers are exact BIGINTs, and what is multiplied is DECIMAL(38, 0). Column names of the inputs may clash; only the named columns are
    read.
    """
    ls = key_states(left, left_key, name, left_sums, "l_")
    rs = key_states(right, right_key, name, right_sums, "r_")
    j = ls.join(rs, name, how)
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    wide = lambda c: c.cast("decimal(20,0)")
    j = j.withColumns({"l_n": n("l_n"), "r_n": n("r_n")}).withColumn("pairs", wide(F.col("l_n")) * wide(F.col("r_n")))
    extra = {f"join_sum_l_{c}": wide(F.col(f"l_sum_{c}")) * wide(F.col("r_n")) for c in left_sums}
    extra |= {f"join_sum_r_{c}": wide(F.col(f"r_sum_{c}")) * wide(F.col("l_n")) for c in right_sums}
    return j.withColumns(extra) if extra else j


def link_domain(links: DataFrame) -> Column:
    """Lower-cased domain of a link row; host of its url where the domain is null."""
    return F.coalesce(F.lower(links["domain"]), F.when(links["url"].isNotNull(), urls.host(links["url"])))


def domain_rollup(links: DataFrame, metrics: DataFrame) -> DataFrame:
    """All domains of both tables with the states and join aggregates of links and metrics.

    links needs url, domain, priority, depth; metrics needs domain, pages_crawled, errors. Rows are
    counted as delivered. The null domain is a row of its own per table.
    """
    return eager_join_aggregate(
        links, metrics, link_domain(links), F.lower(metrics["domain"]),
        ["priority", "depth"], ["pages_crawled", "errors"], "domain", "full",
    )


def dominating(rollup: DataFrame, links: DataFrame, metrics: DataFrame, percent: int = 3) -> DataFrame:
    """(table_name, domain): domains with at least percent % of all link rows, and those with at
    least percent % of all pages crawled. Shares are compared as integers. Totals come from scalar
    subqueries that read no (links) or one (metrics) column. The null domain is never named."""
    n_links = links.agg(F.count(F.lit(1)).alias("n"))
    n_pages = metrics.agg(F.sum("pages_crawled").alias("n"))
    known = rollup.where(F.col("domain").isNotNull())
    tags = F.array(
        F.when((F.col("l_n") > 0) & (F.col("l_n") * 100 >= n_links.scalar() * percent), F.lit("links")),
        F.when((F.col("r_sum_pages_crawled") > 0) & (F.col("r_sum_pages_crawled") * 100 >= n_pages.scalar() * percent), F.lit("domain_metrics")),
    )
    # materialise the tags first: a generator can't hold a subquery
    tagged = known.select("domain", tags.alias("tags"))
    return tagged.select(F.explode(F.array_compact("tags")).alias("table_name"), "domain")
