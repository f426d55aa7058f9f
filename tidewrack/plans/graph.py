"""Queries over the link graph and the frontier, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.config import CrawlConfig, GraphConfig, Mode
from tidewrack.functions import html, urls
from tidewrack.operators import frontier, links
from tidewrack.plans.web import CANON, PAGE_LINKS, RESOLVE as _RES
from tidewrack.session import spread, table

SEEDS = ["ivory-notes.example", "quartz-workshop.example"]
ALLOWED = ["ivory-notes.example", "fallow-almanac.example", "cinder-review.example"]
BLOCKED = ["umber-notes.example"]
IMPORTANT = ["cinder-review.example"]
KEYWORDS = ("archive", "lantern", "library")
ORDER = ["discovered_at", "link_id"]


def config(mode: Mode, **kw) -> GraphConfig:
    return GraphConfig(mode=mode, allowed=frozenset(ALLOWED), blocked=frozenset(BLOCKED), priority=frozenset(IMPORTANT), keywords=KEYWORDS, **kw)


def _links(spark: SparkSession, d: str) -> DataFrame:
    """Links once each: rows that were delivered twice count once."""
    return spread(table(spark, d, "links").where("url IS NOT NULL")).dropDuplicates(["link_id"])


def _priority(mode: Mode = Mode.WHITELIST, text: bool = True):
    return links.priority(config(mode), F.col("url"), F.col("source_url"), urls.domain("url"), F.col("depth"), F.col("link_text") if text else None)


def link_priority(spark: SparkSession, d: str) -> DataFrame:
    return _links(spark, d).select("link_id", _priority().cast("int").alias("score"))


def high_priority_links(spark: SparkSession, d: str) -> DataFrame:
    return link_priority(spark, d).where(F.col("score") > links.HIGH_PRIORITY)


def _stored(spark: SparkSession, d: str) -> DataFrame:
    """(url, links): the stored pages with the links of their last fetch."""
    p = table(spark, d, "fetches").where("parsed_data IS NOT NULL AND url IS NOT NULL")
    return p.groupBy("url").agg(F.max_by(F.col("parsed_data.links"), "fetch_id").alias("links"))


def link_edges(spark: SparkSession, d: str) -> DataFrame:
    """Scored edges of the stored pages, from their parsed links."""
    return links.page_edges(_stored(spark, d), GraphConfig(), F.lit(0)).select("source_url", "url", "domain", "depth", "position", "priority")


def link_ranks(spark: SparkSession, d: str) -> DataFrame:
    """The same edges in the order in which each page's links are queued."""
    return links.by_priority(link_edges(spark, d)).select("source_url", "url", "position", "rank")


def keyword_bonus(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "fetches").select("fetch_id", links.keyword_bonus(F.col("content"), KEYWORDS).alias("bonus"))


#: Limits under which the admission queries have rows of each kind.
ADMIT = {"max_domains": 12, "min_domain_score": 0.5}


def _admitted(mode: Mode):
    """Admission of each link target's domain, with what the links so far made known: the first domains in
    order of discovery up to the limit, and their scores."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        known = links.domain_cap(_links(spark, d), SEEDS, ORDER, ADMIT["max_domains"]).select("domain", F.lit(True).alias("known"))
        dom = _links(spark, d).select(urls.domain("url").alias("domain")).distinct()
        dom = dom.join(known, "domain", "left").join(_scores(spark, d).select("domain", F.round("score", 4).alias("score")), "domain", "left")
        a = links.admission(config(mode, **ADMIT), F.col("domain"), SEEDS, F.coalesce("known", F.lit(False)), F.lit(ADMIT["max_domains"]), F.col("score"))
        return dom.select("domain", a["accepted"].alias("accepted"), a["reason"].alias("reason"))

    return run


def domain_link_counts(spark: SparkSession, d: str) -> DataFrame:
    return links.domain_link_counts(table(spark, d, "links"))


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return links.domain_scores(_links(spark, d), SEEDS, IMPORTANT, ORDER)


def domain_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).select("domain", "n_links", F.round("score", 6).alias("score"))


def top_domains(spark: SparkSession, d: str) -> DataFrame:
    return links.top_domains(domain_link_counts(spark, d), _links(spark, d), ORDER)


def graph_statistics(spark: SparkSession, d: str) -> DataFrame:
    return links.graph_statistics(_links(spark, d), _scores(spark, d), SEEDS)


def link_depths(spark: SparkSession, d: str) -> DataFrame:
    return links.last_depth(_links(spark, d), ORDER)


def domain_cap(spark: SparkSession, d: str) -> DataFrame:
    return links.domain_cap(_links(spark, d), SEEDS, ORDER, 10)


def _frontier(spark: SparkSession, d: str) -> DataFrame:
    """Link targets with the priority of their first discovery."""
    l = _links(spark, d).select("url", F.struct(*ORDER).alias("at"), _priority(text=False).alias("priority"))
    f = l.groupBy("url").agg(F.min_by("priority", "at").alias("priority"), F.min("at").alias("at"))
    return f.where("priority > 0").select("url", F.col("priority").cast("int").alias("priority"), "at.*")


def frontier_topk(spark: SparkSession, d: str) -> DataFrame:
    return frontier.pop(_frontier(spark, d), 100).select("url", "priority")


def frontier_unvisited(spark: SparkSession, d: str) -> DataFrame:
    """New links that are neither fetched nor in the queue, which holds the 500 best of them."""
    seen = table(spark, d, "fetches").select("url")
    return frontier.push(_frontier(spark, d), frontier.pop(_frontier(spark, d), 500), seen).select("url", "priority")


def frontier_batch(spark: SparkSession, d: str) -> DataFrame:
    return frontier.pop_stable(_frontier(spark, d), 50, ORDER).select("url", "priority")


def budget_pages(spark: SparkSession, d: str) -> DataFrame:
    from tidewrack.operators import dedup

    f = table(spark, d, "fetches").select("fetch_id", "url", "fetched_at")
    g = dedup.first_by(f, urls.canonical("url"), ["fetched_at", "fetch_id"]).withColumn("is_blocked", urls.site("url").isin(BLOCKED))
    return frontier.budget(g, 100, ["fetched_at", "fetch_id"]).select("fetch_id")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Links of the stored pages that aren't fetched yet: canonical first-wins dedup, extraction, resolution,
    scoring, the 100 best. Links are taken out of the markup before anything is joined."""
    from tidewrack.operators import dedup

    f = spread(table(spark, d, "fetches").where("parsed_data.html IS NOT NULL").select("fetch_id", "url", "fetched_at", F.col("parsed_data.html").alias("html")))
    first = dedup.first_by(f.select("fetch_id", "url", "fetched_at"), urls.canonical("url"), ["fetched_at", "fetch_id"]).where("NOT is_duplicate").select("fetch_id")
    p = f.select("fetch_id", "url", html.links(F.col("html"), F.col("url")).alias("links")).join(first, "fetch_id", "left_semi")
    e = links.page_edges(p, GraphConfig(), F.lit(0))
    best = e.groupBy("url").agg(F.max("priority").alias("priority"))
    return frontier.pop(best.join(table(spark, d, "fetches").select("url"), "url", "left_anti"), 100)


def _crawl(spark: SparkSession, d: str, n: int) -> tuple[DataFrame, CrawlConfig]:
    p = _stored(spark, d)
    seeds = [r[0] for r in p.where(urls.site("url").isin(SEEDS)).orderBy("url").limit(n).collect()]
    return p, CrawlConfig(seeds=tuple(seeds), graph=GraphConfig(mode=Mode.FOCUSED))


def crawl_replay(spark: SparkSession, d: str) -> DataFrame:
    """A whole-graph crawl with the default budget, in rounds of 10, over the stored pages."""
    p, cfg = _crawl(spark, d, 10)
    return frontier.replay(p, cfg, batch=10)


def crawl_queue_depth(spark: SparkSession, d: str) -> DataFrame:
    """Pages taken and urls queued after each round of a crawl with the default budget."""
    p, cfg = _crawl(spark, d, 5)
    log: list[tuple[int, int, int]] = []
    frontier.replay(p, cfg, 10, log)
    return spark.createDataFrame(log, "round int, pages int, queue_depth int")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        link_priority, high_priority_links, link_edges, link_ranks, keyword_bonus, domain_link_counts, domain_scores, top_domains, graph_statistics, link_depths, domain_cap,
        frontier_topk, frontier_unvisited, frontier_batch, budget_pages, flagship, crawl_replay, crawl_queue_depth,
    )
} | {f"admission_{m.value}": _admitted(m) for m in Mode}

_in = lambda xs: ", ".join(f"'{x}'" for x in xs)
_L = "(SELECT DISTINCT * FROM links WHERE url IS NOT NULL)"
_DOM = "lower(regexp_extract(url, '^(?:[^:/?#]+:)?(?://([^/?#]*))?', 1))"
_SRC = "lower(regexp_extract(source_url, '^(?:[^:/?#]+:)?(?://([^/?#]*))?', 1))"
_PATH = "regexp_extract(url, '^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)', 1)"
_PRI = lambda text: f"""CASE WHEN {_DOM} IN ({_in(BLOCKED)}) THEN -1000 ELSE greatest(0, 100
  + CASE WHEN {_DOM} IN ({_in(IMPORTANT)}) THEN 200 WHEN {_DOM} IN ({_in(ALLOWED)}) THEN 100 ELSE 0 END + CASE WHEN {_DOM} = {_SRC} THEN 150 ELSE 0 END - coalesce(depth, 0) * 50
  + CASE WHEN contains({_PATH}, '.') THEN CASE WHEN list_last(string_split({_PATH}, '.')) = '' THEN 50 ELSE 0 END ELSE 50 END
  + CASE WHEN regexp_matches(lower(url), '/({"|".join(links.HIGH_PATTERNS)})/') THEN 30 ELSE 0 END - CASE WHEN regexp_matches(lower(url), '/({"|".join(links.LOW_PATTERNS)})/') THEN 50 ELSE 0 END
  {f"+ CASE WHEN regexp_matches(lower(coalesce(link_text, '')), '{links.GOOD_TEXT}') THEN 25 ELSE 0 END - CASE WHEN regexp_matches(lower(coalesce(link_text, '')), '{links.BAD_TEXT}') THEN 25 ELSE 0 END" if text else ""}) END"""  # noqa: E731
_FRONT = f"f AS (SELECT url, arg_min(p, (discovered_at, link_id)) AS priority, min((discovered_at, link_id)) AS first_at FROM (SELECT *, {_PRI(False)} AS p FROM {_L}) GROUP BY url)"
_ADM = lambda rule: f"SELECT domain, r = 'OK' AS accepted, r AS reason FROM (SELECT domain, CASE WHEN domain IN ({_in(BLOCKED)}) THEN 'Domain ' || domain || ' is blocked' {rule} ELSE 'OK' END AS r FROM (SELECT DISTINCT {_DOM} AS domain FROM {_L}))"
_SCORES = f"""sc AS (SELECT domain, count(*) AS n_links, sum(gain * pow(0.9, k)) AS score FROM (
  SELECT {_DOM} AS domain, priority / 1000 * CASE WHEN {_SRC} IN ({_in(SEEDS)}) THEN 2.0 WHEN {_SRC} IN ({_in(IMPORTANT)}) THEN 1.5 ELSE 1.0 END AS gain,
    row_number() OVER (PARTITION BY {_DOM} ORDER BY discovered_at DESC, link_id DESC) - 1 AS k FROM {_L} WHERE priority IS NOT NULL) GROUP BY domain)"""
_CAP = lambda n: f"cap AS (SELECT domain FROM (SELECT {_DOM} AS domain, min((discovered_at, link_id)) AS first_at FROM {_L} GROUP BY 1) WHERE domain NOT IN ({_in(SEEDS)}) ORDER BY first_at LIMIT {n - len(SEEDS)})"
_KNOWN = f"""WITH {_SCORES}, {_CAP(ADMIT["max_domains"])}, dom AS (SELECT domain, domain IN (FROM cap) OR domain IN ({_in(SEEDS)}) AS known, coalesce(round(score, 4), 0) AS score FROM (SELECT DISTINCT {_DOM} AS domain FROM {_L}) LEFT JOIN sc USING (domain))
  SELECT domain, r = 'OK' AS accepted, r AS reason FROM (SELECT domain, CASE WHEN domain IN ({_in(BLOCKED)}) THEN 'Domain ' || domain || ' is blocked' WHEN NOT known THEN 'Maximum domains ({ADMIT["max_domains"]}) reached'
    WHEN domain NOT IN ({_in(SEEDS)}) AND score < {ADMIT["min_domain_score"]} THEN 'Domain score ' || printf('%.2f', score) || ' below threshold {ADMIT["min_domain_score"]}' ELSE 'OK' END AS r FROM dom)"""
_EDGES = lambda pages: f"""ed AS (SELECT source_url, u.url, {_DOM.replace('url', 'u.url')} AS domain, 1 AS depth, position, CAST(greatest(0, 100 + CASE WHEN {_DOM.replace('url', 'u.url')} = {_SRC} THEN 150 ELSE 0 END - 50
    + CASE WHEN contains({_PATH.replace('url', 'u.url')}, '.') THEN CASE WHEN list_last(string_split({_PATH.replace('url', 'u.url')}, '.')) = '' THEN 50 ELSE 0 END ELSE 50 END
    + CASE WHEN regexp_matches(lower(u.url), '/({"|".join(links.HIGH_PATTERNS)})/') THEN 30 ELSE 0 END - CASE WHEN regexp_matches(lower(u.url), '/({"|".join(links.LOW_PATTERNS)})/') THEN 50 ELSE 0 END) AS INTEGER) AS priority
  FROM (SELECT source_url, CAST(i - 1 AS INTEGER) AS position, {_RES("href", "source_url")} AS url FROM ({pages}) p, unnest(range(1, len(p.links) + 1)) AS t(i), (SELECT p.links[i] AS href)) u WHERE regexp_matches(u.url, '^[^:/?#]+://[^/?#]'))"""  # noqa: E731
_STORED = "SELECT url AS source_url, arg_max(parsed_data.links, fetch_id) AS links FROM fetches WHERE parsed_data IS NOT NULL AND url IS NOT NULL GROUP BY url"

SQL: dict[str, str] = {
    "link_priority": f"SELECT link_id, CAST({_PRI(True)} AS INTEGER) AS score FROM {_L}",
    "high_priority_links": f"SELECT * FROM (SELECT link_id, CAST({_PRI(True)} AS INTEGER) AS score FROM {_L}) WHERE score > 150",
    "link_edges": f"WITH {_EDGES(_STORED)} SELECT * FROM ed WHERE priority > 0",
    "link_ranks": f"WITH {_EDGES(_STORED)} SELECT source_url, url, position, CAST(row_number() OVER (PARTITION BY source_url ORDER BY priority DESC, position) AS INTEGER) AS rank FROM ed WHERE priority > 0",
    "flagship": f"""
        WITH {CANON}, one AS (SELECT fetch_id FROM (SELECT fetch_id, row_number() OVER (PARTITION BY c ORDER BY canon.fetched_at NULLS FIRST, fetch_id) AS n FROM canon JOIN fetches f USING (fetch_id) WHERE f.parsed_data.html IS NOT NULL) WHERE n = 1),
        pl AS ({PAGE_LINKS}), {_EDGES("SELECT f.url AS source_url, list(link) AS links FROM pl JOIN one USING (fetch_id) JOIN fetches f USING (fetch_id) GROUP BY f.fetch_id, f.url")}
        SELECT url, max(priority) AS priority FROM ed WHERE priority > 0 AND url NOT IN (SELECT url FROM fetches WHERE url IS NOT NULL) GROUP BY url ORDER BY priority DESC, url LIMIT 100""",
    "keyword_bonus": "SELECT fetch_id, CAST(" + " + ".join(f"CASE WHEN contains(lower(coalesce(content, '')), '{k}') THEN 25 ELSE 0 END" for k in KEYWORDS) + " AS INTEGER) AS bonus FROM fetches",
    "domain_link_counts": f"SELECT domain, count(*) AS n_links FROM (SELECT DISTINCT source_url, url, {_DOM} AS domain FROM links WHERE url IS NOT NULL AND source_url IS NOT NULL) GROUP BY domain",
    "top_domains": f"""
        SELECT 'domain' AS kind, domain AS subject, n AS value FROM (SELECT domain, count(*) AS n FROM (SELECT DISTINCT source_url, url, {_DOM} AS domain FROM links WHERE url IS NOT NULL AND source_url IS NOT NULL) GROUP BY domain ORDER BY n DESC, domain LIMIT 3)
        UNION ALL SELECT 'example', url, priority FROM (SELECT url, CAST(priority AS BIGINT) AS priority FROM {_L} ORDER BY discovered_at NULLS FIRST, link_id LIMIT 3)""",
    "domain_scores": f"""
        WITH r AS (SELECT {_DOM} AS domain, priority / 1000 * CASE WHEN {_SRC} IN ({_in(SEEDS)}) THEN 2.0 WHEN {_SRC} IN ({_in(IMPORTANT)}) THEN 1.5 ELSE 1.0 END AS gain,
          row_number() OVER (PARTITION BY {_DOM} ORDER BY discovered_at DESC, link_id DESC) - 1 AS k FROM {_L} WHERE priority IS NOT NULL)
        SELECT domain, count(*) AS n_links, round(sum(gain * pow(0.9, k)), 6) AS score FROM r GROUP BY domain""",
    "graph_statistics": f"""
        WITH {_SCORES} SELECT 'discovered_domains' AS name, '' AS subject, CAST(count(*) AS DOUBLE) AS value FROM sc UNION ALL SELECT 'total_queued_links', '', count(*) FROM {_L} UNION ALL SELECT 'max_depth_reached', '', coalesce(max(depth), 0) FROM {_L}
        UNION ALL SELECT 'domain_link_counts', domain, n_links FROM sc UNION ALL SELECT 'domain_scores', domain, round(score, 3) FROM sc UNION ALL SELECT 'seed_domains', unnest([{_in(SEEDS)}]), 1""",
    "link_depths": f"SELECT url, arg_max(depth, (discovered_at, link_id)) AS depth FROM {_L} GROUP BY url",
    "domain_cap": f"""
        WITH o AS (SELECT {_DOM} AS domain, min((discovered_at, link_id)) AS first_at FROM {_L} GROUP BY 1)
        SELECT unnest([{_in(SEEDS)}]) AS domain, true AS is_seed UNION ALL (SELECT domain, false FROM o WHERE domain NOT IN ({_in(SEEDS)}) ORDER BY first_at LIMIT {10 - len(SEEDS)})""",
    "frontier_topk": f"WITH {_FRONT} SELECT url, CAST(priority AS INTEGER) AS priority FROM f WHERE priority > 0 ORDER BY priority DESC, url LIMIT 100",
    "frontier_unvisited": f"WITH {_FRONT} SELECT url, CAST(priority AS INTEGER) AS priority FROM f WHERE priority > 0 AND url NOT IN (SELECT url FROM fetches WHERE url IS NOT NULL) AND url NOT IN (SELECT url FROM f WHERE priority > 0 ORDER BY priority DESC, url LIMIT 500)",
    "frontier_batch": f"WITH {_FRONT} SELECT url, CAST(priority AS INTEGER) AS priority FROM f WHERE priority > 0 ORDER BY priority DESC, first_at LIMIT 50",
    "budget_pages": f"WITH {CANON}, r AS (SELECT fetch_id, fetched_at, url, row_number() OVER (PARTITION BY c ORDER BY fetched_at NULLS FIRST, fetch_id) AS n FROM canon) SELECT fetch_id FROM r WHERE n = 1 AND regexp_replace(lower(regexp_extract(url, '^(?:[^:/?#]+:)?//(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\\.', '') NOT IN ({_in(BLOCKED)}) ORDER BY fetched_at NULLS FIRST, fetch_id LIMIT 100",
    "admission_single_domain": _ADM(f"WHEN domain NOT IN ({_in(SEEDS)}) THEN 'Cross-domain crawling disabled'"),
    "admission_whitelist": _ADM(f"WHEN domain NOT IN ({_in(ALLOWED)}) THEN 'Domain ' || domain || ' not in whitelist'"),
    "admission_cross_domain": _KNOWN,
    "admission_graph": _KNOWN,
    "admission_focused": _ADM(""),
}
