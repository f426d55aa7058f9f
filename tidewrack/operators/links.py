"""Link admission, priority and domain scores.

A link table has url, source_url, domain, depth, link_text and an order (discovered_at, link_id).
Lists of a configuration are short and go into the plan as literals.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewrack.config import GraphConfig, Mode
from tidewrack.functions import urls
from tidewrack.operators.ordered import runs

# Fixed values of the priority rules.
HIGH_EXTENSIONS = ["html", "htm", "php", "asp", "aspx", "jsp", ""]
MEDIUM_EXTENSIONS = ["pdf", "doc", "docx", "txt"]
LOW_EXTENSIONS = ["jpg", "jpeg", "png", "gif", "css", "js"]
BLOCKED_EXTENSIONS = ["zip", "exe", "dmg", "iso", "tar", "gz"]
HIGH_PATTERNS = ["blog", "news", "article", "post", "content", "research", "publications", "papers", "docs"]
LOW_PATTERNS = ["admin", "login", "register", "cart", "checkout", "api", "ajax", "json", "xml"]
GOOD_TEXT = "article|blog|news|read more"
BAD_TEXT = "login|register|cart|buy now"
HIGH_PRIORITY = 150


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def high_pattern(url: Column | str) -> Column:
    return F.lower(_c(url)).rlike("/(" + "|".join(HIGH_PATTERNS) + ")/")


def low_pattern(url: Column | str) -> Column:
    return F.lower(_c(url)).rlike("/(" + "|".join(LOW_PATTERNS) + ")/")


def keyword_bonus(content: Column, keywords: tuple[str, ...]) -> Column:
    """25 for each keyword that the content holds, whatever its case."""
    low = F.coalesce(F.lower(content), F.lit(""))
    return reduce(lambda a, k: a + F.when(low.contains(k.lower()), 25).otherwise(0), keywords, F.lit(0))


def priority(cfg: GraphConfig, url: Column, source_url: Column, domain: Column, depth: Column, link_text: Column | None = None, content: Column | None = None) -> Column:
    """Priority of a link: 0 at least, -1000 if it is blocked."""
    dom, ext = F.lower(domain), F.lower(urls.extension(F.lower(url)))
    one = lambda cond, yes, no=0: F.when(cond, yes).otherwise(no)
    allowed = F.lit(cfg.mode == Mode.WHITELIST) & dom.isin(list(cfg.allowed))
    by_domain = F.when(dom.isin(list(cfg.priority)), 200).when(allowed, 100).otherwise(0)
    if cfg.extension_rules == "dotted":
        by_ext = F.when(ext.isin(HIGH_EXTENSIONS), 50).when(ext.isin(MEDIUM_EXTENSIONS), 20).when(ext.isin(LOW_EXTENSIONS), -30).otherwise(0)
        closed = ext.isin(BLOCKED_EXTENSIONS)
    else:
        by_ext, closed = one(ext == "", 50), F.lit(False)
    score = (
        F.lit(100) + by_domain + one(dom == urls.domain(source_url), 150) - F.coalesce(depth, F.lit(0)) * 50
        + by_ext + one(high_pattern(url), 30) - one(low_pattern(url), 50)
    )
    if link_text is not None:
        text = F.coalesce(F.lower(link_text), F.lit(""))
        score = score + one(text.rlike(GOOD_TEXT), 25) - one(text.rlike(BAD_TEXT), 25)
    if content is not None and cfg.keywords:
        score = score + keyword_bonus(content, cfg.keywords)
    banned = dom.isin(list(cfg.blocked)) & ~dom.isin(list(cfg.priority)) & ~allowed
    return F.when(banned | closed, -1000).otherwise(F.greatest(score, F.lit(0)))


def admission(cfg: GraphConfig, domain: Column, seeds: list[str], discovered: Column | None = None, n_discovered: Column | None = None, score: Column | None = None) -> Column:
    """struct(accepted, reason) for a target domain. discovered tells whether the domain is known,
    n_discovered how many are, score its score (0 where null)."""
    dom = F.lower(domain)
    no = lambda text: F.struct(F.lit(False).alias("accepted"), text.alias("reason"))
    out = F.when(dom.isin(list(cfg.blocked)), no(F.concat(F.lit("Domain "), domain, F.lit(" is blocked"))))
    if cfg.mode == Mode.SINGLE_DOMAIN:
        out = out.when(~dom.isin(seeds), no(F.lit("Cross-domain crawling disabled")))
    elif cfg.mode == Mode.WHITELIST:
        out = out.when(~dom.isin(list(cfg.allowed)), no(F.concat(F.lit("Domain "), domain, F.lit(" not in whitelist"))))
    elif cfg.mode in (Mode.CROSS_DOMAIN, Mode.GRAPH):
        known, n = discovered if discovered is not None else dom.isin(seeds), n_discovered if n_discovered is not None else F.lit(len(seeds))
        value = F.coalesce(score, F.lit(0.0)) if score is not None else F.lit(0.0)
        out = out.when((n >= cfg.max_domains) & ~known, no(F.lit(f"Maximum domains ({cfg.max_domains}) reached")))
        low = F.concat(F.lit("Domain score "), F.format_number(value, 2), F.lit(f" below threshold {cfg.min_domain_score}"))
        out = out.when(~dom.isin(seeds) & (value < cfg.min_domain_score), no(low))
    return out.otherwise(F.struct(F.lit(True).alias("accepted"), F.lit("OK").alias("reason")))


def page_edges(pages: DataFrame, cfg: GraphConfig, depth: Column, url: str = "url", links: str = "links", content: str | None = None, order: str | None = None) -> DataFrame:
    """Scored edges of pages(url, links): targets resolved, of pages above the depth limit, with
    scheme and host, and a priority above 0. position keeps the order on the page, and the column `order`
    of the pages, if one is named, theirs."""
    more = [order] if order else []
    keep = [F.col(url).alias("source_url"), depth.alias("_d"), *more, *([F.col(content).alias("_content")] if content else [])]
    e = pages.where(depth < cfg.max_depth).select(*keep, F.posexplode(links).alias("position", "href"))
    e = e.withColumn("url", urls.resolve("source_url", "href"))
    e = e.where((urls.part("url", 1) != "") & (urls.authority("url") != "")).withColumns({"domain": urls.domain("url"), "depth": F.col("_d") + 1})
    p = priority(cfg, F.col("url"), F.col("source_url"), F.col("domain"), F.col("depth"), None, F.col("_content") if content else None)
    return e.withColumn("priority", p).where("priority > 0").select("source_url", "url", "domain", "depth", "position", "priority", *more)


def domain_link_counts(links: DataFrame) -> DataFrame:
    """Links per target domain, each target of a page once."""
    pairs = links.where("source_url IS NOT NULL AND url IS NOT NULL").select("source_url", "url", urls.domain("url").alias("domain")).distinct()
    return pairs.groupBy("domain").agg(F.count(F.lit(1)).alias("n_links"))


def domain_scores(links: DataFrame, seeds: list[str], important: list[str], order: list[str], rows: int | None = None) -> DataFrame:
    """Score of each domain after all its links in order: s = 0.9 s + priority / 1000 x weight, with
    weight 2 for links from seeds, 1.5 from important domains, else 1.

    The update is affine, so runs of links compose: a run of bounded size gives (n, sum), and the runs of
    a domain, few, are folded in turn. No task holds a domain's links."""
    src = urls.domain("source_url")
    weight = F.when(src.isin(seeds), 2.0).when(src.isin(important), 1.5).otherwise(1.0)
    gains = links.where("url IS NOT NULL AND priority IS NOT NULL").select(urls.domain("url").alias("domain"), *order, (F.col("priority") / 1000 * weight).alias("gain"))
    r = runs(gains, order, ["domain"], rows)
    behind = F.row_number().over(Window.partitionBy("domain", "_b").orderBy(*(F.col(c).desc() for c in order))) - 1
    part = r.withColumn("k", behind).groupBy("domain", "_b").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("gain") * F.pow(F.lit(0.9), "k")).alias("gain"))
    whole = part.groupBy("domain").agg(F.array_sort(F.collect_list(F.struct("_b", "n", "gain"))).alias("runs"), F.sum("n").alias("n_links"))
    return whole.select("domain", "n_links", F.aggregate("runs", F.lit(0.0), lambda s, r: s * F.pow(F.lit(0.9), r["n"]) + r["gain"]).alias("score"))


def last_depth(links: DataFrame, order: list[str]) -> DataFrame:
    """Depth of each url as its last discoverer left it."""
    return links.where("url IS NOT NULL").groupBy("url").agg(F.max_by("depth", F.struct(*order)).alias("depth"))


def domain_cap(links: DataFrame, seeds: list[str], order: list[str], max_domains: int) -> DataFrame:
    """(domain, is_seed): the seeds and the first other domains, in order of discovery, up to max_domains."""
    first = links.where("url IS NOT NULL").groupBy(urls.domain("url").alias("domain")).agg(F.min(F.struct(*order)).alias("at"))
    others = first.where(~F.col("domain").isin(seeds)).orderBy("at").limit(max(0, max_domains - len(seeds))).select("domain", F.lit(False).alias("is_seed"))
    spark = links.sparkSession
    return spark.createDataFrame([(s, True) for s in seeds], "domain string, is_seed boolean").unionByName(others)


def graph_statistics(links: DataFrame, scores: DataFrame, seeds: list[str]) -> DataFrame:
    """(name, subject, value): domains discovered, links queued and greatest depth; each domain's number
    of links and its score to 3 places; the seeds."""
    row = lambda d, name, subject, value: d.select(F.lit(name).alias("name"), subject.alias("subject"), value.cast("double").alias("value"))
    whole, none = links.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("depth"), F.lit(0)).alias("d")), F.lit("")
    out = row(scores.agg(F.count(F.lit(1)).alias("n")), "discovered_domains", none, F.col("n"))
    out = out.unionAll(row(whole, "total_queued_links", none, F.col("n"))).unionAll(row(whole, "max_depth_reached", none, F.col("d")))
    out = out.unionAll(row(scores, "domain_link_counts", F.col("domain"), F.col("n_links"))).unionAll(row(scores, "domain_scores", F.col("domain"), F.round("score", 3)))
    return out.unionAll(row(links.sparkSession.createDataFrame([(s,) for s in seeds], "s string"), "seed_domains", F.col("s"), F.lit(1)))


def top_domains(counts: DataFrame, links: DataFrame, order: list[str], n: int = 3, examples: int = 3) -> DataFrame:
    """(kind, subject, value): the n domains with most links, and the first links in order as examples."""
    top = counts.orderBy(F.col("n_links").desc(), "domain").limit(n).select(F.lit("domain").alias("kind"), F.col("domain").alias("subject"), F.col("n_links").cast("long").alias("value"))
    first = links.where("url IS NOT NULL").orderBy(*order).limit(examples)
    return top.unionAll(first.select(F.lit("example"), "url", F.col("priority").cast("long")))


def by_priority(edges: DataFrame) -> DataFrame:
    """edges with `rank`: each page's links from the highest priority down, equal ones in page order."""
    w = Window.partitionBy("source_url").orderBy(F.col("priority").desc(), "position")
    return edges.withColumn("rank", F.row_number().over(w))
