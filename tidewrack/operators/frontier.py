"""The frontier of a crawl: pushing, popping and best-first rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewrack.config import CrawlConfig, Mode
from tidewrack.functions import urls
from tidewrack.operators import links as L
from tidewrack.operators import policy
from tidewrack.session import cut

SEED_PRIORITY = 1000
#: Rounds after which the pages taken so far are written together, and most of them that are broadcast.
COMPACT, KEPT = 20, 100_000


def push(new: DataFrame, queued: DataFrame, visited: DataFrame) -> DataFrame:
    """Rows (url, priority, ...) of new, one a url, that are neither queued nor visited."""
    return new.join(queued.select("url"), "url", "left_anti").join(visited.select("url"), "url", "left_anti")


def pop(frontier: DataFrame, n: int) -> DataFrame:
    """The n best: highest priority, ties by url."""
    return frontier.orderBy(F.col("priority").desc(), F.col("url").asc()).limit(n)


def pop_stable(frontier: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The n best, ties in order of arrival."""
    return frontier.orderBy(F.col("priority").desc(), *order).limit(n)


def budget(pages: DataFrame, max_pages: int, order: list[str]) -> DataFrame:
    """The first pages in order that use up the budget; pages with an error count, duplicates and
    those that robots rules block do not."""
    return pages.where("NOT is_duplicate AND NOT is_blocked").orderBy(*order).limit(max_pages)


def _admitted(edges: DataFrame, cfg: CrawlConfig, hosts: list[str], known: list[str]) -> tuple[DataFrame, list[str]]:
    """The round's edges whose domain is admitted, and the known domains after them.

    edges(domain, at, ...) are in the order `at`. In the cross-domain modes a domain becomes known by its
    first admitted link while there are fewer than max_domains; as only admitted links raise a score, a
    threshold above 0 admits the seeds' domains only. Known domains are at most max_domains and the
    seeds', so they are kept on the driver."""
    g = cfg.graph
    if g.mode not in (Mode.CROSS_DOMAIN, Mode.GRAPH):
        return edges.where(L.admission(g, F.col("domain"), hosts)["accepted"]), known
    open_edges = edges.where(~F.col("domain").isin(list(g.blocked)))
    if g.min_domain_score > 0:
        return open_edges.where(F.col("domain").isin(hosts)), known
    room = max(0, g.max_domains - len(known))
    if room:
        new = open_edges.where(~F.col("domain").isin(known)).groupBy("domain").agg(F.min("at").alias("at")).orderBy("at").limit(room)
        known = known + [r.domain for r in new.collect()]
    return open_edges.where(F.col("domain").isin(known)), known


def replay(pages: DataFrame, cfg: CrawlConfig, batch: int = 1, log: list[tuple[int, int, int]] | None = None, robots: DataFrame | None = None) -> DataFrame:
    """(url, round, priority, depth): the best-first crawl over stored pages(url, links), and content_key
    if there is one.

    Each round pops `batch` urls (1 gives the exact order of a sequential crawl). Urls whose canonical
    form was seen are dropped, so are those that robots(domain, robots_txt) bars and pages whose
    content_key was seen; none of them counts as a page. The others' links are scored, admitted in order
    with what is known of domains so far, and pushed if they are new; the last page that links to a queued
    url decides its depth. A target without a stored page counts as an error page and ends there. State
    is a few columns per url, checkpointed in the shared folder each round, so the lineage stays short.
    log gets (round, pages taken so far, urls queued) of each round.
    """
    spark = pages.sparkSession
    keyed = pages if "content_key" in pages.columns else pages.withColumn("content_key", F.lit(None).cast("string"))
    keyed = keyed.select("url", "links", "content_key")
    seeds = list(dict.fromkeys(cfg.seeds))
    frontier = spark.createDataFrame([(u, SEED_PRIORITY, 0) for u in seeds], "url string, priority int, depth int")
    visited = spark.createDataFrame([], "url string, canonical string, content_key string, round int, priority int, depth int, taken boolean")
    taken, round_no = 0, 0
    hosts = list(dict.fromkeys(u.split("//")[-1].split("/")[0].lower() for u in seeds))
    known = hosts
    first = lambda key: F.row_number().over(Window.partitionBy(key).orderBy("at")) == 1
    while taken < cfg.max_pages:
        # at most `batch` rows, so one task orders them
        popped = pop(frontier, min(batch, cfg.max_pages - taken)).withColumn("at", F.row_number().over(Window.orderBy(F.col("priority").desc(), "url")))
        top = popped.withColumn("canonical", urls.canonical("url")).join(F.broadcast(visited.select("canonical", F.lit(True).alias("_seen")).distinct()) if taken <= KEPT else visited.select("canonical", F.lit(True).alias("_seen")).distinct(), "canonical", "left")
        top = top.withColumn("fresh", F.col("_seen").isNull() & first("canonical")).drop("_seen")
        if robots is not None:
            gate = policy.robots_gate(top.select("url", urls.domain("url").alias("domain")), robots, list(cfg.graph.blocked)).select("url", "can_crawl")
            top = top.join(gate, "url")
        else:
            top = top.withColumn("can_crawl", F.lit(True))
        top = keyed.join(F.broadcast(top), "url", "right")
        old = visited.where("content_key IS NOT NULL").select("content_key", F.lit(True).alias("_held")).distinct()
        top = top.join(old, "content_key", "left").withColumn("go", F.col("fresh") & F.col("can_crawl"))
        earlier = F.max(F.when(F.col("go"), 1).otherwise(0)).over(Window.partitionBy("content_key").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
        same = F.col("content_key").isNotNull() & (F.coalesce("_held", F.lit(False)) | (F.coalesce(earlier, F.lit(0)) == 1))
        top = cut(top.withColumn("taken", F.col("go") & ~same).drop("_held"))
        if top.isEmpty():
            break
        round_no += 1
        seen = top.where("fresh").select("url", "canonical", "content_key", F.lit(round_no).alias("round"), "priority", "depth", "taken")
        taken += top.where("taken").count()
        found = top.where("taken").select("url", "links", "depth", "at")
        edges = L.page_edges(found, cfg.graph, F.col("depth"), order="at").withColumn("at", F.struct("at", "position"))
        edges, known = _admitted(edges, cfg, hosts, known)
        best = cut(edges.groupBy("url").agg(F.min_by("priority", "at").alias("priority"), F.max_by("depth", "at").alias("depth")))
        visited = visited.unionByName(seen)
        if round_no % COMPACT == 0:
            visited = cut(visited)
        rest = frontier.join(top.select("url"), "url", "left_anti")
        deeper = best.select("url", F.col("depth").alias("_depth"))
        rest = rest.join(deeper, "url", "left").select("url", "priority", F.coalesce("_depth", "depth").alias("depth"))
        frontier = cut(rest.unionByName(push(best, rest, visited.where("taken"))))
        if log is not None:
            log.append((round_no, taken, frontier.count()))
    return visited.where("taken").select("url", "round", "priority", "depth")
