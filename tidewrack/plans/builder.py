"""A fluent description of a crawl, built into a chain of DataFrame stages.

A stage is any function DataFrame -> DataFrame over pages(url, content, parsed...); built-in stages
add columns, and own stages are added with `stage`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.config import CrawlConfig, GraphConfig, Mode
from tidewrack.functions import html, urls
from tidewrack.operators import dedup, dom, frontier, pages
from tidewrack.sources import storage

Stage = Callable[[DataFrame], DataFrame]


class Crawl:
    def __init__(self, spark: SparkSession, cfg: CrawlConfig, stages: dict[str, Stage]):
        self.spark, self.cfg, self.stages = spark, cfg, stages

    def plan(self, stored: DataFrame, batch: int = 1, robots: DataFrame | None = None) -> DataFrame:
        """Visit stored pages(url, links, content) best first, then run the stages over the visited. With
        content deduplication pages whose content was seen aren't visited."""
        source = stored.select("url", "links", html.content_hash(F.col("content")).alias("content_key")) if "content" in self.stages else stored.select("url", "links")
        visited = frontier.replay(source, self.cfg, batch, robots=robots)
        d = visited.join(stored, "url", "left")
        for s in self.stages.values():
            d = d.transform(s)
        return d


class CrawlBuilder:
    """CrawlBuilder(urls).max_pages(10).with_graph("whitelist", allowed=...).build(spark)"""

    def __init__(self, seeds: list[str]):
        self.cfg = CrawlConfig(seeds=tuple(seeds))
        self.stages: dict[str, Stage] = {}

    def max_pages(self, n: int) -> CrawlBuilder:
        self.cfg = replace(self.cfg, max_pages=n)
        return self

    def with_graph(self, mode: str = "cross_domain", max_depth: int = 3, max_domains: int = 100, allowed=(), blocked=(), priority=()) -> CrawlBuilder:
        g = GraphConfig(mode=Mode.of(mode), max_depth=max_depth, max_domains=max_domains, allowed=frozenset(allowed), blocked=frozenset(blocked), priority=frozenset(priority))
        self.cfg = replace(self.cfg, graph=g)
        return self

    def with_css(self, max_files: int = 50) -> CrawlBuilder:
        self.cfg = replace(self.cfg, max_css_files=max_files)
        return self.stage("css", lambda d: d.withColumn("css_links", F.slice(html.stylesheets(F.coalesce("content", F.lit("")), F.col("url")), 1, max_files)))

    def with_dom(self, max_depth: int = 8) -> CrawlBuilder:
        self.cfg = replace(self.cfg, dom_depth=max_depth)

        def run(d: DataFrame) -> DataFrame:
            stats = dom.tree_stats(pages.dom_table(d.select("url", "content"), "url", "content", max_depth), "url")
            return d.join(stats, "url", "left")

        return self.stage("dom", run)

    def with_content_dedup(self) -> CrawlBuilder:
        return self.stage("content", lambda d: dedup.first_by(d, html.content_hash(F.col("content")), ["round", "url"]).withColumnsRenamed({"key": "content_hash", "is_duplicate": "duplicate_content"}))

    def with_paths(self) -> CrawlBuilder:
        return self.stage("paths", lambda d: d.withColumns({"path": storage.file_path("url", "html"), "canonical": urls.canonical("url")}))

    def with_screenshots(self) -> CrawlBuilder:
        """Where screenshots go; taking them needs a renderer, which is the caller's."""
        return self.stage("screenshots", lambda d: d.withColumn("screenshot_path", storage.file_path("url", "screenshot")))

    def stage(self, name: str, f: Stage) -> CrawlBuilder:
        self.stages[name] = f
        return self

    def build(self, spark: SparkSession) -> Crawl:
        return Crawl(spark, self.cfg, dict(self.stages))

