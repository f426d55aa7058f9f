"""Fetch source: stored pages in place of the network, as a Python data source with one partition per
group of domains. A live fetcher is any function with the signature of `lookup`."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RESULT = "url string, content string, error string, response_time double, status_code int"


def fetch_stored(urls: DataFrame, pages: DataFrame) -> DataFrame:
    """CrawlResult rows for urls(url): 200 keeps the content, another status gives `HTTP n`, a url
    without a stored page an error without status."""
    j = urls.join(pages.select("url", "content", "response_time", "status_code", "error", F.lit(True).alias("_hit")), "url", "left")
    ok = F.coalesce(F.col("status_code") == 200, F.lit(False))
    error = F.when(ok, None).when(F.col("status_code").isNotNull(), F.concat(F.lit("HTTP "), F.col("status_code"))).otherwise(F.coalesce("error", F.lit("not stored")))
    return j.select("url", F.when(ok, F.col("content")).alias("content"), error.alias("error"), F.coalesce("response_time", F.lit(0.0)).alias("response_time"), "status_code")


class _Part(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class FetchSource(DataSource):
    """spark.read.format("tidewrack_fetch"): options urls (separated by line ends), partitions, and
    fetcher, a dotted name module:function of a function url -> (content, error, seconds, status)."""

    @classmethod
    def name(cls) -> str:
        return "tidewrack_fetch"

    def schema(self) -> str:
        return RESULT

    def reader(self, schema):
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        n = int(self.options.get("partitions", "8"))
        groups: dict[int, list[str]] = {}
        for u in filter(None, self.options.get("urls", "").split("\n")):
            # one domain stays in one partition, so that its requests are in sequence
            host = u.split("//")[-1].split("/")[0].lower()
            groups.setdefault(sum(host.encode()) % n, []).append(u)
        return [_Part(v) for v in groups.values()] or [_Part([])]

    def read(self, part: _Part) -> Iterator[tuple]:
        import importlib

        module, _, name = self.options["fetcher"].partition(":")
        fetch: Callable = getattr(importlib.import_module(module), name)
        for u in part.urls:
            try:
                content, error, seconds, status = fetch(u)
            except Exception as e:  # a failed fetch is a row
                content, error, seconds, status = None, str(e), 0.0, None
            yield u, content, error, float(seconds), status


def css_requests(pages: DataFrame, css_links: str = "css_links", max_files: int = 50) -> DataFrame:
    """(url, css_url, position): the style sheets to fetch, at most max_files of a page."""
    return pages.select("url", F.posexplode(F.slice(css_links, 1, max_files)).alias("position", "css_url"))


def robots_requests(domains: DataFrame) -> DataFrame:
    """(domain, url): where each domain keeps its robots text."""
    return domains.where("domain <> ''").select("domain", F.concat(F.lit("https://"), "domain", F.lit("/robots.txt")).alias("url")).distinct()


def robots_texts(requests: DataFrame, results: DataFrame) -> DataFrame:
    """(domain, robots_txt) of fetched robots texts; empty where the answer wasn't 200."""
    got = results.where("status_code = 200").select("url", "content")
    return requests.join(got, "url", "left").select("domain", F.coalesce("content", F.lit("")).alias("robots_txt"))


def nothing(url: str) -> tuple:
    """A fetcher that reaches nothing."""
    return None, "offline", 0.0, None
