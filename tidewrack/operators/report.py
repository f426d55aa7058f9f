"""The final report of a crawl, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack.operators import metrics

PERFORMANCE = ["runtime_minutes", "pages_per_minute", "success_rate", "avg_response_time"]
EFFICIENCY = ["duplication_rate", "error_rate", "average_page_size_kb"]
TOTALS = ["pages_crawled", "errors_count", "duplicates_skipped", "bytes_downloaded"]
DOMAIN = ["pages_crawled", "success_rate", "avg_response_time", "errors"]


def _long(df: DataFrame, section: str, subject: Column, names: list[str]) -> DataFrame:
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in names)))
    return df.select(F.lit(section).alias("section"), subject.alias("subject"), pairs.alias("p")).select("section", "subject", "p.name", "p.value")


def final_report(events: DataFrame, duplicates: Column) -> DataFrame:
    """(section, subject, name, value): totals, performance, efficiency, and four figures a domain."""
    s = metrics.summary(events, duplicates)
    one = F.lit("crawl")
    out = _long(s, "totals", one, TOTALS).unionByName(_long(s, "performance", one, PERFORMANCE)).unionByName(_long(s, "efficiency", one, EFFICIENCY))
    return out.unionByName(_long(metrics.domain_metrics(events), "domain", F.col("domain"), DOMAIN))
