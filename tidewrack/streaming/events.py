"""Streaming front ends of the same operators.

Each takes a streaming DataFrame and returns one; sinks and triggers are the caller's.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.config import PolicyConfig
from tidewrack.functions import urls
from tidewrack.operators.policy import Breaker


def first_urls(pages: DataFrame, ts: str = "fetched_at", watermark: str = "10 days") -> DataFrame:
    """Pages whose canonical url wasn't seen within the watermark. Event times become timestamps, which
    watermarks need."""
    return pages.withColumns({"canonical": urls.canonical("url"), ts: F.col(ts).cast("timestamp")}).withWatermark(ts, watermark).dropDuplicatesWithinWatermark(["canonical"])


def report(events: DataFrame, ts: str = "ts", every: str = "30 seconds", watermark: str = "10 days") -> DataFrame:
    """Pages, errors and characters per window and domain."""
    return (
        events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark).groupBy(F.window(ts, every), "domain")
        .agg(F.count_if("ok").alias("pages"), F.count_if(~F.col("ok")).alias("errors"), F.sum("content_length").alias("characters"))
    )


def next_delay(delay: float, status: int, seconds: float, default: float) -> float:
    if status == 429:
        return delay * 2.0
    if status >= 500:
        return delay * 1.5
    if seconds > 10:
        return delay * 1.2
    if status == 200 and seconds < 2:
        return max(default, delay * 0.95)
    return delay


def domain_policy(events: DataFrame, cfg: PolicyConfig = PolicyConfig()) -> DataFrame:
    """(domain, crawl_delay, breaker, requests): per domain, after each batch of its events(domain,
    ts, event_id, status_code, response_time, ok), the adaptive delay and the breaker's state."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        delay, name, failures, last, n = state.get if state.exists else (cfg.default_delay, "closed", 0, 0.0, 0)
        b = Breaker(cfg, name, failures, last)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for at, status, seconds, ok in zip(rows["ts"], rows["status_code"], rows["response_time"], rows["ok"]):
            delay = next_delay(delay, 0 if pd.isna(status) else int(status), 0.0 if pd.isna(seconds) else float(seconds), cfg.default_delay)
            b.event(pd.Timestamp(at).timestamp(), bool(ok))
            n += 1
        state.update((delay, b.state, b.failures, b.last, n))
        yield pd.DataFrame({"domain": [key[0]], "crawl_delay": [delay], "breaker": [b.state], "requests": [n]})

    return events.groupBy("domain").applyInPandasWithState(
        update, "domain string, crawl_delay double, breaker string, requests long", "delay double, state string, failures int, last double, n long", "update", "NoTimeout"
    )


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All that is available, into a memory table; for tests and small replays."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


