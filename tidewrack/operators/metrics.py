"""Crawl metrics and reports.

An event table has url, domain, status_code, response_time, error, content_length and an order
(ts, event id). Values that need a total order over all events (running rates, moving means) are
computed in runs of bounded size with the runs' prefix sums, never in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewrack.functions import urls
from tidewrack.operators.ordered import runs


def crawl_events(fetches: DataFrame) -> DataFrame:
    """fetches as events; content_length is in characters, octets in bytes."""
    return fetches.select(
        F.col("fetch_id").alias("event_id"), F.col("fetched_at").alias("ts"), "url", urls.domain("url").alias("domain"), "status_code", "response_time", "error",
        F.length("content").cast("long").alias("content_length"), F.octet_length("content").cast("long").alias("octets"), (F.col("error").isNull() & F.col("content").isNotNull()).alias("ok"),
    )


def domain_metrics(events: DataFrame) -> DataFrame:
    """Per domain: pages, errors (all, and those after the first success, which a crawler would have
    recorded), success rate in percent, mean response time of pages, last page, characters.

    Errors after the first success are all errors less those before it. Of those before it there are
    few to look at: they are counted from the errors and one small state per domain."""
    at = F.struct("ts", "event_id")
    g = events.groupBy("domain").agg(
        F.count_if("ok").alias("pages_crawled"), F.count_if(~F.col("ok")).alias("all_errors"), F.min(F.when(F.col("ok"), at)).alias("first"), F.min(F.when(~F.col("ok"), at)).alias("first_error"),
        F.round(F.count_if("ok") / F.count(F.lit(1)) * 100, 6).alias("success_rate"), F.round(F.avg(F.when(F.col("ok"), F.col("response_time"))), 6).alias("avg_response_time"),
        F.max(F.when(F.col("ok"), F.col("ts"))).alias("last_crawled"), F.sum(F.when(F.col("ok"), F.col("content_length"))).alias("bytes_downloaded"),
    )
    # domains that begin with an error; the others need no second look
    late = g.where("first IS NOT NULL AND first_error < first").select("domain", "first")
    early = events.where("NOT ok").select("domain", at.alias("at")).join(late, "domain").where("at < first").groupBy("domain").agg(F.count(F.lit(1)).alias("early"))
    errors = F.when(F.col("first").isNull(), 0).otherwise(F.col("all_errors") - F.coalesce("early", F.lit(0)))
    return g.join(early, "domain", "left").select(
        "domain", "pages_crawled", "all_errors", errors.alias("errors"), "success_rate", "avg_response_time", "last_crawled", "bytes_downloaded")


def summary(events: DataFrame, duplicates: Column) -> DataFrame:
    """One row of totals, rates and efficiency; duplicates marks events that were skipped as such."""
    e = events.withColumn("_dup", duplicates)
    page = F.col("ok") & ~F.col("_dup")
    a = e.agg(
        F.count_if(page).alias("pages_crawled"), F.count_if(~F.col("ok")).alias("errors_count"), F.count_if("_dup").alias("duplicates_skipped"),
        F.sum(F.when(page, F.col("content_length"))).alias("bytes_downloaded"), F.avg(F.when(page, F.col("response_time"))).alias("avg_response_time"),
        (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))).alias("_us"),
    )
    s, n, err, dup = F.col("_us") / 1e6, F.col("pages_crawled"), F.col("errors_count"), F.col("duplicates_skipped")
    rate = lambda x, y: F.round(F.coalesce(x / F.nullif(y, F.lit(0)), F.lit(0.0)), 6)
    return a.select(
        "pages_crawled", "errors_count", "duplicates_skipped", "bytes_downloaded", F.round("avg_response_time", 6).alias("avg_response_time"),
        rate(n * 100.0, n + err).alias("success_rate"), F.round(s / 60, 6).alias("runtime_minutes"), F.round(n / s * 60, 6).alias("pages_per_minute"),
        rate(dup * 100.0, n + dup).alias("duplication_rate"), rate(err * 100.0, n + err).alias("error_rate"), rate(F.col("bytes_downloaded") / 1024.0, n).alias("average_page_size_kb"),
    )


def in_order(events: DataFrame, order: list[str], sums: dict[str, Column], keep: list[str] = (), rows: int | None = None) -> DataFrame:
    """The columns `keep` and `order` with a dense index `i` from 1 in order and running sums: windows
    inside runs, plus the totals of the runs before, which are few."""
    narrow = events.select(*dict.fromkeys((*keep, *order)), *(v.alias(f"_v_{k}") for k, v in sums.items()))
    e = runs(narrow, order, rows=rows)
    w = Window.partitionBy("_b").orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    per = e.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"), *(F.sum(f"_v_{k}").alias(f"_t_{k}") for k in sums))
    e = e.withColumns({"_i": F.row_number().over(w).cast("long")} | {f"_s_{k}": F.sum(f"_v_{k}").over(run) for k in sums})
    before = Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    off = per.select("_b", zero(F.sum("_n").over(before)).alias("_on"), *(zero(F.sum(f"_t_{k}").over(before)).alias(f"_o_{k}") for k in sums))
    j = e.join(off, "_b")
    return j.withColumns({"i": F.col("_i") + F.col("_on")} | {k: F.coalesce(F.col(f"_s_{k}"), F.lit(0)) + F.col(f"_o_{k}") for k in sums}).drop(
        "_b", "_i", "_on", *(f"{p}{k}" for k in sums for p in ("_v_", "_s_", "_o_"))
    )


def running_success_rate(events: DataFrame, order: list[str], rows: int | None = None) -> DataFrame:
    """(event_id, success_rate): percent of successes among all events up to each."""
    r = in_order(events, order, {"good": F.col("ok").cast("long")}, ["event_id"], rows)
    return r.select("event_id", F.round(F.col("good") / F.col("i") * 100, 6).alias("success_rate"))


def moving_average(events: DataFrame, order: list[str], last: int = 100, rows: int | None = None) -> DataFrame:
    """(event_id, moving_avg): mean of the `last` newest response times. Prefix sums are exact decimals;
    the sum of a window is the difference of two of them, joined by index."""
    e = events.where("response_time IS NOT NULL")
    r = in_order(e, order, {"total": F.col("response_time").cast("decimal(18,9)")}, ["event_id"], rows).select("event_id", "i", "total")
    old = r.select((F.col("i") + last).alias("i"), F.col("total").alias("old"))
    d = (F.col("total") - F.coalesce("old", F.lit(0))).cast("double")
    return r.join(old, "i", "left").select("event_id", F.round(d / F.least("i", F.lit(last)), 6).alias("moving_avg"))


def last_events(events: DataFrame, order: list[str], n: int = 1000) -> DataFrame:
    return events.orderBy(*(F.col(c).desc() for c in order)).limit(n)


def last_by_domain(events: DataFrame, order: list[str], n: int = 10) -> DataFrame:
    """The n newest events of each domain, with their rank; partitions are cut to n before the shuffle."""
    w = Window.partitionBy("domain").orderBy(*(F.col(c).desc() for c in order))
    return events.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def domain_rates(events: DataFrame, order: list[str], now: Column, seconds: int = 300, n: int = 10) -> DataFrame:
    """Per domain: requests among its n newest of the last `seconds`, and their mean response time."""
    recent = (F.col("ts") > now - F.make_dt_interval(secs=F.lit(seconds))) & (F.col("ts") <= now)
    g = last_by_domain(events, order, n).groupBy("domain")
    return g.agg(F.count_if(recent).alias("recent_requests"), F.round(F.coalesce(F.avg(F.when(recent, F.coalesce("response_time", F.lit(0.0)))), F.lit(0.0)), 6).alias("avg_response_time"))


def error_summary(errors: DataFrame, now: Column, seconds: int = 300) -> DataFrame:
    """(kind, value, n, recent): errors in all, by type and by domain, in one pass over grouping sets."""
    e = errors.select("error_type", urls.retry_domain("url").alias("domain"), (F.col("occurred_at") > now - F.make_dt_interval(secs=F.lit(seconds))).alias("r"))
    g = e.groupingSets([["error_type"], ["domain"], []], "error_type", "domain").agg(F.count(F.lit(1)).alias("n"), F.count_if("r").alias("recent"), F.grouping_id().alias("g"))
    kind = F.when(F.col("g") == 1, "type").when(F.col("g") == 2, "domain").otherwise("all")
    return g.select(kind.alias("kind"), F.coalesce("error_type", "domain", F.lit("")).alias("value"), "n", "recent")


def failed_urls(events: DataFrame, order: list[str]) -> DataFrame:
    """(url): urls whose last event is a failure."""
    return events.where("url IS NOT NULL").groupBy("url").agg(F.max_by("ok", F.struct(*order)).alias("ok")).where("NOT ok").select("url")


def without_domain(errors: DataFrame, domain: str) -> DataFrame:
    """errors without those whose url holds the text of the domain."""
    return errors.where(~F.coalesce(F.col("url").contains(domain), F.lit(False)))


def snapshot(metrics: DataFrame, totals: DataFrame, at: Column) -> DataFrame:
    """(timestamp, section, subject, snapshot): the totals and each domain's metrics as JSON, a row each,
    so that all domains are in it and no row holds more than one."""
    whole = totals.select(at.alias("timestamp"), F.lit("crawl").alias("section"), F.lit("").alias("subject"), F.to_json(F.struct(*totals.columns)).alias("snapshot"))
    each = metrics.select(at.alias("timestamp"), F.lit("domain").alias("section"), F.col("domain").alias("subject"), F.to_json(F.struct(*(c for c in metrics.columns if c != "domain"))).alias("snapshot"))
    return whole.unionByName(each)


def snapshot_history(events: DataFrame, order: list[str], every: int, keep: int = 100) -> DataFrame:
    """(at_event, pages, errors, characters): the last `keep` snapshots of the running totals, one after
    each `every` events in order. Totals come from the prefix sums of buckets."""
    r = in_order(events, order, {"pages": F.col("ok").cast("long"), "errors": (~F.col("ok")).cast("long"), "characters": F.coalesce(F.when(F.col("ok"), F.col("content_length")), F.lit(0))})
    taken = r.where(F.col("i") % every == 0).select(F.col("i").alias("at_event"), "pages", "errors", "characters")
    return taken.orderBy(F.col("at_event").desc()).limit(keep)


def system_metrics(spark) -> DataFrame:
    """One row about the driver's host; nulls without psutil."""
    schema = "cpu_percent double, memory_used_mb double, memory_percent double, disk_used_gb double, network_sent_mb double, network_recv_mb double, open_files int"
    try:
        import psutil

        m, n = psutil.virtual_memory(), psutil.net_io_counters()
        row = (psutil.cpu_percent(), m.used / 2**20, m.percent, psutil.disk_usage("/").used / 2**30, n.bytes_sent / 2**20, n.bytes_recv / 2**20, len(psutil.Process().open_files()))
    except ImportError:
        row = (None,) * 7
    return spark.createDataFrame([row], schema)
