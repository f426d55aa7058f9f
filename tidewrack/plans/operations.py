"""Queries over fetch logs and errors: metrics, politeness, retries, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.functions import urls
from tidewrack.operators import dedup, metrics, pages, policy, report
from tidewrack.plans.web import CANON
from tidewrack.sources import replay
from tidewrack.session import table

ORDER = ["ts", "event_id"]


def _events(spark: SparkSession, d: str) -> DataFrame:
    return metrics.crawl_events(table(spark, d, "fetches"))


def _errors(spark: SparkSession, d: str) -> DataFrame:
    """Errors once each: rows that were delivered twice count once."""
    return table(spark, d, "fetch_errors").dropDuplicates(["error_id"])


def crawl_domain_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.domain_metrics(_events(spark, d))


def crawl_summary(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "fetches")
    dup = dedup.first_by(f.select("fetch_id", "url", "fetched_at"), urls.canonical("url"), ["fetched_at", "fetch_id"]).select(F.col("fetch_id").alias("event_id"), "is_duplicate")
    return metrics.summary(_events(spark, d).join(dup, "event_id"), F.col("is_duplicate"))


def running_success_rate(spark: SparkSession, d: str) -> DataFrame:
    return metrics.running_success_rate(_events(spark, d), ORDER)


def moving_avg_100(spark: SparkSession, d: str) -> DataFrame:
    return metrics.moving_average(_events(spark, d).where("ok"), ORDER)


def last_events(spark: SparkSession, d: str) -> DataFrame:
    return metrics.last_events(_events(spark, d), ORDER).select("event_id", "url", "domain", "status_code", "content_length")


def last10_by_domain(spark: SparkSession, d: str) -> DataFrame:
    return metrics.last_by_domain(_events(spark, d), ORDER).select("domain", "event_id", "rank")


def domain_rates(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    return metrics.domain_rates(e, ORDER, e.agg(F.max("ts")).scalar(), 86_400)


def error_summary(spark: SparkSession, d: str) -> DataFrame:
    e = _errors(spark, d)
    return metrics.error_summary(e, e.agg(F.max("occurred_at")).scalar(), 86_400)


def failed_urls(spark: SparkSession, d: str) -> DataFrame:
    return metrics.failed_urls(_events(spark, d), ORDER)


def errors_after_reset(spark: SparkSession, d: str) -> DataFrame:
    return metrics.without_domain(_errors(spark, d), "ivory-notes.example").groupBy("error_type").agg(F.count(F.lit(1)).alias("n"))


def final_report(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "fetches")
    dup = dedup.first_by(f.select("fetch_id", "url", "fetched_at"), urls.canonical("url"), ["fetched_at", "fetch_id"]).select(F.col("fetch_id").alias("event_id"), "is_duplicate")
    return report.final_report(_events(spark, d).join(dup, "event_id"), F.col("is_duplicate"))


def usable_pages(spark: SparkSession, d: str) -> DataFrame:
    return pages.usable(table(spark, d, "fetches")).select("fetch_id")


def robots_requests(spark: SparkSession, d: str) -> DataFrame:
    return replay.robots_requests(_events(spark, d).select("domain"))


def metrics_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """The snapshot's rows with what their JSON holds."""
    e = _events(spark, d)
    s = metrics.snapshot(metrics.domain_metrics(e), metrics.summary(e, F.lit(False)), F.lit("2025-01-01T00:00:00"))
    at = lambda c, kind: F.get_json_object("snapshot", f"$.{c}").cast(kind).alias(c)
    return s.select("timestamp", "section", "subject", at("pages_crawled", "bigint"), at("success_rate", "double"), at("avg_response_time", "double"))


def snapshot_history(spark: SparkSession, d: str) -> DataFrame:
    return metrics.snapshot_history(_events(spark, d), ORDER, 5)


def system_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.system_metrics(spark)


def error_classes(spark: SparkSession, d: str) -> DataFrame:
    e = _errors(spark, d)
    kind = policy.classify_error(F.col("error_type"), F.col("status_code"), F.col("message"))
    return e.select("error_id", kind.alias("kind"), policy.is_retryable(kind, F.col("attempt")).alias("retryable"), policy.backoff(kind, F.col("attempt")).alias("delay"))


def retry_schedule(spark: SparkSession, d: str) -> DataFrame:
    r = policy.retry_schedule(_errors(spark, d).select("error_id", "error_type"), F.col("error_type"))
    return r.select("error_id", "retry", "delay", "waited")


def adaptive_delay(spark: SparkSession, d: str) -> DataFrame:
    """Logarithm of the delay, as delays grow by powers."""
    r = policy.adaptive_delay_closed(_events(spark, d), ORDER)
    return r.select("domain", F.round(F.ln("crawl_delay"), 6).alias("log_delay"), F.col("requests").cast("long").alias("requests"))


def breaker_states(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return policy.breaker_states(e, ORDER, "t", "ok")


def politeness_schedule(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).where("ts IS NOT NULL")
    r = policy.politeness_schedule(e, F.unix_micros(F.col("ts").cast("timestamp")) / 1000000, F.lit(1.0), ORDER)
    return r.select("event_id", F.round("start", 3).alias("start"))


def robots_policy(spark: SparkSession, d: str) -> DataFrame:
    """Policies of a stored robots text per domain: the text is chosen by the domain's length."""
    dom = _events(spark, d).select("domain").where("domain <> ''").distinct()
    n = F.length("domain") % 4
    text = (
        F.when(n == 0, "User-agent: *\nCrawl-delay: 2.5\nDisallow: /private/\n").when(n == 1, "User-agent: *\nDisallow: /\n")
        .when(n == 2, "User-agent: other\nCrawl-delay: 9\n# note\nUser-agent: tidewrack/1.0 beta\nCrawl-delay: 0.5\n")
    )
    return policy.robots_policy(dom.withColumn("robots_txt", text))


def robots_gate(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "links").where("url IS NOT NULL").select("url", urls.domain("url").alias("domain")).distinct()
    dom = u.select("domain").distinct().withColumn("robots_txt", F.when(F.length("domain") % 2 == 0, "User-agent: *\nDisallow: /archive\n"))
    return policy.robots_gate(u, dom, ["umber-notes.example"]).select("url", "can_crawl", "reason")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        crawl_domain_metrics, crawl_summary, running_success_rate, moving_avg_100, last_events, last10_by_domain, domain_rates, error_summary, failed_urls,
        errors_after_reset, final_report, usable_pages, robots_requests, metrics_snapshot, snapshot_history, system_metrics, error_classes, retry_schedule, adaptive_delay, breaker_states,
        politeness_schedule, robots_policy, robots_gate,
    )
}

_E = "e AS (SELECT fetch_id AS event_id, fetched_at AS ts, url, lower(regexp_extract(url, '^(?:[^:/?#]+:)?(?://([^/?#]*))?', 1)) AS domain, status_code, response_time, length(content) AS content_length, error IS NULL AND content IS NOT NULL AS ok FROM fetches)"
_X = "x AS (SELECT DISTINCT ON (error_id) * FROM fetch_errors)"
_FOLD = f"""
  WITH RECURSIVE {_E}, n AS (SELECT domain, row_number() OVER (PARTITION BY domain ORDER BY ts NULLS FIRST, event_id) AS i, coalesce(status_code, 0) AS s, coalesce(response_time, 0.0) AS t FROM e),
  f AS (SELECT domain, CAST(0 AS BIGINT) AS i, CAST(1.0 AS DOUBLE) AS d FROM n WHERE i = 1
    UNION ALL SELECT n.domain, n.i, CASE WHEN s = 429 THEN d * 2 WHEN s >= 500 THEN d * CAST(1.5 AS DOUBLE) WHEN t > 10 THEN d * CAST(1.2 AS DOUBLE) WHEN s = 200 AND t < 2 THEN greatest(CAST(1.0 AS DOUBLE), d * CAST(0.95 AS DOUBLE)) ELSE d END
    FROM f JOIN n ON n.domain = f.domain AND n.i = f.i + 1)"""

SQL: dict[str, str] = {
    "crawl_domain_metrics": f"""
        WITH {_E}, b AS (SELECT domain, min((ts, event_id)) AS first FROM e WHERE ok GROUP BY 1)
        SELECT domain, count(*) FILTER (ok) AS pages_crawled, count(*) FILTER (NOT ok) AS all_errors, count(*) FILTER (NOT ok AND first IS NOT NULL AND (ts, event_id) > first) AS errors,
          round(count(*) FILTER (ok) / count(*) * 100, 6) AS success_rate, round(avg(response_time) FILTER (ok), 6) AS avg_response_time, max(ts) FILTER (ok) AS last_crawled,
          CAST(sum(content_length) FILTER (ok) AS BIGINT) AS bytes_downloaded FROM e LEFT JOIN b USING (domain) GROUP BY domain""",
    "running_success_rate": f"WITH {_E} SELECT event_id, round(sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER w / count(*) OVER w * 100, 6) AS success_rate FROM e WINDOW w AS (ORDER BY ts NULLS FIRST, event_id ROWS UNBOUNDED PRECEDING)",
    "moving_avg_100": f"WITH {_E} SELECT event_id, round(CAST(sum(CAST(response_time AS DECIMAL(18, 9))) OVER w AS DOUBLE) / count(*) OVER w, 6) AS moving_avg FROM e WHERE ok AND response_time IS NOT NULL WINDOW w AS (ORDER BY ts NULLS FIRST, event_id ROWS 99 PRECEDING)",
    "last_events": f"WITH {_E} SELECT event_id, url, domain, status_code, content_length FROM e ORDER BY ts DESC NULLS LAST, event_id DESC LIMIT 1000",
    "last10_by_domain": f"WITH {_E} SELECT domain, event_id, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY ts DESC NULLS LAST, event_id DESC) AS rank FROM e) WHERE rank <= 10",
    "domain_rates": f"""
        WITH {_E}, r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY ts DESC NULLS LAST, event_id DESC) AS k, ts > (SELECT max(ts) FROM e) - INTERVAL 86400 SECOND AS near FROM e)
        SELECT domain, count(*) FILTER (near) AS recent_requests, round(coalesce(avg(coalesce(response_time, 0.0)) FILTER (near), 0.0), 6) AS avg_response_time FROM r WHERE k <= 10 GROUP BY domain""",
    "error_summary": f"""
        WITH {_X}, y AS (SELECT error_type, CASE WHEN contains(url, '//') THEN split_part(split_part(url, '//', 2), '/', 1) ELSE 'unknown' END AS domain, occurred_at > (SELECT max(occurred_at) FROM x) - INTERVAL 86400 SECOND AS r FROM x)
        SELECT 'type' AS kind, error_type AS value, count(*) AS n, count(*) FILTER (r) AS recent FROM y GROUP BY error_type
        UNION ALL SELECT 'domain', domain, count(*), count(*) FILTER (r) FROM y GROUP BY domain UNION ALL SELECT 'all', '', count(*), count(*) FILTER (r) FROM y""",
    "failed_urls": f"WITH {_E} SELECT url FROM (SELECT url, arg_max(ok, (ts, event_id)) AS ok FROM e WHERE url IS NOT NULL GROUP BY url) WHERE NOT ok",
    "errors_after_reset": f"WITH {_X} SELECT error_type, count(*) AS n FROM x WHERE NOT coalesce(contains(url, 'ivory-notes.example'), false) GROUP BY 1",
    "usable_pages": "SELECT fetch_id FROM fetches WHERE error IS NULL AND coalesce(content, '') <> ''",
    "robots_requests": f"WITH {_E} SELECT DISTINCT domain, 'https://' || domain || '/robots.txt' AS url FROM e WHERE domain <> ''",
    "error_classes": f"""
        WITH {_X}, k AS (SELECT error_id, attempt, CASE WHEN error_type IN ('network_timeout', 'connection_error') THEN error_type WHEN coalesce(status_code, 0) <> 0 THEN
            CASE WHEN status_code = 429 THEN 'rate_limited' WHEN status_code BETWEEN 400 AND 499 THEN 'http_client_error' WHEN status_code BETWEEN 500 AND 599 THEN 'http_server_error' ELSE 'unknown_error' END
          WHEN contains(lower(coalesce(message, '')), 'parsing') THEN 'parsing_error' WHEN contains(lower(coalesce(message, '')), 'screenshot') THEN 'screenshot_error'
          WHEN contains(lower(coalesce(message, '')), 'storage') THEN 'storage_error' ELSE 'unknown_error' END AS kind FROM x)
        SELECT error_id, kind, coalesce(attempt < 3 AND kind IN ('network_timeout', 'connection_error', 'http_server_error', 'rate_limited'), false) AS retryable,
          least(pow(2.0, attempt - 1) * CASE WHEN kind = 'rate_limited' THEN 2 ELSE 1 END, 60.0) AS delay FROM k""",
    "adaptive_delay": f"{_FOLD} SELECT domain, round(ln(arg_max(d, i)), 6) AS log_delay, max(i) AS requests FROM f GROUP BY domain",
    "crawl_summary": f"""
        WITH {CANON}, {_E}, z AS (SELECT e.*, row_number() OVER (PARTITION BY c ORDER BY fetched_at NULLS FIRST, fetch_id) > 1 AND c IS NOT NULL AS dup FROM e JOIN canon ON fetch_id = event_id),
        a AS (SELECT count(*) FILTER (ok AND NOT dup) AS n, count(*) FILTER (NOT ok) AS err, count(*) FILTER (dup) AS dups, CAST(sum(content_length) FILTER (ok AND NOT dup) AS BIGINT) AS b, avg(response_time) FILTER (ok AND NOT dup) AS rt, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS s FROM z)
        SELECT n AS pages_crawled, err AS errors_count, dups AS duplicates_skipped, b AS bytes_downloaded, round(rt, 6) AS avg_response_time, round(coalesce(n * 100.0 / nullif(n + err, 0), 0), 6) AS success_rate, round(s / 60, 6) AS runtime_minutes,
          round(n / s * 60, 6) AS pages_per_minute, round(coalesce(dups * 100.0 / nullif(n + dups, 0), 0), 6) AS duplication_rate, round(coalesce(err * 100.0 / nullif(n + err, 0), 0), 6) AS error_rate, round(coalesce(b / 1024.0 / nullif(n, 0), 0), 6) AS average_page_size_kb FROM a""",
    "retry_schedule": f"""
        WITH {_X}, r AS (SELECT error_id, error_type, unnest(CASE WHEN error_type IN ('network_timeout', 'connection_error', 'http_server_error', 'rate_limited') THEN [1, 2, 3] ELSE [1] END) AS retry, error_type IN ('network_timeout', 'connection_error', 'http_server_error', 'rate_limited') AS again, CASE WHEN error_type = 'rate_limited' THEN 2.0 ELSE 1.0 END AS f FROM x)
        SELECT error_id, CAST(retry AS INTEGER) AS retry, CASE WHEN again AND retry < 3 THEN CAST(f * pow(2, retry - 1) AS DOUBLE) END AS delay, CAST(f * (pow(2, retry - 1) - 1) AS DOUBLE) AS waited FROM r""",
    "breaker_states": f"""
        WITH RECURSIVE {_E}, n AS (SELECT domain, row_number() OVER (PARTITION BY domain ORDER BY ts NULLS FIRST, event_id) AS i, epoch_us(ts) / 1e6 AS t, ok FROM e),
        f AS (SELECT domain, CAST(0 AS BIGINT) AS i, 'closed' AS state, 0 AS failures, CAST(0 AS DOUBLE) AS last, 0 AS refused FROM n WHERE i = 1
          UNION ALL SELECT m.domain, m.i, CASE WHEN no THEN state WHEN m.ok THEN CASE WHEN now = 'half_open' THEN 'closed' ELSE now END WHEN failures + 1 >= 5 THEN 'open' ELSE now END,
            CASE WHEN no THEN failures WHEN m.ok THEN CASE WHEN now = 'half_open' THEN 0 ELSE failures END ELSE failures + 1 END, CASE WHEN no OR m.ok THEN last ELSE m.t END, refused + CASE WHEN no THEN 1 ELSE 0 END
          FROM (SELECT n.*, f.state, f.failures, f.last, f.refused, f.state = 'open' AND NOT coalesce(n.t - f.last > 60, false) AS no, CASE WHEN f.state = 'open' AND coalesce(n.t - f.last > 60, false) THEN 'half_open' ELSE f.state END AS now FROM f JOIN n ON n.domain = f.domain AND n.i = f.i + 1) m)
        SELECT domain, arg_max(state, i) AS state, arg_max(failures, i) AS failures, arg_max(refused, i) AS refused FROM f GROUP BY domain""",
    "politeness_schedule": f"""
        WITH {_E}, r AS (SELECT event_id, domain, epoch_us(ts) / 1000000 AS a, row_number() OVER (PARTITION BY domain ORDER BY ts, event_id) - 1 AS i, ts FROM e WHERE ts IS NOT NULL)
        SELECT event_id, round(i + max(a - i) OVER (PARTITION BY domain ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 3) AS start FROM r""",
    "robots_policy": f"""
        WITH {_E}, d AS (SELECT DISTINCT domain FROM e WHERE domain <> '')
        SELECT domain, CASE WHEN length(domain) % 4 = 0 THEN 2.5 ELSE 1.0 END AS crawl_delay, length(domain) % 4 <> 1 AS user_agent_allowed FROM d""",
}

SQL["final_report"] = f"""
    WITH s AS ({SQL["crawl_summary"]}), m AS ({SQL["crawl_domain_metrics"]}),
    r AS (SELECT 'totals' AS section, 'crawl' AS subject, unnest({report.TOTALS}) AS name, unnest([{", ".join(report.TOTALS)}]::DOUBLE[]) AS value FROM s
      UNION ALL SELECT 'performance', 'crawl', unnest({report.PERFORMANCE}), unnest([{", ".join(report.PERFORMANCE)}]::DOUBLE[]) FROM s
      UNION ALL SELECT 'efficiency', 'crawl', unnest({report.EFFICIENCY}), unnest([{", ".join(report.EFFICIENCY)}]::DOUBLE[]) FROM s
      UNION ALL SELECT 'domain', domain, unnest({report.DOMAIN}), unnest([{", ".join(report.DOMAIN)}]::DOUBLE[]) FROM m)
    SELECT section, subject, name, value FROM r"""

SQL["metrics_snapshot"] = f"""
    WITH m AS ({SQL["crawl_domain_metrics"]}), {_E}, a AS (SELECT count(*) FILTER (ok) AS n, count(*) FILTER (NOT ok) AS err, avg(response_time) FILTER (ok) AS rt FROM e)
    SELECT '2025-01-01T00:00:00' AS timestamp, 'domain' AS section, domain AS subject, pages_crawled, success_rate, avg_response_time FROM m
    UNION ALL SELECT '2025-01-01T00:00:00', 'crawl', '', n, round(n * 100.0 / nullif(n + err, 0), 6), round(rt, 6) FROM a"""
SQL["snapshot_history"] = f"""
    WITH {_E}, r AS (SELECT row_number() OVER w AS at_event, count(*) FILTER (ok) OVER w AS pages, count(*) FILTER (NOT ok) OVER w AS errors, coalesce(sum(content_length) FILTER (ok) OVER w, 0) AS characters FROM e WINDOW w AS (ORDER BY ts NULLS FIRST, event_id ROWS UNBOUNDED PRECEDING))
    SELECT at_event, pages, errors, CAST(characters AS BIGINT) AS characters FROM r WHERE at_event % 5 = 0 ORDER BY at_event DESC LIMIT 100"""
SQL["robots_gate"] = """
    WITH u AS (SELECT DISTINCT url, lower(regexp_extract(url, '^(?:[^:/?#]+:)?(?://([^/?#]*))?', 1)) AS domain FROM links WHERE url IS NOT NULL),
    r AS (SELECT url, CASE WHEN domain = 'umber-notes.example' THEN 'Domain umber-notes.example is blocked' WHEN length(domain) % 2 = 0 AND starts_with(regexp_extract(url, '^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)', 1), '/archive') THEN 'URL blocked by robots.txt' ELSE 'OK' END AS reason FROM u)
    SELECT url, reason = 'OK' AS can_crawl, reason FROM r"""
