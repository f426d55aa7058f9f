import pandas as pd
from pyspark.sql import functions as F

from tidewrack.operators import metrics, policy
from tidewrack.plans.builder import CrawlBuilder
from tidewrack.sources import replay, storage
from tidewrack.streaming import events


def test_fetch_stored(spark):
    p = spark.createDataFrame([("a", "x", 0.1, 200, None), ("b", "y", 0.2, 404, None)], "url string, content string, response_time double, status_code int, error string")
    u = spark.createDataFrame([("a",), ("b",), ("c",)], "url string")
    got = {r.url: (r.content, r.error, r.status_code) for r in replay.fetch_stored(u, p).collect()}
    assert got == {"a": ("x", None, 200), "b": (None, "HTTP 404", 404), "c": (None, "not stored", None)}


def test_fetch_source(spark):
    spark.dataSource.register(replay.FetchSource)
    d = spark.read.format("tidewrack_fetch").option("urls", "https://a/1\nhttps://a/2\nhttps://b/1").option("fetcher", "tidewrack.sources.replay:nothing").load()
    assert sorted(r.url for r in d.collect()) == ["https://a/1", "https://a/2", "https://b/1"] and d.first().error == "offline"


def test_storage(spark, tmp_path):
    p = spark.createDataFrame([("html", "https://www.a.example/1", "x" * 2000), ("css", "https://a.example/2", "y"), ("html", "https://b.example/3", None)], "kind string, url string, content string")
    out = str(tmp_path / "store")
    storage.save_pages(p, out)
    s = {r.kind: r.files for r in storage.storage_stats(spark, out).collect()}
    assert set(s) == {"html", "css"}
    u = F.lit("https://www.a.example:8/x")
    r = spark.range(1).select(storage.file_path(u, "html"), storage.file_path(u, "css", F.lit("m"), compress=True), storage.file_path(u, "component_screenshots", F.lit("c_1"))).first()
    assert r[0].startswith("crawl_data/a.example_8/") and r[0].endswith("/html.html") and r[1].endswith("/css/m.css.gz") and r[2].endswith("/component_screenshots/c_1.png")


def _source(spark, sf, tmp_path):
    rows = metrics.crawl_events(spark.read.parquet(f"{sf}/fetches.parquet").where("fetched_at IS NOT NULL"))
    rows.write.parquet(str(tmp_path / "in"))
    return rows, spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))


def test_streaming_policy_equals_batch(spark, sf, tmp_path):
    rows, stream = _source(spark, sf, tmp_path)
    out = events.run_once(events.domain_policy(stream), "policy", str(tmp_path / "c"), "update")
    got = {r.domain: (r.crawl_delay, r.requests) for r in out.collect()}
    want = {r.domain: (r.crawl_delay, r.requests) for r in policy.adaptive_delay(rows, ["ts", "event_id"]).collect()}
    assert got == want


def test_streaming_first_urls(spark, sf, tmp_path):
    rows, stream = _source(spark, sf, tmp_path)
    out = events.run_once(events.first_urls(stream, "ts", "4000 days"), "first", str(tmp_path / "c"))
    from tidewrack.functions import urls

    assert out.count() == rows.select(urls.canonical("url")).distinct().count()


def test_streaming_report(spark, sf, tmp_path):
    rows, stream = _source(spark, sf, tmp_path)
    out = events.run_once(events.report(stream, "ts", "1 day"), "report", str(tmp_path / "c"), "complete")
    assert out.agg(F.sum("pages")).first()[0] == rows.where("ok").count()


def test_builder(spark):
    pages = pd.DataFrame([("https://a.example/1", ["/2", "https://b.example/3"], "<html><body><p>x</p></body></html>"), ("https://a.example/2", [], None)], columns=["url", "links", "content"])
    p = spark.createDataFrame(pages, "url string, links array<string>, content string")
    c = CrawlBuilder(["https://a.example/1"]).max_pages(5).with_graph("single_domain").with_css(3).with_dom(4).with_paths().with_screenshots().with_content_dedup().stage("own", lambda d: d.withColumn("n", F.size("links"))).build(spark)
    got = {r.url: (r.total_nodes, r.n) for r in c.plan(p).collect()}
    assert got == {"https://a.example/1": (4, 2), "https://a.example/2": (None, 0)}


def test_images_that_are_none_stay(spark):
    from tidewrack.sources import storage

    d = spark.createDataFrame([("u", bytearray(b"no image")), ("v", None)], "url string, image binary")
    got = {r.url: (r.image, r.format) for r in storage.to_webp(d).collect()}
    assert bytes(got["u"][0]) == b"no image" and got["v"][0] is None and got["u"][1] == "png"


def test_robots_texts(spark):
    q = replay.robots_requests(spark.createDataFrame([("a.example",), ("b.example",), ("",)], "domain string"))
    r = spark.createDataFrame([("https://a.example/robots.txt", "User-agent: *", 200), ("https://b.example/robots.txt", "x", 404)], "url string, content string, status_code int")
    assert {x.domain: x.robots_txt for x in replay.robots_texts(q, r).collect()} == {"a.example": "User-agent: *", "b.example": ""}


def test_progress_log(spark, sf, tmp_path):
    from tidewrack.streaming.log import ProgressLog

    log = ProgressLog(keep=5)
    for i in range(9):
        log._add({"i": i})
    assert log.table(spark).count() == 5


def test_public_names():
    import tidewrack

    assert tidewrack.CrawlBuilder is CrawlBuilder and all(getattr(tidewrack, n) for n in tidewrack.__all__)
