import json
import random

import pytest
from pyspark.sql import functions as F

from tidewrack.config import CrawlConfig, GraphConfig, Mode, PolicyConfig
from tidewrack.functions import urls
from tidewrack.operators import dedup, dom, frontier, links, metrics, nested, pages, policy, skew
from tidewrack.session import clean, scan_splits, spread, store

LINKS = "link_id long, url string, source_url string, domain string, depth int, priority int, link_text string, count int"
METRICS = "snapshot_id long, domain string, pages_crawled long, errors long, count int"


# --- skewed keys


def brute_join(left, right):
    out = {}
    for k in {x[0] for x in left} & {y[0] for y in right} - {None}:
        l, r = [x[1] for x in left if x[0] == k], [y[1] for y in right if y[0] == k]
        s = [x for x in l if x is not None]
        t = [y for y in r if y is not None]
        out[k] = (len(l), len(r), len(l) * len(r), sum(s) * len(r) if s else None, sum(t) * len(l) if t else None)
    return out


def test_eager_join_aggregate(spark):
    rng = random.Random(1)
    left = [(rng.choice(["a", "a", "a", "b", "c", None]), rng.choice([1, 2, None])) for _ in range(200)]
    right = [(rng.choice(["a", "b", "d", None]), rng.choice([5, 7, None])) for _ in range(90)]
    l, r = spark.createDataFrame(left, "k string, v int"), spark.createDataFrame(right, "k string, v int")
    j = skew.eager_join_aggregate(l, r, l["k"], r["k"], ["v"], ["v"])
    got = {x.key: (x.l_n, x.r_n, x.pairs, x.join_sum_l_v, x.join_sum_r_v) for x in j.collect()}
    assert got == brute_join(left, right)


def test_dominating(spark):
    rows = [(i, "https://Big.example/x" if i % 3 else None, "s", "BIG.example" if i % 2 else None, 1, i, None, 0) for i in range(60)]
    rows += [(100 + i, f"https://d{i}.example:80/", "s", None, None, None, None, 0) for i in range(39)]
    l = spark.createDataFrame(rows, LINKS)
    m = spark.createDataFrame([(1, "A", 97, 0, 0), (2, "a", None, 0, 0), (3, "b", 3, 0, 0), (4, None, 50, 0, 0)], METRICS)
    got = {tuple(r) for r in skew.dominating(skew.domain_rollup(l, m), l, m).collect()}
    # big.example: 30 by domain, 20 by url; the other 10 rows have neither
    assert got == {("links", "big.example"), ("domain_metrics", "a")}


def test_skew_on_empty_tables(spark):
    l, m = spark.createDataFrame([], LINKS), spark.createDataFrame([], METRICS)
    r = skew.domain_rollup(l, m)
    assert r.count() == 0 and skew.dominating(r, l, m).count() == 0


def test_spread_starts_no_job(spark, sf):
    big = spark.read.parquet(f"{sf}/links.parquet")
    assert scan_splits(big.where("depth > 0").select("url")) >= 1 and scan_splits(big.groupBy("domain").count()) is None
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("spread", "")
    spread(big.groupBy("domain").count())
    assert list(tracker.getJobIdsForGroup("spread")) == []
    assert spread(big.select("url")).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_stored_tables(spark):
    import os

    d = store(spark.range(5))
    path = d.inputFiles()[0].removeprefix("file://")
    assert d.count() == 5 and os.path.exists(path)
    clean(spark)
    assert not os.path.exists(path)


# --- nested records


def brute_nodes(text):
    try:
        root = json.loads(text) if text else None
    except ValueError:
        return []
    out = []

    def go(n, path, up):
        out.append(("node", path, up))
        a = n.get("attributes")
        for k, v in (a.items() if isinstance(a, dict) else ()):
            if v is not None:
                out.append(("attribute", f"{path}@{k}", path))
        if n.get("bounding_box") is not None:
            out.append(("box", path + "#box", path))
        kids = n.get("children")
        for i, c in enumerate([kids] if isinstance(kids, dict) else kids if isinstance(kids, list) else []):
            if isinstance(c, dict):
                go(c, f"{path}.{i}", path)

    if isinstance(root, dict):
        go(root, "0", "")
    return out


def tree(rng, depth=0):
    n = {}
    for k, v in (
        ("tag_name", rng.choice(["p", None, 'q"u', "\\", "ключ", "a\\\\"])), ("attributes", rng.choice([None, {}, {"a": None, "b": "", "ö{[": "]}", 'x"': 1, "children": [{}]}])),
        ("bounding_box", rng.choice([None, {"x": "1", "y": [2, {"z": 3}]}, {}])), ("text_content", rng.choice(["{}[],:\"\\", None, " \t ", "\U0001f600"])), ("depth", depth),
    ):
        if rng.random() < 0.7:
            n[k] = v
    if depth < 6 and rng.random() < 0.8:
        n["children"] = rng.choice([None, {}, [], tree(rng, depth + 1), [tree(rng, depth + 1) if rng.random() < 0.8 else rng.choice([None, 3, "x", [{}]]) for _ in range(rng.randrange(4))]])
    items = list(n.items())
    rng.shuffle(items)
    return dict(items)


@pytest.mark.parametrize("values", [False, True])
def test_flatten_like_recursion(spark, values):
    rng = random.Random(5)
    texts = []
    for _ in range(150):
        t = tree(rng)
        s = json.dumps(t, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, None, 1]))
        texts.append(rng.choice([s, s, s, s[: len(s) // 2], s + "x", s.replace('"', "'", 1), None, "", "null", "[1]", "NaN", '{"a":1}}', "{", '"x']))
    texts += ['{"tag_name":"a","children":[{"tag_name":"b"}],"children":[null,{"tag_name":"c"}]}', '{"child\\u0072en":[{}]}', '{"attributes":{"a":1,"a":null}}']
    deep = '{"children":[' * 300 + "{}" + "]}" * 300
    texts.append(deep)
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "dom_id long, dom_tree string, record_kind string")
    got = sorted((r.dom_id, r.record_kind, r.record_key, r.parent_key) for r in nested.flatten_records(df, "dom_id", "dom_tree", values).collect())
    want = sorted((i, *x) for i, t in enumerate(texts) for x in brute_nodes(t))
    assert got == want


def test_flatten_values_and_empty(spark):
    df = spark.createDataFrame([(1, '{"tag_name":"a\\u00e9","depth":0,"attributes":{"k":"v\\"w"},"bounding_box":{"x":1}}')], "dom_id long, dom_tree string")
    rows = {r.record_kind: r for r in nested.flatten_records(df, "dom_id", "dom_tree", True).collect()}
    assert rows["node"].tag_name == "aé" and rows["node"].depth == 0
    assert rows["attribute"].name == "k" and rows["attribute"].value == '"v\\"w"' and rows["box"].value == '{"x":1}'
    assert nested.flatten_records(df.limit(0), "dom_id", "dom_tree").count() == 0


def test_deep_records_are_checked():
    for n in (50_000,):
        good = b'{"children":[' * n + b"{}" + b"]}" * n
        assert nested.is_json(good)
        for bad in (good.replace(b"{}", b"{,}"), good[:-1], good.replace(b"{}", b'{"a":1,,}'), good + b"x", good.replace(b"{}", b"[1 2]"), good.replace(b"{}", b"{1:2}"), good.replace(b"{}", b'"\x01"')):
            assert not nested.is_json(bad)
    for text in (b'{"a":[1,2.5e-3,{"b":null}],"c":"x\\u00e9\\n"}', b"[]", b'"s"', b" 1 ", b"{", b"[1,]", b'{"a"}', b'{"a":1,}', b"01", b"'x'", b"nul", b"", b"[}", b'"\\x"'):
        assert nested.is_deep_json(text) == nested.is_json(text)


# --- dedup


def test_first_by(spark):
    df = spark.createDataFrame([(3, "u"), (1, "u"), (2, None), (4, None), (5, "v")], "id long, url string")
    got = {r.id: (r.is_duplicate, r.original) for r in dedup.first_by(df, F.col("url"), ["id"]).collect()}
    assert got == {1: (False, "u"), 3: (True, "u"), 2: (False, None), 4: (False, None), 5: (False, "v")}


def test_bloom_has_no_false_negatives(spark):
    a, b = spark.range(300).select(F.col("id").cast("string").alias("s")), spark.range(200, 600).select("id", F.col("id").cast("string").alias("s"))
    r = dedup.bloom_contains(b, dedup.bloom_filter(a, F.col("s"), 1000), "id", F.col("s"), 1000).collect()
    assert len(r) == 400 and all(x.maybe for x in r if x.id < 300) and sum(x.maybe for x in r if x.id >= 300) < 30


def test_bloom_positions_are_the_digest_modulo_the_size(spark):
    import hashlib

    words = ["a", "é", "", "https://x.example/1?q=2"]
    d = spark.createDataFrame([(w,) for w in words], "s string")
    for capacity in (1000, 999_983, 100_000_007):
        got = {r.s: r.p for r in d.select("s", dedup.bloom_positions(F.col("s"), capacity).alias("p")).collect()}
        assert got == {w: [int(hashlib.md5(f"{w}{i}".encode()).hexdigest(), 16) % (capacity * 10) for i in range(3)] for w in words}
    a = spark.range(300).select(F.col("id").cast("string").alias("s"))
    for kw in ({"simple": True}, {"n_shards": dedup.shards(300, 40)}):
        r = dedup.bloom_contains(spark.range(600).withColumn("s", F.col("id").cast("string")), dedup.bloom_filter(a, F.col("s"), 100, **kw), "id", F.col("s"), 100, **kw).collect()
        assert len(r) == 600 and all(x.maybe for x in r if x.id < 300) and not all(x.maybe for x in r)


def test_keep_newest(spark):
    df = spark.range(20)
    assert dedup.keep_newest(df, ["id"], 5, 20) is df
    assert sorted(r.id for r in dedup.keep_newest(df, ["id"], 5, 19).collect()) == [15, 16, 17, 18, 19]


# --- links


def score(spark, cfg, url, source="https://s.example/", depth=1, text=None, content=None):
    c = F.lit(url)
    return spark.range(1).select(links.priority(cfg, c, F.lit(source), urls.domain(c), F.lit(depth), F.lit(text), F.lit(content))).first()[0]


def test_priority_card(spark):
    g = GraphConfig(priority=frozenset({"p.example"}), blocked=frozenset({"b.example", "p.example"}), allowed=frozenset({"a.example"}), mode=Mode.WHITELIST, keywords=("Tide", "x"))
    assert score(spark, GraphConfig(), "https://s.example/x") == 250
    assert score(spark, g, "https://p.example/x") == 300
    assert score(spark, g, "https://a.example/x") == 200
    assert score(spark, g, "https://b.example/x") == -1000
    assert score(spark, g, "https://o.example/x.html") == 50
    assert score(spark, GraphConfig(extension_rules="dotted"), "https://o.example/x.html") == 100
    assert score(spark, GraphConfig(extension_rules="dotted"), "https://o.example/x.zip") == -1000
    assert score(spark, g, "https://o.example/blog/x") == 130 and score(spark, g, "https://o.example/blog/api/x") == 80 and score(spark, g, "https://o.example/blog") == 100
    assert score(spark, g, "https://o.example/x", depth=9) == 0
    assert score(spark, g, "https://o.example/x", text="Read more, buy now") == 100
    assert score(spark, g, "https://o.example/x", content="the TIDE") == 125


@pytest.mark.parametrize("mode,seed,allowed,other", [("single_domain", True, False, False), ("whitelist", False, True, False), ("cross_domain", True, False, False), ("graph", True, False, False), ("focused", True, True, True), ("no such", True, False, False)])
def test_admission(spark, mode, seed, allowed, other):
    g = GraphConfig(mode=Mode.of(mode), allowed=frozenset({"a.example"}), blocked=frozenset({"b.example"}))
    d = spark.createDataFrame([("s.example",), ("a.example",), ("o.example",), ("b.example",)], "d string")
    got = {r[0]: r[1] for r in d.select("d", links.admission(g, F.col("d"), ["s.example"])["accepted"]).collect()}
    assert got == {"s.example": seed, "a.example": allowed, "o.example": other, "b.example": False}


def test_domain_scores_equal_the_fold(spark):
    rng = random.Random(2)
    rows = [(i, f"https://d{rng.randrange(3)}.example/{i}", rng.choice(["https://seed.example/", "https://x.example/"]), None, 1, rng.randrange(400), None, 0) for i in range(120)]
    df = spark.createDataFrame(rows, LINKS)
    want = {}
    for r in rows:
        d = r[1].split("/")[2]
        want[d] = want.get(d, 0) * 0.9 + r[5] / 1000 * (2 if "seed" in r[2] else 1)
    got = {r.domain: r.score for r in links.domain_scores(df, ["seed.example"], [], ["link_id"], rows=7).collect()}
    assert got == pytest.approx(want)


# --- frontier


def test_replay_is_the_sequential_crawl(spark):
    rng = random.Random(3)
    names = [f"https://h{i % 3}.example/{i}" for i in range(14)]
    graph = {u: rng.sample(names, 3) for u in names[:11]}
    p = spark.createDataFrame(list(graph.items()), "url string, links array<string>")
    cfg = CrawlConfig(seeds=(names[0],), max_pages=6, graph=GraphConfig(mode=Mode.FOCUSED))
    r = frontier.replay(p, cfg, 1).orderBy("round").collect()
    assert [x.url for x in r] == [u for u, _ in crawl_by_rules({u: (x, None) for u, x in graph.items()}, cfg)]


def crawl_by_rules(pages, cfg):
    """A sequential crawl by the rules, one page at a time: pages is {url: (links, content)}."""
    import heapq

    g = cfg.graph
    host = lambda u: u.split("/")[2]
    heap = [(-frontier.SEED_PRIORITY, s) for s in cfg.seeds]
    heapq.heapify(heap)
    queued, visited, canon, contents, out = set(cfg.seeds), set(), set(), set(), []
    seeds = {host(s) for s in cfg.seeds}
    known, scores, depth = set(seeds), {}, {s: 0 for s in cfg.seeds}
    while heap and len(out) < cfg.max_pages:
        _, u = heapq.heappop(heap)
        queued.discard(u)
        c = u.rstrip("/").replace("//www.", "//")
        if c in canon:
            continue
        canon.add(c)
        links_of, content = pages.get(u, ([], None))
        if content is not None:
            if content in contents:
                continue
            contents.add(content)
        found, now = [], depth.get(u, 0)
        for v in links_of if now < g.max_depth else []:
            d = host(v)
            if d in g.blocked or g.mode == Mode.SINGLE_DOMAIN and d not in seeds or g.mode == Mode.WHITELIST and d not in g.allowed:
                continue
            if g.mode in (Mode.CROSS_DOMAIN, Mode.GRAPH):
                if len(known) >= g.max_domains and d not in known or d not in seeds and scores.get(d, 0.0) < g.min_domain_score:
                    continue
            p = 100 + (100 if g.mode == Mode.WHITELIST and d in g.allowed else 0) + (150 if d == host(u) else 0) - 50 * (now + 1) + 50
            if p <= 0:
                continue
            known.add(d)
            scores[d] = scores.get(d, 0.0) * 0.9 + p / 1000 * (2 if host(u) in seeds else 1)
            depth[v] = now + 1
            found.append((p, v))
        for p, v in sorted(found, key=lambda x: -x[0]):
            if v not in queued and v not in visited:
                queued.add(v)
                heapq.heappush(heap, (-p, v))
        visited.add(u)
        out.append((u, now))
    return out


@pytest.mark.parametrize("mode,low,cap", [("single_domain", 0.1, 9), ("cross_domain", 0.0, 3), ("cross_domain", 0.1, 9), ("graph", 0.0, 2), ("whitelist", 0.1, 9), ("focused", 0.1, 1)])
def test_replay_follows_the_rules_of_each_mode(spark, mode, low, cap):
    rng = random.Random(len(mode) + cap)
    names = [f"https://{'www.' if i % 7 == 3 else ''}h{i % 5}.example/{i // 2 if i % 3 else i}{'/' if i % 4 == 1 else ''}" for i in range(24)]
    names = list(dict.fromkeys(names))
    pages = {u: (rng.sample(names, 4), rng.choice([f"c{i}", f"c{i}", "same"])) for i, u in enumerate(names[:20])}
    g = GraphConfig(mode=Mode.of(mode), max_domains=cap, min_domain_score=low, allowed=frozenset({"h1.example", "h2.example"}), blocked=frozenset({"h4.example"}))
    cfg = CrawlConfig(seeds=(names[0], names[5]), max_pages=8, graph=g)
    df = spark.createDataFrame([(u, x, c) for u, (x, c) in pages.items()], "url string, links array<string>, content_key string")
    got = [(r.url, r.depth) for r in frontier.replay(df, cfg, 1).orderBy("round").collect()]
    assert got == crawl_by_rules(pages, cfg)


def test_replay_asks_robots(spark):
    p = spark.createDataFrame([("https://a.example/1", ["https://a.example/x/2", "https://a.example/3"])], "url string, links array<string>")
    robots = spark.createDataFrame([("a.example", "User-agent: *\nDisallow: /x\n")], "domain string, robots_txt string")
    cfg = CrawlConfig(seeds=("https://a.example/1",), max_pages=5)
    assert sorted(r.url for r in frontier.replay(p, cfg, 2, robots=robots).collect()) == ["https://a.example/1", "https://a.example/3"]


# --- policy


def test_error_classes(spark):
    rows = [("network_timeout", 500, ""), ("x", 429, ""), ("x", 404, ""), ("x", 503, "parsing"), ("x", 302, "parsing"), ("x", None, "A Parsing fault"), ("x", 0, "storage"), ("x", None, None)]
    d = spark.createDataFrame(rows, "k string, s int, m string")
    got = [r[0] for r in d.select(policy.classify_error(F.col("k"), F.col("s"), F.col("m"))).collect()]
    assert got == ["network_timeout", "rate_limited", "http_client_error", "http_server_error", "unknown_error", "parsing_error", "storage_error", "unknown_error"]


def test_backoff(spark):
    r = spark.range(1, 9).select(policy.backoff(F.lit("rate_limited"), F.col("id")), policy.backoff(F.lit("x"), F.col("id"), jitter=F.lit(1.0))).collect()
    assert [x[0] for x in r] == [2, 4, 8, 16, 32, 60, 60, 60] and r[7][1] == pytest.approx(66)


EVENTS = "event_id long, domain string, status_code int, response_time double"


def test_adaptive_delay_both_ways(spark):
    from tidewrack.streaming.events import next_delay

    rng = random.Random(4)
    rows = [(i, rng.choice("ab"), rng.choice([200, 200, 429, 500, 404, None]), rng.choice([0.5, 3.0, 11.0, None])) for i in range(150)]
    want = {}
    for _, d, s, t in rows:
        want[d] = next_delay(want.get(d, 1.0), s or 0, t or 0.0, 1.0)
    e = spark.createDataFrame(rows, EVENTS)
    assert {r.domain: r.crawl_delay for r in policy.adaptive_delay(e, ["event_id"]).collect()} == want
    closed = {r.domain: r.crawl_delay for r in policy.adaptive_delay_closed(e, ["event_id"], rows=10).collect()}
    assert closed == pytest.approx(want)


@pytest.mark.parametrize("rows_a_run,seed", [(None, 6), (9, 6), (23, 7), (40, 8), (5, 9)])
def test_breaker(spark, rows_a_run, seed):
    from tidewrack.operators.policy import Breaker

    rng = random.Random(seed)
    rows, t = [(-1, "b", None, False), (-2, "a", None, True)], 0.0
    for i in range(200):
        t += rng.choice([1, 5, 70]) if i % 50 < 30 else 1
        rows.append((i, rng.choice("ab"), t, rng.random() < 0.3))
    rows.sort()
    want, refused = {}, {}
    for _, d, at, ok in rows:
        b = want.setdefault(d, Breaker(PolicyConfig()))
        refused[d] = refused.get(d, 0) + (not b.event(float("nan") if at is None else at, ok))
    e = spark.createDataFrame(rows, "event_id long, domain string, t double, ok boolean")
    got = {r.domain: (r.state, r.failures, r.refused) for r in policy.breaker_states(e, ["event_id"], "t", "ok", rows=rows_a_run).collect()}
    assert got == {d: (b.state, b.failures, refused[d]) for d, b in want.items()}


def test_robots(spark):
    texts = [
        ("a", None, 1.0, True), ("b", "User-agent: *\nDisallow: /\n", 1.0, False), ("c", "User-agent: *\nDisallow: /x\nCrawl-delay: 3\nCrawl-delay: no", 3.0, True),
        ("d", "Crawl-delay: 9", 1.0, True), ("e", "User-agent: other\nDisallow: /\nUser-agent: TideWrack/1.0\nCrawl-delay: .5", 1.0, True), ("f", "# x\n\nUSER-AGENT:*\n DISALLOW : /\ndisallow:/", 1.0, False),
    ]
    d = spark.createDataFrame([t[:2] for t in texts], "domain string, robots_txt string")
    got = {r.domain: (r.crawl_delay, r.user_agent_allowed) for r in policy.robots_policy(d).collect()}
    assert got == {t[0]: t[2:] for t in texts}
    u = spark.createDataFrame([("https://c/x/1", "c"), ("https://c/y", "c"), ("https://b/", "b"), ("https://z/", "z")], "url string, domain string")
    r = {x.url: x.reason for x in policy.robots_gate(u, d, ["z"]).collect()}
    assert r == {"https://c/x/1": "URL blocked by robots.txt", "https://c/y": "OK", "https://b/": "User agent tidewrack/1.0 not allowed by robots.txt", "https://z/": "Domain z is blocked"}


def test_politeness(spark):
    arrivals = [("a", 0, 0.0), ("a", 1, 0.1), ("a", 2, 5.0), ("a", 3, 5.2), ("b", 4, 9.0)]
    d = spark.createDataFrame(arrivals, "domain string, i long, t double")
    got = {r.i: r.start for r in policy.politeness_schedule(d, F.col("t"), F.lit(1.0), ["i"], rows=2).collect()}
    assert got == pytest.approx({0: 0, 1: 1.0, 2: 5.0, 3: 6.0, 4: 9.0})


# --- metrics


def test_running_values_over_buckets(spark):
    rng = random.Random(7)
    rows = [(i, rng.random() < 0.6, round(rng.random(), 6) if rng.random() < 0.9 else None) for i in range(300)]
    e = spark.createDataFrame(rows, "event_id long, ok boolean, response_time double")
    got = {r.event_id: r.success_rate for r in metrics.running_success_rate(e, ["event_id"], 11).collect()}
    n = 0
    for i, (k, ok, _) in enumerate(rows):
        n += ok
        assert got[k] == pytest.approx(n / (i + 1) * 100, abs=1e-6)
    avg = {r.event_id: r.moving_avg for r in metrics.moving_average(e, ["event_id"], 20, 11).collect()}
    kept = [(k, t) for k, _, t in rows if t is not None]
    for i, (k, _) in enumerate(kept):
        w = [t for _, t in kept[max(0, i - 19) : i + 1]]
        assert avg[k] == pytest.approx(sum(w) / len(w), abs=1e-6)


# --- pages and DOM


PAGE = '<html><head><title> T </title><meta name=d content=1></head><body class="a b"><p>one<p id=x>two<b>bold</b></p><a href="../u">l</a><script>s</script><!-- c --><br/> </body></html>'


def test_parse(spark):
    df = spark.createDataFrame([(1, "https://h.example/d/e", PAGE), (2, None, None), (3, None, "")], "id long, url string, content string")
    got = {r.id: r.parsed for r in pages.parse_pages(df, "id").collect()}
    assert got[1].title == "T" and got[1].links == ["https://h.example/u"] and got[1].meta_data == {"d": "1"} and got[1].text_content == "Tonetwoboldl"
    assert got[2] is None and got[3].title == ""


def test_dom(spark):
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "id long, content string")
    rows = pages.dom_table(df, "id").where("id = 1").orderBy("node_id").collect()
    by = {r.xpath: r for r in rows if r.tag_name}
    assert by["/html/body"].css_selector == "body.a.b" and by["/html/body/p/p"].css_selector == "#x"
    assert by["/html/body/p"].text_content == "one"
    assert [r.text_content for r in rows if r.tag_name is None][:2] == ["T", "one"]
    assert max(r.depth for r in pages.dom_table(df, "id", max_depth=2).collect()) <= 3
    m = {(r.selector, r.node_id) for r in dom.match_components(pages.dom_table(df, "id").where("id = 1"), "id", ["body", ".a", "#x"]).collect()}
    assert len(m) == 3
    j = dom.trees_as_json(pages.dom_table(df, "id").where("id = 1"), "id").first()
    assert json.loads(j.dom_tree)["tag_name"] == "html" and j.total_nodes == len(rows)


def test_safe_names_and_positions(spark):
    assert spark.range(1).select(dom.safe_name(F.lit("#a .b > c[d='e']:f"))).first()[0] == "id_a_class_b_gt_c_d_eq_e_f"
    n = spark.createDataFrame([(1, "n", 1.9, 2.0), (1, "m", 8.0, 8.0)], "id long, node string, x double, y double")
    s = spark.createDataFrame([(1, 1.2, 2.7, 1, "old"), (1, 1.0, 2.0, 2, "new")], "id long, x double, y double, seq int, path string")
    assert {r.node: r.screenshot_path for r in dom.link_by_position(n, s, "id").collect()} == {"n": "new", "m": None}


def test_registered_crawls_have_the_default_budget(spark, sf, monkeypatch):
    from tidewrack.config import CrawlConfig
    from tidewrack.plans import graph

    seen = []
    monkeypatch.setattr(graph.frontier, "replay", lambda p, cfg, *a, **k: seen.append(cfg.max_pages))
    graph.crawl_replay(spark, sf)
    graph.crawl_queue_depth(spark, sf)
    assert seen == [CrawlConfig().max_pages] * 2
