import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from urllib.parse import urljoin

from tidewrack.functions import html, urls

CASES = [
    ("https://www.Example.com/A/?utm_source=x&b=2&a=1#f", "https://example.com/a?a=1&b=2"),
    ("http://www.www.h.example/", "http://www.h.example/"),
    ("https://h.example/p;v=1?x=&y", "https://h.example/p"),
    ("https://h.example/p?b=1&a=2&b=0", "https://h.example/p?a=2&b=1&b=0"),
    ("https://h.example/p?q=a+b%20c", "https://h.example/p?q=a+b+c"),
    ("https://h.example/p?q=*~", "https://h.example/p?q=%2A~"),
    ("https://h.example:8080/x///", "https://h.example:8080/x"),
    ("h.example/x", "https://h.example/x"),
    ("  https://h.example  ", "https://h.example/"),
    ("https://h.example/p?REF=1&Id=3", "https://h.example/p?id=3"),
]


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


@pytest.mark.parametrize("url,want", CASES)
def test_canonical(spark, url, want):
    assert one(spark, urls.canonical(F.lit(url)))[0] == want


def test_null_url_stays_null(spark):
    n = F.lit(None).cast("string")
    assert all(v is None for v in one(spark, urls.canonical(n), urls.domain(n), urls.url_hash(n), urls.resolve(n, F.lit("/a"))))


REFS = ["", "?q=1", "#f", "//o.example/p", "../../c", "./d", "d/../e", "/r/./s/../t", "https://x.example/y", "mailto:a@b", "g;x=1?y#s", "..", "."]


@pytest.mark.parametrize("ref", REFS)
def test_resolve_like_the_standard_library(spark, ref):
    base = "https://h.example/a/b/c?q=0"
    assert one(spark, urls.resolve(F.lit(base), F.lit(ref)))[0] == urljoin(base, ref)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.text("abz", min_size=1, max_size=3), st.text("xy1 &=%", min_size=1, max_size=4)), max_size=4), st.text("ab/.", max_size=6))
def test_canonical_is_idempotent(spark, params, path):
    from urllib.parse import urlencode

    u = "https://h.example/" + path + ("?" + urlencode(params) if params else "")
    c = one(spark, urls.canonical(F.lit(u)))[0]
    assert one(spark, urls.canonical(F.lit(c)))[0] == c


def test_small_functions(spark):
    r = one(
        spark, urls.extension(F.lit("https://a.b/x.tar.GZ")), urls.extension(F.lit("https://a.b/x")), urls.clean_domain(F.lit("https://www.A.b:80/x")),
        urls.css_filename(F.lit("https://a.b/s/main.min.css?v=1")), urls.retry_domain(F.lit("nothing")), urls.retry_domain(F.lit("https://a.b/c")),
    )
    assert list(r) == ["gz", "", "A.b_80", "main_min", "unknown", "a.b"]


PAGE = """<html><head><title> A &amp; B </title><meta name="d" content="1"><meta property="d" content="2"><meta charset="x">
<link rel="alternate stylesheet" href="/s.css"><style></style><style>p{}</style></head>
<body><!-- <a href="/no"> --><a href="/x?a=1&amp;b=2">t</a><a href="mailto:q">m</a><a class="c" href="y">u</a><img alt="" src="i.png"><script>var s = '</p>';</script></body></html>"""


def test_html(spark):
    h, b = F.lit(PAGE), F.lit("https://h.example/d/")
    r = one(spark, html.title(h), html.links(F.regexp_replace(h, html.COMMENT, ""), b), html.stylesheets(h, b), html.inline_css(h), html.meta(h), html.images(h, b), html.text(h))
    assert r[0] == "A & B"
    assert r[1] == ["https://h.example/x?a=1&b=2", "https://h.example/d/y"]
    assert r[2] == ["https://h.example/s.css"] and r[3] == ["p{}"] and r[4] == {"d": "2"} and r[5] == ["https://h.example/d/i.png"]
    assert "var" not in r[6]


def test_normalized_hash_ignores_what_changes(spark):
    a = "<p>x</p><script>1</script> <!-- c --> timestamp: 123 csrfToken: 'abc'"
    b = "<p>x</p>  <script>2</script>\n timestamp: 9 csrfToken: 'q'"
    assert one(spark, html.content_hash(F.lit(a)))[0] == one(spark, html.content_hash(F.lit(b)))[0]
    assert one(spark, html.content_hash(F.lit(a), False))[0] != one(spark, html.content_hash(F.lit(b), False))[0]
