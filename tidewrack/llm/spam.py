"""Keyword-stuffed pages, link lists and lists of product tags.

The main area of a page is measured: share of its most frequent content word, of its most frequent
pair of content words and of all repeated pairs, duplicate lines, link-text ratio, separators per
word, words per full stop, and the share of function words. Pairs are of content words next to each
other when function words are left out. What is little or much depends on the language, so each bound
is a multiple of a quantile over all pages of that language; those of rare languages are taken over all
pages.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewrack.llm.pagetree import Page, main_area
from tidewrack.session import store

WORD = re.compile(r"[^\W\d_]+")
SEPARATOR = re.compile(r"[|,;/#•·、，；]")
STOP = re.compile(r"[.!?。！？…](?:\W|$)")
ROOT = re.compile(r"<!--.*?(?:-->|\Z)|<html\b([^>]*)", re.I | re.S)
LANG = re.compile(r"\blang\s*=\s*[\"']?([A-Za-z]{2})", re.I)
IDEOGRAPH = re.compile("[぀-鿿]")
#: Frequent function characters of Chinese and Japanese, which have no word borders.
PARTICLES = re.compile("[的了在和是不把被后前里上下边は が を の に で と も た]")
FEATURES = T.StructType([
    T.StructField("lang", T.StringType()), T.StructField("words", T.IntegerType()), T.StructField("function", T.DoubleType()),
    T.StructField("top_word", T.DoubleType()), T.StructField("top_pair", T.DoubleType()), T.StructField("top_phrase", T.DoubleType()), T.StructField("repeated", T.DoubleType()), T.StructField("separators", T.DoubleType()),
    T.StructField("per_stop", T.DoubleType()), T.StructField("linked", T.DoubleType()), T.StructField("double_lines", T.DoubleType()), T.StructField("links", T.IntegerType()),
])


def language(source: str) -> str:
    """The language that the first html tag outside comments names; "und" without one."""
    root = next((m.group(1) for m in ROOT.finditer(source) if m.group(1) is not None), "")
    m = LANG.search(root)
    return m.group(1).lower() if m else "und"


def features(page: Page, source: str, common: dict[str, frozenset[str]]) -> tuple | None:
    """The values of FEATURES for the main area of a page; None without one."""
    area = main_area(page)
    if area is None:
        return None
    lines = [page.lines[i] for i in area.lines]
    text = "\n".join(x.text for x in lines)
    words = WORD.findall(text.lower())
    n = len(words)
    if not n:
        return None
    lang = language(source)
    wide = 0 if text.isascii() else len(IDEOGRAPH.findall(text))
    everything = common[""]
    if wide > 0.3 * len(text):
        function = min(1.0, 3 * len(PARTICLES.findall(text)) / wide)
    else:
        count = Counter(words)
        function = max((sum(map(count.__getitem__, own & count.keys())) for k, own in common.items() if k), default=0) / n
    # single letters are what elision leaves of function words
    content = [w for w in words if len(w) > 1 and w not in everything]
    top = max(Counter(content).values(), default=0) / max(len(content), 1)
    rep = [c for c in Counter(zip(content, content[1:])).values() if c >= 3]
    phrases = Counter(zip(words, words[1:], words[2:], words[3:]))
    kept = [x.text.strip().lower() for x in lines]
    return (
        lang, n, function, top, 2 * max(rep, default=0) / n, 4 * max(phrases.values(), default=0) / n, 2 * sum(rep) / n, len(SEPARATOR.findall(text)) / n, n / (len(STOP.findall(text)) + 1),
        area.linked / max(area.size, 1), 1 - len(set(kept)) / len(kept), sum(x.linked > 0.5 * x.size for x in lines),
    )


KINDS = [pa.string(), pa.int32(), *[pa.float64()] * 9, pa.int32()]


def word_lists(rows: list) -> dict[str, frozenset[str]]:
    """Rows (lang, word) as the words of each language, and under "" of all."""
    out = {lang: frozenset(w for k, w in rows if k == lang) for lang in {k for k, _ in rows}}
    return out | {"": frozenset(w for _, w in rows)}


#: What a page's features are held against, by language: (quantile of all its pages, times, least, most).
BOUNDS = {
    "few": ("function", 0.5, 0.45, 0.0, 0.5), "much_word": ("top_word", 0.5, 6.0, 0.15, 0.25), "much_pair": ("top_pair", 0.9, 2.2, 0.11, 0.13), "much_phrase": ("top_phrase", 0.9, 2.4, 0.19, 0.3),
    "much_repeated": ("repeated", 0.9, 1.1, 0.35, 0.65), "most_repeated": ("repeated", 0.9, 1.5, 0.75, 0.9), "much_separated": ("separators", 0.9, 4.0, 0.2, 0.5), "long_stop": ("per_stop", 0.9, 1.6, 45.0, 60.0),
    "much_linked": ("linked", 0.9, 2.0, 0.6, 0.8), "much_doubled": ("double_lines", 0.95, 4.0, 0.25, 0.4),
}
#: Languages with fewer pages than this are held against the pages of all languages.
KNOWN = 50


def calibrated(measured: DataFrame) -> DataFrame:
    """measured with the columns of BOUNDS: multiples of quantiles of all pages of the language that
    have sentences, each within fixed ends. There are at most as many languages as two letters can
    name, so their bounds are broadcast."""
    text = "words >= 60 AND per_stop < 60 AND function > 0"
    aggs = [F.expr(f"percentile_approx(IF({text}, {f}, NULL), {q}, 10000)").alias(k) for k, (f, q, *_) in BOUNDS.items()]
    whole = measured.agg(F.struct(*aggs)).scalar()
    own = measured.groupBy("lang").agg(F.count_if(F.expr(text)).alias("_n"), *aggs).withColumn("_all", whole)
    value = lambda k: F.when(F.col("_n") >= KNOWN, F.col(k)).otherwise(F.col(f"_all.{k}"))
    bound = lambda k, times, least, most: F.least(F.greatest(F.coalesce(value(k) * times, F.lit(least)), F.lit(least)), F.lit(most)).alias(k)
    bounds = own.select("lang", *(bound(k, *rest) for k, (_, _, *rest) in BOUNDS.items()))
    return measured.join(F.broadcast(bounds), "lang")


def stuffed() -> Column:
    """Is a page, by its calibrated features, made of keywords, links or tags?"""
    c = F.col
    few = c("function") < c("few")
    keywords = (c("words") >= 30) & (c("per_stop") > c("long_stop")) & few & ((c("repeated") > c("much_repeated")) | (c("separators") > c("much_separated")) | (c("double_lines") > c("much_doubled")))
    phrases = (c("words") >= 60) & ((c("top_pair") > c("much_pair")) | ((c("top_pair") > 0.65 * c("much_pair")) & (c("repeated") > c("most_repeated"))) | (c("top_word") > c("much_word")))
    phrases |= (c("words") >= 200) & (c("top_phrase") > c("much_phrase"))
    links = (c("links") >= 10) & (c("linked") > c("much_linked")) & few
    return F.coalesce(keywords | phrases | links, F.lit(False))


def find_stuffed(fetches: DataFrame, common_words: DataFrame, id_col: str = "fetch_id") -> DataFrame:
    """(id_col): fetches whose main text is for the most part repeated keywords, links or tags.

    fetches needs id_col, url, content and parsed_data (title, html, text_content). Null or empty text is
    no case; repeated rows give repeated cases; other columns aren't read. common_words(lang, word) is a
    small table of fixed size. The features, of a few bytes a page, are stored; nothing else is shuffled
    but the partial quantiles of the languages.
    """
    from tidewrack.llm.pages import SPAM, read_pages  # which uses features()

    return stuffed_of(store(read_pages(fetches, common_words, id_col, SPAM)), id_col)


def stuffed_of(pages: DataFrame, id_col: str) -> DataFrame:
    """find_stuffed() on stored pages of read_pages()."""
    return calibrated(pages.where("has_text AND words IS NOT NULL")).where(stuffed()).select(F.col("id").alias(id_col))
