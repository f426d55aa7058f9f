"""Signs that several operators look for in a line of text."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

#: Ideographs, kana and hangul, of which one counts as three characters of other scripts.
WIDE = re.compile("[぀-鿿가-힣]")
SENTENCE = re.compile(r"[.!?…。！？;:；：](?:[\s\"'”“’»)\]」』]|$)")
STOP = re.compile(r"[.!?…。！？;:；：,，][\s\"'”“’»)\]」』]*$")


#: A table of frequent words is of fixed size; one with more rows is refused, not cut.
MAX_WORDS = 1_000_000


def word_rows(common_words: DataFrame) -> list[tuple[str, str]]:
    """(lang, word) of a small table of frequent words; rows with a null are left out."""
    known = common_words.select("lang", "word").where("word IS NOT NULL AND lang IS NOT NULL")
    if known.count() > MAX_WORDS:
        raise ValueError(f"more than {MAX_WORDS} frequent words")
    return [tuple(r) for r in known.collect()]


def width(text: str) -> int:
    return len(text) if text.isascii() else len(text) + 2 * len(WIDE.findall(text))
