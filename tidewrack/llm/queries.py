"""Queries of the operators on training text, and their SQL where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.llm import bpe, encoding, leakage, main_content, quality, repeated_lines, spam, templates
from tidewrack.session import table

#: Folder of the public vocabulary files.
TOKENIZERS = os.environ.get("TIDEWRACK_TOKENIZERS", "/opt/tokenizers")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines.repeated_occurrences(table(spark, d, "fetches"))


def p1_clean_text(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines.without_repeated_lines(table(spark, d, "fetches"))


def _garbled(spark: SparkSession, d: str) -> DataFrame:
    return encoding.find_garbled(table(spark, d, "fetches"), "fetch_id", {"content": ("content", True), "title": ("parsed_data.title", False)})


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _garbled(spark, d).select("fetch_id", "field")


def p3_restored(spark: SparkSession, d: str) -> DataFrame:
    return _garbled(spark, d)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return main_content.find_main_lines(table(spark, d, "fetches"), table(spark, d, "common_words"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return templates.find_residue(table(spark, d, "fetches"), table(spark, d, "common_words"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return spam.find_stuffed(table(spark, d, "fetches"), table(spark, d, "common_words"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(table(spark, d, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json")


def p8_lengths(spark: SparkSession, d: str) -> DataFrame:
    return p8_ids(spark, d).select("doc_id", F.size("ids").alias("n_tokens"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p9_leaked_items(spark: SparkSession, d: str) -> DataFrame:
    found = leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("windows").alias("n_windows"))


def p9_near(spark: SparkSession, d: str) -> DataFrame:
    """Documents and items that share ten words in order or nearly so: each at most 2 words off its place."""
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), slop=2).select("doc_id", "item_id")


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Texts decoded from their ids as a stream."""
    return bpe.decode(p8_ids(spark, d), f"{TOKENIZERS}/byte_bpe_50k.json")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.find_not_prose(table(spark, d, "documents"), table(spark, d, "common_words"))


def p10_stats(spark: SparkSession, d: str) -> DataFrame:
    return quality.text_statistics(table(spark, d, "documents"), table(spark, d, "common_words"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_clean_text": p1_clean_text,
    "p3_found": p3_found,
    "p3_restored": p3_restored,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p7_found": p7_found,
    "p8_ids": p8_ids,
    "p8_lengths": p8_lengths,
    "p8_decoded": p8_decoded,
    "p9_found": p9_found,
    "p9_near": p9_near,
    "p9_leaked_items": p9_leaked_items,
    "p10_found": p10_found,
    "p10_stats": p10_stats,
}

_LINES = r"""
lines AS (
  SELECT f.fetch_id, f.url, regexp_replace(lower(regexp_extract(f.url, '^(?:[^:/?#]+:)?//(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\.', '') AS source,
         CAST(u.i - 1 AS INTEGER) AS line_no,
         regexp_replace(lower(trim(regexp_replace(string_split(f.parsed_data.text_content, chr(10))[u.i], '[ \t\x{00A0}]+', ' ', 'g'), ' ')), '[0-9]+', '0', 'g') AS line
  FROM fetches f, unnest(range(1, len(string_split(f.parsed_data.text_content, chr(10))) + 1)) AS u(i)
  WHERE f.url IS NOT NULL AND f.parsed_data.text_content IS NOT NULL
), often AS (
  SELECT source, line FROM lines WHERE line <> '' AND source <> '' GROUP BY source, line HAVING count(DISTINCT url) >= 4
)"""

_LEAKS = r"""
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
it AS (SELECT item_id, regexp_extract_all(lower(passage), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE passage IS NOT NULL),
iw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[u.i:u.i + least(10, len(w)) - 1], ' ') AS g FROM it, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(i) WHERE len(w) > 0),
ns AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, u.i, array_to_string(w[u.i:u.i + n - 1], ' ') AS g FROM d, ns, unnest(range(1, len(w) - n + 2)) AS u(i)),
hits AS (SELECT doc_id, item_id, count(*) AS windows FROM dw JOIN iw USING (n, g) GROUP BY doc_id, item_id)"""

SQL: dict[str, str] = {
    "p1_found": f"WITH {_LINES} SELECT l.fetch_id, l.line_no FROM lines l JOIN often USING (source, line)",
    "p1_clean_text": f"""
        WITH {_LINES}, k AS (SELECT l.fetch_id, l.line_no, string_split(f.parsed_data.text_content, chr(10))[l.line_no + 1] AS raw FROM lines l JOIN fetches f USING (fetch_id) LEFT JOIN often o USING (source, line) WHERE o.line IS NULL),
        t AS (SELECT fetch_id, string_agg(raw, chr(10) ORDER BY line_no) AS text FROM k GROUP BY fetch_id)
        SELECT f.fetch_id, CASE WHEN f.url IS NULL THEN f.parsed_data.text_content WHEN f.parsed_data.text_content IS NOT NULL THEN coalesce(t.text, '') END AS text FROM fetches f LEFT JOIN t USING (fetch_id)""",
    "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p9_found": f"WITH {_LEAKS} SELECT doc_id, item_id FROM hits",
    "p9_leaked_items": f"WITH {_LEAKS} SELECT item_id, count(*) AS n_docs, CAST(sum(windows) AS BIGINT) AS n_windows FROM hits GROUP BY item_id",
}
