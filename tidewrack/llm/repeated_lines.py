"""Lines repeated across one source's documents, by bitmaps of documents per line.

Documents (distinct urls) of a source are numbered densely from 0, so the documents of a line are a
bitmap. Bitmaps are compressed by words: only words of 64 documents with a bit set are stored, one
row per (source, line, word). Words of variant spellings of a line (case, spacing, digits) fall
together under its normal form and are united by OR, in map-side partial aggregates first, so a
line on every page of a dominating source moves one word per 64 pages and partition. Cardinalities
are exact bit counts. A line occurrence is deleted if the bitmap of its line has enough bits and a
word for its document: occurrences look up (line, word), so no task holds all of a line's documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewrack.functions import urls
from tidewrack.session import store

#: Number ranges that the urls of one source are split into for numbering; one task numbers a range.
BUCKETS = 256


def normal_lines(text: Column) -> Column:
    """The lines of a text in normal form: runs of spaces, tabs and U+00A0 as one space, trimmed,
    lower case, each run of digits as 0."""
    t = F.regexp_replace(F.lower(F.regexp_replace(text, "[ \t ]+", " ")), "[0-9]+", "0")
    return F.split(F.regexp_replace(t, "(?m)^ | $", ""), "\n")


def number_documents(pages: DataFrame) -> DataFrame:
    """pages(source, url) to distinct (source, url, doc), doc counting from 0 within each source.
    Urls are numbered within hash ranges, and each range starts where the ranges before it end, so
    no task holds a whole source."""
    distinct = pages.select("source", "url").distinct().withColumn("bucket", F.pmod(F.xxhash64("url"), F.lit(BUCKETS)).cast("int"))
    numbered = distinct.withColumn("rank", F.row_number().over(Window.partitionBy("source", "bucket").orderBy("url")))
    sizes = distinct.groupBy("source", "bucket").agg(F.count(F.lit(1)).alias("size"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("source", "bucket", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    return numbered.join(offsets, ["source", "bucket"]).select("source", "url", (F.col("offset") + F.col("rank") - 1).alias("doc"))


def line_occurrences(fetches: DataFrame, id_col: str, url_col: str, text_col: str) -> DataFrame:
    """(id, line_no, l1, l2, word, bit) of each line that isn't empty; l1, l2 are two independent 64-bit
    hashes of the source and the line's normal form. Texts become hashes in the scan, before anything is
    shuffled, and a page's hashes travel as one array to where its document's number is."""
    base = fetches.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(text_col).alias("text")).where("url IS NOT NULL AND text IS NOT NULL")
    pages = base.select("id", "url", urls.site(F.col("url")).alias("source"), "text").where("source <> ''")
    hashed = F.transform(
        normal_lines(F.col("text")),
        lambda line: F.when(line != "", F.struct(F.xxhash64("source", line).alias("l1"), F.xxhash64(F.lit(7), F.reverse(line), "source").alias("l2"))),
    )
    # numbered over all urls, so that this pass reads no texts
    docs = number_documents(fetches.where(F.col(url_col).isNotNull()).select(F.col(url_col).alias("url")).select("url", urls.site(F.col("url")).alias("source")))
    placed = pages.select("id", "source", "url", hashed.alias("lines")).join(docs, ["source", "url"])
    # stored, as bitmaps, cardinalities and lookups start from it
    placed = store(placed.select("id", "doc", "lines"))
    lines = placed.select("id", F.shiftright("doc", 6).alias("word"), F.expr("shiftleft(1L, CAST(pmod(doc, 64) AS INT))").alias("bit"), F.posexplode("lines").alias("line_no", "line")).where("line IS NOT NULL")
    return lines.select("id", "line_no", "line.l1", "line.l2", "word", "bit")


def line_bitmaps(occurrences: DataFrame) -> DataFrame:
    """(l1, l2, word, bits): the compressed bitmap of each line's documents; the bitmaps of its variant
    spellings, which have one normal form, are united in it."""
    return occurrences.groupBy("l1", "l2", "word").agg(F.bit_or("bit").alias("bits"))


def repeated_occurrences(fetches: DataFrame, min_docs: int = 4, id_col: str = "fetch_id", url_col: str = "url", text_col: str = "parsed_data.text_content") -> DataFrame:
    """(id_col, line_no INT): line occurrences whose line is on at least min_docs
    different urls of the same source (host without www.).

    Repeated fetches of a url are one document, and all their lines come out. Rows with a null url
    or text, and urls without a host, have no cases; empty lines don't count; repeated rows give
    repeated occurrences; columns other than the three named aren't read.
    """
    occ = line_occurrences(fetches, id_col, url_col, text_col)
    keys = ["l1", "l2"]
    bitmaps = line_bitmaps(occ)
    frequent = bitmaps.groupBy(*keys).agg(F.sum(F.bit_count("bits")).alias("docs")).where(F.col("docs") >= min_docs).select(*keys)
    # the word is part of the key, so that a line on most pages is looked up by many tasks; the bit of
    # an occurrence is set in its word by construction
    found = occ.select("id", "line_no", *keys, "word").join(bitmaps.select(*keys, "word").join(frequent, keys, "left_semi"), [*keys, "word"], "left_semi")
    return found.select(F.col("id").alias(id_col), F.col("line_no").cast("int").alias("line_no"))


def without_repeated_lines(fetches: DataFrame, min_docs: int = 4, id_col: str = "fetch_id", url_col: str = "url", text_col: str = "parsed_data.text_content") -> DataFrame:
    """(id_col, text): each text without its repeated lines; null stays null. id_col is unique. What is
    kept are the slices between dropped lines, so the work is in proportion to the lines."""
    found = repeated_occurrences(fetches, min_docs, id_col, url_col, text_col).groupBy(id_col).agg(F.array_sort(F.collect_set("line_no")).alias("drop"))
    base = fetches.select(id_col, F.col(text_col).alias("text"))
    # split once a row: a lambda would do it again for each dropped line
    split = base.join(found, id_col, "left").withColumn("lines", F.split("text", "\n"))
    starts, ends = F.concat(F.array(F.lit(-1)), "drop"), F.concat("drop", F.array(F.size("lines")))
    kept = F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice("lines", a + 2, b - a - 1)))
    return split.select(id_col, F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"))
