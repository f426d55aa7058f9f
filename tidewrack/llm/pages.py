"""One pass over the pages for all operators that look at them: markup is parsed once a page, and what
the operators go on from is stored."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidewrack.functions import urls
from tidewrack.llm import main_content, spam, templates
from tidewrack.llm.pagetree import mend_lines, read_page
from tidewrack.llm.signs import word_rows
from tidewrack.session import spread

#: Parts of a page: lines of its body, its lines, title and slots as a record, its features.
BODY, TEMPLATE, SPAM = 1, 2, 4
SOURCE = ["id", "url", "title", "html", "text"]


def read_pages(fetches: DataFrame, common_words: DataFrame, id_col: str = "fetch_id", parts: int = BODY | TEMPLATE | SPAM) -> DataFrame:
    """(id, has_content, has_html, has_text, and the columns of the parts): one row per fetch with content
    or text. With TEMPLATE `address` is a number that spellings of an address have in common, and `page` one that
    copies of an article have, else the address.

    fetches needs id_col, url, content, parsed_data (title, html, text_content); nulls count as empty.
    Each page is parsed once, without a shuffle. To use several operators on one corpus store the result
    and give it to main_lines_of(), residue_of() and stuffed_of().
    """
    lists = spam.word_lists(word_rows(common_words))
    fields = [T.StructField("body", T.ArrayType(T.IntegerType()))] * bool(parts & BODY) + list(templates.RECORD) * bool(parts & TEMPLATE) + list(spam.FEATURES) * bool(parts & SPAM)
    kept = [F.col("_id").alias("id"), "url", "title", "html", "text", "has_content", "has_html", "has_text"]
    source = fetches.select(
        F.col(id_col).alias("_id"), F.coalesce("url", F.lit("")).alias("url"), F.col("parsed_data.title").alias("title"), F.col("parsed_data.html").alias("html"), F.col("parsed_data.text_content").alias("text"),
        F.col("content").isNotNull().alias("has_content"), F.col("parsed_data.html").isNotNull().alias("has_html"), F.col("parsed_data.text_content").isNotNull().alias("has_text"),
    ).where("has_content OR has_text").select(*kept)
    told = [f for f in source.schema if f.name in ("id", "url") or f.name.startswith("has_")]
    schema = T.StructType([*told, *fields])
    kinds = [to_arrow_type(f.dataType) for f in fields]

    def one(url: str, title: str, html: str, text: str) -> tuple:
        page = mend_lines(read_page(html, text))
        out: tuple = ()
        if parts & BODY:
            out += (main_content.main_lines(page),)
        if parts & TEMPLATE:
            site, name, named, fits, empty, lines, article, slots = templates.read_record(url, title, page, lists[""])
            out += (site, name, named, fits, empty, [dict(zip(("template", "named", "own"), x)) for x in lines], article, [dict(zip(("key", "words", "share"), x)) for x in slots])
        if parts & SPAM:
            out += spam.features(page, html, lists) or (None,) * len(spam.FEATURES)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [one(*(b.column(k)[i].as_py() or "" for k in (1, 2, 3, 4))) for i in range(b.num_rows)]
            columns = zip(*rows) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(b.column(k) for k in (5, 6, 7)), *(pa.array(c, k) for c, k in zip(columns, kinds))], schema.names)

    read = spread(source).mapInArrow(run, schema)
    if parts & TEMPLATE:
        read = read.withColumn("address", F.xxhash64(F.regexp_replace(urls.canonical("url"), "^https?:", "")))
        read = read.withColumn("page", F.coalesce("article", "address"))
    return read.drop("url")
