"""Sinks: page contents, metadata, DOM trees and reports, and the statistics of what is stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.functions import urls

#: File of each kind of content in its page's folder.
FILES = {"html": "html.html", "json": "json.json", "screenshot": "screenshot.png", "dom_trees": "dom_trees.json"}


def page_folder(url: Column | str, base: str = "crawl_data") -> Column:
    return F.concat_ws("/", F.lit(base), urls.clean_domain(url), urls.url_hash(url))


def file_path(url: Column | str, kind: str, suffix: Column | None = None, base: str = "crawl_data", compress: bool = False) -> Column:
    """Where a page's content of a kind is kept; style sheets and component shots in subfolders."""
    gz = ".gz" if compress else ""
    if kind == "css":
        name = F.concat(F.lit("css/"), F.coalesce(suffix, F.lit("styles")) if suffix is not None else F.lit("styles"), F.lit(".css" + gz))
    elif kind == "component_screenshots":
        name = F.concat(F.lit("component_screenshots/"), suffix if suffix is not None else F.lit("component"), F.lit(".webp" if compress else ".png"))
    else:
        name = F.lit(FILES.get(kind, f"{kind}.txt").replace(".png", ".webp") if compress and kind == "screenshot" else FILES.get(kind, f"{kind}.txt") + (gz if kind != "screenshot" else ""))
    return F.concat(page_folder(url, base), F.lit("/"), name)


def page_metadata(pages: DataFrame, crawled_at: Column) -> DataFrame:
    """(url, path, metadata): the JSON that lies beside each page."""
    meta = F.struct(F.col("url"), urls.url_hash("url").alias("url_hash"), urls.clean_domain("url").alias("domain"), F.date_format(crawled_at, "yyyy-MM-dd'T'HH:mm:ss").alias("crawled_at"))
    return pages.select("url", F.concat(page_folder("url"), F.lit("/metadata.json")).alias("path"), F.to_json(meta).alias("metadata"))


def save_pages(pages: DataFrame, out: str, compress: bool = False) -> None:
    """Contents as text tables split by kind and domain: rows (kind, url, content). A dominating
    domain is spread over files by a hash of the url."""
    d = pages.withColumns({"domain": urls.clean_domain("url"), "page": urls.url_hash("url")})
    d = d.repartition("kind", "domain", F.pmod(F.xxhash64("url"), F.lit(32)))
    d.write.mode("append").option("compression", "gzip" if compress else "none").partitionBy("kind", "domain").json(out)


def to_webp(shots: DataFrame, quality: int = 85) -> DataFrame:
    """shots(url, image, ...) with PNG bytes as WebP where the imaging library is installed, else as
    they are; format tells which. Bytes that are no image stay."""

    def run(batches):
        try:
            import io

            from PIL import Image
        except ImportError:
            Image = None
        for b in batches:
            out, kinds = [], []
            for raw in b["image"]:
                data, kind = raw, "png"
                if Image is not None and raw is not None:
                    try:
                        to = io.BytesIO()
                        Image.open(io.BytesIO(raw)).save(to, "WEBP", quality=quality)
                        data, kind = to.getvalue(), "webp"
                    except OSError:
                        pass
                out.append(data)
                kinds.append(kind)
            yield b.assign(image=out, format=kinds)

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in shots.schema)
    return shots.mapInPandas(run, names + ", format string")


def save_json(df: DataFrame, out: str) -> None:
    df.write.mode("overwrite").json(out)


def storage_stats(spark: SparkSession, out: str) -> DataFrame:
    """(kind, files, mb): number and size of the files of each kind below out."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json*").load(out).select("path", "length")
    kind = F.regexp_extract("path", r"/kind=([^/]+)/", 1)
    return f.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("files"), F.round(F.sum("length") / 1048576, 2).alias("mb"))
