"""Duplicate URLs and contents: the first in a stated order stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_by(df: DataFrame, key: Column, order: list[str], url_col: str = "url") -> DataFrame:
    """df with key, is_duplicate and original (url_col of the first row of the key).

    The first row of each key comes from a map-side minimum, so that a key with many rows moves one
    row per partition; rows then look their key up. Rows with a null key are never duplicates.
    """
    keyed = df.withColumn("key", key)
    at = F.struct(*order, F.col(url_col).alias("_url"))
    first = keyed.where("key IS NOT NULL").groupBy("key").agg(F.min(at).alias("_first"))
    joined = keyed.join(first, "key", "left")
    own = F.struct(*order, F.col(url_col).alias("_url"))
    return joined.withColumns({"is_duplicate": F.coalesce(own != F.col("_first"), F.lit(False)), "original": F.col("_first._url")}).drop("_first")


def crawl_gate(df: DataFrame, canonical: Column, order: list[str], url_col: str = "url") -> DataFrame:
    """first_by with the reason that a crawler logs."""
    d = first_by(df, canonical, order, url_col)
    reason = F.when(F.col("is_duplicate"), F.concat(F.lit("Duplicate of "), "original", F.lit(" (canonical: "), "key", F.lit(")"))).otherwise(F.lit("OK"))
    return d.withColumns({"should_crawl": ~F.col("is_duplicate"), "reason": reason})


def dedup_stats(df: DataFrame, canonical: Column, content_key: Column) -> DataFrame:
    """One row: URLs checked, unique and duplicate with their rate, and the same for contents; the
    content rate is over the unique count."""
    d = df.select(canonical.alias("c"), content_key.alias("h"))
    urls = d.where("c IS NOT NULL").groupBy("c").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("urls_checked"), F.count(F.lit(1)).alias("unique_urls"))
    texts = d.where("h IS NOT NULL").groupBy("h").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("contents_checked"), F.count(F.lit(1)).alias("unique_contents"))
    one = urls.withColumn("_k", F.lit(1)).join(texts.withColumn("_k", F.lit(1)), "_k").drop("_k")
    return one.withColumns({
        "duplicate_urls": F.col("urls_checked") - F.col("unique_urls"),
        "url_duplicate_rate": F.round((F.col("urls_checked") - F.col("unique_urls")) / F.greatest("urls_checked", F.lit(1)) * 100, 6),
        "duplicate_contents": F.col("contents_checked") - F.col("unique_contents"),
        "content_duplicate_rate": F.round((F.col("contents_checked") - F.col("unique_contents")) / F.greatest("unique_contents", F.lit(1)) * 100, 6),
    })


def _modulo(hex_digest: Column, m: int) -> Column:
    """A 128-bit number in hexadecimal modulo m (below 2**31), exactly: its parts are folded in, from the
    front, 28 bits at a time."""
    number = F.lit(0).cast("bigint")
    for at in range(1, 33, 7):
        part = F.substring(hex_digest, at, 7)
        bits = 4 * min(7, 33 - at)
        number = F.pmod(F.pmod(number * F.lit(2**bits % m), F.lit(m)) + F.conv(part, 16, 10).cast("bigint"), F.lit(m))
    return number


def bloom_positions(item: Column, capacity: int, bits_per_item: int = 10, hashes: int = 3, simple: bool = False) -> Column:
    """Bit positions of an item: md5 of the item and a seed, as a number modulo the size; of the simple
    filter a 64-bit hash in place of md5. A filter has
    less than 2**31 bits; more items go into filters of their own (bloom_filter's shards)."""
    m = capacity * bits_per_item
    if m >= 2**31:
        raise ValueError("a filter of more than 2**31 bits: use shards")
    if simple:
        return F.array(*(F.pmod(F.xxhash64(F.concat(item, F.lit(str(s)))), F.lit(m)) for s in range(hashes)))
    return F.array(*(_modulo(F.md5(F.concat(item, F.lit(str(s)))), m) for s in range(hashes)))


def shards(rows: int, capacity: int) -> int:
    """Filters that so many items need."""
    return max(1, -(-rows // capacity))


def _shard(item: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(item), F.lit(n)).cast("int") if n > 1 else F.lit(0)


def bloom_filter(df: DataFrame, item: Column, capacity: int, n_shards: int = 1, **kw: int) -> DataFrame:
    """(shard, word, bits): the filter as a bitset of 64-bit words, united by map-side OR. Items are dealt
    out to n_shards filters of `capacity` each by their hash, so the filter grows with what it holds."""
    p = df.select(_shard(item, n_shards).alias("shard"), F.explode(bloom_positions(item, capacity, **kw)).alias("p"))
    return p.groupBy("shard", F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(pmod(p, 64) AS INT))")).alias("bits"))


def bloom_contains(df: DataFrame, bloom: DataFrame, id_col: str, item: Column, capacity: int, n_shards: int = 1, **kw: int) -> DataFrame:
    """(id_col, maybe): may the filter hold the item? No false negatives. id_col is unique."""
    p = df.select(id_col, _shard(item, n_shards).alias("shard"), F.explode(bloom_positions(item, capacity, **kw)).alias("p")).withColumn("word", F.shiftright("p", 6))
    hit = F.coalesce(F.expr("(bits & shiftleft(1L, CAST(pmod(p, 64) AS INT))) <> 0"), F.lit(False))
    return p.join(bloom, ["shard", "word"], "left").groupBy(id_col).agg(F.bool_and(hit).alias("maybe"))


def keep_newest(seen: DataFrame, order: list[str], keep: int, limit: int) -> DataFrame:
    """seen as it is up to `limit` rows; beyond that the `keep` newest."""
    if seen.limit(limit + 1).count() <= limit:
        return seen
    return seen.orderBy(*(F.col(c).desc() for c in order)).limit(keep)
