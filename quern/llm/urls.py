"""URL filter: a blocked Bloom filter of listed canonical URLs, then an exact hash join.

The filter is a table of 256-bit blocks (eight words of 32 bits; each URL sets one bit in each
word of one block, as in Parquet's split-block filters), so that building it is an aggregation
and probing it a join on the block's number. Only URLs whose eight bits are all set reach the
join with the list itself, which decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import free_name, prepare, quoted, written

WORDS = 8
SALTS = (0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31)
#: Bits of the filter for each listed URL; 16 let about one unlisted URL in 1,000 pass.
BITS_PER_URL = 16
#: A filter of more blocks than this (about 40 bytes each) is probed by shuffle, not broadcast.
BROADCAST_BLOCKS = 1_000_000
#: A list of more URLs than this is joined by shuffle, and only with the pages that the filter lets pass.
BROADCAST_URLS = 500_000

PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*)://)?(?:[^/@?#]*@)?([^/:?#]*)(?::([0-9]*))?([^?#]*)(?:[?]([^#]*))?"
#: Parameters that only track where a visitor comes from.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)"


def canonical_url(url: Column) -> Column:
    """host/path?query: without scheme, user, a leading www., default port, index page, closing
    slash, fragment and tracking parameters; host in lower case, parameters sorted. Null for a
    null URL and for one without a host."""
    trimmed = F.trim(url)
    part = lambda i: F.regexp_extract(trimmed, PARTS, i)
    host = F.regexp_replace(F.lower(part(2)), r"^www[.]", "")
    port = F.when(part(3).isin("", "80", "443"), F.lit("")).otherwise(F.concat(F.lit(":"), part(3)))
    path = F.regexp_replace(F.regexp_replace(part(4), r"/index[.]html?$", "/"), r"/+$", "")
    kept = F.sort_array(F.filter(F.split(part(5), "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))
    return F.when(host != "", F.concat(host, port, path, query))


def _bits(hashed: Column) -> list[Column]:
    """One bit for each word of the block, as Parquet's filters choose it; 31 bits keep the products in range."""
    low = hashed.bitwiseAND(F.lit(0x7FFFFFFF))
    places = [F.shiftrightunsigned((low * F.lit(s)).bitwiseAND(F.lit(0xFFFFFFFF)), 27).cast("int") for s in SALTS]
    return [F.call_function("shiftleft", F.lit(1), p) for p in places]


def _block(hashed: Column, n_blocks: int) -> Column:
    return F.pmod(F.shiftrightunsigned(hashed, 32), F.lit(n_blocks))


def bloom_blocks(urls: DataFrame, n_blocks: int) -> DataFrame:
    """The filter's blocks that aren't empty: rows (block, w0 .. w7) for rows (canonical)."""
    hashed = urls.select(F.xxhash64("canonical").alias("h")).select(_block(F.col("h"), n_blocks).alias("block"), *(b.alias(f"w{i}") for i, b in enumerate(_bits(F.col("h")))))
    return hashed.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)))


def filter_urls(pages: DataFrame, listed: DataFrame, *, url_col: str = "url", listed_col: str = "url", bits_per_url: int = BITS_PER_URL, most_broadcast: int = BROADCAST_URLS) -> DataFrame:
    """pages with canonical_url and listed, true where the canonical URL is on the list.

    All rows and columns stay, repeated rows each; the two new ones get underscores if pages has
    such columns. A null URL, or one without a host, has a null canonical URL and is not listed;
    URLs of any length are compared whole; repeated listed URLs do not matter; an empty list lists
    nothing, and an empty table gives an empty one.
    """
    spark = pages.sparkSession
    prepare(spark)
    canonical, flag = free_name(pages.columns, "canonical_url"), free_name(pages.columns, "listed")
    hashed, maybe, key = (free_name(pages.columns, x) for x in ("__h", "__maybe", "__key"))
    on_list = listed.select(canonical_url(quoted(listed_col)).alias("canonical")).where(F.col("canonical").isNotNull()).distinct()
    on_list = written(on_list)
    n_listed = on_list.count()
    few = n_listed <= most_broadcast
    n_blocks = max(1, -(-n_listed * bits_per_url // (32 * WORDS)))
    blocks = bloom_blocks(on_list, n_blocks).withColumnRenamed("block", key)
    if n_blocks <= BROADCAST_BLOCKS:
        blocks = F.broadcast(blocks)
    page = pages.withColumn(canonical, canonical_url(quoted(url_col))).withColumn(hashed, F.xxhash64(quoted(canonical)))
    words = [free_name(pages.columns, f"__w{i}") for i in range(WORDS)]
    for i, w in enumerate(words):
        blocks = blocks.withColumnRenamed(f"w{i}", w)
    at = page.withColumn(maybe, _block(quoted(hashed), n_blocks))
    probed = at.join(blocks, quoted(maybe) == quoted(key), "left")
    hit = quoted(canonical).isNotNull()
    for w, bit in zip(words, _bits(quoted(hashed))):
        hit = hit & (F.coalesce(quoted(w), F.lit(0)).bitwiseAND(bit) != 0)
    columns = [*map(quoted, pages.columns), quoted(canonical)]
    probed = probed.select(*columns, hit.alias(maybe))
    key_of = F.when(quoted(maybe), quoted(canonical))
    if few:
        exact = F.broadcast(on_list.select(F.col("canonical").alias(key)))
        return probed.join(exact, key_of == quoted(key), "left").select(*columns, quoted(key).isNotNull().alias(flag))
    # the rows that the filter rules out are not shuffled
    passed = probed.where(~quoted(maybe)).select(*columns, F.lit(False).alias(flag))
    exact = on_list.select(F.col("canonical").alias(key)).hint("shuffle_hash")
    decided = probed.where(quoted(maybe)).join(exact, quoted(canonical) == quoted(key), "left").select(*columns, quoted(key).isNotNull().alias(flag))
    return passed.unionByName(decided)
