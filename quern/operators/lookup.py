"""Assets and bytes found in a release: point lookups, block lookups and range reads, in batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.codec import segment_file


def find_assets(assets: DataFrame, wanted: DataFrame) -> DataFrame:
    """The assets of the wanted paths."""
    return assets.join(wanted.select("path").distinct(), "path", "left_semi")


def absent(assets: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted paths that no asset has."""
    return wanted.select("path").distinct().join(assets, "path", "left_anti")


def block_of_offset(requests: DataFrame, assets: DataFrame) -> DataFrame:
    """For requests (request_id, path, offset) on fixed layouts: block_no = offset / block length.

    assets: (path, len, fixed_block_len); requests past the end, and other layouts, give no row.
    """
    a = assets.where("fixed_block_len > 0").select("path", "len", "fixed_block_len")
    return requests.join(a, "path").where("offset < len").withColumn("block_no", F.floor(F.col("offset") / F.col("fixed_block_len")))


def block_as_of(requests: DataFrame, blocks: DataFrame) -> DataFrame:
    """For requests (request_id, path, offset): the last block that begins at the offset or before.

    Blocks of a path are laid end to end, so the as-of match is the one block whose range holds the
    offset: an equi-join by path with a range condition, and no sort of either side's offsets.
    """
    b = blocks.select("path", "block_no", "logical_offset", "plain_len")
    at = (F.col("logical_offset") <= F.col("offset")) & (F.col("offset") < F.col("logical_offset") + F.col("plain_len"))
    return requests.join(b, "path").where(at)


def uncovered(requests: DataFrame, blocks: DataFrame) -> DataFrame:
    """Requests whose offset no block covers."""
    return requests.join(block_as_of(requests, blocks).select("request_id").distinct(), "request_id", "left_anti")


def range_blocks(requests: DataFrame, blocks: DataFrame) -> DataFrame:
    """For requests (request_id, path, offset, n): each block that overlaps [offset, offset + n) with
    the part of it that is wanted, from take_from, take_len bytes."""
    b = blocks.select("path", "block_no", "logical_offset", "plain_len")
    lo = F.greatest("offset", "logical_offset")
    hi = F.least(F.col("offset") + F.col("n"), F.col("logical_offset") + F.col("plain_len"))
    joined = requests.join(b, "path").where((F.col("logical_offset") < F.col("offset") + F.col("n")) & (F.col("offset") < F.col("logical_offset") + F.col("plain_len")))
    return joined.withColumn("take_from", lo - F.col("logical_offset")).withColumn("take_len", hi - lo)


def read_ranges(requests: DataFrame, assets: DataFrame, block_contents: DataFrame) -> DataFrame:
    """(request_id, status, data) for requests (request_id, path, offset, n), all in one job.

    status: "ok", "not_found" for an unknown path, "out_of_range" for an offset past the end. A
    range is cut at the end of the asset; an offset at its end gives no bytes. block_contents:
    blocks with their content.
    """
    known = requests.join(assets.select("path", F.col("len").alias("__len")), "path", "left")
    status = F.when(F.col("__len").isNull(), F.lit("not_found")).when(F.col("offset") > F.col("__len"), F.lit("out_of_range")).otherwise(F.lit("ok"))
    judged = known.select("request_id", "path", "offset", "n", status.alias("status"))
    parts = range_blocks(judged.where("status = 'ok'").drop("status"), block_contents).join(block_contents.select("path", "block_no", "content"), ["path", "block_no"])
    piece = F.substring("content", (F.col("take_from") + 1).cast("int"), F.col("take_len").cast("int"))
    listed = F.array_sort(F.collect_list(F.struct("block_no", piece.alias("piece"))))
    joined = F.aggregate(listed, F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["piece"]))
    data = parts.groupBy("request_id").agg(joined.alias("data"))
    got = judged.select("request_id", "status").join(data, "request_id", "left")
    return got.withColumn("data", F.when(F.col("status") == "ok", F.coalesce("data", F.lit(b"").cast("binary"))))


def prefetch_trace(requests: DataFrame, blocks: DataFrame, budget_bytes: int) -> DataFrame:
    """The accesses (session, seq, block, size, prefetch) by which ranges (request_id, path, offset, n,
    session) are read ahead: all their blocks in order, but those larger than the budget."""
    parts = range_blocks(requests, blocks).where(F.col("plain_len") <= budget_bytes)
    block = F.concat_ws(":", "path", F.col("block_no").cast("string"))
    return parts.select("session", F.struct("request_id", "block_no").alias("seq"), block.alias("block"), F.col("plain_len").alias("size"), F.lit(True).alias("prefetch"))


def slot_capacity(records):
    """Slots of an open-addressing index of so many records: a power of two, at most half of them taken."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.ceil(F.log2(F.greatest(records * 2, F.lit(1)).cast("double"))).cast("int"))


def segment_files(segments: DataFrame, files: DataFrame) -> DataFrame:
    """(segment_id, name, available) of segments: the file (name) that holds each, case apart, if there is one."""
    named = files.groupBy(F.lower("name").alias("__name")).agg(F.min("name").alias("name"))
    return segments.select("segment_id").join(named, segment_file(F.col("segment_id")) == F.col("__name"), "left").select("segment_id", "name", F.col("name").isNotNull().alias("available"))


def page_of(index: str, page: int) -> tuple:
    """(page number, slot) of a record's index."""
    return F.floor(F.col(index) / page).alias("page_id"), (F.col(index) % page).alias("slot")
