"""Totals of a release: bytes, blocks, storage and the fingerprint of its sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.errors import IntegrityError
from quern.schema import ADDED, MODIFIED


def total_bytes(assets: DataFrame) -> DataFrame:
    return assets.agg(F.coalesce(F.sum("len"), F.lit(0)).alias("source_bytes"))


def changed_bytes(diff: DataFrame) -> DataFrame:
    return diff.agg(F.coalesce(F.sum(F.when(F.col("change").isin(ADDED, MODIFIED), F.col("source_len"))), F.lit(0)).alias("changed_source_bytes"))


def storage(segments: DataFrame, blocks: DataFrame) -> DataFrame:
    """One row (retained, referenced, stranded): bytes of segment files, of distinct stored blocks
    that the release refers to, and of stored blocks that it does not.

    segments: (segment_id, block_count, payload_len, file_len); blocks: (segment_id,
    segment_block_ordinal, stored_len), one for each reference.
    """
    distinct = blocks.groupBy("segment_id", "segment_block_ordinal").agg(F.min("stored_len").alias("stored_len"))
    return _sums(segments, distinct)


def _sums(segments: DataFrame, distinct: DataFrame, *more: Column) -> DataFrame:
    """One row of storage, for distinct stored blocks referred to, and of more aggregates of those."""
    referenced = distinct.agg(F.coalesce(F.sum("stored_len"), F.lit(0)).alias("referenced"), *more)
    held = segments.agg(F.coalesce(F.sum("file_len"), F.lit(0)).alias("retained"), F.coalesce(F.sum("payload_len"), F.lit(0)).alias("payload"))
    return held.crossJoin(referenced).withColumn("stranded", F.col("payload") - F.col("referenced")).select("retained", "referenced", "stranded", *referenced.columns[1:])


def _each(segments: DataFrame, blocks: DataFrame) -> DataFrame:
    """(segment_id, segment_block_ordinal, stored_len, fault) of the distinct stored blocks referred to. References
    are brought together once, and only then meet the segments."""
    each = blocks.groupBy("segment_id", "segment_block_ordinal").agg(F.min("stored_len").alias("stored_len"), F.max("stored_len").alias("__most"))
    joined = each.join(segments.groupBy("segment_id").agg(F.first("block_count").alias("__count")), "segment_id", "left")
    fault = (
        F.when(F.col("__count").isNull(), F.lit("missing segment"))
        .when(F.col("segment_block_ordinal") >= F.col("__count"), F.lit("missing block"))
        .when(F.col("stored_len") < F.col("__most"), F.lit("inconsistent length"))
    )
    return joined.select("segment_id", "segment_block_ordinal", "stored_len", fault.alias("fault"))


def storage_faults(segments: DataFrame, blocks: DataFrame) -> DataFrame:
    """(segment_id, segment_block_ordinal, fault) of references to no segment, to no block of one,
    and of blocks whose references disagree on their length."""
    return _each(segments, blocks).select("segment_id", "segment_block_ordinal", "fault").where("fault IS NOT NULL")


def checked_storage(segments: DataFrame, blocks: DataFrame) -> dict[str, int]:
    """storage as numbers, in one pass over the references; raises IntegrityError where it has faults or refers
    to more than is held."""
    row = _sums(segments, _each(segments, blocks), F.count("fault").alias("faults")).first().asDict()
    if row.pop("faults"):
        faults = storage_faults(segments, blocks).limit(3).collect()
        raise IntegrityError("; ".join(f"{r.fault}: {r.segment_id}/{r.segment_block_ordinal}" for r in faults))
    if row["stranded"] < 0:
        raise IntegrityError("blocks refer to more than the segments hold")
    return row


#: Characters of a path's digest by which assets are first grouped: 16 ** 8 groups.
FINGERPRINT_WIDTH = 8


def fingerprint(classified: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row (source_fingerprint): a digest of all paths, lengths, classes and chunk ids, in order.

    Each asset is digested on its own, from its chunks in order; then the assets' digests are
    folded by the digest of their path: each level takes two characters off, so that some 256 digests
    meet in a row, whatever the size of the release, once there are more levels than it needs.
    """
    listed = F.transform(F.array_sort(F.collect_list(F.struct("block_no", "chunk_id"))), lambda x: x["chunk_id"])
    ids = chunks.groupBy("path").agg(F.concat_ws(",", listed).alias("ids"))
    fields = ["path", "len", "layout", "access", "availability", "compression", "fixed_block_len"]
    own = F.sha2(F.concat_ws("|", *(F.col(c).cast("string") for c in fields), F.coalesce("ids", F.lit(""))), 256)
    level = classified.select(*fields).join(ids, "path", "left").select(F.sha2("path", 256).alias("at"), own.alias("digest"))
    for width in range(FINGERPRINT_WIDTH, -1, -2):
        folded = F.transform(F.array_sort(F.collect_list(F.struct("at", "digest"))), lambda x: x["digest"])
        level = level.groupBy(F.substring("at", 1, width).alias("part")).agg(F.sha2(F.concat_ws(",", folded), 256).alias("digest")).select(F.col("part").alias("at"), "digest")
    return level.select(F.col("digest").alias("source_fingerprint"))


def by_change(diff: DataFrame) -> DataFrame:
    return diff.groupBy("change").agg(F.count("*").alias("assets"))


def by_availability(segments: DataFrame) -> DataFrame:
    return segments.groupBy("availability").agg(F.count("*").alias("segments"), F.sum("file_len").alias("bytes"))


def amplification(backend: str, logical: str):
    """Bytes read for each byte asked for; 0 where none was asked for."""
    return F.when(F.sum(logical) > 0, F.sum(backend) / F.sum(logical)).otherwise(F.lit(0.0)).alias("amplification")
