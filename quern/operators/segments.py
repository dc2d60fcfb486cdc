"""Stored blocks packed into bounded segments of one class each."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.schema import SEGMENT_HEADER
from quern.session import ensure_workers_import

CLASS = ("availability", "access")


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Where segments open is found by leaps: the block that outgrows the open segment is sought in the
    running total of the batch, so that work is in proportion to segments, not blocks."""
    klass, segment, payload, count = None, 0, 0, 0
    for pdf in batches:
        n = len(pdf)
        stored, target = pdf["stored_len"].to_numpy(np.int64), pdf["target"].to_numpy(np.int64)
        total = np.concatenate(([0], np.cumsum(stored)))
        names = (pdf["availability"] + "/" + pdf["access"]).to_numpy()
        ends = [*(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), n]
        numbers, ordinals, offsets = (np.empty(n, dtype=np.int64) for _ in range(3))
        at = 0
        while at < n:
            end = ends[bisect_right(ends, at)]
            if names[at] != klass:
                klass, segment, payload, count = names[at], 0, 0, 0
            # the first block from here on that the open segment has no room for
            stop = min(end, int(np.searchsorted(total, total[at] + target[at] - payload, side="right")) - 1)
            if stop <= at and count:
                segment, payload, count = segment + 1, 0, 0
                continue
            stop = max(stop, at + 1)
            numbers[at:stop] = segment
            ordinals[at:stop] = count + np.arange(stop - at)
            offsets[at:stop] = SEGMENT_HEADER + payload + total[at:stop] - total[at]
            payload, count, at = payload + int(total[stop] - total[at]), count + stop - at, stop
        yield pdf.drop(columns="target").assign(segment_no=numbers, segment_block_ordinal=ordinals, physical_offset=offsets)


def rotate(blocks: DataFrame) -> DataFrame:
    """blocks (path, block_no, stored_len, target, availability, access) with segment_no in their
    class, segment_block_ordinal and physical_offset.

    In the order (path, block_no) a block opens a new segment if the open one is not empty and
    would outgrow the target, which is one for a class; a block larger than the target sits alone.
    State resets at each opening, so each class is folded in order, in batches, by one task; rows
    carry no content, and a batch takes a few array operations for each segment in it.
    """
    ensure_workers_import(blocks.sparkSession)
    narrow = blocks.select("path", "block_no", *CLASS, "stored_len", "target")
    ordered = narrow.repartition(*CLASS).sortWithinPartitions(*CLASS, "path", "block_no")
    return ordered.mapInPandas(_fold, "path string, block_no bigint, availability string, access string, stored_len bigint, segment_no bigint, segment_block_ordinal bigint, physical_offset bigint")


def segment_table(placed: DataFrame) -> DataFrame:
    """Segments (availability, access, segment_no, block_count, payload_len, file_len) of placed blocks."""
    sums = placed.groupBy(*CLASS, "segment_no").agg(F.count("*").alias("block_count"), F.sum("stored_len").alias("payload_len"))
    return sums.withColumn("file_len", F.col("payload_len") + SEGMENT_HEADER)


def segment_ids(placed: DataFrame, chunk_ids: DataFrame, build: str = "") -> DataFrame:
    """(availability, access, segment_no, segment_id): the digest of the build's name, of the segment's
    class and number and of its chunk ids in order, so that no two segments of any builds share an id."""
    joined = placed.join(chunk_ids.select("path", "block_no", "chunk_id"), ["path", "block_no"])
    listed = F.array_sort(F.collect_list(F.struct("segment_block_ordinal", "chunk_id")))
    return joined.groupBy(*CLASS, "segment_no").agg(F.concat_ws(",", F.transform(listed, lambda x: x["chunk_id"])).alias("ids")).select(
        *CLASS, "segment_no", F.sha2(F.concat_ws("|", F.lit(build), *CLASS, F.col("segment_no").cast("string"), "ids"), 256).alias("segment_id")
    )


def offsets_in_segment(blocks: DataFrame, key: str = "segment_id") -> DataFrame:
    """blocks (key, path, block_no, stored_len) with segment_block_ordinal and physical_offset in segments given."""
    w = W.partitionBy(key).orderBy("path", "block_no")
    before = F.sum("stored_len").over(w.rowsBetween(W.unboundedPreceding, -1))
    return blocks.withColumn("segment_block_ordinal", F.row_number().over(w) - 1).withColumn("physical_offset", F.lit(SEGMENT_HEADER) + F.coalesce(before, F.lit(0)))


def ordinals(segments: DataFrame) -> DataFrame:
    """(segment_id, ordinal) by ascending id. A release has a bounded number of segments, one row each."""
    return segments.select("segment_id").distinct().withColumn("ordinal", F.row_number().over(W.orderBy("segment_id")) - 1)


def first_open(segments: DataFrame) -> DataFrame:
    """For each class the open segment of least number."""
    return segments.groupBy(*CLASS).agg(F.min("segment_no").alias("segment_no"))


def active(used_existing: DataFrame, new: DataFrame) -> DataFrame:
    """Segments of the release: those of the one before that still serve it, and the new ones."""
    return used_existing.unionByName(new).distinct()
