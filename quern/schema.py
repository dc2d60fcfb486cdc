"""Schemas, enumerations and limits of releases."""

from __future__ import annotations

from dataclasses import dataclass

HOT, NORMAL, STREAMING, TRANSIENT = "hot", "normal", "streaming", "transient"
FIXED, CONTENT_DEFINED = "fixed", "content_defined"
AUTO, RAW = "auto", "raw"
ZSTD = "zstd"
REQUIRED, DEFERRED = "required", "deferred"
ADDED, MODIFIED, UNCHANGED, REMOVED = "Added", "Modified", "Unchanged", "Removed"

KIB, MIB = 1 << 10, 1 << 20
SEGMENT_HEADER = 4096
#: Bytes that sealing adds to a block.
SEAL = 16
MAP_PAGE, REUSE_PAGE = 341, 204

ASSETS = "path string, content binary, len bigint"
BLOCKS = "path string, block_no bigint, logical_offset bigint, plain_len bigint, chunk_id string"
SEGMENTS = "segment_id string, availability string, access string, block_count bigint, payload_len bigint, file_len bigint"
REQUESTS = "request_id bigint, path string, offset bigint, n bigint"


@dataclass(frozen=True)
class Limits:
    """Sizes in bytes that decide an asset's class, its blocks and its segments."""

    hot_file: int = 32 * KIB
    short_audio: int = MIB
    content_defined: int = 64 * MIB
    stream_block: int = 256 * KIB
    bulk_block: int = MIB
    chunk_min: int = 32 * KIB
    chunk_avg: int = 128 * KIB
    chunk_max: int = 512 * KIB
    zstd_gain: int = 64
    hot_segment: int = 64 * MIB
    normal_segment: int = 256 * MIB
    transient_segment: int = 128 * MIB
    segment: int = 512 * MIB


#: For the driver's tables, whose texts are too small for the true limits.
SMALL = Limits(hot_file=2 * KIB, short_audio=4 * KIB, content_defined=16 * KIB, stream_block=KIB, bulk_block=2 * KIB, chunk_min=256, chunk_avg=KIB, chunk_max=4 * KIB, hot_segment=30_000, normal_segment=30_000, transient_segment=30_000, segment=30_000)
