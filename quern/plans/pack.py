"""A release built from sources: classified, cut, deduplicated, encoded, packed and accounted for."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.errors import InvalidInput
from quern.functions.classify import segment_target, stored_len, with_classes
from quern.functions.paths import is_canonical
from quern.operators import dedup, segments, stats
from quern.operators.ordering import with_running
from quern.schema import MIB, RAW, Limits
from quern.session import written
from quern.sources import bodies

Progress = Callable[[str], None]


@dataclass(frozen=True)
class Options:
    limits: Limits = field(default_factory=Limits)
    deferred: Sequence[str] = ()
    segment_target: int | None = None
    zstd_level: int = 3
    #: Blocks are compressed only where they may be and it pays; without, all are stored raw.
    compress: bool = True
    #: Files whose stamp is that of the last build are not read again.
    development_cache: bool = False

    def check(self) -> None:
        if self.segment_target is not None and self.segment_target < MIB:
            raise InvalidInput("segment target is less than 1 MiB")
        if not -7 <= self.zstd_level <= 22:
            raise InvalidInput("compression level is not in -7..22")
        if any(not p or p.startswith("/") or p.endswith("/") or ".." in p.split("/") for p in self.deferred):
            raise InvalidInput("deferred prefix is not canonical")


@dataclass
class Release:
    """Tables of a release; blocks has one row for each reference. encoded has the new blocks as they are
    stored, before sealing: (segment_id, segment_block_ordinal, codec, plain_len, encoded)."""

    sequence: int
    assets: DataFrame
    blocks: DataFrame
    segments: DataFrame
    fingerprint: str
    encoded: DataFrame | None = None


def classified(sources: DataFrame, options: Options) -> DataFrame:
    return with_classes(sources, options.limits, options.deferred)


def bad_paths(sources: DataFrame) -> DataFrame:
    return sources.where(~is_canonical(F.col("path"))).select("path")


def _cut(assets: DataFrame, options: Options, cache: DataFrame | None, previous: Release | None) -> DataFrame:
    """The blocks of the assets; those of assets that the cache knows come from there."""
    known = None
    if cache is not None and previous is not None and "mtime" in assets.columns:
        known = dedup.unchanged_since(assets.select("path", "len", "mtime", "access", "compression"), cache, previous.blocks.select("chunk_id"))
        known = written(known)
    fresh = assets if known is None else assets.join(known, "path", "left_anti")
    blocks = bodies.cut(fresh, options.limits)
    if known is None:
        return blocks
    held = assets.join(known, "path", "left_semi").select("path", "access", "availability", "compression").join(cache.select("path", "chunks"), "path")
    held = held.select("path", "access", "availability", "compression", F.posexplode("chunks").alias("block_no", "chunk"))
    held = held.select("path", "access", "availability", "compression", F.col("block_no").cast("bigint").alias("block_no"), "chunk.logical_offset", "chunk.plain_len", "chunk.chunk_id")
    return blocks.unionByName(held)


def pack(sources: DataFrame, options: Options | None = None, previous: Release | None = None, progress: Progress | None = None, cache: DataFrame | None = None, build: str = "") -> tuple[Release, dict]:
    """The release of sources (path, content or file, len[, mtime]) and its report.

    With a previous release, blocks that it stores are reused, and if nothing that counts has
    changed, it is the result. The sequence goes on from it. cache: (path, len, mtime, access,
    compression, chunks) of the last build; assets that it knows are not read. build goes into the
    names of segments. Raises InvalidInput for bad paths.

    Bodies are read twice: to be cut and hashed, and, only those with new blocks, to be encoded.
    All joins and windows carry digests and lengths alone.
    """
    options = options or Options()
    options.check()
    say = progress or (lambda phase: None)
    say("scan")
    if bad := [r.path for r in bad_paths(sources).limit(3).collect()]:
        raise InvalidInput(f"paths are not canonical: {bad}")
    assets = classified(sources, options)
    say("chunk")
    blocks = written(_cut(assets, options, cache, previous))
    print_ = stats.fingerprint(assets, blocks).first()
    fingerprint = print_.source_fingerprint if print_ else ""
    source_bytes = stats.total_bytes(assets).first().source_bytes
    if previous is not None and previous.fingerprint == fingerprint:
        total = previous.blocks.count()
        held = stats.checked_storage(previous.segments, previous.blocks)
        return previous, _report(previous, False, source_bytes, total, 0, total, 0, held)
    say("deduplicate")
    released = None if previous is None else previous.blocks.withColumn("global_index", F.struct("path", "block_no"))
    marked = written(dedup.places(blocks, released))
    say("encode")
    new = marked.where("origin = 'new'")
    encoded = written(bodies.encode(new.select("path", "block_no", "logical_offset", "plain_len", "chunk_id", "compression"), sources, level=options.zstd_level, least_gain=options.limits.zstd_gain, compress=options.compress))
    sizes = encoded.select("path", "block_no", "codec", stored_len(F.octet_length("encoded")).alias("stored_len"))
    sized = new.select("path", "block_no", "availability", "access", "plain_len", "chunk_id", "early").join(sizes, ["path", "block_no"])
    # a block that stands apart from an earlier one that turns out to be raw is served by that one
    raw = sizes.where(F.col("codec") == RAW).select(F.struct("path", "block_no").alias("early"))
    moved = written(sized.join(raw, "early").select(F.struct("path", "block_no").alias("rep"), F.col("early").alias("to")))
    gone = moved.select("rep.*")
    say("pack")
    stored = sized.drop("early").join(gone, ["path", "block_no"], "left_anti")
    stored = written(stored.withColumn("target", segment_target(F.col("access"), options.limits, options.segment_target)))
    placed = written(segments.rotate(stored))
    sequence = (previous.sequence if previous else 0) + 1
    ids = written(segments.segment_ids(placed, stored, f"{build}|{sequence}"))
    table = segments.segment_table(placed).join(ids, [*segments.CLASS, "segment_no"]).drop("segment_no")
    place = ["codec", "stored_len", "segment_id", "segment_block_ordinal", "physical_offset"]
    at = placed.join(ids, [*segments.CLASS, "segment_no"]).select("path", "block_no", "segment_id", "segment_block_ordinal", "physical_offset")
    ours = written(stored.join(at, ["path", "block_no"]).select("path", "block_no", "plain_len", *place))
    serving = ours.select(F.struct("path", "block_no").alias("rep"), *place)
    if previous is not None:
        index = dedup.reuse_index(previous.blocks.select("chunk_id", "availability", *place, F.struct("path", "block_no").alias("global_index")))
        old = marked.where("origin = 'release'").select("rep", "chunk_id", "availability").join(index.select("chunk_id", "availability", *place), ["chunk_id", "availability"])
        serving = serving.unionByName(old.select("rep", *place))
    settled = marked.join(moved, "rep", "left").withColumn("rep", F.coalesce("to", "rep"))
    settled = settled.withColumn("is_new", (F.col("origin") == "new") & F.col("to").isNull())
    refs = settled.join(serving, "rep").select("path", "block_no", "logical_offset", "plain_len", "chunk_id", "availability", "access", *place, "is_new")
    refs = written(refs)
    new_segments = table.count()
    if previous is not None:
        kept = previous.segments.join(refs.select("segment_id").distinct(), "segment_id", "left_semi")
        table = segments.active(kept.select(*_SEGMENT), table.select(*_SEGMENT))
    table = written(table.select(*_SEGMENT))
    say("account")
    n = refs.groupBy("path").agg(F.count("*").alias("block_count"))
    counted = assets.drop("content", "file").join(n, "path", "left").withColumn("block_count", F.coalesce("block_count", F.lit(0).cast("bigint")))
    indexed = written(with_running(counted, ["path"], {"file_index": F.lit(1).cast("bigint"), "first_block": F.col("block_count")}))
    body = ours.select("path", "block_no", "segment_id", "segment_block_ordinal", "plain_len").join(encoded, ["path", "block_no"])
    release = Release(sequence, indexed, refs, table, fingerprint, body.select("segment_id", "segment_block_ordinal", "codec", "plain_len", "encoded"))
    total = refs.count()
    new_blocks = refs.where("is_new").count()
    return release, _report(release, True, source_bytes, total, new_blocks, total - new_blocks, new_segments, stats.checked_storage(table, refs))


def cache_entries(release: Release) -> DataFrame:
    """The build cache of a release: (path, len, mtime, access, compression, chunks) of its assets."""
    chunks = release.blocks.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("logical_offset", "plain_len", "chunk_id"))).alias("chunks"))
    none = F.array().cast("array<struct<logical_offset:bigint,plain_len:bigint,chunk_id:string>>")
    return release.assets.join(chunks, "path", "left").select("path", "len", "mtime", "access", "compression", F.coalesce("chunks", none).alias("chunks"))


_SEGMENT = ["segment_id", "availability", "access", "block_count", "payload_len", "file_len"]


def _report(release: Release, changed: bool, source_bytes: int, total: int, new: int, reused: int, new_segments: int, held: dict) -> dict:
    return {
        "changed": changed,
        "release_sequence": release.sequence,
        "source_bytes": source_bytes,
        "files": release.assets.count(),
        "total_blocks": total,
        "new_blocks": new,
        "reused_blocks": reused,
        "segments": release.segments.count(),
        "new_segments": new_segments,
        "source_fingerprint": release.fingerprint,
        **held,
    }
