"""Equal blocks stored once: within a release, and against the one before it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions.classify import accepts
from quern.schema import RAW

#: Blocks are equal in a release if these are; across releases the access class does not count.
WITHIN = ("chunk_id", "availability", "access", "plain_len")
ACROSS = ("chunk_id", "availability")
_INDEX = ("__len", "__codec", "__segment")


def _settled(blocks: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """blocks with rep, the place (path, block_no) of the block that serves each of them, early, where
    that one only stands apart because its policy takes nothing but raw blocks, and origin.

    In processing order (path, block_no) the first of a kind serves the later ones. One whose policy
    takes raw blocks only cannot be served by a block that may be compressed: the first such one is
    then stored again, raw, and serves all from there on. The codec of the first block is that of the
    released block that serves it, else that of the column codec, where there is one; where it is not
    known, it is taken for compressed.
    """
    at = F.struct("path", "block_no")
    policy = F.col("compression") if "compression" in blocks.columns else F.lit("auto")
    own = F.col("codec") if "codec" in blocks.columns else F.lit(None).cast("string")
    kinds = blocks.groupBy(*WITHIN).agg(F.min(at).alias("__first"), F.min(F.when(policy == RAW, at)).alias("__raw"), F.min_by(policy, at).alias("__policy"), F.min_by(own, at).alias("__own"))
    if index is None:
        served, codec = F.lit(False), F.col("__own")
    else:
        kinds = kinds.join(index.select(*ACROSS, *_INDEX), list(ACROSS), "left")
        served = F.coalesce(F.col("__segment").isNotNull() & (F.col("__len") == F.col("plain_len")) & accepts(F.col("__policy"), F.col("__codec")), F.lit(False))
        codec = F.when(served, F.col("__codec")).otherwise(F.col("__own"))
    apart = F.col("__raw").isNotNull() & (F.col("__raw") != F.col("__first")) & ~codec.eqNullSafe(F.lit(RAW))
    kinds = kinds.select(*WITHIN, "__first", F.when(apart, F.col("__raw")).alias("__again"), served.alias("__served"), *([F.col("__segment")] if index is not None else []))
    late = F.col("__again").isNotNull() & (at >= F.col("__again"))
    rep = F.when(late, F.col("__again")).otherwise(F.col("__first"))
    joined = blocks.join(kinds, list(WITHIN)).withColumn("rep", rep).withColumn("early", F.when(late, F.col("__first")))
    return joined.withColumn("origin", F.when(at != F.col("rep"), F.lit("self")).when(F.col("__served") & ~late, F.lit("release")).otherwise(F.lit("new"))).drop("__first", "__again", "__served")


def first_in_release(blocks: DataFrame) -> DataFrame:
    """blocks with is_first: whether a block is stored, or served by an earlier one (see reuse)."""
    return _settled(blocks).withColumn("is_first", F.col("origin") == "new").drop("rep", "early", "origin")


def reuse_index(released: DataFrame) -> DataFrame:
    """Released blocks (chunk_id, availability, plain_len, codec, segment_id, global_index, ...), the
    first by global_index of each (chunk_id, availability)."""
    rest = [c for c in released.columns if c not in ACROSS]
    best = released.groupBy(*ACROSS).agg(F.min_by(F.struct(*rest), "global_index").alias("__best"))
    return best.select(*ACROSS, "__best.*")


def places(blocks: DataFrame, released: DataFrame | None = None) -> DataFrame:
    """blocks with rep, early, origin and, where released blocks are given, reused_segment_id; see reuse.

    rep is the place (path, block_no) of the block that serves the row; early that of the block that
    would serve rep too, should it turn out to be raw.
    """
    if released is None:
        return _settled(blocks).withColumn("reused_segment_id", F.lit(None).cast("string"))
    index = reuse_index(released).select(*ACROSS, F.col("plain_len").alias("__len"), F.col("codec").alias("__codec"), F.col("segment_id").alias("__segment"))
    ours = _settled(blocks, index)
    return ours.withColumn("reused_segment_id", F.when(F.col("origin") == "release", F.col("__segment"))).drop("__segment")


def reuse(blocks: DataFrame, released: DataFrame) -> DataFrame:
    """blocks with origin: "release" for one that the released blocks serve, "self" for a repeat of
    an earlier one of this release, "new" otherwise; and reused_segment_id, for the first.

    A repeat within the release is recognised first, by (chunk, availability, access); the first
    of its kind may then come from the released blocks by (chunk, availability) alone, if their
    length is equal. Either way the codec policy must accept the codec of the block that serves.
    """
    return places(blocks, released).drop("rep", "early")


def counts(blocks: DataFrame) -> DataFrame:
    """One row (total_blocks, new_blocks, reused_blocks) for blocks with is_first or origin."""
    new = F.col("origin") == "new" if "origin" in blocks.columns else F.col("is_first")
    return blocks.agg(F.count("*").alias("total_blocks"), F.count_if(new).alias("new_blocks"), F.count_if(~new).alias("reused_blocks"))


def repeated(df: DataFrame, name: str) -> DataFrame:
    """Values of a column that occur more than once, with their count."""
    return df.groupBy(name).agg(F.count("*").alias("n")).where("n > 1")


def unchanged_since(sources: DataFrame, cache: DataFrame, stored: DataFrame) -> DataFrame:
    """Sources (path, len, mtime, access, compression) whose cached chunks can stand for their bodies.

    cache: (path, len, mtime, access, compression, chunks array of (logical_offset, plain_len,
    chunk_id)); stored: (chunk_id) of the release. Path, stamp and class must be equal, the chunks
    contiguous from 0 to the length, and each one stored.
    """
    stamp = ("len", "mtime", "access", "compression")
    c = cache.alias("c")
    s = sources.alias("s")
    same = s.join(c, (F.col("s.path") == F.col("c.path")) & F.expr(" AND ".join(f"s.{x} <=> c.{x}" for x in stamp))).select("s.path", "s.len", "c.chunks")
    each = same.select("path", "len", F.posexplode_outer("chunks").alias("i", "chunk")).select("path", "len", "i", "chunk.*")
    w = W.partitionBy("path").orderBy("i")
    joined = each.withColumn("start", F.coalesce(F.lag(F.col("logical_offset") + F.col("plain_len")).over(w), F.lit(0)))
    known = joined.join(stored.select("chunk_id", F.lit(True).alias("known")).distinct(), "chunk_id", "left")
    ok = known.groupBy("path", "len").agg(
        F.bool_and(F.coalesce((F.col("start") == F.col("logical_offset")) & F.col("known"), F.col("i").isNull())).alias("ok"),
        F.coalesce(F.sum("plain_len"), F.lit(0)).alias("total"),
    )
    return ok.where("ok AND total = len").select("path")
