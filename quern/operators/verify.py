"""Whether a release is what it says: constraint queries whose rows are the violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.errors import IntegrityError, ProjectMismatch, ReleaseRollback
from quern.functions.classify import encoded_len_valid
from quern.schema import FIXED, MIB, REQUIRED, SEGMENT_HEADER


def header_mismatches(headers: DataFrame, catalog: DataFrame, fields: tuple[str, ...] = ("availability", "block_count", "payload_len", "file_len")) -> DataFrame:
    """Segments (segment_id, field) whose own header and the catalog disagree; a missing header too."""
    joined = catalog.select("segment_id", F.struct(*fields).alias("c")).join(headers.select("segment_id", F.struct(*fields).alias("h")), "segment_id", "left")
    wrong = F.array_compact(F.array(*(F.when(~F.col(f"c.{f}").eqNullSafe(F.col(f"h.{f}")), F.lit(f)) for f in fields)))
    return joined.select("segment_id", F.explode(wrong).alias("field"))


def not_installed(segments: DataFrame, installed: DataFrame, availability: str | None = REQUIRED) -> DataFrame:
    """Segments, of one availability or (None) all, that are not installed."""
    wanted = segments if availability is None else segments.where(F.col("availability") == availability)
    return wanted.join(installed.select("segment_id").distinct(), "segment_id", "left_anti")


def unreferenced(files: DataFrame, active: DataFrame) -> DataFrame:
    """Files (name) named by 64 hex digits that the release does not refer to; all others stay."""
    named = files.where(F.col("name").rlike("^[0-9a-fA-F]{64}$"))
    ids = active.select(F.lower("segment_id").alias("__id")).distinct()
    return named.withColumn("__id", F.lower("name")).join(ids, "__id", "left_anti").drop("__id")


def block_mismatches(stored: DataFrame, contents: DataFrame) -> DataFrame:
    """Blocks (path, block_no) whose content, hashed again, is not what was recorded, or is missing."""
    again = contents.select("path", "block_no", F.sha2("content", 256).alias("now"))
    return stored.join(again, ["path", "block_no"], "left").where(~F.col("chunk_id").eqNullSafe(F.col("now"))).select("path", "block_no")


def segment_mismatches(segments: DataFrame, now: DataFrame) -> DataFrame:
    """Recorded segments (segment_id) that the content ids computed now do not include."""
    return segments.select("segment_id").join(now.select("segment_id").distinct(), "segment_id", "left_anti")


def repeated_blocks(data: DataFrame) -> DataFrame:
    """(segment_id, segment_block_ordinal) of blocks that are stored more than once."""
    return data.groupBy("segment_id", "segment_block_ordinal").agg(F.count("*").alias("n")).where("n > 1").drop("n")


def rebuilt_mismatches(assets: DataFrame, blocks: DataFrame, contents: DataFrame) -> DataFrame:
    """Assets (path) that the contents (path, block_no, content), laid end to end, do not give: blocks
    are missing or repeated, or the bytes are not as many as the asset has."""
    want = blocks.groupBy("path").agg(F.count("*").alias("want"))
    have = contents.groupBy("path").agg(F.count("*").alias("have"), F.count_distinct("block_no").alias("apart"), F.sum(F.octet_length("content").cast("bigint")).alias("bytes"))
    both = assets.select("path", "len").join(want, "path", "left").join(have, "path", "left")
    same = lambda a, b: F.coalesce(F.col(a), F.lit(0)) == F.coalesce(F.col(b), F.lit(0))
    return both.where(~(same("want", "have") & same("want", "apart") & same("len", "bytes"))).select("path")


def block_bounds(blocks: DataFrame, segments: DataFrame) -> DataFrame:
    """Blocks whose place lies outside of their segment."""
    joined = blocks.join(segments.select("segment_id", "block_count", "file_len"), "segment_id", "left")
    bad = F.col("block_count").isNull() | (F.col("segment_block_ordinal") >= F.col("block_count")) | (F.col("physical_offset") < SEGMENT_HEADER) | (F.col("physical_offset") + F.col("stored_len") > F.col("file_len"))
    return joined.where(bad).select("path", "block_no")


def catalog_violations(assets: DataFrame, blocks: DataFrame, segments: DataFrame) -> DataFrame:
    """(rule, violations) for each rule that ties the tables of a release together."""
    spans = assets.select("path", "len", "layout", "fixed_block_len", "block_count")
    per_asset = blocks.groupBy("path").agg(F.count("*").alias("n"), F.sum("plain_len").alias("bytes"))
    joined = spans.join(per_asset, "path", "left").select("*", F.coalesce("n", F.lit(0)).alias("have"), F.coalesce("bytes", F.lit(0)).alias("got"))
    w = W.partitionBy("path").orderBy("block_no")
    gaps = blocks.select("logical_offset", F.coalesce(F.lag(F.col("logical_offset") + F.col("plain_len")).over(w), F.lit(0)).alias("want"))
    rule = lambda name, df, bad: df.agg(F.lit(name).alias("rule"), F.count_if(bad).alias("violations"))
    parts = [
        rule("segment length is header and payload", segments, F.col("file_len") != F.col("payload_len") + SEGMENT_HEADER),
        rule("block span", joined, F.col("have") != F.col("block_count")),
        rule("blocks cover the asset", joined, F.col("got") != F.col("len")),
        rule("fixed block length", joined, F.when(F.col("layout") == FIXED, (F.col("len") > 0) & (F.col("fixed_block_len") <= 0)).otherwise(F.col("fixed_block_len") != 0)),
        rule("encoded length", blocks, ~encoded_len_valid(F.col("codec"), F.col("stored_len"), F.col("plain_len"))),
        rule("block length", blocks, (F.col("plain_len") <= 0) | (F.col("plain_len") > MIB)),
        rule("blocks are contiguous", gaps, F.col("logical_offset") != F.col("want")),
        rule("segments have ids of their own", segments.groupBy("segment_id").agg(F.count("*").alias("n")), F.col("n") > 1),
        rule("blocks have places of their own", blocks.groupBy("path", "block_no").agg(F.count("*").alias("n")), F.col("n") > 1),
        rule("stored blocks have one content", blocks.groupBy("segment_id", "segment_block_ordinal").agg(F.count_distinct("chunk_id", "codec", "plain_len", "physical_offset").alias("n")), F.col("n") > 1),
    ]
    return reduce(DataFrame.unionByName, parts)


def check_catalog(assets: DataFrame, blocks: DataFrame, segments: DataFrame) -> None:
    broken = catalog_violations(assets, blocks, segments).where("violations > 0").collect()
    if broken:
        raise IntegrityError("; ".join(f"{r.rule}: {r.violations}" for r in broken))


def acceptable(releases: DataFrame, at_least: int) -> DataFrame:
    return releases.where(F.col("release_sequence") >= at_least)


def rollbacks(offers: DataFrame, seen: DataFrame) -> DataFrame:
    """Offers (client, release_sequence) older than the newest release that the client has seen, with it as
    required; a client's first release is trusted."""
    newest = seen.groupBy("client").agg(F.max("release_sequence").alias("required"))
    return offers.join(newest, "client").where("release_sequence < required").select("client", "release_sequence", "required")


def check_rollback(sequence: int, at_least: int | None) -> None:
    """None trusts the first release seen."""
    if at_least is not None and sequence < at_least:
        raise ReleaseRollback(at_least, sequence)


def check_project(expected: str, found: str) -> None:
    if expected != found:
        raise ProjectMismatch(f"release is of project {found}, not {expected}")
