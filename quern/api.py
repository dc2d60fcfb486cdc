"""From a folder of files to a committed release and back.

    output/release_sequence=N/...      tables of each release (see quern.sources.store)
    output/data/segment_id=ID/         the stored blocks of a segment: segment_block_ordinal, content
    output/CURRENT                     the release in force
    output/build-cache                 what a build with the development cache knows of the files

Blocks are stored compressed where that pays, and either sealed, under a key for each segment, or
followed by a digest. A build writes its data into a staged folder, compares it with the sources,
and moves it in place just before the release is put in force.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.errors import IntegrityError, InvalidInput, SegmentUnavailable
from quern.functions import codec as C
from quern.operators import verify
from quern.plans import diff as D
from quern.plans.pack import Options, Release, cache_entries, classified, pack
from quern.schema import RAW
from quern.session import ensure_checkpoint_dir, written
from quern.sources import bodies, files, store
from quern.sources.identity import Publisher, ReaderKeys

DATA = "segment_id string, segment_block_ordinal bigint, content binary"
Keys = Publisher | ReaderKeys


def check_places(source: str, output: str, identity_file: str | None = None) -> None:
    """Raises InvalidInput if the sources are no folder, or the output or the identity lies in it."""
    if not os.path.isdir(source):
        raise InvalidInput(f"input is not a directory: {source}")
    base = os.path.realpath(source)
    inside = lambda at: os.path.commonpath([base, os.path.realpath(at)]) == base
    if inside(output):
        raise InvalidInput(f"output directory must be outside of the input: {output}")
    if identity_file is not None and inside(identity_file):
        raise InvalidInput(f"identity must be outside of the input: {identity_file}")


def _ids(segments: DataFrame) -> list[str]:
    return [r.segment_id for r in segments.select("segment_id").distinct().toLocalIterator()]


def _stored(encoded: DataFrame, keys: Keys | None) -> DataFrame:
    """Encoded blocks (segment_id, segment_block_ordinal, codec, plain_len, encoded) as they are stored."""
    if keys is None:
        content = C.checked(F.col("encoded"))
    else:
        table = keys.schedule().table(encoded.sparkSession, _ids(encoded))
        encoded = encoded.join(F.broadcast(table), "segment_id")
        content = C.seal(F.col("encoded"), F.col("key"), C.nonce(C.nonce_prefix(F.col("segment_id")), F.col("segment_block_ordinal")), _context())
    return encoded.select("segment_id", "segment_block_ordinal", content.alias("content"))


def _context():
    return C.block_context(F.col("segment_id"), F.col("segment_block_ordinal"), F.col("codec"), F.col("plain_len"))


def pack_directory(
    spark: SparkSession,
    source: str,
    output: str,
    project: str = "project",
    options: Options | None = None,
    incremental: bool = True,
    progress: Callable[[str], None] | None = None,
    identity: Publisher | None = None,
) -> dict:
    """Builds and commits a release of the files below source; returns the report.

    One build at a time; what an interrupted one left is cleared first. The release is written and
    compared with the sources before it is put in force, then data that it no longer refers to goes.
    Without incremental, nothing is reused, but the sequence still goes on. With an identity, blocks
    are sealed, the release is signed, and the project is the identity's.
    """
    ensure_checkpoint_dir(spark)
    options = options or Options()
    options.check()
    if options.development_cache and not incremental:
        raise InvalidInput("a full build reads all sources: no development cache")
    check_places(source, output)
    project = identity.project if identity else project
    os.makedirs(output, exist_ok=True)
    say = progress or (lambda phase: None)
    with store.locked(output):
        store.recover(output)
        sources = files.listed(spark, source)
        files.check_sources(source, sources)
        stamps = written(sources.select("path", "file", "len", "mtime"))
        last = store.current(output)
        old = store.open_release(spark, output, project, keys=identity) if last is not None else None
        clear_data(output, old.segments if old else None)
        if old is not None and old.sealed != (identity is not None):
            incremental = False  # blocks of the other kind cannot be reused
        previous = old if incremental else None
        cache = store.load_cache(spark, output, project, last) if options.development_cache and previous is not None else None
        build = uuid.uuid4().hex
        release, report = pack(stamps, options, previous, progress, cache, build)
        if not report["changed"]:
            if options.development_cache and cache is None:
                _save_cache(release, stamps, output, project)
            return report
        if last is not None and previous is None:
            release.sequence = report["release_sequence"] = last + 1
        say("write")
        staged = os.path.join(output, f"staged-{build}")
        _stored(release.encoded, identity).repartition("segment_id").sortWithinPartitions("segment_id", "segment_block_ordinal").write.option("compression", "uncompressed").partitionBy("segment_id").parquet(staged)
        store.write(release, output, project, identity)
        say("verify")
        files.check_unchanged(stamps, files.listed(spark, source))
        fresh = release.blocks.where("is_new")
        _check(fresh, stored_contents(spark, staged, fresh, identity), [])
        say("commit")
        _move(staged, os.path.join(output, "data"))
        store.commit(output, release.sequence)
        clear_data(output, release.segments)
        if options.development_cache:
            _save_cache(release, stamps, output, project)
        return report


def _save_cache(release: Release, stamps: DataFrame, output: str, project: str) -> None:
    assets = release.assets
    if "mtime" not in assets.columns:
        return
    now = release.assets.drop("mtime").join(stamps.select("path", "mtime"), "path")
    store.save_cache(cache_entries(Release(release.sequence, now, release.blocks, release.segments, release.fingerprint)), output, project, release.sequence)


def _move(staged: str, data: str) -> None:
    """Each staged segment takes its place; one left there by an interrupted build is replaced."""
    os.makedirs(data, exist_ok=True)
    for name in sorted(os.listdir(staged)) if os.path.isdir(staged) else []:
        if name.startswith("segment_id="):
            to = os.path.join(data, name)
            shutil.rmtree(to, ignore_errors=True)
            os.rename(os.path.join(staged, name), to)
    shutil.rmtree(staged, ignore_errors=True)


def _check(blocks: DataFrame, contents: DataFrame, assets: list[DataFrame]) -> None:
    """Raises IntegrityError where stored blocks are damaged or missing, or do not make up the given assets."""
    bad = verify.block_mismatches(blocks, contents).limit(1).collect()
    if bad:
        raise IntegrityError(f"block {bad[0].block_no} of {bad[0].path}")
    for table in assets:
        odd = verify.rebuilt_mismatches(table, blocks, contents).limit(1).collect()
        if odd:
            raise IntegrityError(f"blocks do not make up {odd[0].path}")


def stored_data(spark: SparkSession, at: str) -> DataFrame:
    """Blocks (segment_id, segment_block_ordinal, content) as they are stored."""
    return spark.read.schema(DATA).parquet(at) if os.path.isdir(at) and any(n.startswith("segment_id=") for n in os.listdir(at)) else spark.createDataFrame([], DATA)


def stored_contents(spark: SparkSession, data: str, blocks: DataFrame, keys: Keys | None = None) -> DataFrame:
    """Blocks (path, block_no, content) read from stored data; a segment that is not installed gives none,
    and a block that was altered, or that other keys seal, a null content."""
    wanted = blocks.select("path", "block_no", "segment_id", "segment_block_ordinal", "codec", "plain_len").join(stored_data(spark, data), ["segment_id", "segment_block_ordinal"])
    if keys is None:
        opened = C.unchecked_or_null(F.col("content"))
    else:
        table = keys.schedule().table(spark, _ids(blocks))
        wanted = wanted.join(F.broadcast(table), "segment_id")
        opened = C.unseal_or_null(F.col("content"), F.col("key"), C.nonce(C.nonce_prefix(F.col("segment_id")), F.col("segment_block_ordinal")), _context())
    wanted = wanted.select("path", "block_no", "codec", "plain_len", opened.alias("encoded"))
    raw = wanted.where((F.col("codec") == RAW) | F.col("encoded").isNull()).select("path", "block_no", F.col("encoded").alias("content"))
    packed = wanted.where((F.col("codec") != RAW) & F.col("encoded").isNotNull())
    return raw.unionByName(packed.select("path", "block_no", C.unzstd_column()(F.col("encoded"), F.col("plain_len")).alias("content")))


def contents(spark: SparkSession, output: str, blocks: DataFrame, keys: Keys | None = None) -> DataFrame:
    return stored_contents(spark, os.path.join(output, "data"), blocks, keys)


def installed(spark: SparkSession, output: str) -> DataFrame:
    at = f"{output}/data"
    names = [n.partition("=")[2] for n in os.listdir(at) if n.startswith("segment_id=")] if os.path.isdir(at) else []
    return spark.createDataFrame([(n,) for n in names], "segment_id string")


def clear_data(output: str, active: DataFrame | None) -> list[str]:
    """Deletes the data of segments that no release in force refers to; other files stay."""
    at = f"{output}/data"
    names = [n for n in os.listdir(at) if n.startswith("segment_id=")] if os.path.isdir(at) else []
    used = {f"segment_id={i}" for i in _ids(active)} if names and active is not None else set()
    gone = sorted(n for n in names if n not in used)
    for n in gone:
        shutil.rmtree(os.path.join(at, n))
    return gone


def plan_directory(spark: SparkSession, source: str, output: str, project: str = "project", options: Options | None = None, keys: Keys | None = None) -> DataFrame:
    """What a build would change; see quern.plans.diff. Files of the length and chunks of the release
    are equal: sources are cut as a build would and compared by their chunks' digests."""
    ensure_checkpoint_dir(spark)
    options = options or Options()
    options.check()
    check_places(source, output)
    sources = files.listed(spark, source)
    files.check_sources(source, sources)
    ours = _digests(bodies.cut(classified(sources, options), options.limits), sources)
    if store.current(output) is None:
        return D.diff(ours, spark.createDataFrame([], "path string, len bigint, digest string"), options.limits, options.deferred)
    release = store.open_release(spark, output, keys.project if keys else project, keys=keys)
    recut = classified(sources, options).join(release.assets.select("path", F.col("layout").alias("l"), F.col("fixed_block_len").alias("b")), "path")
    # a file whose layout is another now is cut as the release was, so that digests can be compared
    moved = recut.where("l <> layout OR b <> fixed_block_len").drop("layout", "fixed_block_len").withColumnsRenamed({"l": "layout", "b": "fixed_block_len"})
    again = _digests(bodies.cut(moved, options.limits), moved).select("path", F.col("digest").alias("again"))
    ours = ours.join(again, "path", "left").select("path", "len", F.coalesce("again", "digest").alias("digest"))
    old = _digests(release.blocks, release.assets).join(release.assets.select("path", "access"), "path")
    return D.diff(ours, old, options.limits, options.deferred, released_access=True)


def _digests(blocks: DataFrame, assets: DataFrame) -> DataFrame:
    """(path, len, digest) of assets by the digests of their blocks in order."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("block_no", "chunk_id"))), lambda x: x["chunk_id"])
    made = blocks.groupBy("path").agg(F.sha2(F.concat_ws(",", listed), 256).alias("digest"))
    return assets.select("path", "len").join(made, "path", "left").select("path", "len", F.coalesce("digest", F.lit("")).alias("digest"))


def plan_directory_after_pack(spark: SparkSession, source: str, output: str, project: str = "project", options: Options | None = None, keys: Keys | None = None) -> DataFrame:
    """The plan just after a build, by paths and lengths alone; raises StalePlan where they differ."""
    options = options or Options()
    release = store.open_release(spark, output, keys.project if keys else project, keys=keys)
    sources = files.listed(spark, source).select("path", "len", F.lit("").alias("digest"))
    D.check_fresh(sources, release.assets)
    return D.diff(sources, release.assets.select("path", "len", "access", F.lit("").alias("digest")), options.limits, options.deferred, released_access=True)


def verify_release(spark: SparkSession, output: str, project: str | None = None, at_least: int | None = None, keys: Keys | None = None) -> int:
    """Checks the signature, the tables, that every segment is installed, that no block is stored twice,
    every stored block, and that blocks make up each asset; returns the blocks."""
    return _verified(spark, output, project, at_least, keys).blocks.count()


def _verified(spark: SparkSession, output: str, project: str | None, at_least: int | None, keys: Keys | None) -> store.OpenRelease:
    ensure_checkpoint_dir(spark)
    release = store.open_release(spark, output, project, at_least, keys)
    if release.sealed and keys is None:
        raise InvalidInput("the release is sealed: keys are needed")
    release.check()
    missing = verify.not_installed(release.segments, installed(spark, output), None).limit(1).collect()
    if missing:
        raise SegmentUnavailable(missing[0].segment_id)
    data = stored_data(spark, f"{output}/data").join(release.segments.select("segment_id"), "segment_id", "left_semi")
    held = data.groupBy("segment_id").agg(F.count("*").alias("block_count"), F.sum(F.octet_length("content").cast("bigint")).alias("payload_len"))
    twice = verify.repeated_blocks(data).limit(1).collect()
    if twice:
        raise IntegrityError(f"block {twice[0].segment_block_ordinal} of segment {twice[0].segment_id} is stored more than once")
    odd = verify.header_mismatches(held, release.segments, ("block_count", "payload_len")).limit(1).collect()
    if odd:
        raise IntegrityError(f"{odd[0].field} of segment {odd[0].segment_id} is not what is stored")
    _check(release.blocks, contents(spark, output, release.blocks, keys), [release.assets])
    return release


def extract_release(spark: SparkSession, output: str, target: str, project: str | None = None, keys: Keys | None = None) -> DataFrame:
    """Writes all assets below target, a folder that all executors share; see files.extract. Raises
    IntegrityError, and writes nothing, if stored blocks are damaged, missing or stored twice."""
    release = _verified(spark, output, project, None, keys)
    return files.extract(release.assets, contents(spark, output, release.blocks, keys), target)
